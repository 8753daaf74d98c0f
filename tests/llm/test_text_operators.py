"""The text operators against brute-force versions on small fixtures, with nulls, empty texts, ties and repeats."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from meshlag.llm import chars, decontamination, graph, imatch, licenses, packing, quality, sharding, simhash, token_counts, toxicity, urls
from meshlag.llm.util import fold, labelled_sample, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "."]) for _ in range(n))


def documents(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " ", "  two  spaces ", "line\n\nbreaks \n end", "The\tTab", "it's 4.5!! <|endoftext|> x", "naïve Élan ΑΣ İ ß", "🙂 漢字", "\x00nul", "▁mark", "x" * 5000, prose(1, 4000), "same", "same", "<s> </s>"]


# 1
def test_token_counts(spark):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    out = {r["doc_id"]: r for r in token_counts.count_tokens(documents(spark, ODD), model).collect()}
    for i, t in enumerate(ODD):
        assert (out[i]["n_bytes"], out[i]["n_tokens"]) == (len((t or "").encode()), len(sp.encode(t or ""))), t
        assert out[i]["over_limit"] == (out[i]["n_tokens"] > 4096) and out[i]["label"] == "x"
    assert token_counts.count_tokens(documents(spark, []), model).count() == 0


def test_cache_overflow():
    lengths = token_counts.PieceLengths(public_tokenizers.path("piece_bpe_32k.model"), {"a": 1}, most=3)
    want = [len(lengths.model.encode(w)) for w in WORDS]
    assert [lengths[w] for w in WORDS] == want and len(lengths) <= 4


# 2
def brute_fingerprint(text, lexicon):
    terms = {xx for w in re.split(r"[^\w]+|_", text.lower()) if w and (xx := w) in lexicon}
    return frozenset(terms)


def test_imatch(spark):
    texts = [prose(k, 30) for k in range(12)] + [prose(3, 30), None, "", "solo", prose(5, 2000)]
    ids = [7 * k + 3 for k in range(len(texts))]
    out = {r["doc_id"]: r for r in imatch.fingerprint_edits(documents(spark, texts, ids), rarest=0.05, commonest=0.9, buckets=4).collect()}
    assert len(out) == len(texts)
    full = [t or "" for t in texts]
    for k, i in enumerate(ids):
        nxt, n = full[(k + 1) % len(full)], len(full[k])
        edited = full[k][: n - n // 4] + nxt[: n // 4]
        assert out[i]["n_chars"] == n
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[i]["near_edited"] <= 1 and 0 <= out[i]["near_next"] <= 1
    assert out[ids[3]]["fingerprint"] == out[ids[12]]["fingerprint"]  # equal texts
    assert out[ids[13]]["fingerprint"] == out[ids[14]]["fingerprint"]  # null and empty
    assert out[ids[13]]["near_next"] == 1
    n_terms = Counter(w for t in full for w in set(re.split(r"\W+", t.lower())) if w)
    band = {w for w, c in n_terms.items() if max(2, 0.05 * len(full)) <= c <= 0.9 * len(full)}
    sets = [brute_fingerprint(t, band) for t in full]
    for a in range(12):
        for b in range(12):
            assert (sets[a] == sets[b]) <= (out[ids[a]]["fingerprint"].split(".")[0] == out[ids[b]]["fingerprint"].split(".")[0])


def spark_hash(value, seed=42):
    """Spark's xxhash64 of a long, an int or a list of longs."""
    if isinstance(value, list):
        for x in value:
            seed = spark_hash(x, seed)
        return seed
    return xxhash.xxh64_intdigest(int(value).to_bytes(8, "little", signed=True), seed & (1 << 64) - 1)


def brute_imatch(text, lexicon):
    """All components: sorted signed term hashes, filtered by each subset at each level, then hashed."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = {w for w in re.split(r"[^\w]+|_", text.lower()) if w in lexicon}
    terms = sorted(signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in found)
    hexed = lambda x: f"{x & (1 << 64) - 1:016x}"
    rest = signed(xxhash.xxh64_intdigest(text.lower().encode(), 42))
    out = [hexed(spark_hash(terms)) if terms else hexed(spark_hash(rest))]
    for bits in imatch.LEVEL_BITS:
        for s in range(imatch.SUBSETS):
            def kept(t, s=s, bits=bits):
                word = t
                if s // 4:  # a second argument of Spark's hash is an int
                    word = xxhash.xxh64_intdigest((s // 4).to_bytes(4, "little"), spark_hash(t))
                return (word >> 16 * (s % 4)) % (1 << bits) == 0

            chosen = [t for t in terms if kept(t)]
            out.append(hexed(spark_hash(chosen))[:8] if chosen else "-")
    return out


def brute_likeness(a, b):
    used = sum((x, y) != ("-", "-") for x, y in zip(a, b, strict=True))
    return 1.0 if a == b else sum(x == y != "-" for x, y in zip(a, b, strict=True)) / used


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_imatch_brute(spark, ranges):
    """Every component and both likenesses, over texts from one word to 20,000, for any number of ranges."""
    r = random.Random(3)
    vocabulary = [a + b + c + d for a in WORDS for b in WORDS for c in WORDS for d in WORDS]
    free = lambda n: " ".join(r.choices(vocabulary, k=n))
    texts = [free(20_000), free(20_000), free(20_000), *[free(n) for n in (1, 2, 3, 10, 50, 300, 300, 1000)], None, "", "Not, in_the lexicon", free(40)]
    ids = r.sample(range(-50, 200), len(texts))
    full = [t or "" for t in texts]
    counts = Counter(w for t in full for w in {w for w in re.split(r"[^\w]+|_", t.lower()) if w})
    lexicon = {w for w, c in counts.items() if 2 <= c <= 6}
    out = {x["doc_id"]: x for x in imatch.fingerprint_edits(documents(spark, texts, ids).repartition(3), rarest=0.01, commonest=6 / len(texts), buckets=ranges).collect()}
    order = sorted(range(len(ids)), key=lambda k: ids[k])
    for n, k in enumerate(order):
        t, nxt = full[k], full[order[(n + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        mine, changed, following = (brute_imatch(x, lexicon) for x in (t, edited, nxt))
        got = out[ids[k]]
        assert got["fingerprint"] == ".".join(mine) and got["edited_fingerprint"] == ".".join(changed)
        assert got["near_edited"] == pytest.approx(brute_likeness(mine, changed)) and got["near_next"] == pytest.approx(brute_likeness(mine, following))
    assert all(out[ids[k]]["near_edited"] > 0 for k in range(3))  # the longest texts with a quarter edited


def test_imatch_repeated_and_missing_ids(spark):
    out = imatch.fingerprint_edits(documents(spark, ["a b c d", "a b c d", "e f g h", "i j"], [5, 5, None, 1])).collect()
    assert sorted(r["n_chars"] for r in out) == [3, 7, 7, 7]
    assert imatch.fingerprint_edits(documents(spark, [])).count() == 0
    assert imatch.fingerprint_edits(documents(spark, ["one doc here"])).first()["near_next"] == 1


def test_imatch_hot_ids(spark):
    """A third of the rows share an id, a third have none, and they are dealt over many ranges; other columns may have working names."""
    texts = [f"word{k % 5} and text {k // 9}" for k in range(90)]
    ids = [7 if k % 3 == 0 else None if k % 3 == 1 else 100 + k for k in range(90)]
    docs = documents(spark, texts, ids).withColumns({"_b": F.lit(1), "_key": F.lit(2), "fingerprint": F.lit("mine")})
    got = imatch.fingerprint_edits(docs, rarest=0.01, commonest=0.9, buckets=16).collect()
    hashed = lambda t: (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(range(90), key=lambda k: (ids[k] is None, ids[k] or 0, hashed(texts[k])))
    want = Counter()
    for n, k in enumerate(order):
        t, nxt = texts[k], texts[order[(n + 1) % 90]]
        want[(ids[k], hashlib.sha256((t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want
    dealt = imatch.with_next(docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")), 16).where("not _copy").groupBy("_b").count().collect()
    assert len(dealt) > 8 and max(r["count"] for r in dealt) < 20


# 3
def brute_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, ids):
    parent = list(range(len(prints)))

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(i, least.get(root(k), i))
    return [least[root(k)] for k in range(len(prints))]


def test_covering_masks():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for a in range(64):
        for b in range(64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_simhash(spark):
    base = prose(9, 400)
    texts = [*ODD, base, base + " end", base.upper(), base[:-20], prose(10, 400), *["chain " * k for k in range(1, 12)], "A b C", "a b c"]
    ids = [1000 - 3 * k for k in range(len(texts))]
    out = {r["doc_id"]: r for r in simhash.group_near_duplicates(documents(spark, texts, ids)).collect()}
    prints = [brute_simhash(t) for t in texts]
    for k, i in enumerate(ids):
        assert out[i]["fingerprint"] == f"{prints[k]:016x}"
    assert [out[i]["component_id"] for i in ids] == brute_components(prints, ids)
    assert simhash.group_near_duplicates(documents(spark, [])).count() == 0


def test_links_are_complete(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for k in range(200):  # chains of near fingerprints
        p = rng.choice(prints)
        for _ in range(rng.randint(1, 3)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    prints = list(dict.fromkeys(prints))
    signed = sorted((p - (1 << 64) if p >> 63 else p, p) for p in prints)
    links = simhash.near_links(spark.createDataFrame([(x,) for x, _ in signed], "fp long"))
    label = {r["node"]: r["label"] for r in graph.connected_components(links).collect()}
    assert [label.get(x, x) for x, _ in signed] == brute_components([p for _, p in signed], [x for x, _ in signed])


def test_simhash_without_ids(spark):
    """Rows without an id link and bridge like any other; a group of them alone has no name."""
    base = prose(9, 400)
    prints = {}
    for k in range(400):  # texts a bit or two apart
        t = base + f" end{k}"
        prints.setdefault(brute_simhash(t), t)
    texts = [*prints.values(), prose(33, 50)]
    ids = [k if k % 3 == 0 else None for k in range(len(texts) - 1)] + [None]
    docs = documents(spark, texts, [k if i is None else i for k, i in enumerate(ids)]).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))).withColumn("fp", F.lit(1))
    docs = docs.where(F.col("text") != texts[-1]).unionByName(docs.where(F.col("text") == texts[-1]).withColumn("doc_id", F.lit(None).cast("long")))
    got = {r["fingerprint"]: r["component_id"] for r in simhash.group_near_duplicates(docs).collect()}
    mine = [brute_simhash(t) for t in texts]
    roots = brute_components(mine, range(len(texts)))
    for k, p in enumerate(mine):
        named = [ids[j] for j in range(len(texts)) if roots[j] == roots[k] and ids[j] is not None]
        assert got[f"{p:016x}"] == min(named, default=None)
    assert got[f"{mine[-1]:016x}"] is None


def test_keep_first(spark):
    docs = documents(spark, ["same words in here", "same words in here", "other text", "same words in here", None, "lone", "lone"], [4, 2, 9, 2, 11, None, None])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 2), (False, 9), (False, 11), (True, None)]
    # rows that share an id, rows without one, repeated rows, and working names as columns
    shared = documents(spark, [prose(1, 60), prose(2, 60), prose(2, 60), prose(1, 60), prose(3, 60), prose(4, 60), prose(3, 60) + " end"], [5, 5, 5, None, None, None, 8]).withColumns({"_n": F.lit(1), "k": F.lit(2), "row": F.lit(3), "node": F.lit(4)})
    kept = simhash.keep_first(shared)
    assert kept.columns == shared.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(5, prose(1, 60)), (5, prose(2, 60)), (8, prose(3, 60) + " end"), (None, prose(4, 60))} and kept.count() == 4
    assert simhash.keep_first(documents(spark, [])).count() == 0


def shingle_set(text):
    w = "".join(c.lower()[0] if c.isalnum() else " " for c in text).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {text}


def test_print_pairs(spark):
    """Texts of one SimHash component meet its first; others don't. The pipeline's stage takes its candidates from them."""
    texts = [prose(1, 300), prose(1, 300) + " end", prose(2, 300), prose(2, 299) + " other", prose(3, 300), "", " "]
    nodes = spark.createDataFrame([(k, simhash.simhash64(t)) for k, t in enumerate(texts)], "node long, fp long")
    mine = [brute_simhash(t) for t in texts]
    roots = brute_components(mine, range(len(texts)))
    want = {(k, roots.index(r)) for k, r in enumerate(roots) if roots.index(r) != k}
    assert (6, 5) in want and len(want) > 1 and {(r["a"], r["b"]) for r in simhash.print_pairs(nodes).collect()} == want
    # without any MinHash band in common, near copies are found by their fingerprints alone, and proved on their shingles
    bands = simhash.band_keys
    try:
        simhash.band_keys = lambda texts, *a: np.array([[zlib.crc32(t.encode())] * simhash.BANDS for t in texts], np.int64).reshape(len(texts), simhash.BANDS)
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(documents(spark, texts)).collect()}
    finally:
        simhash.band_keys = bands
    alike = lambda a, b: len(shingle_set(texts[a]) & shingle_set(texts[b])) >= 0.8 * len(shingle_set(texts[a]) | shingle_set(texts[b]))
    assert got == {k: next((b for a, b in want if a == k and alike(a, b)), k) for k in range(len(texts))} and got[6] == 6 and len(set(got.values())) < len(texts)


def test_similar_groups(spark):
    def edited(t, k, seed):
        w, r = t.split(), random.Random(seed)
        for _ in range(k):
            w[r.randrange(len(w))] = "changed" + str(r.randrange(99))
        return " ".join(w)

    vocabulary = [a + b + c for a in WORDS for b in WORDS for c in ("", "s")]
    free = lambda seed, n: " ".join(random.Random(seed).choices(vocabulary, k=n))
    base = [free(k, 300) for k in range(6)]
    texts = [*base, *[edited(b, 1, k) for k, b in enumerate(base)], *[edited(b, 2, 50 + k) for k, b in enumerate(base)], base[0].upper(), base[0].replace(" ", ", "), base[1], edited(base[2], 120, 9), "", None, "...", "!", "a b", "a b"]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(documents(spark, texts)).collect()}
    sets = [shingle_set(t or "") for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            alike = len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            if got[a] == got[b] and a < 20 and b < 20:
                assert alike or a % 6 == b % 6 or 18 in (a, b) or 19 in (a, b)
    assert all(got[k] == got[k + 6] == got[k + 12] == k for k in range(6))
    assert got[18] == got[19] == 0 and got[20] == 1 and got[21] == 21
    assert got[22] == got[23] == 22 and got[26] == got[27] == 26 and got[24] != got[25]
    assert simhash.similar_groups(documents(spark, [])).count() == 0


def edits_of(words, r):
    """The text of `words` after each kind of edit, at several strengths."""
    n = len(words)
    other = lambda k: [f"new{r.randrange(10**6)}" for _ in range(k)]
    for share in (0.02, 0.05, 0.1, 0.15, 0.19, 0.25):
        k = max(1, int(n * share))
        scattered = list(words)
        for i in r.sample(range(n), max(1, k // 5)):
            scattered[i] = other(1)[0]
        yield "cut", words[: n - k]
        yield "appended", words + other(k)
        yield "scattered", scattered
        yield "short", [*other(1), *words[1 : max(12, k)]]
        yield "short", words[: max(12, k)]


def test_similar_groups_brute(spark):
    """Hubs unlike both ends of a link, and copies cut, extended, scattered and short: components as by all pairs."""
    r = random.Random(11)
    vocabulary = [a + b + c for a in WORDS for b in WORDS for c in ("", "s")]
    texts = []
    for _ in range(8):  # a and b hold the same words in other orders; c is b with two sentences swapped
        sentences = [" ".join(r.choices(vocabulary, k=20)) for _ in range(40)]
        b = r.sample(sentences, 40)
        c = [*b[:7], b[8], b[7], *b[9:]]
        texts += [" ".join(x) for x in (sentences, b, c)]
    for n in (40, 200, 600):
        for _ in range(4):
            words = r.choices(vocabulary, k=n)
            texts += [" ".join(words), *[" ".join(w) for _, w in edits_of(words, r)]]
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(documents(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == label
    assert all(label[k + 2] == k + 1 != label[k] for k in range(0, 24, 3))


def test_band_recall():
    """Every kind of edit is proposed alike: only the similarity counts."""
    r, seen = random.Random(12), {}
    vocabulary = [a + b + c for a in WORDS for b in WORDS for c in ("", "s")]
    for _ in range(60):
        words = r.choices(vocabulary, k=r.randrange(40, 400))
        for kind, w in edits_of(words, r):
            before, after = " ".join(words if kind != "short" else words[: len(w)]), " ".join(w)
            a, b = shingle_set(before), shingle_set(after)
            if len(a & b) >= 0.8 * len(a | b):
                one, two = simhash.band_keys([before, after])
                seen.setdefault(kind, []).append((one == two).any())
    assert all(len(x) > 60 and np.mean(x) > 0.99 for x in seen.values()) and len(seen) == 4
    one, two = simhash.band_keys(["a b c", "A, b; c."])
    assert (one == two).all() and simhash.band_keys([]).shape == (0, simhash.BANDS)


# 4
def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [*ODD, *[prose(k, 300) for k in range(30)]]
    rows = packing.pack_documents(documents(spark, texts).repartition(3), path).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i]) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[i][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[i])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack_documents(documents(spark, []), path).count() == 0


def brute_cost(positions, penalties, width):
    best = {0: 0}
    for p, pen in zip(positions, penalties, strict=True):
        options = []
        for q, c in best.items():
            n = p - q
            if 0 < n <= width:
                options.append(c + (0 if n & (n - 1) == 0 else width - n))
        best[p] = min(options) + pen
    return best[positions[-1]]


@pytest.mark.parametrize("seed", range(8))
def test_cuts_are_optimal(seed):
    r = random.Random(seed)
    positions, penalties, p = [], [], 0
    for _ in range(60):
        p += r.randint(1, 90)
        positions.append(p)
        penalties.append(r.choice([0, 16, 64]))
    ends = packing.choose_cuts(positions, penalties, 256)
    assert ends[-1] == positions[-1]
    cost, a, pen = 0, 0, dict(zip(positions, penalties, strict=True))
    for e in ends:
        n = e - a
        assert n <= 256
        cost += (0 if n & (n - 1) == 0 else 256 - n) + pen[e]
        a = e
    assert cost == brute_cost(positions, penalties, 256)


def test_windows_stay_open_between_groups():
    """Pieces of many small groups cover every id once; the ids of a group's last window go on in the next group."""
    import pyarrow as pa

    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), most=2000)
    texts = ["", "one", prose(1, 3000), *[prose(k, k % 90) for k in range(120)], "x" * 9000, prose(2, 5000)]
    want = [[*words.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    packer, rows = packing.Packer(words, 256, 7), []
    for k in range(0, len(texts), 3):
        part = texts[k : k + 3]
        rows += packer.add(pa.array(range(k, k + len(part)), pa.int64()), pa.array(part), last=k + 3 >= len(texts)).to_pylist()
    pieces = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    at = {k: 0 for k in range(len(texts))}
    for d, start, length, crc, n in pieces:
        assert start == at[d] and n == len(want[d]) and crc == zlib.crc32(np.array(want[d][start : start + length], "<u4").tobytes())
        at[d] += length
    assert [at[k] for k in range(len(texts))] == [len(w) for w in want]
    filled = {}
    for r in rows:
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    sizes = [filled[k] for k in sorted(filled)]
    assert sorted(filled) == list(range(7, 7 + len(filled))) and max(sizes) <= 256
    padded = sum(256 - n for n in sizes if n & (n - 1))
    assert padded < 0.06 * sum(sizes)  # 41 groups; closing each early would pad 41 windows


# 5 and 10
def labelled(spark, n=400):
    rows, labels = [], []
    for k in range(n):
        bad, toxic = k % 4 == 0, k % 3 == 0
        words = prose(k, 40).split()
        if toxic:
            words.insert(k % 30, "wretchedfool")
        text = " ".join(words)
        rows.append(text.upper().replace(" ", "!! ") if bad else text)
        labels.append((k, int(not bad), int(toxic)))
    docs = documents(spark, [*rows, None, ""], list(range(n + 2)))
    return docs, spark.createDataFrame([*labels, (n, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score, label", [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_classifiers(spark, score, label):
    docs, labels = labelled(spark)
    out = score(docs, labels)
    assert set(docs.columns) < set(out.columns)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == 402 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[400]["score"] == rows[401]["score"]
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    held = [r for r in rows.values() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows.values())
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95
    # the held-out labels change nothing
    flipped = labels.withColumn(label, F.when(fold("doc_id") == 0, 1 - F.col(label)).otherwise(F.col(label)))
    assert {r["doc_id"]: r["score"] for r in score(docs, flipped).collect()} == {i: r["score"] for i, r in rows.items()}


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifiers_without_labels(spark, score):
    docs = documents(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score(docs, none).count() == 2
    assert score(documents(spark, []), none).count() == 0
    one = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert score(docs, one).count() == 2


def n_grams(text):
    mapped = "".join((c.lower()[0] if c.isalpha() else " ") for c in text)
    return {mapped[i : i + n] for n in toxicity.ORDERS for i in range(len(mapped) - n + 1)}


def hash_of(gram):
    return int(chars.Batch([gram], chars.letters()).grams(len(gram))[0])


def test_toxicity_brute(spark, monkeypatch):
    """Log-count ratios, the optimum of the logistic loss, and every score, from n-gram strings counted by hand."""
    docs, labels = labelled(spark, 90)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    y = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and r["doc_id"] in texts}
    learned = [i for i in y if zlib.crc32(str(i).encode()) % 5]
    held = {i: n_grams(texts[i]) for i in learned}
    ones, zeros = sum(y[i] for i in learned), sum(1 - y[i] for i in learned)
    counts = {k: Counter(g for i in learned if y[i] == k for g in held[i]) for k in (0, 1)}
    candidates = [g for g in counts[0] | counts[1] if counts[0][g] + counts[1][g] >= toxicity.LEAST_DOCS]
    shares = lambda g: abs(counts[1][g] / ones - counts[0][g] / zeros) / np.sqrt((counts[0][g] + counts[1][g] + 1) / (ones + zeros))
    signed = lambda g: hash_of(g) - (hash_of(g) >> 63 << 64)
    monkeypatch.setattr(toxicity, "FEATURES", most := min(1500, len(candidates) // 2))
    candidates = sorted(candidates, key=lambda g: (-shares(g), signed(g)))[:most]
    assert min(counts[1][g] for g in candidates) < toxicity.LEAST_DOCS  # some are typical of the other class
    ratio = {g: np.log(((counts[1][g] + 1) / (ones + 2)) / ((counts[0][g] + 1) / (zeros + 2))) for g in candidates}
    model = toxicity.train(docs, labels)
    assert len(candidates) == most and {int(g) for g in model.grams} == {hash_of(g) for g in candidates}
    name = {hash_of(g): g for g in candidates}
    weight = {name[int(h)]: w for h, w in zip(model.grams, model.weights, strict=True)}
    grams = sorted(candidates)
    x = np.array([[ratio[g] * (g in held[i]) for g in grams] for i in learned])
    w = np.array([weight[g] / ratio[g] for g in grams])
    truth = np.array([y[i] for i in learned])
    loss = lambda v, b: -np.mean(np.log(1 / (1 + np.exp(-np.where(truth == 1, 1, -1) * (x @ v + b))))) + 0.5e-4 * (v**2).sum()
    start = float(np.log((ones + 1) / (zeros + 1)))
    v, b = np.zeros(len(grams)), start
    for _ in range(400):  # plain gradient steps from the same start
        error = (1 / (1 + np.exp(-(x @ v + b))) - truth) / len(truth)
        v, b = v - 0.05 * (x.T @ error + 1e-4 * v), b - 0.05 * error.sum()
    assert loss(w, model.bias) < 0.1 * loss(np.zeros(len(grams)), start) and loss(w, model.bias) <= loss(v, b) + 0.01
    for r in toxicity.score_toxicity(docs, labels).collect():
        z = sum(weight.get(g, 0) for g in n_grams(texts[r["doc_id"]])) + model.bias
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_log_count_ratios():
    ratio = toxicity.log_ratios(np.array([0, 4, 2, 1]), np.array([5, 1, 2, 0]), 4, 5)
    want = [np.log((6 / 7) / (1 / 6)), np.log((2 / 7) / (5 / 6)), np.log((3 / 7) / (3 / 6)), np.log((1 / 7) / (2 / 6))]
    assert ratio == pytest.approx(want)


def test_bradley_terry_optimum():
    """The weights are where the gradient of the pairs' logistic loss vanishes; the cut leaves the labelled share of rejects below."""
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 4))
    y = (x @ [1.0, -2.0, 0.0, 0.5] + r.normal(size=300) > 0.4).astype(int)
    model = quality.fit(x, y)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -5, 5)
    draw = np.random.default_rng(5)
    better, worse = (draw.choice(np.flatnonzero(y == k), quality.PAIRS) for k in (1, 0))
    assert y[better].all() and not y[worse].any()
    d = z[better] - z[worse]
    gradient = d.T @ (1 / (1 + np.exp(d @ model.weights))) / len(d) - 1e-3 * model.weights
    assert np.abs(gradient).max() < 1e-8
    w = np.zeros(4)
    for _ in range(3000):  # brute force: plain ascent
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 1e-3 * w)
    assert w == pytest.approx(model.weights, abs=1e-3)
    assert np.mean(z @ model.weights < model.cut) == pytest.approx(np.mean(y == 0), abs=0.01)


def test_quality_brute(spark):
    """Scores follow from the measures of each text, the fitted weights and the cut."""
    docs, labels = labelled(spark, 120)
    rows = quality.score_quality(docs, labels).collect()
    model = quality.train(docs, labels)
    for r in rows:
        z = np.clip((chars.profile([r["text"] or ""])[0] - model.mean) / model.scale, -5, 5) @ model.weights
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(z - model.cut + np.log(0.3 / 0.7)))), abs=1e-6)
        assert r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_sample_is_bounded(spark):
    """A labelled id that many rows share counts once, so the driver never gets more than `rows`."""
    docs, labels = labelled(spark, 60)
    many = docs.unionByName(docs.where("doc_id < 12").crossJoin(spark.range(100)).select(docs.columns))
    for rows in (5, 1000):
        sample = labelled_sample(many, labels, "toxic", rows)
        assert sample.count() == min(rows, sum(zlib.crc32(str(k).encode()) % 5 > 0 for k in range(60)))


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifier_edges(spark, score):
    """Long texts whole, repeated rows alike, rows without an id, an empty table, and a column named like an output."""
    docs, labels = labelled(spark, 200)
    long = prose(7, 150_000)
    more = documents(spark, [long, long, long + " wretchedfool" * 40_000, "same", "same"], [900, 901, 902, 903, 903]).unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    own = docs.unionByName(more).withColumns({"score": F.lit(-7.0), "y": F.lit("mine"), "predicted": F.lit("mine")})
    out = score(own, labels)
    assert sorted(out.columns) == sorted([*own.columns, "held_out"])
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert got[900, long]["score"] == got[901, long]["score"] and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["y"] == "mine" for r in got.values())
    assert any(k[0] is None for k in got) and score(docs.limit(0), labels).count() == 0


def test_token_counts_edges(spark):
    """Repeated and missing ids stay apart; a column named like an output is replaced; long texts are counted whole."""
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    long = prose(3, 80_000)
    docs = documents(spark, [long, "a b", "a b", None], [1, 1, 2, 3]).withColumn("doc_id", F.when(F.col("doc_id") < 3, F.col("doc_id"))).withColumns({"n_tokens": F.lit("mine"), "k": F.lit(1)})
    out = token_counts.count_tokens(docs, model)
    want = len(sentencepiece.SentencePieceProcessor(model_file=model).encode(long))
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["over_limit"]) for r in out.collect()) == [(0, 0, False), (1, 2, False), (1, want, True), (2, 2, False)]
    assert set(out.columns) == {*docs.columns, "n_bytes", "over_limit"}


def test_gram_hashes():
    b = chars.Batch(["Hello, World", "", "hello"], chars.letters())
    g = b.grams(5)
    where = {}
    for k in range(len(g)):
        where.setdefault(int(g[k]), []).append((int(b.owner[k]), k))
    assert [(0, 0), (2, 14)] in where.values()
    p = chars.profile(["", "a a a b", "X!! Y!!"])
    assert p.shape[0] == 3 and np.isfinite(p).all()
    assert (chars.profile([""])[0] == p[0]).all()


# 6
def brute_containment(texts, items):
    out = set()
    for d, t in enumerate(texts):
        for i, q in items:
            width = max(1, min(5, len(decontamination.words_of(q or ""))))
            s = decontamination.shingles_of(q or "", width)
            if s and len(s & decontamination.shingles_of(t or "", width)) >= 0.8 * len(s):
                out.add((d, i))
    return out


def test_decontamination(spark):
    r = random.Random(6)
    vocabulary = [f"{a}{b}" for a in WORDS for b in WORDS]
    free = lambda n: " ".join("".join(c for c in r.choice(vocabulary)) for _ in range(n))
    items = [(k, free(n)) for k, n in enumerate([5, 6, 9, 12, 17, 30, 33, 60, 64, 65, 130])] + [(50, None), (51, ""), (52, "only four words here"), (53, free(20) + ". ")]
    texts = [free(3000), None, "", "one two"]
    for _, q in items:
        w = (q or "").split()
        texts.append(free(r.randint(0, 800)) + " " + (q or "") + " " + free(r.randint(0, 800)))
        if len(w) > 20:
            texts.append(free(200) + " " + " ".join(w[: len(w) // 2] + ["inserted"] + w[len(w) // 2 :]) + " " + free(100))
            texts.append(free(100) + " " + " ".join(w[: len(w) // 2]) + " " + free(100))
            texts.append(" ".join(w).upper().replace(" ", ", "))
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.find_contaminated(docs, bench).collect()
    want = brute_containment(texts, items)
    assert {(x["doc_id"], x["item_id"]) for x in out} == want and len(out) == len(want)
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contaminated(docs, empty).count() == 0
    assert decontamination.drop_contaminated(docs, empty).count() == len(texts)
    assert decontamination.find_contaminated(documents(spark, []), bench).count() == 0


def test_words_of_scripts():
    assert decontamination.words_of("It's 12 TIMES 7,\n\x00x²!") == ["it", "s", "12", "times", "7", "x²"]
    assert decontamination.words_of("東京は abcカナ 9") == ["東", "京", "は", "abc", "カ", "ナ", "9"]
    assert decontamination.words_of("𐐀𐐁 𠀀𠀁x 🙂") == ["𐐨𐐩", "𠀀", "𠀁", "x"]
    for t in [*map(str, ODD), "東京は abcカナ 9", "a東", "東a", "東", "𠀀𠀁x", "12 times 7 in 東京"]:
        owner, words = decontamination._words(["pre fix", t, "東"])
        assert np.bincount(owner, minlength=3).tolist() == [2, len(decontamination.words_of(t)), 1], t


def test_decontamination_edges(spark):
    """Digits count, scripts without blanks match, short items are one shingle, texts that share an id are judged one by one."""
    questions = ["What is 12 times 7 in base ten?", "東京から大阪まで新幹線で何時間かかりますか", "only four words here", prose(71, 20), prose(72, 20), prose(73, 9)]
    items = list(zip([1, 2, 3, 4, 4, None], questions, strict=True)) + [(9, "..."), (10, None)]
    long = prose(50, 30_000)
    texts = ["They ask: what is 12 times 7 in base ten? And so on.", "What is 99 times 3 in base ten?", "次の問題。東京から大阪まで新幹線で何時間かかりますか。答え", "大阪から東京", "here words four only", "the only four words here are", long + " " + questions[3] + " " + long, questions[4], questions[5], questions[5], None, ""]
    docs = documents(spark, texts, [*range(9), 8, None, 11]).withColumns({"item_id": F.lit(5), "shared": F.lit("x")})
    got = Counter((r["doc_id"], r["item_id"]) for r in decontamination.find_contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == Counter({(0, 1): 1, (2, 2): 1, (5, 3): 1, (6, 4): 1, (7, 4): 1, (8, None): 2})
    kept = decontamination.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4, None, 11}


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 2)
    items = [(k if k else None, prose(100 + k, 12)) for k in range(5)]
    docs = documents(spark, [t for _, t in items])
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(k, k if k else None) for k in range(5)} <= got


# 7
def test_licenses(spark):
    mit = licenses.KNOWN["MIT"]
    changed = "MIT License\n".replace("MIT License\n", "") + "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper().replace(",", " ,").replace("MERCHANTABILITY", "merchantability")
    texts = [mit, changed, "# " + mit.replace("\n\n", "\n# \n# "), mit + " extra", None, "", prose(1, 50) + "\nReleased under the MIT License.\n" + prose(2, 5), "licence", "Licence", mit]
    out = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    assert [out[k]["license"] for k in range(10)] == ["MIT", "MIT", "MIT", None, None, None, None, None, None, "MIT"]
    assert out[4]["digest"] == out[5]["digest"] and out[7]["digest"] == out[8]["digest"]
    assert out[6]["line_licenses"] == ["MIT-notice"]
    own = licenses.known_digests(spark, {"mine": "Licence"})
    assert {r["doc_id"] for r in licenses.scan_licenses(documents(spark, texts), own).where("license = 'mine'").collect()} == {7, 8}
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


def test_licenses_edges(spark):
    """Titles, spellings at word bounds only, lines of an own table, whole files, long texts, rows without an id, clashing names."""
    mit, isc = licenses.KNOWN["MIT"], licenses.KNOWN["ISC"]
    texts = ["MIT License\n\nCopyright <year> <holder>\n\n" + mit, "The ISC Licence (ISC)\n\n" + isc, "paper century", "paper cent ury", "a licence licence", "a license license", "x\nMy own licence.\ny", (prose(4, 60_000) + "\n") * 2 + "My own license", "MIT License"]
    docs = documents(spark, [*texts, texts[0]], [*range(9), None]).withColumns({"row": F.lit(1), "lines": F.lit(2), "digest": F.lit(3), "license": F.lit("y")})
    out = licenses.scan_licenses(docs).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 10 and by[0]["license"] == by[None]["license"] == "MIT" and by[1]["license"] == "ISC"
    assert by[2]["digest"] != by[3]["digest"] and by[4]["digest"] == by[5]["digest"] and by[8]["license"] is None
    own = {r["doc_id"]: r["line_licenses"] for r in licenses.scan_licenses(docs, licenses.known_digests(spark, {"own": "my own licence"})).collect()}
    assert own[6] == own[7] == ["own"] and own[0] == []
    folder = "/usr/share/common-licenses"
    for name, file in {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "MPL-2.0": "MPL-2.0"}.items():
        if os.path.exists(f"{folder}/{file}"):
            with open(f"{folder}/{file}") as f:
                body = f.read()
            assert [r["license"] for r in licenses.scan_licenses(documents(spark, [body, body.upper().replace("\n", " \n "), body + " more"])).orderBy("doc_id").collect()] == [name, name, None]


# 8
def test_sharding(spark):
    texts = [prose(k, k % 50) for k in range(3000)] + [None, "", "x", "x"]
    ids = [*range(3000), None, 5, 6, 6]
    rows = sharding.assign_shards(documents(spark, texts, ids)).collect()
    assert len(rows) == len(texts)
    load, slots = Counter(), {}
    for r in rows:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(load.values()) / 16
    assert set(load) == set(range(16)) and max(load.values()) <= 1.002 * mean + 1000 and min(load.values()) >= 0.95 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter((r["size"], r["text_crc32"]) for r in rows)
    assert sizes == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    assert sharding.assign_shards(documents(spark, [])).count() == 0


def brute_walk(nodes, units, shards, slack):
    """The ring walked by definition: the heaviest first, each to the first node at or after its place whose shard has room."""
    room, used, out = (1 + slack) * sum(u[2] for u in units) / shards, [0] * shards, {}
    for position, part, load in sorted(units, key=lambda u: (-u[2], u[0], u[1])):
        ring = sorted(nodes, key=lambda n: ((n[0] - position) % sharding.POSITIONS, n))
        fits = [s for _, s in ring if used[s] + load <= room]
        shard = fits[0] if fits else min(range(shards), key=lambda s: (used[s], s))
        out[position, part] = shard
        used[shard] += load
    return out


@pytest.mark.parametrize("seed", range(4))
def test_walk_brute(seed):
    r = random.Random(seed)
    nodes = sorted((r.randrange(sharding.POSITIONS), k % 5) for k in range(60))
    units = [(p, 0, r.choice([1, 5, 40, 400])) for p in r.sample(range(sharding.POSITIONS), 300)] + [(77, k, 300) for k in range(8)]
    assert sharding.walk(nodes, units, 5, 0.01) == brute_walk(nodes, units, 5, 0.01)


def test_adding_a_shard_moves_little(spark):
    """With one more shard, about its share of the load moves, nearly all of it into the new shard; far less than a new deal would move."""
    r = random.Random(2)
    units = [(p, 0, r.randint(500, 1500)) for p in r.sample(range(sharding.POSITIONS), 20_000)]
    for slack, most in ((1.0, 1.0), (0.1, 1.6), (0.002, 3.2)):
        old, new = (sharding.walk(sharding.ring(spark, n, 64), units, n, slack) for n in (16, 17))
        moved = sum(u[2] for u in units if old[u[:2]] != new[u[:2]])
        assert moved < (most + 0.5) / 17 * sum(u[2] for u in units)
        if slack == 1.0:  # nobody overflows: only the new shard gains
            assert all(new[k] == 16 for k in old if old[k] != new[k])


def test_sharding_copies(spark):
    """A third of the rows are copies without an id; others share a text: equal texts stay together unless their load forces a split."""
    hot = "hot " * 40
    texts = [hot] * 1000 + [prose(k // 4, 30) for k in range(2000)]
    docs = documents(spark, texts, [0] * 500 + [1] * 500 + list(range(2000))).withColumn("doc_id", F.when(F.col("text") != hot, F.col("doc_id"))).withColumns({"position": F.lit(1), "part": F.lit(2), "row": F.lit(3), "shard": F.lit(4)})
    rows = sharding.assign_shards(docs, slack=0.02).collect()
    load, slots, homes = Counter(), {}, {}
    for x in rows:
        load[x["shard"]] += x["size"]
        slots.setdefault(x["shard"], []).append(x["slot"])
        homes.setdefault(x["text_crc32"], set()).add(x["shard"])
    assert len(rows) == 3000 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(load.values()) <= 1.05 * sum(load.values()) / 16 and len(load) == 16
    assert sum(len(h) == 1 for h in homes.values()) >= 0.95 * len(homes)


# 9
def brute_url(url, rules, default):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    best = None
    for rule, verdict in rules.items():
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best and best[0], best[1] if best else default


def test_urls(spark):
    links = [None, "", "no scheme", "http://A.Example.NET/en/1", "http://example.net/en", "http://example.net/en/?q", "https://x.org/fr/", "https://org/fr/x#y", "http://notnet/", "http://a.net", "http://a.net/", "HTTP://EXAMPLE.COM/de/x", "x://badexample.com/de/", "http://é.net/ü", "http://a.net/\nb", "http://u@h.net:80/x", "http://a.net/", "://net/", "http://example.net?x/en/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(links)], "page_id long, url string, html string")
    for rules, default in ((urls.RULES, "allow"), ({}, "block"), ({"net/": "block", "a.net/": "allow", "net/en/": "allow"}, "allow")):
        out = urls.filter_urls(pages, rules, default).collect()
        assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out} == {(k, *brute_url(u, rules, default)) for k, u in enumerate(links)}
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_long_urls(spark):
    """A host of very many labels costs its length once; repeated page ids and clashing names are kept apart."""
    deep = "http://" + "a." * 150_000 + "example.net/en/" + "p" * 100_000
    pages = spark.createDataFrame([(1, deep), (1, deep), (None, "http://net/"), (2, "http://" + "x" * 200_000 + "/")], "page_id long, url string").withColumns({"rule": F.lit("mine"), "host": F.lit("h"), "_j": F.lit(0)})
    got = Counter((r["page_id"], len(r["host"]), r["rule"], r["verdict"]) for r in urls.filter_urls(pages).collect())
    assert got == Counter({(1, 300_011, "example.net/en/", "allow"): 2, (None, 3, "net/", "block"): 1, (2, 200_000, None, "allow"): 1})


def test_digest_collisions(tmp_path, monkeypatch):
    class Same:
        def xxh64_intdigest(self, data):
            return 5

    n, parts = 2, [b"aa/", b"bb/"]
    body = np.array([n], "<u8").tobytes() + np.array([5, 5], "<u8").tobytes() + np.array([0, 3, 6], "<u8").tobytes() + bytes([1, 0]) + b"".join(parts)
    (tmp_path / "t").write_bytes(body)
    monkeypatch.setattr(urls, "xxhash", Same())
    assert urls.DigestTable(str(tmp_path / "t")).probe([b"bb/", b"cc/", b"aa/"]) == [(0, False), (2, True)]


def test_files_of_rules(spark, monkeypatch):
    monkeypatch.setattr(urls, "FILE_RULES", 1)
    pages = spark.createDataFrame([(1, "http://a.example.net/en/x")], "page_id long, url string")
    assert urls.filter_urls(pages).first()["rule"] == "example.net/en/"


# graph
def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400, k) for k in range(401, 460)] + [(k, k + 1) for k in range(500, 560)] + [(1, None), (2, 2)]
    got = {r["node"]: r["label"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {a: root(a) for a in parent}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_planned_size(spark):
    """The planner's guess of the size stays that of the rows however many rounds there are, and no file of a round stays."""
    bits = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    at = shared_dir(spark).removeprefix("file:")
    got = graph.connected_components(spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long"))
    assert got.where("label = 0").count() == got.count() == 201 and bits(got) < 64
    again = graph.connected_components(got.where("node <> label"), "node", "label")
    assert again.where("label = 0").count() == 201 and bits(again) < 64
    assert not [f for f in os.listdir(at) if f.startswith("components-")]


def test_decontamination_ids_of_any_type(spark, monkeypatch):
    """Ids keep their types, an id column may be called like another of the result, several blocks find what one finds."""
    items = [(f"q{k:02}", prose(300 + k, 12 + k)) for k in range(7)]
    rows = [(f"a {k}", prose(900 + k, 40) + " " + t + " " + prose(950 + k, 30)) for k, (_, t) in enumerate(items)] + [(None, items[0][1]), ("clean", prose(77, 90))]
    docs, bench = spark.createDataFrame(rows, "item_id string, text string"), spark.createDataFrame(items, "`my item` string, text string")
    want = Counter({(f"a {k}", f"q{k:02}"): 1 for k in range(7)}) + Counter({(None, "q00"): 1})
    for size in (20_000, 3):
        monkeypatch.setattr(decontamination, "BLOCK_ITEMS", size)
        out = decontamination.find_contaminated(docs, bench, "item_id", item_col="my item")
        assert out.columns == ["doc_item_id", "item_id", "shared", "item_shingles", "containment"] and dict(out.dtypes)["doc_item_id"] == "string"
        assert Counter((r["doc_item_id"], r["item_id"]) for r in out.collect()) == want
        assert [r["item_id"] for r in decontamination.drop_contaminated(docs, bench, item_col="my item").collect()] == ["clean"]


def test_template_items():
    """Items that share a long opening: all true matches, each once, against sets of words."""
    opening = prose(500, 40)
    items = [(k, opening + " " + prose(600 + k, 6)) for k in range(60)] + [(99, "only three words")]
    texts = [prose(700, 50) + " " + opening + " " + prose(701, 20), items[3][1], opening[: len(opening) // 3], "", "here only three words"]
    index = decontamination.Index(items)
    got = {(t, index.ids[k]) for t, k, *_ in index.matches(texts)}
    assert got == brute_containment(texts, items) | {(4, 99)} and len(index.matches(texts)) == len(got)


def test_packing_ids_of_any_type(spark):
    """Ids keep their type; the pieces are those of the same rows under integers."""
    texts = [prose(20 + k, 30 * (k + 1)) for k in range(6)] + [None]
    docs = documents(spark, texts).select("doc_id", "text").coalesce(1)
    file = public_tokenizers.path("word_bpe_49k.json")
    want = sorted((f"x {r['doc_id']}", *r[1:]) for r in packing.pack_documents(docs, file, 64).collect())
    out = packing.pack_documents(docs.select(F.concat(F.lit("x "), "doc_id").alias("my id"), "text"), file, 64, "my id")
    assert out.dtypes[0] == ("doc_id", "string") and sorted(tuple(r) for r in out.collect()) == want
