"""Resampling, ranked search and set joins against brute-force versions, with nulls, empty texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlag.llm import resampling, search, set_join

SCHEMA = "doc_id long, text string, item_id long, rank int, score string, node int, _row int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau".split()
ODD = [None, "", " ", "one", "One TWO", "same words here", "same words here", "naïve Élan ΑΣ İ ß", "🙂 漢字 12", "\x00nul\x0bvt", "x" * 5000, "a b c", "it's 4.5!! <|endoftext|> x"]
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS).title() + r.choice(["", "", "", ".", "\n", "-4x"]) for _ in range(n))


def documents(spark, rows):
    """(doc_id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 7, 1, "x", 2, 3) for i, t in rows], SCHEMA)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("id", F.lit(1))


# 11
def brute_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(rows, target):
    made = [(i, *brute_features(t)) for i, t in rows]
    s, t = Counter(b for *_, f in made for b in f), Counter(b for x in target for b in brute_features(x)[1])
    whole_s, whole_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (whole_s + 10_000) / ((s[k] + 1) * (whole_t + 10_000)))) for k in range(10_000)]
    out = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(enough[: 5 * len(enough) // 100], 1):
        x[4] = rank
    return Counter(tuple(x[:5]) for x in out)


def test_resampling(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, prose(k, 5 + 3 * (k % 30))) for k in range(150)] + [(None, prose(5, 40))] * 3 + [(400, prose(6, 30))] * 4 + [(500, prose(7, 30_000)), (501, ("w" * 200 + " ") * 30)]
    target = [prose(5, 60), None, "", prose(7, 20), "Élan 漢字"]
    got = resampling.resample_towards(documents(spark, rows), items(spark, list(enumerate(target)))).collect()
    assert Counter(tuple(r) for r in got) == brute_resample(rows, target)
    assert max(r["rank"] or 0 for r in got) == 5 * sum(brute_features(t)[0] >= 20 for _, t in rows) // 100


def test_resampling_empty(spark):
    rows = [(1, prose(1, 30)), (2, None)]
    assert resampling.resample_towards(documents(spark, []), items(spark, [(1, "a b")])).count() == 0
    got = resampling.resample_towards(documents(spark, rows), items(spark, [])).collect()
    assert Counter(tuple(r) for r in got) == brute_resample(rows, [])
    assert resampling.resample_towards(documents(spark, rows).withColumnRenamed("doc_id", "n_words"), items(spark, []), id_col="n_words").columns == ["n_words", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("length", [0, 1, 2, 63, 64, 65, 200, 5000])
def test_crc_of_joined_strings(length):
    r = random.Random(length)
    a, b = r.randbytes(17), r.randbytes(length)
    shifted = resampling.CrcShift()(np.array([zlib.crc32(a)], np.uint32), np.array([length]))
    assert int(shifted[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


# 12
def brute_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_rank(rows, queries):
    docs = [(i, Counter(w), len(w)) for i, t in rows if (w := brute_terms(t))]
    n_docs, words, df = len(docs), sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in queries:
        scored = []
        for i, tf, n in docs:
            m = 100 - 90 + (90 * n * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(brute_terms(text)) if tf[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:10], 1)]
    return Counter(out)


QUERIES = [(1, "alpha beta Gamma zeta"), (2, "ALPHA, beta gamma; delta"), (3, "alpha beta gamma epsilon mu nu"), (3, "kappa"), (None, "mu nu xi alpha"), (5, None), (6, ""), (7, "unknown words"), (8, "漢字 élan naïve 12"), (9, prose(3, 300)), (1, "alpha beta Gamma zeta")]


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, monkeypatch, small):
    if small:  # several blocks, no known vocabulary, one document a chunk, no pairs mined
        for name, value in {"BLOCK_ITEMS": 3, "VOCABULARY": 2, "ACCUMULATORS": 1, "MINED": 0}.items():
            monkeypatch.setattr(search, name, value)
    rows = list(enumerate(ODD)) + [(100 + k, prose(k, 2 + k)) for k in range(60)] + [(None, prose(9, 20))] * 2 + [(300, prose(4, 12)), (300, prose(5, 12))] + [(400 + k, "kappa mu") for k in range(40)] + [(900, prose(8, 20_000))]
    got = search.rank_documents(documents(spark, rows), items(spark, QUERIES)).collect()
    assert Counter(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in got) == brute_rank(rows, QUERIES)


def test_ranked_search_ids_and_empty(spark):
    docs = documents(spark, [(k, "kappa mu") for k in range(30)]).withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 3, "0")))
    other = docs.withColumn("text", F.lit("filler"))
    got = search.rank_documents(docs.unionByName(other), items(spark, [(1, "mu")])).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in got) == [(k + 1, f"d{k:03}") for k in range(10)]
    assert search.rank_documents(documents(spark, []), items(spark, QUERIES)).count() == 0
    assert search.rank_documents(documents(spark, [(1, "a")]), items(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_sharing_plan(seed):
    """Every query's root adds each of its terms once, with fewer additions than one by one."""
    r = random.Random(seed)
    common = [r.sample(range(200), 8) for _ in range(6)]
    queries = [set(r.sample(range(200), r.randint(0, 6))) | set(r.choice(common)) | set(r.choice(common)) for _ in range(60)] + [set(), {3}]
    plan = search.Sharing(queries)
    sums = {k: Counter([t]) for k, t in enumerate(plan.terms.tolist())}
    for k, children in enumerate(plan.children):
        sums[len(plan.terms) + k] = sum((sums[c] for c in children), Counter())
    for q, root in zip(queries, plan.roots, strict=True):
        assert (sums[root] if root >= 0 else Counter()) == Counter(q)
    assert sum(len(c) - 1 for c in plan.children) < 0.7 * sum(max(len(q) - 1, 0) for q in queries)
    order = [n for nodes, *_ in plan.levels() for n in nodes.tolist()]
    assert sorted(order) == list(range(len(plan.terms), len(plan.terms) + len(plan.children)))


# 13
def brute_join(rows):
    sets = []
    for i, t in rows:
        w = (t or "").translate(LOWER).encode()
        w = w.split()
        sets.append((i, frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()))
    label = list(range(len(sets)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and (both := len(x & y)) and 100 * both >= 85 * (len(x) + len(y) - both):
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        ids = least.setdefault(root(k), [])
        if i is not None:
            ids.append(i)
    return Counter((i, len(s), min(least[root(k)], default=None)) for k, (i, s) in enumerate(sets))


def edited(words, r, share):
    out = list(words)
    for _ in range(max(1, int(share * len(out)))):
        k = r.randrange(len(out))
        out[k : k + 1] = r.choice([[], [f"new{r.randrange(10**6)}"], [out[k], f"more{r.randrange(10**6)}"]])
    return " ".join(out)


def corpus(seed):
    r = random.Random(seed)
    rows, passage = [], [f"p{k}" for k in range(60)]
    for g in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([3, 5, 8, 12, 30, 90, 400, 2500]))]
        rows += [" ".join(base)] * r.randint(1, 3) + [edited(base, r, r.choice([0.005, 0.01, 0.03, 0.05])) for _ in range(10)] + [" ".join(base[: int(len(base) * cut)]) for cut in (0.84, 0.86, 0.9, 0.97)]
    rows += [" ".join([f"q{r.randrange(5000)}" for _ in range(40)] + passage + [f"q{r.randrange(5000)}" for _ in range(20)]) for _ in range(40)]
    return [(1000 + 7 * k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("seed", range(2))
def test_set_join(spark, monkeypatch, seed):
    if seed:  # the second family and few hubs
        for name, value in {"CROWD": 2, "SEEN": 5, "KNOWN_WORDS": 50}.items():
            monkeypatch.setattr(set_join, name, value)
    rows = list(enumerate(ODD)) + corpus(seed)
    rows += [(None, rows[20][1])] + [(None, "nobody owns these five words")] * 2 + [(2000, rows[30][1]), (2000, "another text of one id")]
    got = set_join.join_documents(documents(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == brute_join(rows)


def test_copies_of_one_text(spark):
    """Copies with one to seven edits each, some in the same places: those out of reach of the source still link among themselves."""
    r = random.Random(11)
    base = [f"w{k}" for k in range(170)]
    texts = [" ".join(base)]
    for k in range(180):
        words = list(base)
        for at in r.sample(range(170), r.randint(1, 7)) if k % 3 else [*(range(20, 69, 7) if k % 2 else ()), r.randrange(170)]:
            words[at] = f"x{at}" if k % 3 == 0 else f"new{r.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    want = brute_join(rows)
    assert len({c for _, _, c in want}) > 10 and any(n > 5 for n in Counter(c for _, _, c in want if c).values())
    assert Counter(tuple(x) for x in set_join.join_documents(documents(spark, rows)).collect()) == want


def test_copies_without_a_hub(spark, monkeypatch):
    """Copies that are out of reach of their source and of each other share a root, so they hardly meet by signatures."""
    r, met, whole = random.Random(5), [], set_join.open_pairs
    monkeypatch.setattr(set_join, "open_pairs", lambda members: met.append(members.selectExpr("node", "root").distinct().groupBy("root").count().agg(F.max("count"), F.sum("count")).first()) or whole(members))
    base = [f"w{k}" for k in range(170)]
    texts = [" ".join(f"new{r.randrange(10**6)}" if k in at else w for k, w in enumerate(base)) for at in (set(r.sample(range(170), 8)) for _ in range(120))]
    rows = list(enumerate([*texts, " ".join(base)]))
    assert Counter(tuple(x) for x in set_join.join_documents(documents(spark, rows)).collect()) == brute_join(rows)
    most, every = met[0]
    assert every > 100 and most > 0.95 * every


def test_set_join_empty(spark):
    assert set_join.join_documents(documents(spark, [])).count() == 0
    assert [tuple(r) for r in set_join.join_documents(documents(spark, [(4, " \t"), (4, None)])).collect()] == [(4, 0, 4)] * 2
    named = documents(spark, [(3, "a b"), (2, "A\tB")]).withColumnRenamed("doc_id", "signature")
    assert sorted(tuple(r) for r in set_join.join_documents(named, id_col="signature").collect()) == [(2, 1, 2), (3, 1, 2)]


@pytest.mark.parametrize("family", [set_join.FIRST, set_join.SECOND, set_join.Family(2, weak=3, most=5)])
def test_signatures_meet(family):
    """Any two sets at or above the similarity share a signature, whatever their sizes and the place of the differences."""
    r = np.random.default_rng(1)
    for size in [*range(2, 60), 99, 150, 380, 1000, 4000]:
        for _ in range(6):
            whole = np.unique(r.integers(0, 1 << 64, size, np.uint64))
            n = len(whole)
            gone = r.integers(0, n * 15 // 100 + 1)
            added = max(0, (100 * (n - gone) - 85 * n) // 85)
            other = np.unique(np.concatenate([r.permutation(whole)[gone:], r.integers(0, 1 << 64, r.integers(0, added + 1), np.uint64)]))
            both = len(np.intersect1d(whole, other))
            assert 100 * both >= 85 * (n + len(other) - both)
            if not np.array_equal(whole, other):
                (one, firm), (two, other_firm) = family.signatures(whole), family.signatures(other)
                shared, larger = len(np.intersect1d(one, two)), firm if n > len(other) else other_firm
                assert shared and shared >= larger - 15 * (n + len(other)) // 185
