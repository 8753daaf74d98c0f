"""SimHash near-duplicate groups by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlag.llm.chars import Batch, words_only
from meshlag.llm.graph import connected_components
from meshlag.llm.util import cut, small_batches, whole_text

RADIUS = 2
SEED = 42


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One 64-bit mask for each nonzero vector v of {0,1}**(radius+1).

    Bit i of the fingerprint carries the nonzero vector phi(i), dealt round robin; the mask of v keeps bit i
    where <phi(i), v> is odd. The phi of `radius` differing bits span at most `radius` dimensions, so some
    v is orthogonal to all of them, and its mask hides every differing bit: any pair within the radius
    agrees under that mask. No pair is missed, whatever the data.
    """
    vectors = (1 << radius + 1) - 1
    phi = [i % vectors + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (phi[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def simhash64(text: str, width: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half the XXH64 of the shingles, repeats included."""
    found = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space parts words
    if not found:
        return 0
    body = b" ".join(found)
    if len(found) <= width:
        hashes = [xxhash.xxh64_intdigest(body, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = [0, *(ends[: len(found) - width] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(body[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = np.array(hashes[k : k + 65_536], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect every two fingerprints within the radius, from distinct (fp).

    A fingerprint goes into one bucket of each mask's table. Within a bucket of two or more, pairs are not
    formed: every member sends itself and its flips of one hidden bit, and two members meet at a common flip
    exactly when they differ in at most two bits. At most 65 fingerprints can meet at one flip, so groups
    stay bounded however many rows share a bucket, and rows grow linearly.
    """
    masks = covering_masks()
    keyed = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("k")
    placed = prints.select("fp", keyed).select("fp", "k.t", "k.key")
    shared = cut(placed.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("t", "key"))
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks])
    met = (
        cut(placed)
        .join(shared, ["t", "key"], "left_semi")
        .select("fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
        .select(F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"), "fp")
        .groupBy("hub")
        .agg(F.collect_set("fp").alias("fps"))
        .where(F.size("fps") > 1)
    )
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")


def group_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns id, fingerprint (16 hex digits) and component_id: the smallest id reachable over links.

    Fingerprints link at two or fewer differing bits. Exact copies share a fingerprint and are folded into
    one node first; only distinct fingerprints are searched. Null and empty texts, and those of white space,
    have fingerprint zero and link like any other. Rows that share an id keep a row each. A row without an id
    links like any other too; it never names a component unless all its members lack an id (then null). Texts
    of any length are hashed whole. An empty table gives an empty table; other columns are left out, whatever
    their names.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([simhash64(x) for x in texts.to_pylist()], pa.int64())

    # one pass over the texts; from here on rows are 16 bytes
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprint(whole_text(text)).alias("fp")))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    groups = connected_components(near_links(nodes))
    labelled = cut(nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "rep", F.coalesce("label", "fp").alias("label")))
    names = cut(labelled.groupBy("label").agg(F.min("rep").alias("component_id")))
    owners = cut(labelled.join(names, "label").select("fp", "component_id"))
    return prints.join(owners, "fp", "left").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


SHINGLE, SIMILAR = 5, 0.8
#: Times that texts which are like no other open text are left out before pairs are formed.
BOUND_ROUNDS = 2
#: A pair of similarity J shares no band with probability (1 - J ** BAND_ROWS) ** BANDS: 7e-6 at J = 0.8, whatever the edit.
BANDS, BAND_ROWS = 30, 5


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner): the five-word shingles of every text in order; a shorter text is one shingle.

    Words are runs of letters and digits, lower-cased. A text without words has one shingle of its own bytes.
    """
    batch = Batch(texts, words_only())
    starts, _, words = batch.spans((batch.codes != 32) & (batch.codes != 0))
    owner = batch.owner[starts]
    words = _mixed(words + np.uint64(1))
    n, count = len(words), np.bincount(owner, minlength=len(texts))
    end = np.cumsum(count)
    place = np.arange(n) - (end - count)[owner]
    hashes = np.zeros(n, np.uint64)
    for k in range(SHINGLE):  # past the end of a shorter text nothing is added
        inside = np.flatnonzero(place[: n - k] + k < count[owner[: n - k]]) if n > k else np.zeros(0, np.int64)
        hashes[inside] = _mixed(hashes[inside] * np.uint64(0x9E3779B97F4A7C15) + words[inside + k])
    whole = place <= np.maximum(count[owner] - SHINGLE, 0)
    hashes, owner = hashes[whole], owner[whole].astype(np.int64)
    if len(mute := np.flatnonzero(count == 0)):
        own = np.array([xxhash.xxh64_intdigest(texts[i].encode("utf-8", "surrogatepass"), SEED) for i in mute], np.uint64)
        at = np.searchsorted(owner, mute)
        hashes, owner = np.insert(hashes, at, own), np.insert(owner, at, mute)
    return hashes, owner


def band_keys(texts: list[str], bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """`bands` signed MinHash keys of each text, of `rows` minima over its shingles each."""
    if not texts:
        return np.zeros((0, bands), np.int64)
    hashes, owner = shingle_hashes(texts)
    first = np.searchsorted(owner, np.arange(len(texts)))
    r = np.random.default_rng(SEED)
    factors = r.integers(0, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
    addends = r.integers(0, 1 << 63, (bands, rows), np.uint64)
    out = np.zeros((len(texts), bands), np.uint64)
    for b in range(bands):
        for f, a in zip(factors[b], addends[b], strict=True):
            out[:, b] = _mixed(out[:, b] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashes * f + a, first))
    return out.view(np.int64)


def overlaps(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The `pairs` (a, b, ...) with na, nb and both: shingles of either end and of both."""
    one, two = (shingles.select(F.col("node").alias(e), F.col("shingles").alias(f"s_{e}")) for e in "ab")
    met = pairs.join(one, "a").join(two, "b")
    return met.select(*pairs.columns, F.size("s_a").alias("na"), F.size("s_b").alias("nb"), F.size(F.array_intersect("s_a", "s_b")).alias("both"))


ALIKE = f"both >= {SIMILAR}D * (na + nb - both)"


def possible(m: Column) -> Column:
    """Whether sets of sx and sy shingles, m at most in both, may be similar."""
    return (F.col("x") != F.col("y")) & (m >= SIMILAR * (F.col("sx") + F.col("sy") - m))


def star_pairs(placed: DataFrame) -> DataFrame:
    """(a, b): every node with one hub b, so as many pairs as nodes.

    A bucket's hub is its member that meets the most rows in all its buckets: where many copies derive from one
    text, that text. Of the hubs it meets, a node is paired with the one it shares most buckets with.
    """
    hubs = cut(placed.groupBy("bucket").agg(F.max_by(F.struct("node", "size"), F.struct("score", "node")).alias("hub")))
    met = placed.join(hubs.select("bucket", F.col("hub.node").alias("y"), F.col("hub.size").alias("sy")), "bucket")
    seen = met.select(F.col("node").alias("x"), F.col("size").alias("sx"), "y", "sy").where(possible(F.least("sx", "sy"))).groupBy("x", "y").agg(F.count("*").alias("n"))
    return seen.groupBy("x").agg(F.max_by("y", F.struct("n", "y")).alias("b")).select(F.col("x").alias("a"), "b")


def in_common(nodes: DataFrame, shingles: DataFrame) -> DataFrame:
    """(node, common): how many of its shingles some other of the `nodes` holds too. Only counts are joined, no pairs."""
    held = nodes.join(shingles, "node")
    once = held.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1")
    alone = once.groupBy("node").agg(F.count("*").alias("u"))
    return held.select("node", F.size("shingles").alias("n")).join(alone, "node", "left").select("node", (F.col("n") - F.coalesce("u", F.lit(0))).alias("common"))


def open_rows(rows: DataFrame) -> DataFrame:
    """Rows (bucket, node, label, ...) of the buckets that hold more than one label, with the commonest one as main."""
    main = rows.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main")).where("labels > 1")
    return cut(rows.drop("main").join(main.select("bucket", "main"), "bucket"))


def open_pairs(placed: DataFrame, labels: DataFrame, stars: DataFrame, shingles: DataFrame) -> DataFrame:
    """(a, b, la, lb): all pairs of a bucket that no label (node, label) joins yet, with their labels la < lb.

    Rows outside a bucket's commonest label meet every row of the bucket, so a group that is already joined
    makes no pairs within itself. Pairs that counts rule out are left out: what two texts share is at most what
    each has in common with any other open text; and where both were compared with one hub (`stars`), what each
    shares with it, and with others beside it. So a crowd of half-similar texts, each with edits of its own,
    isn't tested pair by pair.
    """
    rows = open_rows(placed.join(labels, "node", "left").select("bucket", "node", "size", F.coalesce("label", "node").alias("label")))
    hubs = stars.groupBy(F.col("b").alias("node")).agg(F.first("nb").alias("both")).withColumn("hub", F.col("node"))
    told = stars.select(F.col("a").alias("node"), F.col("b").alias("hub"), "both").join(hubs.select("node"), "node", "left_anti").unionByName(hubs.select("node", "hub", "both"))
    told = cut(told)
    for _ in range(BOUND_ROUNDS):  # what only texts that are out by now held too is a text's own in the next round
        nodes = cut(rows.select("node").distinct().join(told, "node", "left"))
        asked = nodes.select("node").unionByName(nodes.where("hub IS NOT NULL").select(F.col("hub").alias("node"))).distinct()
        bounds = in_common(asked, shingles).join(nodes, "node").withColumn("beside", F.greatest(F.lit(0), F.col("common") - F.col("both")))
        rows = rows.select("bucket", "node", "size", "label").join(cut(bounds), "node").where(F.col("common") >= SIMILAR * F.col("size"))
        rows = open_rows(rows)
    # a pair is formed in the first bucket that both share: no row of it has an earlier bucket in common
    rows = cut(rows.join(rows.groupBy("node").agg(F.collect_list("bucket").alias("all")), "node").withColumn("earlier", F.filter("all", lambda b: b < F.col("bucket"))).drop("all"))
    end = lambda e: [F.col(c).alias(k + e) for c, k in {"label": "l", "size": "s", "common": "c", "hub": "h", "both": "o", "beside": "r", "earlier": "e"}.items()]
    left, right = rows.where("label <> main").select("bucket", F.col("node").alias("x"), *end("x")), rows.select("bucket", "main", F.col("node").alias("y"), *end("y"))
    most = F.when(F.col("hx") == F.col("hy"), F.least("cx", "cy", F.least("ox", "oy") + F.least("rx", "ry"))).otherwise(F.least("cx", "cy"))
    met = left.join(right, (left.bucket == right.bucket) & F.expr("lx <> ly AND (ly = main OR x < y)") & possible(most) & ~F.arrays_overlap("ex", "ey"))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.least("lx", "ly").alias("la"), F.greatest("lx", "ly").alias("lb"))


def print_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): every node (node, fp) with the first node of its SimHash component, where that holds more than one."""
    prints = cut(nodes.select("fp").distinct())
    groups = connected_components(near_links(prints))
    placed = cut(nodes.join(groups, nodes.fp == groups.node, "left").select(nodes.node, F.coalesce("label", "fp").alias("group")))
    first = placed.groupBy("group").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    return cut(placed.join(first.select("group", "b"), "group").where("node <> b").select(F.col("node").alias("a"), "b"))


def similar_texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(h1, h2, rep, label): the distinct texts by two hashes, their smallest ids, and the component of each.

    Equal texts are folded into one node first. The texts of a SimHash component (fingerprints of `simhash64`, links
    of `near_links`, as in `group_near_duplicates`) are candidates with its first text; so that no pair is missed
    which differs in more bits, texts that share one of BANDS MinHash bands are candidates too.
    Meeting is no link: every candidate pair is either tested on its shingles or already in one component.
    Components are first drawn together by the pairs of SimHash and one pair a node, with a hub; then all pairs of
    a bucket that lie in different components are tested, less those whose numbers of shingles, shared and of their own, rule the
    similarity out. The shingles of a text that meets another are hashed once.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<long>")
    def keys(texts: pa.Array) -> pa.Array:
        return pa.array(list(band_keys(texts.to_pylist())), pa.list_(pa.int64()))

    @F.arrow_udf("array<long>")
    def shingles(texts: pa.Array) -> pa.Array:
        hashes, owner = shingle_hashes(texts.to_pylist())
        parts = np.split(hashes, np.searchsorted(owner, np.arange(1, len(texts))))
        return pa.array([np.unique(x).view(np.int64) for x in parts], pa.list_(pa.int64()))

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([simhash64(x) for x in texts.to_pylist()], pa.int64())

    body = whole_text(text)
    h1, h2 = F.xxhash64(body).alias("h1"), F.hash(body).alias("h2")
    found = docs.select(F.col(id_col).alias("id"), h1, h2, keys(body).alias("v"), fingerprint(body).alias("fp"))
    nodes = cut(found.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("v").alias("v"), F.first("fp").alias("fp")).withColumn("node", F.monotonically_increasing_id()))
    printed = print_pairs(nodes.select("node", "fp"))
    placed = nodes.select("node", F.posexplode("v").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "node")
    shared = placed.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1")
    placed = cut(placed.join(shared, "bucket"))
    scores = placed.groupBy("node").agg(F.sum("rows").alias("score"))
    linked = printed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    met = cut(scores.join(linked, "node", "full").join(nodes.select("node", "h1", "h2"), "node"))
    bodies = docs.select(h1, h2, body.alias("t")).join(met, ["h1", "h2"]).groupBy("node", "score").agg(F.min("t").alias("t"))
    texts = cut(bodies.select("node", "score", shingles("t").alias("shingles")))
    placed = cut(placed.select("bucket", "node").join(texts.select("node", "score", F.size("shingles").alias("size")), "node"))
    texts = texts.select("node", "shingles")
    stars = cut(overlaps(cut(star_pairs(placed)), texts))
    same = cut(overlaps(printed, texts).where(ALIKE).select("a", "b"))
    labels = connected_components(stars.where(ALIKE).select("a", "b").unionByName(same))
    more = cut(overlaps(cut(open_pairs(placed, labels, stars, texts)), texts).where(ALIKE).select("la", "lb").distinct())
    joined = nodes.select("h1", "h2", "rep", "node").join(labels, "node", "left").select("h1", "h2", "rep", F.coalesce("label", "node").alias("label"))
    if more.isEmpty():
        return cut(joined)
    above = connected_components(more, "la", "lb").select(F.col("node").alias("label"), F.col("label").alias("top"))
    return cut(joined.join(above, "label", "left").select("h1", "h2", "rep", F.coalesce("top", "label").alias("label")))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, component_id): components of the texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Rows that share an id are grouped by their own texts. Null texts count as empty. A row without an id
    links like any other; it never names a component unless all its members lack an id (then null). An empty
    table gives an empty table. See `similar_texts` for the search.
    """
    joined = similar_texts(docs, id_col, text)
    names = cut(joined.groupBy("label").agg(F.min("rep").alias("component_id")))
    owners = cut(joined.join(names, "label").select("h1", "h2", "component_id"))
    body = whole_text(text)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("h1"), F.hash(body).alias("h2"))
    return rows.join(owners, ["h1", "h2"], "left").select(F.col("id").alias(id_col), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of `similar_groups`, that with the smallest id; all columns as they were.

    Rows without an id come last, and of equal ids the text with the smaller hash comes first. Rows that share
    an id but hold unlike texts are in different groups and stay. Of rows equal in id and text one stays. Null
    texts count as empty: one of all empty texts stays. Columns may have any names.
    """
    order = F.struct(F.col("rep").isNull(), F.col("rep"), F.col("h1"), F.col("h2"))
    first = similar_texts(docs, id_col, text).groupBy("label").agg(F.min_by(F.struct("h1", "h2", "rep"), order).alias("k"))
    kept = cut(first.select(F.struct("k.h1", "k.h2").alias("k"), F.col("k.rep").alias("rep")))
    body = whole_text(text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.xxhash64(body).alias("h1"), F.hash(body).alias("h2")).alias("k"), F.col(id_col).alias("id"))
    once = rows.join(kept, "k").where(F.col("id").eqNullSafe(F.col("rep"))).groupBy("k").agg(F.first("row").alias("row"))
    return once.select("row.*")
