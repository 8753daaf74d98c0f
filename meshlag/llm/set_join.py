"""Jaccard join of word n-gram sets by PartEnum signatures."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlag.functions.cut import small
from meshlag.llm.graph import connected_components
from meshlag.llm.util import cut_freed as cut
from meshlag.llm.util import remove, shared_dir, small_batches, whole_text

WIDTH = 4
#: Two sets link when LEAST * union <= 100 * intersection.
LEAST = 85
#: Sets and words that a task or worker remembers.
SEEN, KNOWN_WORDS = 1 << 18, 500_000
#: Open rows of a signature from which its nodes meet by the second family.
CROWD = 64

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Shingles:
    """Sorted distinct hashes of the word n-grams of a text."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > KNOWN_WORDS:
                known.clear()
            known.update({w: xxhash.xxh64_intdigest(w) for w in set(words) if w not in known})
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space parts words
        if not words:
            return np.zeros(0, np.uint64)
        h, width = self.hashes(words), min(WIDTH, len(words))
        n = len(h) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = _mixed(out * _GOLD + h[k : k + n])
        return np.unique(out)


def band_starts(largest: int) -> np.ndarray:
    """Smallest sizes of the size bands, growing by about 1 / 0.85 ** 2, so that sets that may link lie in one band or in neighbouring ones."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(starts[-1] * 10_000 // LEAST**2 + 1)
    return np.array(starts)


STARTS = band_starts(1 << 40)


def bands(size: int) -> list[tuple[int, int]]:
    """(band, k) of each band whose signatures a set of that size takes part in: its own, and the next if a larger set there may link.

    Sets of one band that link differ in at most k elements: |A| + |B| - 2 |A and B| <= (100 - LEAST) / (100 + LEAST) (|A| + |B|).
    Bands with k = 0 hold equal sets only and need no signatures.
    """
    own = int(np.searchsorted(STARTS, size, "right")) - 1
    wanted = [own, own + 1] if 100 * size >= LEAST * STARTS[own + 1] else [own]
    found = [(b, int(2 * (100 - LEAST) * (STARTS[b + 1] - 1) // (100 + LEAST))) for b in wanted]
    return [(b, k) for b, k in found if k]


@dataclass(frozen=True)
class Family:
    """A way to cut the domain of the hashes into first-level parts, and those into cells.

    Of sets that differ in at most k elements, some part differs in at most `missed` = ceil((k + 1) / parts) - 1.
    It has `missed` + 2 cells, so two of them agree whole. A signature covers a subset of a part's cells. A cell of
    more than `weak` elements has one of its own: a pair that agrees in such a cell shares it. A pair that does not
    agrees in two weak cells of the part, and shares the signature of these two; every two weak cells of a part
    have one. So nothing is missed, and no signature covers a single cell with next to nothing in it.
    """

    seed: int
    weak: int = 1
    most: int = 40

    def signatures(self, elements: np.ndarray) -> tuple[np.ndarray, int]:
        """(signatures, firm) of a sorted set of 64-bit hashes; firm: cells of more than `weak` elements in its own band.

        At most d cells hold a difference of sets that differ in d elements, so two sets share no fewer signatures than
        the larger one has firm cells, less d.
        """
        out, wanted, firm = [], bands(len(elements)) if len(elements) else [], 0
        if wanted and self.seed:
            elements = np.sort(_mixed(elements ^ np.uint64(self.seed)))
        if wanted:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(elements + _GOLD), dtype=np.uint64)])
        for band, k in wanted:
            parts = -(-(k + 1) // self.most)
            cells = -(-(k + 1) // parts) + 1
            n = parts * cells
            edge = (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64)
            at = np.concatenate([[0], np.searchsorted(elements, edge), [len(elements)]])
            tag = np.uint64((self.seed << 56) + (band << 40))
            cell = _mixed(sums[at[1:]] - sums[at[:-1]] + (np.arange(n, dtype=np.uint64) + tag) * _GOLD)
            light = np.diff(at) <= self.weak
            out.append(cell[~light])
            if STARTS[band] <= len(elements):
                firm = int((~light).sum())
            places, step = np.flatnonzero(light), 1
            while step < len(places) and (together := places[step:] // cells == places[:-step] // cells).any():
                out.append(_mixed(cell[places[:-step][together]] * _GOLD + cell[places[step:][together]]))
                step += 1
        return (np.concatenate(out) if out else np.zeros(0, np.uint64)).view(np.int64), firm


FIRST, SECOND = Family(0), Family(1)


def set_digest(elements: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(elements.tobytes())
    return h - (1 << 64) if h >> 63 else h


def signed_rows(docs: DataFrame) -> DataFrame:
    """(id, text_key, n, node, firm, signatures) of (id, text): node is a digest of the set; its signatures stand on the first row of a set in a task."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(), set()
        for batch in batches:
            n, nodes, firm, signatures = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text)
                node = set_digest(s) if len(s) else None
                n.append(len(s))
                nodes.append(node)
                found, solid = FIRST.signatures(s) if len(s) and node not in seen else (None, 0)
                signatures.append(found)
                firm.append(solid)
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(firm, pa.int64()), pa.array(signatures, pa.list_(pa.int64()))], ["id", "text_key", "n", "node", "firm", "signatures"])

    rows = docs.select("id", F.xxhash64("text").alias("text_key"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(signed, f"id {kind}, text_key long, n long, node long, firm long, signatures array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the `wanted` (text_key, node), one row each, from the texts of `docs` (id, text)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(), set()
        for batch in batches:
            rows = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node not in seen and set_digest(found := shingles(text)) == node:  # else another text has the same key
                    rows.append((node, found.view(np.int64)))
                    seen.add(node)
            if len(seen) >= SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.int64()))], ["node", "shingles"])

    met = docs.select(F.xxhash64("text").alias("text_key"), "text").join(small(wanted), "text_key").select("node", "text")
    return met.mapInArrow(hashed, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The `pairs` (a, b, ...) whose sets link."""
    one, two = (sets.select(F.col("node").alias(e), F.col("shingles").alias(f"s_{e}")) for e in "ab")
    both = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(one, "a").join(two, "b").where(100 * both >= LEAST * (F.size("s_a") + F.size("s_b") - both)).select(*pairs.columns)


def may_link(x: str, y: str, shared: str | None = None) -> str:
    """Whether sets of sizes n{x}, n{y} with so many firm cells may link, judged by size and by the signatures they share."""
    fits = f"100 * least(n{x}, n{y}) >= {LEAST} * greatest(n{x}, n{y})"
    if shared is None:
        return fits
    firm = f"CASE WHEN n{x} > n{y} THEN firm{x} WHEN n{x} < n{y} THEN firm{y} ELSE greatest(firm{x}, firm{y}) END"
    return f"{fits} AND {shared} >= {firm} - ({100 - LEAST} * (n{x} + n{y})) div {100 + LEAST}"


def hub_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each node with at most one other, b, so as many pairs as nodes, from (signature, node, n, firm, rows).

    The hub of a signature is the node that meets the most others in all its signatures; a node takes the hub
    with which it shares the most signatures, if they are enough for a link.
    """
    scored = cut(members.join(members.groupBy("node").agg(F.sum("rows").alias("score")), "node"))
    hubs = scored.groupBy("signature").agg(F.max_by(F.struct(*[F.col(c).alias(f"{c}_h") for c in ("node", "n", "firm")]), F.struct("score", "node")).alias("h")).select("signature", "h.*")
    met = scored.withColumnsRenamed({"n": "n_x", "firm": "firm_x"}).join(hubs, "signature").where("node <> node_h").groupBy("node", "n_x", "firm_x", "node_h", "n_h", "firm_h").agg(F.count("*").alias("shared"))
    # a signature that both hold has another hub now and then: half of what a link needs will do here
    likely = met.where(may_link("_x", "_h", "2 * shared"))
    return likely.groupBy(F.col("node").alias("a")).agg(F.max_by("node_h", F.struct("shared", "node_h")).alias("b"))


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(signature, node, n, firm, label, main): members of the signatures whose nodes bear more than one label; main is the commonest."""
    rows = cut(members.select("signature", "node", "n", "firm").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    counted = rows.groupBy("signature", "label").agg(F.count("*").alias("k")).groupBy("signature").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("k", "label")).alias("main"))
    return cut(rows.join(counted.where("labels > 1").select("signature", "main"), "signature"))


def second_signatures(sets: DataFrame) -> DataFrame:
    """(signature, node, n, firm): the nodes of (node, shingles) under the signatures of the second family that several share."""

    @F.arrow_udf("struct<firm: long, signatures: array<long>>")
    def signed(column: pa.Array) -> pa.Array:
        found = [SECOND.signatures(np.asarray(x.values).view(np.uint64)) for x in column]
        return pa.StructArray.from_arrays([pa.array([f for _, f in found], pa.int64()), pa.array([s for s, _ in found], pa.list_(pa.int64()))], ["firm", "signatures"])

    rows = cut(sets.select("node", F.size("shingles").cast("long").alias("n"), signed("shingles").alias("s")).select("node", "n", "s.firm", F.explode("s.signatures").alias("signature")))
    shared = rows.groupBy("signature").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("signature")
    return cut(rows.join(shared, "signature"))


def open_pairs(members: DataFrame) -> DataFrame:
    """(a, b, la, lb): nodes with different labels that share signatures enough for a link.

    Nodes of a signature's commonest label meet the others only. Of rows that are `crowded` at both ends, or have one
    root, no pair is made.
    """
    side = lambda e: [F.col(c).alias(c + e) for c in ("node", "n", "firm", "label", "crowded", "root")]
    left, right = members.where("label <> main").select("signature", *side("_x")), members.select("signature", "main", *side("_y"))
    met = left.join(right, "signature").where(f"label_x <> label_y AND (label_y = main OR node_x < node_y) AND NOT (crowded_x AND crowded_y) AND root_x <> root_y AND {may_link('_x', '_y')}")
    one, other = (f"CASE WHEN node_x {sign} node_y THEN struct(node_x AS node, n_x AS n, firm_x AS firm, label_x AS label) ELSE struct(node_y AS node, n_y AS n, firm_y AS firm, label_y AS label) END" for sign in "<>")
    pairs = met.select(F.expr(one).alias("p"), F.expr(other).alias("q")).groupBy("p", "q").agg(F.count("*").alias("shared"))
    ends = pairs.select("shared", *[F.col(f"{e}.{c}").alias(f"{c}_{e}") for e in "pq" for c in ("node", "n", "firm", "label")]).where(may_link("_p", "_q", "shared"))
    return ends.select(F.col("node_p").alias("a"), F.col("node_q").alias("b"), F.least("label_p", "label_q").alias("la"), F.greatest("label_p", "label_q").alias("lb"))


def roots_of(stars: DataFrame) -> DataFrame:
    """(node, root): the hub of the hub of each node's hub, as far as there is one. A hub meets more rows than its nodes do, so there is no circle."""
    up = stars.select(F.col("a").alias("b"), F.col("b").alias("above"))
    for _ in range(2):
        stars = cut(stars.join(up, "b", "left").select("a", F.coalesce("above", "b").alias("b")))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))


def common_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of every node of the open `rows`: of the roots that the nodes of its signatures have, the one of most nodes.

    Any node will do as a root, like or unlike (`rooted_pairs`); the more nodes have one, the fewer pairs are met by signatures.
    """
    first = cut(rows.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    known = cut(first.join(first.groupBy("root").agg(F.count("*").alias("k")), "root"))
    tops = rows.select("signature", "node").join(known, "node").groupBy("signature").agg(F.max(F.struct("k", "root")).alias("top"))
    return cut(rows.select("signature", "node").join(tops, "signature").groupBy("node").agg(F.max("top").alias("top")).select("node", "top.root"))


def differing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root, diff): the elements that only one of a node's set and its root's has."""
    own, of_root = sets.select("node", "shingles"), sets.select(F.col("node").alias("root"), F.col("shingles").alias("base"))
    return pairs.join(own, "node").join(of_root, "root").select("node", "root", F.concat(F.array_except("shingles", "base"), F.array_except("base", "shingles")).alias("diff"))


def rooted_pairs(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, la, lb): nodes of one root with different labels that may link, from open `members` and (node, root).

    What two sets do not share is what their differences from the root do not share: |A - B| + |B - A| =
    |DA| + |DB| - 2 |DA and DB|. Links bound it by d, so two nodes must share t = (|DA| + |DB| - d) / 2 elements of their
    differences, and of these one is among the |D| - t + 1 that are rarest in the root's group, on both sides. So
    copies with edits of their own meet hardly any other, however many derive from one text. Partners are taken by
    size class of |D|; where t is not above zero, all of the classes meet under one key.
    """
    nodes = members.select("node", "n", "label").distinct().join(roots, "node")
    told = cut(nodes.join(differing(nodes.select("node", "root"), sets), ["node", "root"]))
    groups = told.groupBy("root").agg(F.max("n").alias("most"))
    main = told.groupBy("root", "label").agg(F.count("*").alias("k")).groupBy("root").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("k", "label")).alias("main")).where("labels > 1")
    told = cut(told.join(groups, "root").join(main.select("root", "main"), "root"))
    elements = told.select("root", "node", F.explode("diff").alias("e"))
    held = cut(elements.groupBy("root", "e").agg(F.count("*").alias("df")).where("df > 1"))  # what one node has alone comes first in its order and meets nothing
    ranked = cut(elements.join(held, ["root", "e"]).groupBy("root", "node").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("shared")))
    size = F.size("diff").cast("long")
    whole = told.join(ranked, ["root", "node"], "left").select("root", "node", "n", "label", "main", size.alias("size"), F.coalesce(F.transform("shared", lambda x: x["e"]), F.array().cast("array<long>")).alias("shared"))
    whole = whole.join(groups, "root").withColumn("d", F.expr(f"({100 - LEAST} * (n + least(most, n * 100 div {LEAST}))) div {100 + LEAST}"))
    size_class = lambda x: f"cast(floor(log2(greatest(0, {x}) + 1)) AS int)"
    classed = whole.withColumns({"own": F.expr(size_class("size")), "other": F.explode(F.expr(f"sequence({size_class('size - d')}, {size_class('size + d')})"))})
    # the smallest |D| of a class is 2**class - 1
    need = classed.withColumn("t", F.expr("cast(ceil((size + shiftleft(1L, other) - 1 - d) / 2.0D) AS int)"))
    alone = F.col("size") - F.size("shared")
    first = F.when(F.col("t") < 1, F.array(F.lit(None).cast("long"))).otherwise(F.slice("shared", 1, F.greatest(F.lit(0), F.col("size") - F.col("t") + 1 - alone).cast("int")))
    keyed = need.select("root", "main", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "n", "label", "own", "other", F.explode(first).alias("e"))
    keyed = cut(keyed.withColumn("e", F.struct(F.col("e").isNull().alias("any"), F.coalesce("e", F.lit(0)).alias("e"))))
    side = lambda x: [F.col(c).alias(c + x) for c in ("node", "n", "label", "own", "other")]
    left, right = keyed.where("label <> main").select("root", "low", "high", "e", *side("_x")), keyed.select("root", "low", "high", "e", "main", *side("_y"))
    met = left.join(right, ["root", "low", "high", "e"]).where(f"own_x = other_y AND own_y = other_x AND label_x <> label_y AND (label_y = main OR node_x < node_y) AND {may_link('_x', '_y')}")
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"), F.least("label_x", "label_y").alias("la"), F.greatest("label_x", "label_y").alias("lb")).distinct()


def joined_labels(labels: DataFrame, more: DataFrame) -> DataFrame:
    """(node, label) after the links (la, lb) between labels."""
    above = cut(connected_components(more, "la", "lb").select(F.col("node").alias("label"), F.col("label").alias("top")))
    old = labels.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    new = above.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("top").alias("label"))
    return cut(old.unionByName(new))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def set_components(members: DataFrame, sets_of_nodes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, label): components of the linked nodes, from those that share signatures. `sets_of_nodes` builds the sets of some nodes.

    First a node is tested with one hub, if it is likely to link with it; that joins most of what links. Signatures
    whose nodes all bear one label by then are done, however many nodes they have. Then every two nodes of a
    signature with different labels are tested, if they share as many as a link needs: no link is lost. Nodes of
    one root meet by what sets them apart from it instead (`rooted_pairs`), so the copies of one text make few
    pairs, and a root is shared as widely as signatures reach (`common_roots`). Other nodes that both lie in
    signatures of more than CROWD meet by the second family, so a passage of very many texts makes few.
    """
    stars = cut(hub_pairs(members))
    likely = sets_of_nodes(ends(stars))
    labels = connected_components(cut(linked(stars, likely)))
    rows = open_members(members, labels)
    roots = common_roots(rows, roots_of(stars))
    asked = roots.select("node").unionByName(roots.select(F.col("root").alias("node"))).distinct()
    more = sets_of_nodes(cut(asked.join(likely.select("node"), "node", "left_anti")))
    pairs = rooted_pairs(rows, roots, likely.unionByName(more))
    rows = cut(rows.join(roots, "node"))
    crowds = rows.groupBy("signature").agg(F.count("*").alias("k")).where(F.col("k") > CROWD).select("signature")
    crowded = cut(rows.join(crowds, "signature").select("node", F.lit(True).alias("crowded")).distinct())
    pairs = pairs.unionByName(open_pairs(rows.join(crowded, "node", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))))
    if not crowded.isEmpty():
        second = open_members(second_signatures(sets_of_nodes(crowded.select("node"))), labels)
        second = second.join(roots, "node", "left").withColumns({"root": F.coalesce("root", "node"), "crowded": F.lit(False)})
        pairs = pairs.unionByName(open_pairs(second))
    pairs = cut(pairs.distinct())
    return joined_labels(labels, cut(linked(pairs, sets_of_nodes(ends(pairs)))))


def join_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): the components of the texts whose sets have a Jaccard similarity of 0.85 or more.

    A text's set holds its distinct runs of WIDTH words, A-Z lower-cased; a text of fewer words is one run. A null,
    empty or blank text has an empty set, links with nothing and names its own component. Rows that share an id
    are joined by their own texts. A row without an id links like any other; it never names a component unless
    all its members lack an id (then null). Texts of any length count whole. An empty table gives an empty table;
    other columns are left out, whatever their names. Sets and runs are told apart by 64-bit hashes.

    Equal sets are one node. Sets of one size band, or of neighbouring ones, share a PartEnum signature if they
    link (`Family`). Signatures that one node has alone are dropped by counting; of the others only the sets that
    are compared are built again from the texts, and each link between nodes is proved on whole sets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text).alias("text"))
    signed_rows(texts).write.parquet(folder := f"{shared_dir(spark)}/signatures-{uuid.uuid4().hex}")
    rows = spark.read.parquet(folder)
    light = cut(rows.select("id", "n", "node", "text_key"))
    signs = rows.where("signatures IS NOT NULL").select("node", "n", "firm", F.explode("signatures").alias("signature"))
    shared = cut(signs.groupBy("signature").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("rows")).where("lo <> hi").select("signature", "rows"))
    members = cut(signs.join(shared.hint("shuffle_hash"), "signature").groupBy("signature", "node").agg(*[F.first(c).alias(c) for c in ("n", "firm", "rows")]))
    remove(spark, folder)

    def sets_of_nodes(nodes: DataFrame) -> DataFrame:
        keys = light.join(nodes, "node").groupBy("node").agg(F.min("text_key").alias("text_key"))
        return cut(sets_of(texts, cut(keys)))

    labels = set_components(members, sets_of_nodes)
    nodes = cut(light.where("n > 0").groupBy("node").agg(F.min("id").alias("rep")).join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label")))
    names = cut(nodes.groupBy("label").agg(F.min("rep").alias("component_id")))
    owners = cut(nodes.join(names, "label").select("node", "component_id"))
    with_words = light.where("n > 0").join(owners, "node").select("id", "n", "component_id")
    rest = light.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return with_words.unionByName(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
