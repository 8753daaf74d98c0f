"""Ranked lexical search of many queries at once: terms that queries share are added up once a document."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlag.llm.util import cut, small_batches, whole_text

TOP = 10
#: Queries that are answered in one reading of the documents' term counts, and query terms that the first reading knows.
BLOCK_ITEMS, VOCABULARY = 2_000, 1_000_000
#: Most shared parts of a query that take part in the search for pairs; the others are added one by one.
MINED = 64
#: Bytes of accumulators that a worker holds.
ACCUMULATORS = 32 << 20
#: Parts into which a query's candidates are dealt before the last ranking.
SPREAD = 64
#: A-Z lower-cased, and a blank for every other character below U+0080 that is no letter or digit.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


def term_hash(term: bytes) -> int:
    h = xxhash.xxh64_intdigest(term)
    return h - (1 << 64) if h >> 63 else h


class Sharing:
    """An addition plan of term sets: nodes are sums of earlier nodes; the first ones are the terms themselves.

    Terms that belong to exactly the same queries become one node. Then, as long as two nodes stand together in
    two queries or more, the pair found in most queries becomes a node of its own and replaces both there. What
    is left of a query is its last node. A document's partial sum at a node is formed once, however many
    queries use it.
    """

    def __init__(self, queries: list[Iterable[int]]):
        users: dict[int, list[int]] = defaultdict(list)
        for q, terms in enumerate(queries):
            for t in sorted(set(terms)):
                users[t].append(q)
        self.terms = np.array(sorted(users), np.int64)
        at = {t: k for k, t in enumerate(self.terms.tolist())}
        self.children: list[list[int]] = []
        classes: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for t in sorted(users):
            classes[tuple(users[t])].append(at[t])
        parts: list[set[int]] = [set() for _ in queries]
        for group, members in classes.items():
            node = self._add(members) if len(members) > 1 else members[0]
            for q in group:
                parts[q].add(node)
        self._pair_up(parts)
        self.roots = [next(iter(p)) if len(p) == 1 else self._add(sorted(p)) if p else -1 for p in parts]

    def _add(self, children: list[int]) -> int:
        self.children.append(children)
        return len(self.terms) + len(self.children) - 1

    def _pair_up(self, parts: list[set[int]]) -> None:
        uses = Counter(n for p in parts for n in p)
        mined = [set(heapq.nsmallest(MINED, (n for n in p if uses[n] > 1), key=lambda n: (-uses[n], n))) for p in parts]
        together: Counter[tuple[int, int]] = Counter(pair for m in mined for pair in combinations(sorted(m), 2))
        where = defaultdict(set)
        for q, m in enumerate(mined):
            for n in m:
                where[n].add(q)
        heap = [(-n, pair) for pair, n in together.items() if n > 1]
        heapq.heapify(heap)
        while heap:
            n, (a, b) = heapq.heappop(heap)
            shared = where[a] & where[b]
            if len(shared) != -n:
                if len(shared) > 1:
                    heapq.heappush(heap, (-len(shared), (a, b)))
                continue
            node = self._add([a, b])
            met: Counter[int] = Counter()
            for q in shared:
                for s in (mined[q], parts[q]):
                    s.difference_update((a, b))
                met.update(mined[q])
                mined[q].add(node)
                parts[q].add(node)
            where[a], where[b], where[node] = where[a] - shared, where[b] - shared, set(shared)
            for other, k in met.items():
                if k > 1:
                    heapq.heappush(heap, (-k, (min(other, node), max(other, node))))

    def levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(nodes, their children one after another, first child of each), every level after those it needs."""
        depth = [0] * len(self.terms)
        for c in self.children:
            depth.append(1 + max(depth[k] for k in c))
        found = defaultdict(list)
        for k, c in enumerate(self.children):
            found[depth[len(self.terms) + k]].append((len(self.terms) + k, c))
        out = []
        for d in sorted(found):
            nodes, children = zip(*found[d], strict=True)
            sizes = [len(c) for c in children]
            out.append((np.array(nodes), np.concatenate(children), np.cumsum([0, *sizes[:-1]])))
        return out


class Ranking:
    """The documents of highest score for each query of a block, over the batches of a task."""

    def __init__(self, plan: Sharing, weights: np.ndarray, keys: list[int]):
        self.terms, self.weights, self.nodes, self.levels = plan.terms, weights, len(plan.terms) + len(plan.children), plan.levels()
        used = [q for q, r in enumerate(plan.roots) if r >= 0]
        self.roots, self.keys = np.array([plan.roots[q] for q in used], np.int64), [keys[q] for q in used]
        self.chunk = max(1, ACCUMULATORS // (8 * max(1, self.nodes)))

    def scores(self, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray, damping: np.ndarray) -> np.ndarray:
        """(query, document): owner, term and count of each posting, and m of each document."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        at, owner, counts = at[known], owner[known], counts[known]
        sums = np.zeros((self.nodes, len(damping)), np.int64)
        sums[at, owner] = self.weights[at] * (1_000_000_000 * counts // (1000 * counts + 8 * damping[owner]))
        for nodes, children, first in self.levels:
            sums[nodes] = np.add.reduceat(sums[children], first, axis=0)
        return sums[self.roots]

    def search(self, batches: Iterable[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, int, object]]:
        """(query's key, score, id) of at most TOP documents a query; ids None come last among equals."""
        best: list[list[tuple]] = [[] for _ in self.keys]
        least = np.ones(len(self.keys), np.int64)  # a document needs that score
        for ids, lengths, terms, counts, damping in batches:
            ends = np.cumsum(lengths)
            for a in range(0, len(ids) if self.keys else 0, self.chunk):
                b = min(a + self.chunk, len(ids))
                x, y = ends[a] - lengths[a], ends[b - 1]
                found = self.scores(np.repeat(np.arange(b - a), lengths[a:b]), terms[x:y], counts[x:y], damping[a:b])
                need = np.maximum(least, np.partition(found, -TOP, axis=1)[:, -TOP]) if b - a > TOP else least
                for q, group in _runs(*np.nonzero(found >= need[:, None])):
                    last = best[q][-1] if len(best[q]) == TOP else None
                    new = [(-s, i is None, i) for s, i in zip(found[q, group].tolist(), [ids[a + d] for d in group.tolist()], strict=True)]
                    if last:
                        new = [e for e in new if _before(e, last)]
                    if new:
                        best[q] = heapq.nsmallest(TOP, best[q] + new, key=lambda e: (e[0], e[1], 0 if e[1] else e[2]))
                        if len(best[q]) == TOP:
                            least[q] = -best[q][-1][0]
        return [(key, -s, i) for key, found in zip(self.keys, best, strict=True) for s, _, i in found]


def _before(one: tuple, other: tuple) -> bool:
    return one[:2] < other[:2] or (one[:2] == other[:2] and not one[1] and one[2] < other[2])


def _runs(rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its columns) from the sorted places of a matrix."""
    edges = np.flatnonzero(np.diff(rows)) + 1
    for part in np.split(np.arange(len(rows)), edges):
        if len(part):
            yield int(rows[part[0]]), columns[part]


def term_counts(texts: DataFrame, known: dict[bytes, int] | None = None) -> DataFrame:
    """(id, n, terms, counts): terms of each text (id, text) with repeats, hashes of its distinct terms and how often each stands; only the `known` ones, if given."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("struct<n: long, terms: array<long>, counts: array<int>>")
    def counted(column: pa.Array) -> pa.Array:
        known, rows = shared.value, []
        for text in column.to_pylist():
            found = terms_of(text)
            tally = Counter(found)
            if known is None:
                rows.append((len(found), [term_hash(t) for t in tally], list(tally.values())))
            else:
                both = tally.keys() & known.keys()
                rows.append((len(found), [known[t] for t in both], [tally[t] for t in both]))
        n, terms, counts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], ["n", "terms", "counts"])

    return texts.select("id", counted(whole_text("text")).alias("t")).select("id", "t.*")


def vocabulary(items: DataFrame) -> dict[bytes, int] | None:
    """Hashes of the distinct terms of the queries; None where there are more than VOCABULARY."""

    @F.arrow_udf("array<binary>")
    def distinct(column: pa.Array) -> pa.Array:
        return pa.array([list(set(terms_of(t))) for t in column.to_pylist()], pa.list_(pa.binary()))

    found = items.select(F.explode(distinct(whole_text("text"))).alias("term")).distinct().limit(VOCABULARY + 1).collect()
    return {bytes(r["term"]): term_hash(bytes(r["term"])) for r in found} if len(found) <= VOCABULARY else None


def block_top(postings: DataFrame, ranking: Ranking) -> DataFrame:
    """(item, score, id): the best documents of each query of the block; every task hands over at most TOP a query."""
    spark = postings.sparkSession
    shared = spark.sparkContext.broadcast(ranking)
    kind = postings.schema["id"].dataType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays():
            for batch in batches:
                ids, terms, counts, damping = (batch.column(k) for k in range(4))
                yield ids.to_pylist(), np.asarray(terms.value_lengths()), np.asarray(terms.flatten()), np.asarray(counts.flatten()).astype(np.int64), np.asarray(damping)

        found = shared.value.search(arrays())
        typed = zip(zip(*found, strict=True) if found else ((), (), ()), (pa.int64(), pa.int64(), id_type), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in typed], ["item", "score", "id"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(postings.schema["id"].dataType)
    out = postings.select("id", "terms", "counts", "damping").mapInArrow(best, f"item long, score long, id {kind}")
    part = F.pmod(F.xxhash64("score", "id"), F.lit(SPREAD))  # a query's rows of all tasks first meet in parts
    order = (F.col("score").desc(), F.col("id").asc_nulls_last())
    first = out.withColumn("r", F.row_number().over(Window.partitionBy("item", part).orderBy(*order))).where(F.col("r") <= TOP)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= TOP).select("item", "rank", "id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item id, rank, id, score): the TOP documents of highest score for every query, equal scores by ascending id.

    A score adds w * (10**9 tf div (1000 tf + 8 m)) over the query's distinct terms, where w is a rounded inverse
    document frequency and m the document's length against the mean. Null and empty texts have no terms: such
    documents count for nothing and such queries return no rows. Queries that share an id, or have none, are
    answered row by row; so are documents, those without an id last among equals. Texts of any length count
    whole. Empty tables give an empty table; other columns are left out, whatever their names. Terms are told
    apart by 64-bit hashes.

    The texts are read once, into counts of the terms that some query holds (of all terms, where the queries hold
    over VOCABULARY). Queries are answered in blocks of about BLOCK_ITEMS, one reading of these counts each; a
    block's plan is dropped before the next one is made. A task hands over TOP documents a query at most.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = cut(items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"), F.monotonically_increasing_id().alias("id")))
    queries = cut(term_counts(asked.select("id", "text")).select("id", "terms"))
    found = cut(term_counts(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), vocabulary(asked)).where("n > 0"))
    total = found.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    wanted = queries.select(F.explode("terms").alias("term")).distinct()
    frequency = cut(found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(wanted, "term"))
    postings = found.select("id", "terms", "counts", F.expr(f"100 - 90 + ((90 * n * {total['N']}) div {total['L'] or 1})").alias("damping"))
    blocks = -(-queries.count() // BLOCK_ITEMS)
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(blocks, 1))))
    weight = F.floor(1000 * F.log((2.0 * total["N"] + 2) / (2.0 * F.col("df") + 1)))
    parts = []
    for k in range(blocks):
        block = dealt.where(F.col("block") == k).select("id", "terms")
        rows = block.collect()  # about BLOCK_ITEMS
        terms = block.select(F.explode("terms").alias("term")).distinct().join(frequency, "term").select("term", weight.alias("w")).where("w > 0").collect()
        weights = {r["term"]: r["w"] for r in terms}
        plan = Sharing([[t for t in r["terms"] if t in weights] for r in rows])
        if len(plan.terms):
            parts.append(cut(block_top(postings, Ranking(plan, np.array([weights[t] for t in plan.terms.tolist()], np.int64), [r["id"] for r in rows]))))
    kind = docs.schema[id_col].dataType.simpleString()
    best = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"item long, rank int, id {kind}, score long")
    return best.join(asked.select(F.col("id").alias("item"), "item_id"), "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
