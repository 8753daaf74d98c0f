"""Benchmark decontamination by size-partitioned MinHash containment search, verified on exact shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from meshlag.llm.chars import POINTS, Batch, unspaced, words_only
from meshlag.llm.util import cut, small_batches, whole_text

WIDTH = 5
THRESHOLD = 0.8
#: Hash functions; one band each, since the shingles of unrelated texts hardly ever agree.
PERMUTATIONS = 32
#: Items that are searched for in one pass over the documents; more are taken in blocks.
BLOCK_ITEMS = 20_000

_rng = np.random.default_rng(20_111)
FACTORS = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEPS = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased, as `words_only` maps them; of unspaced scripts each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.minimum(codes, POINTS - 1)
    mapped = words_only()[at]
    mapped = np.where(mapped == 0, 32, mapped).astype("<u4")
    alone = unspaced()[at]
    if alone.any():
        mapped = np.insert(np.insert(mapped, np.flatnonzero(alone) + 1, 32), np.flatnonzero(alone) + np.arange(alone.sum()), 32)
    return [w for w in mapped.tobytes().decode("utf-32-le", "surrogatepass").split(" ") if w]


def shingles_of(text: str, width: int = WIDTH) -> set[tuple[str, ...]]:
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, word hash) in order."""
    batch = Batch(texts, words_only())
    alone = unspaced()[np.minimum(batch.raw, POINTS - 1)]
    starts, _, words = batch.spans((batch.codes != 32) & (batch.codes != 0), alone)
    return batch.owner[starts].astype(np.int64), words


def _shingles(owner: np.ndarray, words: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) in order, from the word hashes of the batch."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ words[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    inside = owner[:n] == owner[width - 1 :]
    return owner[:n][inside], out[inside]


class Index:
    """MinHash values of the items, partitioned by size.

    A size class holds the items of (s/2, s] shingles, s a power of two. For it a document is searched in
    windows of 1.5 s shingles at steps of s/2: every run of s shingles lies in one window, so a short item is
    compared with a window about its own size however long the document is, at a Jaccard similarity of 0.25
    or more when 0.8 of the item is there.

    An item of fewer than WIDTH words is one shingle of all its words, and a document is searched for runs of
    as many words.
    """

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = np.array([i for i, _ in items] + [None], object)[:-1]
        texts = [t or "" for _, t in items]
        lengths = [len(words_of(t)) for t in texts]
        self.widths = [min(n, WIDTH) for n in lengths]
        items = {k: shingles_of(t, w) for k, (t, w) in enumerate(zip(texts, self.widths, strict=True)) if w}
        #: Number of each shingle; the numbers of all items' shingles, one item after another.
        self.known: dict[tuple[str, ...], int] = {}
        self.shingles = np.array([self.known.setdefault(x, len(self.known)) for s in items.values() for x in s], np.int32)
        self.sizes = np.zeros(len(texts), np.int64)
        self.sizes[list(items)] = [len(s) for s in items.values()]
        self.first = np.cumsum(self.sizes) - self.sizes
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sized: dict[int, list[int]] = {}
        for k, s in items.items():
            if self.widths[k] == WIDTH:
                sized.setdefault(max(2, 1 << (len(s) - 1).bit_length()), []).append(k)
        for width in sorted({w for w in self.widths if 0 < w < WIDTH}):
            members = np.array([k for k, w in enumerate(self.widths) if w == width])
            _, hashes = _shingles(*_words([texts[k] for k in members]), width)
            order = np.argsort(hashes, kind="stable")
            self.short[width] = hashes[order], members[order]
        for size, members in sized.items():
            owner, hashes = _shingles(*_words([texts[k] for k in members]))
            at = np.searchsorted(owner, np.arange(len(members)))
            self.classes[size] = []
            for f, c in zip(FACTORS, STEPS, strict=True):
                least = np.minimum.reduceat(hashes * f + c, at)
                order = np.argsort(least, kind="stable")
                self.classes[size].append((least[order], np.array(members)[order]))

    def candidates(self, texts: list[str]) -> np.ndarray:
        """text * items + item, in order, of all pairs that agree in some hash function's least value over some window."""
        of_word, words = _words(texts)
        met = [np.zeros(0, np.int64)]
        for width, (values, members) in self.short.items():
            owner, hashes = _shingles(of_word, words, width)
            met.append(self._meet(values, members, owner, hashes))
        owner, hashes = _shingles(of_word, words)
        if not len(owner) or not self.classes:
            return np.unique(np.concatenate(met))
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        position = np.arange(len(owner)) - first[owner]
        finest = min(self.classes) // 2
        blocks = np.flatnonzero(position % finest == 0)
        for k, (f, c) in enumerate(zip(FACTORS, STEPS, strict=True)):
            least, at = np.minimum.reduceat(hashes * f + c, blocks), blocks
            half = finest
            for size in sorted(self.classes):
                while half < size // 2:  # two neighbouring blocks of the same text make one of twice the size
                    keep = np.flatnonzero(position[at] % (2 * half) == 0)
                    least, at, half = np.minimum.reduceat(least, keep), at[keep], 2 * half
                of = owner[at]
                window = least.copy()
                for step in (1, 2):
                    same = of[step:] == of[:-step]
                    window[:-step][same] = np.minimum(window[:-step][same], least[step:][same])
                met.append(self._meet(*self.classes[size][k], of, window))
            met = [np.unique(np.concatenate(met))]
        return met[0]

    def _meet(self, values: np.ndarray, members: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """text * items + item of every text hash among the sorted item `values`.

        A text meets a value once, however many of its windows have it, and then all items of that value together.
        """
        lo = np.searchsorted(values, hashes)
        hit = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == hashes)
        if not len(hit):
            return np.zeros(0, np.int64)
        text, first = np.divmod(np.unique(owner[hit] * len(values) + lo[hit]), len(values))
        count = np.searchsorted(values, values[first], "right") - first
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(text, count) * len(self.ids) + members[at]

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, shared shingles, shingles of the item) of the candidates that hold.

        Shingles of the items have numbers, one for each sequence of words, so the exact counts of all candidates
        of a text come from one look at which numbers the text holds.
        """
        pairs = self.candidates(texts)
        out: list[tuple[int, int, int, int]] = []
        of_text, item = pairs // len(self.ids), pairs % len(self.ids)
        widths, held = np.array(self.widths)[item], np.zeros(len(self.known), bool)
        for t, width in sorted(set(zip(of_text.tolist(), widths.tolist(), strict=True))):
            mine = item[(of_text == t) & (widths == width)]
            here = [self.known[x] for x in shingles_of(texts[t], width) if x in self.known]
            held[here] = True
            first, size = self.first[mine], self.sizes[mine]
            at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            shared = np.bincount(np.repeat(np.arange(len(mine)), size), held[self.shingles[at]], minlength=len(mine)).astype(np.int64)
            held[here] = False
            keep = shared >= THRESHOLD * size
            out += zip([t] * int(keep.sum()), mine[keep].tolist(), shared[keep].tolist(), size[keep].tolist(), strict=True)
        return out


def indexes(benchmark: DataFrame, item_col: str) -> Iterator[Index]:
    """An index for each block of at most BLOCK_ITEMS distinct items (id and text), in their order."""
    kind = benchmark.select(item_col).schema[0].dataType
    named = cut(benchmark.select(F.struct(F.col(item_col).alias("item"), F.col("text").alias("body")).alias("k")).where("k.body is not null").distinct())
    last = None
    while part := (named if last is None else named.where(F.col("k") > last)).orderBy("k").limit(BLOCK_ITEMS).collect():
        end = part[-1]["k"]
        last = F.struct(F.lit(end["item"]).cast(kind).alias("item"), F.lit(end["body"]).alias("body"))
        index = Index([tuple(r["k"]) for r in part])
        if index.known:
            yield index


FOUND = ("item_id", "shared", "item_shingles", "containment")


def find_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item_id, shared, item_shingles, containment): documents that hold 0.8 or more of an item's shingles.

    Documents are searched where they are read, whole however long; nothing is shuffled. Items go to the executors
    in blocks of BLOCK_ITEMS, one pass over the documents each, so the broadcast is bounded; with several blocks
    what a pass found is written and its block let go before the next is built. Shingles are five words of letters
    and digits in lower case; in scripts without blanks each character is a word. An item of fewer words is one
    shingle. Null and empty texts hold no shingle: such documents are clean and such items match nothing. Texts that
    share an item id are judged one by one, each with a row of its own; items without an id are searched too.
    Repeated document rows are judged one by one. Ids keep their types. Empty tables give an empty table; other
    columns are left out, whatever their names. Ids of documents in a column of the same name as one of the other
    four are returned as `doc_<name>`.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = [docs.select(F.col(id_col)).schema[0].dataType, benchmark.select(item_col).schema[0].dataType]
    schema = StructType([StructField(k, t) for k, t in zip(("id", *FOUND), [*kinds, IntegerType(), IntegerType(), DoubleType()], strict=True)])
    rows, passes, before = docs.select(F.col(id_col).alias("id"), whole_text(text).alias("text")), [], None
    for index in indexes(benchmark, item_col):
        if before is not None:
            passes[-1] = cut(passes[-1])
            before.destroy()
        before = spark.sparkContext.broadcast(index)
        passes.append(rows.mapInArrow(_searcher(before, to_arrow_schema(schema)), schema))
    if len(passes) > 1:
        passes[-1] = cut(passes[-1])
        before.destroy()
    out = reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], schema)
    return out.withColumnRenamed("id", f"doc_{id_col}" if id_col in FOUND else id_col)


def _searcher(shared, schema: pa.Schema):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.matches(batch.column(1).to_pylist())
            ids = batch.column(0).take(pa.array([t for t, *_ in found], pa.int64()))
            columns = [shared.value.ids[[k for _, k, *_ in found]].tolist() if found else [], [s for _, _, s, _ in found], [n for *_, n in found], [s / n for *_, s, n in found]]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema.names)

    return search


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id") -> DataFrame:
    """`docs` without those that hold an item, judged where they are read; all columns as they were, whatever their names.

    Items, shingles, null, empty, short and very long texts are those of `find_contaminated`. Repeated rows stay or
    go together; an empty table stays empty, and without items all rows stay. Each block of items is a filter of
    the same pass, so all blocks are on the executors together: split a benchmark of many blocks into calls whose
    results are written in between.
    """
    spark = docs.sparkSession
    small_batches(spark)
    for index in indexes(benchmark, item_col):
        docs = docs.where(~_flag(spark.sparkContext.broadcast(index))(whole_text(text)))
    return docs


def _flag(shared):
    @F.arrow_udf("boolean")
    def contaminated(texts: pa.Array) -> pa.Array:
        hit = {t for t, *_ in shared.value.matches(texts.to_pylist())}
        return pa.array([t in hit for t in range(len(texts))], pa.bool_())

    return contaminated
