"""Token counts by a two-tier lookup of pre-token lengths on the map side."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlag.llm.util import small_batches, whole_text

#: A pre-token is a run of spaces with what follows, or a line break with what follows.
PRE_TOKEN = re.compile(r"\n[^ \n]*| +[^ \n]*")
SPACE_MARK = "▁"


def split_pre_tokens(text: str) -> list[str]:
    """Keys of the pre-tokens of a text; the first space of a space run is implied.

    No piece of the vocabulary holds a space mark after another character, nor a line break beside another
    character (`PieceLengths` asserts both), so no merge crosses these cuts and lengths add up exactly.
    """
    if not text:
        return []
    if SPACE_MARK in text:
        text = text.replace(SPACE_MARK, " ")
    spaced = text.replace("\n", " \n")
    if "  " not in spaced and (spaced[0] != " " or spaced[1:2] == "\n"):
        return spaced.split(" ")
    return [x if x[0] == "\n" else x[1:] for x in PRE_TOKEN.findall(" " + text)]


class PieceLengths(dict):
    """Pre-token -> number of tokens. Starts with the shared frequent entries; encodes what is missing."""

    def __init__(self, model_file: str, frequent: dict[str, int], most: int = 400_000, longest: int = 64):
        import sentencepiece

        super().__init__(frequent)
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.frequent, self.most, self.longest = frequent, most, longest
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) or ("\n" in p and p != "\n") for p in pieces):
            raise ValueError("a piece of this vocabulary crosses a pre-token cut")

    def __missing__(self, key: str) -> int:
        if key == "":  # a lone space mark
            n = 1
        elif key[0] == "\n":  # less the space mark that the library puts in front
            n = len(self.model.encode(key, num_threads=1)) - 1
        else:
            n = len(self.model.encode(key, num_threads=1))
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
                self.update(self.frequent)
            self[key] = n
        return n


_workers: dict[tuple, PieceLengths] = {}


def _lengths(model_file: str, shared) -> PieceLengths:
    key = (model_file, shared.id if hasattr(shared, "id") else id(shared))
    if key not in _workers:
        _workers.clear()
        _workers[key] = PieceLengths(model_file, shared.value)
    return _workers[key]


def frequent_lengths(docs: DataFrame, text: Column, model_file: str, sample_rows: int = 2000, entries: int = 32_768) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of about `sample_rows` random documents; never over `entries`.

    The table only saves work: whatever it lacks is encoded where it occurs, so results do not depend on it.
    Every task counts whole pre-token lists and hands over its own largest counts; none are shuffled.
    """
    rows = docs.count()
    if not rows:
        return {}
    tasks = 8

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                counts.update(k for k in split_pre_tokens(x) if len(k) <= 64)
        top = counts.most_common(entries // 2)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["k", "n"])

    sample = docs.select(text.alias("text")).sample(min(1.0, sample_rows / rows), seed=7)
    total: Counter[str] = Counter()
    for k, n in sample.repartition(tasks).mapInArrow(tally, "k string, n long").collect():  # at most tasks * entries / 2 rows
        total[k] += n
    lengths = PieceLengths(model_file, {})
    return {k: lengths[k] for k, _ in total.most_common(entries)}


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) to `docs`; other columns stay as they are.

    A column of `docs` with one of these names is replaced. Whole texts, as the library counts them without begin or end ids. A null or empty text has 0 bytes and
    0 tokens. Texts of any length go through in pieces of a pre-token; an unbroken run of characters is one
    pre-token and is encoded whole. Repeated rows are counted one by one. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, whole_text(text), model_file))

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        length = _lengths(model_file, shared).__getitem__
        return pa.array([sum(map(length, split_pre_tokens(x))) for x in texts.to_pylist()], pa.int64())

    return docs.withColumns({"n_bytes": F.octet_length(whole_text(text)).cast("long"), "n_tokens": n_tokens(whole_text(text))}).withColumn("over_limit", F.col("n_tokens") > limit)
