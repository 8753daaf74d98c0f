"""Importance resampling towards a target text collection, on hashed word n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlag.llm.util import cut, small_batches, whole_text

BUCKETS, LONGEST_GRAM = 10_000, 3
#: Words that a document needs to be drawn, and the share of such documents that is drawn, in hundredths.
LEAST_WORDS, DRAWN_PERCENT = 20, 5
#: What lies between words: every character below U+0080 but digits and lower-case letters.
BETWEEN = r"[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
#: Lengths in bytes for which a CRC is moved on by one look-up a byte; longer ones go by powers of two.
DIRECT = 64
#: Words that a worker remembers.
KNOWN_WORDS = 500_000


def _matrix_tables(columns: np.ndarray) -> np.ndarray:
    """4 x 256 look-ups of the linear map over GF(2) whose image of bit i is columns[i]."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k, 1 << bit : 2 << bit] = out[k, : 1 << bit] ^ columns[8 * k + bit]
    return out


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


class CrcShift:
    """CRC-32 of joined strings: crc(a + b) = shift(crc(a), len(b)) ^ crc(b), for whole arrays at a time."""

    def __init__(self):
        one = np.array([zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0") for i in range(32)], np.uint32)
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        step, lengths = _matrix_tables(one), [_matrix_tables(unit)]
        for _ in range(DIRECT - 1):
            lengths.append(_matrix_tables(_apply(step, np.array([lengths[-1][i // 8, 1 << i % 8] for i in range(32)], np.uint32))))
        self.direct = np.stack(lengths).reshape(-1)
        columns, self.powers = one, []
        for _ in range(40):
            self.powers.append(_matrix_tables(columns))
            columns = _apply(self.powers[-1], columns)

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        base = np.minimum(length, DIRECT - 1) * 1024
        t = self.direct
        out = t[base + (crc & 255)] ^ t[base + 256 + (crc >> 8 & 255)] ^ t[base + 512 + (crc >> 16 & 255)] ^ t[base + 768 + (crc >> 24)]
        if len(long := np.flatnonzero(length >= DIRECT)):
            x, n = crc[long], length[long]
            for k in range(int(n.max()).bit_length()):
                odd = n >> k & 1 == 1
                x[odd] = _apply(self.powers[k], x[odd])
            out[long] = x
        return out


class GramBuckets:
    """Bucket numbers of all runs of one to three words of a text."""

    def __init__(self):
        from tokenizers import PreTokenizedString, Regex, pre_tokenizers

        self.whole, self.split, self.shift = PreTokenizedString, pre_tokenizers.Split(Regex(BETWEEN), behavior="removed"), CrcShift()
        self.known: dict[str, int] = {}

    def words(self, text: str) -> tuple[list[str], np.ndarray]:
        """The words of a text, A-Z lower-cased, and their (start, end) bytes there."""
        piece = self.whole(text.encode().lower().decode())  # bytes: only A-Z are lowered
        self.split.pre_tokenize(piece)
        found = piece.get_splits(offset_referential="original", offset_type="byte")
        return [w for w, _, _ in found], np.fromiter(chain.from_iterable([o for _, o, _ in found]), np.int64, 2 * len(found)).reshape(-1, 2)

    def crc(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        except KeyError:
            if len(known) > KNOWN_WORDS:
                known.clear()
            known.update({w: zlib.crc32(w.encode()) for w in set(words) if w not in known})
            return np.fromiter(map(known.__getitem__, words), np.uint32, len(words))

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        """(words, bucket of every feature): the CRC-32 of the words of each window, one space between, modulo BUCKETS."""
        words, offsets = self.words(text)
        size, last = offsets[:, 1] - offsets[:, 0], self.crc(words)
        spaced = self.shift(last, np.ones(len(last), np.int64)) ^ np.uint32(zlib.crc32(b" "))
        head, out = last, [last]
        for k in range(1, LONGEST_GRAM):  # head: CRC of the k words from each place on
            n = len(words) - k
            if n <= 0:
                break
            before = spaced[:n] if k == 1 else self.shift(head[:n], np.ones(n, np.int64)) ^ np.uint32(zlib.crc32(b" "))
            head = self.shift(before, size[k:]) ^ last[k:]
            out.append(head)
        return len(words), (np.concatenate(out) % BUCKETS).astype(np.uint16)


_worker: list[GramBuckets] = []


def _buckets() -> GramBuckets:
    if not _worker:
        _worker.append(GramBuckets())
    return _worker[0]


def with_buckets(docs: DataFrame, text: str | Column) -> DataFrame:
    """(id, n_words, buckets): two bytes for each feature of each text of `docs` (id, ...)."""

    @F.arrow_udf("struct<n_words: long, buckets: binary>")
    def featured(texts: pa.Array) -> pa.Array:
        made = [_buckets()(x) for x in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in made], pa.int64()), pa.array([b.tobytes() for _, b in made], pa.binary())], ["n_words", "buckets"])

    return docs.select("id", featured(whole_text(text)).alias("f")).select("id", "f.n_words", "f.buckets")


def histogram(featured: DataFrame) -> DataFrame:
    """(bucket, n): features of each bucket. Every task adds up its rows and hands over at most BUCKETS sums."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), np.uint16), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return featured.select("buckets").mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame) -> list[int]:
    """The gain of every bucket: floor(1000 ln((t+1)(S+BUCKETS) / ((s+1)(T+BUCKETS)))) of the counts s of S features of `docs` and t of T of `target`."""
    counts = docs.withColumn("of", F.lit("s")).unionByName(target.withColumn("of", F.lit("t"))).groupBy("bucket").pivot("of", ["s", "t"]).agg(F.sum("n"))
    rows = {r["bucket"]: (r["s"] or 0, r["t"] or 0) for r in counts.collect()}  # at most BUCKETS rows
    s, t = np.array([rows.get(b, (0, 0)) for b in range(BUCKETS)], float).T
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64).tolist()


def with_rank(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds rank, from 1 on in this order: place inside a range partition plus the sizes of those before.

    Rows that tie follow their storage order, so that no number of equal rows has to lie in one range. The driver
    sees one count a partition. `rows` must come from a stored table.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (*order, F.col("_row"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).count().collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    bases = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, starts, strict=False)], "_p long, _base long")
    return placed.withColumn("_p", part).join(F.broadcast(bases), "_p").withColumn("rank", F.col("_base") + inside + 1).drop("_p", "_base", "_at")


def resample_towards(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", seed: int = 42) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of `docs`; rank is null where it is not drawn.

    The features of a text are its runs of one to three words. Its weight sums the gains of their buckets; a
    Gumbel number from a hash of the id is added, and the DRAWN_PERCENT hundredths of highest score among the
    texts of LEAST_WORDS words or more are drawn, ties to the smaller id: a sample without replacement whose
    odds follow the weights. Null and empty texts have no features, a weight of 0, and are never drawn. Texts
    of any length count whole. A row without an id takes the number of the empty id and comes last among ties;
    rows that share an id share its number and are judged one by one. An empty target makes every gain that of
    no counts; an empty table gives an empty table. Other columns are left out, whatever their names.

    Texts are split once: two bytes for each feature are kept in the shared folder for the second reading.
    """
    small_batches(docs.sparkSession)
    featured = cut(with_buckets(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text"))
    wanted = with_buckets(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), "text")
    gains = np.array(bucket_gains(histogram(featured), histogram(wanted)), np.int64)

    @F.arrow_udf("long")
    def weighed(buckets: pa.Array) -> pa.Array:
        return pa.array([int(gains[np.frombuffer(x.as_buffer(), np.uint16)].sum()) for x in buckets], pa.int64())

    number = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((number + 0.5) / 4294967296.0)))
    scored = featured.select("id", "n_words", (F.octet_length("buckets") / 2).cast("long").alias("n_features"), weighed("buckets").alias("weight")).withColumn("score", F.col("weight") + gumbel)
    enough = F.col("n_words") >= LEAST_WORDS
    ranked = with_rank(scored, F.when(enough, 0).otherwise(1), F.col("score").desc(), F.col("id").asc_nulls_last())
    drawn = featured.where(F.col("n_words") >= LEAST_WORDS).count() * DRAWN_PERCENT // 100
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(enough & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))
