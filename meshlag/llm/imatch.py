"""I-Match document fingerprints over randomised lexicon subsets, in DataFrame functions only."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from meshlag.llm.util import cut, whole_text

#: Bits s*16 to s*16+15 of a term's hash words draw subset s; a level keeps the terms whose lowest so many bits there are zero.
SUBSETS, LEVEL_BITS = 16, (1, 4, 7, 10, 13)
#: A component is void when its subset keeps no term.
VOID = "-"
#: Text that a range of ids holds, and the most ranges: the driver sees one id for each.
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 16
#: Terms that are broadcast at most (about 200 MB); a larger lexicon is joined by a shuffle.
BROADCAST_TERMS = 4_000_000
#: An entry of every lexicon and every document, so that a document without a lexicon term keeps its row.
MARK = -1


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def hashed_words(text: Column) -> Column:
    """Hashes of the distinct words of a text."""
    return F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: Column, rows: int, rarest: float, commonest: float) -> DataFrame:
    """(term): hashes of the terms whose share of the `rows` documents lies in [rarest, commonest].

    This is the band of inverse document frequency from ln(1/commonest) to ln(1/rarest). Counts cover every
    document. A term in the band is in at least `rarest` of all documents, so there are at most (mean number
    of distinct terms of a document) / rarest of them however many documents there are.
    """
    terms = docs.select(F.explode(hashed_words(text)).alias("term"))
    counted = terms.where(F.col("term") != F.xxhash64(F.lit(""))).groupBy("term").agg(F.count("*").alias("df"))
    return counted.where((F.col("df") >= max(2.0, rarest * rows)) & (F.col("df") <= max(2.0, commonest * rows))).select("term")


def drawn(subset: int, bits: int) -> Callable[[Column], Column]:
    """Whether a term belongs to a subset: the lowest `bits` bits of its 16 there are zero."""
    mask, word = ((1 << bits) - 1) << 16 * (subset % 4), subset // 4
    mask -= (mask >> 63) << 64
    return lambda t: (F.xxhash64(t, F.lit(word)) if word else t).bitwiseAND(F.lit(mask)) == 0


def with_components(df: DataFrame, terms: str, rest: str, name: str) -> DataFrame:
    """Adds the fingerprint `name`: a hash of all sorted terms (of `rest` if there are none), then of each subset at each level.

    Whatever the length of a text, some level keeps about one to eight of its terms in a subset; hashes of
    denser levels change with any edit, those of sparser ones are void. A level filters the one before.
    """
    hashed = lambda x: F.lpad(F.lower(F.hex(F.xxhash64(x))), 16, "0")
    out = [F.when(F.size(terms) == 0, hashed(rest)).otherwise(hashed(terms))]
    last = dict.fromkeys(range(SUBSETS), terms)
    made = []
    for level, bits in enumerate(LEVEL_BITS):
        new = {f"_{name}{level}_{s}": F.filter(last[s], drawn(s, bits)) for s in range(SUBSETS)}
        df = df.withColumns(new)
        last = dict(enumerate(new))
        made += new
    out += [F.when(F.size(c) == 0, VOID).otherwise(F.substring(hashed(c), 1, 8)) for c in made]
    return df.withColumn(name, F.array(*out)).drop(*made, terms)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints; else the equal components over those that are not void on both sides."""
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != VOID) | (y != VOID)), lambda x: x))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != VOID)), lambda x: x))
    return F.when(a == b, 1.0).otherwise(same / used)


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """(_id, _text) dealt into contiguous ranges of the id, with a copy of the following range's first rows.

    Adds _b (range), _copy (row borrowed from the range that follows) and _key, the place of a row: by id,
    nulls last, then by a hash of the text, then by row number, so that rows which share an id or have none are
    dealt like any other. Spark ranges the keys alone; the driver gets the first key of each range. Every row
    then finds its range by binary search, and a lead over _b ordered by (_copy, _key) finds the next document
    without a global sort: the texts are moved once. Rows equal to a range's first one in id and text are
    copied, since any of them may be read first. `docs` must be a stored table: it is read more than once.
    """
    key = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.xxhash64("_text").alias("h"), F.monotonically_increasing_id().alias("r"))
    keyed = docs.withColumn("_key", key)
    light = keyed.select("_key").repartitionByRange(ranges, "_key")
    starts = [r["k"] for r in light.groupBy(F.spark_partition_id().alias("p")).agg(F.min("_key").alias("k")).orderBy("k").collect()]
    kind = light.schema["_key"].dataType
    table = F.from_json(F.lit(json.dumps([s.asDict() for s in starts])), ArrayType(kind))
    found = keyed.withColumn("_b", F.lit(0))
    for step in (1 << k for k in reversed(range(max(len(starts) - 1, 0).bit_length()))):
        found = found.withColumn("_b", F.when(F.col("_key") >= F.get(table, F.col("_b") + step), F.col("_b") + step).otherwise(F.col("_b")))
    first = F.get(table, F.col("_b"))
    at_start = F.coalesce(F.col("_key.i").eqNullSafe(first["i"]) & (F.col("_key.h") == first["h"]), F.lit(False))
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("c"))
    borrowed = F.struct(F.pmod(F.col("_b") - 1, F.lit(max(len(starts), 1))).alias("b"), F.lit(True).alias("c"))
    dealt = found.withColumn("_at", F.explode(F.when(at_start, F.array(own, borrowed)).otherwise(F.array(own))))
    return dealt.select("_key", "_text", F.col("_at.b").alias("_b"), F.col("_at.c").alias("_copy"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rarest: float = 0.001, commonest: float = 0.05, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness.

    The edited text: the last floor(n/4) code points of n are replaced by the first as many (or all) of the
    next document by ascending id, for the last the first. Rows that share an id follow each other by a hash
    of their texts; rows with a null id come last. A null text counts as empty. A text without a term in the
    band is fingerprinted by the whole lower-cased text. Equal texts have equal fingerprints; two empty texts
    too. An empty table gives an empty table, and other columns of `docs` are left out, whatever their names.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("_id"), whole_text(text).alias("_text"))
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("_text").cast("long")).alias("bytes")).first()
    spread = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = buckets or min(MOST_RANGES, max(8, spread, (size["bytes"] or 0) // RANGE_BYTES))
    terms = cut(lexicon(docs, F.col("_text"), size["rows"], rarest, commonest).unionByName(spark.range(1).select(F.lit(MARK).cast("long").alias("term"))))
    small = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms

    order = Window.partitionBy("_b").orderBy("_copy", "_key")
    placed = with_next(docs, ranges).repartition("_b").withColumn("_next", F.coalesce(F.lead("_text").over(order), F.lit("")))
    n = F.char_length("_text").cast("long")
    edited = F.concat(F.expr("substring(_text, 1, cast(char_length(_text) - floor(char_length(_text) / 4) as int))"), F.expr("substring(_next, 1, cast(floor(char_length(_text) / 4) as int))"))
    kept = [n.alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), F.xxhash64(F.lower("_text")).alias("_rest"), F.xxhash64(F.lower("_edited")).alias("_edited_rest")]
    both = placed.withColumn("_edited", edited).select("_b", "_key", "_copy", *kept, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("_edited").alias("t")))).alias("_s"))
    marked = F.concat(hashed_words(F.col("_s.t")), F.array(F.lit(MARK).cast("long")))
    names = ["n_chars", "edited_sha256", "_rest", "_edited_rest"]
    tokens = both.select("_b", "_key", "_copy", *names, F.col("_s.side").alias("_side"), F.explode(marked).alias("term"))
    mine = lambda side: F.array_sort(F.collect_set(F.when((F.col("_side") == side) & (F.col("term") != MARK), F.col("term"))))
    # grouping starts with _b, by which rows already lie together: no second shuffle
    grouped = tokens.join(small, "term").groupBy("_b", "_key", "_copy").agg(*[F.first(c).alias(c) for c in names], mine(0).alias("_terms"), mine(1).alias("_edited_terms"))
    made = with_components(with_components(grouped, "_terms", "_rest", "_fp"), "_edited_terms", "_edited_rest", "_efp")
    made = made.withColumn("_nfp", F.lead("_fp").over(order)).where(~F.col("_copy"))
    near_next = F.when(F.col("_nfp").isNull(), F.lit(1.0)).otherwise(likeness(F.col("_fp"), F.col("_nfp")))
    return made.select(F.col("_key.i").alias(id_col), "n_chars", "edited_sha256", F.concat_ws(".", "_fp").alias("fingerprint"), F.concat_ws(".", "_efp").alias("edited_fingerprint"), likeness(F.col("_fp"), F.col("_efp")).cast("double").alias("near_edited"), near_next.cast("double").alias("near_next"))
