"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlag.llm.util import cut, whole_text

#: Positions of the ring. Loads are summed by position, so what the plan looks at never exceeds this.
POSITIONS = 1 << 16
#: Share of a mean shard that a position holds at most before its rows are dealt in parts.
SPLIT = 1 / 8
#: Rows of a position that are numbered in one task.
PART_ROWS = 1 << 20


def ring(spark: SparkSession, shards: int, virtual: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, by position."""
    nodes = spark.range(shards * virtual).select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("v"))
    at = F.pmod(F.xxhash64(F.concat_ws("#", F.lit("node"), "shard", "v")), F.lit(POSITIONS))
    return sorted((r["at"], r["shard"]) for r in nodes.select(at.alias("at"), F.col("shard").cast("int")).collect())


def walk(nodes: list[tuple[int, int]], loads: list[tuple[int, int, int]], shards: int, slack: float) -> dict[tuple[int, int], int]:
    """(position, part) -> shard. A unit goes to the first virtual node clockwise whose shard has room.

    `loads` holds (position, part, load). Room ends at (1 + slack) times the mean load. Heavy units choose
    first, so late ones are small and still fit; one that fits nowhere goes to the least loaded shard. Most
    units stay where plain consistent hashing puts them: only what overflows moves on.
    """
    room = (1 + slack) * sum(x for *_, x in loads) / shards
    starts = [p for p, _ in nodes]
    used, out = [0] * shards, {}
    for position, part, load in sorted(loads, key=lambda x: (-x[2], x[:2])):
        k = bisect.bisect_left(starts, position)
        tried: set[int] = set()
        for step in range(len(nodes)):
            shard = nodes[(k + step) % len(nodes)][1]
            if shard not in tried:
                if used[shard] + load <= room:
                    break
                tried.add(shard)
                if len(tried) == shards:
                    shard = min(range(shards), key=lambda s: (used[s], s))
                    break
        out[position, part] = shard
        used[shard] += load
    return out


def assign_shards(docs: DataFrame, shards: int = 16, virtual: int = 64, slack: float = 0.002, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns id, size, text_crc32, law, shard, slot and grown_shard.

    Size is the UTF-8 bytes of the text (null: none) plus 1. The law is `bytes`: no shard exceeds the mean by
    more than `slack`, except by one unit's load where nothing else is left. Keys are digests of the text, so
    equal texts share a position of the ring and a shard. Only a position that holds more than SPLIT of a mean
    shard, or over PART_ROWS rows, is dealt in parts, whose overflow goes on clockwise: a group of copies with
    a third of all rows can't fit one shard. Null and repeated ids change
    nothing. Slots number a shard's rows from 0 without gaps: the counts of earlier units plus the rank inside
    the unit, so no window spans a shard. `grown_shard` is null under this law. A null text counts as empty.
    An empty table gives an empty table; other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    body = whole_text(text)
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
            F.pmod(F.xxhash64(body), F.lit(POSITIONS)).cast("int").alias("position"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    whole = rows.agg(F.sum("size").alias("load")).first()["load"] or 0
    most = max(1.0, SPLIT * whole / shards)
    by_position = rows.groupBy("position").agg(F.sum("size").alias("load"), F.count("*").alias("n"))
    parts = F.greatest(F.ceil(F.col("load") / most), F.ceil(F.col("n") / PART_ROWS)).cast("int")
    heavy = by_position.select("position", parts.alias("parts")).where("parts > 1")  # at most POSITIONS rows
    rows = rows.join(F.broadcast(heavy), "position", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int"))
    rows = cut(rows.select("id", "size", "text_crc32", "position", "part", "row"))
    # at most POSITIONS + shards / SPLIT + rows / PART_ROWS units
    units = sorted(tuple(r) for r in rows.groupBy("position", "part").agg(F.sum("size").alias("load"), F.count("*").alias("n")).collect())
    place = walk(ring(spark, shards, virtual), [u[:3] for u in units], shards, slack)
    counts, plan = [0] * shards, []
    for position, part, _, n in units:
        shard = place[position, part]
        plan.append((position, part, shard, counts[shard]))
        counts[shard] += n
    plan = spark.createDataFrame(plan, "position int, part int, shard int, base long")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("position", "part").orderBy("id", "size", "text_crc32", "row")))
    return ranked.join(F.broadcast(plan), ["position", "part"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
