"""Connected components by hooking and pointer jumping, each step's table stored in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlag.llm.util import cut, remove, shared_dir, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node reachable over `edges`; nodes without an edge don't appear.

    Each round takes the smallest label among a node's neighbours (a combined minimum, so a node with very
    many neighbours costs one row a task), then jumps to the label's own label. Both sides of every join
    are stored tables, so the adaptive planner may split a hot key. They are files, not checkpoints: a checkpoint
    keeps the planner's guess of its size, a join's guess is the product of both sides', so over the rounds its digits
    would grow by a power of the rounds and fill the driver; a file has its true size. Files go when their round is
    over. Nulls and self links are ignored; repeated links change nothing; without links the result is empty.
    """
    spark = edges.sparkSession
    folder = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
    try:
        both = stored(both.distinct(), f"{folder}/both")
        labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), f"{folder}/labels")
        last = f"{folder}/labels"
        for k in range(max_rounds):
            near = (
                both.join(labels, both.v == labels.node)
                .groupBy("u")
                .agg(F.min("label").alias("m"))
            )
            hooked = stored(labels.join(near, labels.node == near.u).select("node", "label", F.least("label", "m").alias("next")), f"{folder}/hooked-{k}")
            own = hooked.select(F.col("node").alias("target"), F.col("next").alias("jump"))
            jumped = stored(
                hooked.join(own, hooked.next == own.target, "left").select(
                    "node", F.least("next", F.coalesce("jump", "next")).alias("label"), (F.least("next", F.coalesce("jump", "next")) != F.col("label")).alias("moved")
                ),
                f"{folder}/labels-{k}",
            )
            for path in (last, f"{folder}/hooked-{k}"):
                remove(spark, path)
            labels, last = jumped.select("node", "label"), f"{folder}/labels-{k}"
            if jumped.where("moved").isEmpty():
                return cut(labels)
    finally:
        remove(spark, folder)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
