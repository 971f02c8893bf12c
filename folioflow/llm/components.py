"""Connected components of a graph whose edges never meet in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import forget, materialize


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of ``edges`` (u, v: bigint); label is the smallest node it is connected to.

    Large-star and small-star rounds hang each node under ever smaller neighbours until nothing moves. A round groups edges
    by node with a minimum, which tasks pre-aggregate, and joins that minimum back. The minima are written first: a join of two
    tables is one whose large partitions Spark can split, so a hub's edges do not meet in one task.
    Self-links count as nodes; no edges give no rows.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
        large = both.join(least, "u").where(F.col("v") >= F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc")
        forget(least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("m")))).alias("e"))
        small = materialize(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).distinct(), "cc")
        state = small.where("u <> v").agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (now, large, least):
            forget(old)
        now = small
        if state == before:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
        before = state
