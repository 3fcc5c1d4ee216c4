"""Connected components by alternating large and small stars.

Edges are rewired towards the smallest node of each neighbourhood until every
node hangs on its component's smallest (Kiveris et al., Connected components in
MapReduce and beyond).  All steps are aggregations and equi-joins of narrow
rows, each written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.runtime import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, own: Scratch, name: str) -> DataFrame:
    """``node``, ``label`` for every node of ``edges`` (a, b: long) but the labels themselves: the smallest node it reaches.

    Loops, repeated and reversed edges are harmless; no edges give no rows.
    """
    now = own.keep(_small_star(edges.where(F.col("a") != F.col("b"))), f"{name}-0")
    step, before = 0, None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before or seen[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before, step = seen, step + 1
        now = own.keep(_small_star(_large_star(now)), f"{name}-{step}")
        if step > 1:
            own.drop(f"{name}-{step - 2}")
