"""Mixing sources to target weights.

Every document gets a hash-random key; within a source the documents stand in
key order, running sums of their sizes say where the source's budget is reached,
and the cut is made there.  A budget above the source's size repeats whole
epochs first.  Running sums are distributed: ranges of the key (buckets) are
summed, prefix sums over the buckets give each its start, and a window adds up
inside the bucket, so a source with a third of all rows is spread over as many
tasks as any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.runtime import Scratch, Shield, shuffle_partitions

#: Weights by place in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words to take, as a share of all words.
SHARE = 1.5
#: Most that a source may give, in times its size.
MOST = 2.0


def random_key(*columns: Column) -> Column:
    """32 hexadecimal digits by MD5 over the columns as text, nulls apart from empty."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]).cast("binary"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size; a row each) with column ``target``.

    A source's weight follows from its place in code point order, null last.
    Targets are proportional to the weights but for sources held at ``most``
    times their size.  Those held are first in the order of that bound over the
    weight, and a source is held while its bound is below the level that the
    rest would share.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = sources.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    s = s.withColumn("_nth", F.row_number().over(order))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_budget", share * F.sum("source_size").over(everything))
    s = s.withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    # The level that holds is that of the first source that isn't held at its bound.
    free = F.min(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.struct("_nth", "_level"))).over(everything)
    s = s.withColumn("_free", free)
    s = s.withColumn("_final", F.col("_free._level"))
    held = F.col("_nth") < F.coalesce(F.col("_free._nth"), F.lit(2**31 - 1))
    return s.withColumn("target", F.when(held, F.col("_cap")).otherwise(F.col("_w") * F.col("_final"))).select("source", "source_size", "target")


def mix(rows: DataFrame, key: Column, source: str = "source", size: str = "size", whole: bool = False, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``rows`` with columns ``source_size``, ``target``, ``taken`` (size units that the mix takes, epochs counted) and ``copies`` (epochs that the row is in, in whole or part).

    With ``whole`` false the document at the cut gives just what is missing, so
    a source's sum is its target rounded.  With ``whole`` true documents are
    taken as a whole: the one at the cut if more than half of it lies before.
    Null sources are one source, ordered last; null sizes count as 0; rows with
    equal keys are interchangeable (they should be equal); a column named as an
    output is replaced; an empty table stays empty.  The table of sources is
    aggregated first and bounded by the number of sources.
    """
    spark = rows.sparkSession
    own = Scratch(spark, "mixing")
    buckets = 8 * shuffle_partitions(spark)
    key32 = F.conv(F.substring(F.col("_key"), 1, 8), 16, 10).cast("long")
    shield = Shield(rows, _key=key)
    size, source = F.coalesce(F.col(shield(size)).cast("long"), F.lit(0)), F.coalesce(F.concat(F.lit("="), shield(source)), F.lit("-"))
    slim = shield.inner.withColumn("_size", size).withColumn("_bucket", F.shiftright(key32 * buckets, 32))
    # Computed anew wherever it is read, always to the same values: the rows may be wide and aren't written again.
    slim = slim.withColumn("_source", source)
    sums = own.keep(slim.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum")), "sums")
    totals = sums.groupBy("_source").agg(F.sum("_sum").alias("source_size"))
    named = totals.withColumn("source", F.when(F.col("_source") != "-", F.expr("substring(_source, 2)")))
    plan = targets(named.select("source", "source_size"), weights, share, most)
    plan = plan.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).drop("source")
    plan = own.keep(plan, "plan")
    start = sums.withColumn("_start", F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_sum")).drop("_sum")
    run = Window.partitionBy("_source", "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    out = slim.withColumn("_before", F.coalesce(F.sum("_size").over(run), F.lit(0))).join(start, ["_source", "_bucket"]).join(plan, "_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.round(F.col("target")).cast("long") - epochs * F.col("source_size") - F.col("_start") - F.col("_before")
    if whole:
        more = F.when(left * 2 >= F.col("_size"), F.when(left > 0, F.col("_size")).otherwise(0)).otherwise(0)
    else:
        more = F.least(F.greatest(left, F.lit(0)), F.col("_size"))
    out = out.withColumn("taken", (epochs * F.col("_size") + more).cast("long")).withColumn("copies", (epochs + (more > 0).cast("int")).cast("int"))
    return shield.restore(out, "source_size", "target", "taken", "copies")
