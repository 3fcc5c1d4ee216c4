"""Shards in Hilbert-curve order of several metadata dimensions.

Each dimension is quantised to levels of about equal row counts, a row's levels
give its place on a Hilbert curve, and the rows in curve order are cut into runs
of equal length (at most one row apart).  Neighbours on the curve are close in
every dimension, so a run covers a narrow range of each and readers skip files
by their column statistics.

The global rank needs no global sort: rows are counted by curve cell and by a
hash bucket inside the cell, prefix sums over those counts give each bucket its
first rank, and ranks inside a bucket come from a window.  Cells with many rows
(a hot source) are spread over many buckets by a hash.  Rows that are to stay
together (copies of a text) share the least of their cells and their hash, so
that they are neighbours; such a group is spread over buckets of its own once it
is larger than one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from larkspur.llm.mixing import random_key
from larkspur.llm.runtime import Scratch, Shield, join_told, ship, shuffle_partitions, small

#: Bits of a dimension's level.
BITS = 4
#: Rows of a group beyond which it has buckets of its own.
BIG = 1_000


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``levels`` (n rows, d dimensions, values below 2**bits).

    The levels are turned bit by bit into the curve's transposed index: from
    the top bit down, each dimension either reflects the first one's lower bits
    or swaps them with its own; then a Gray code over the dimensions.
    """
    x = levels.astype(np.int64).T.copy()
    d = len(x)
    if d == 1:
        return x[0]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            up = (x[i] >> b) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        gray ^= np.where((x[d - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= gray
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def _key(column: Column, kind: str) -> Column:
    """The values of a dimension, in an order that plain comparison has."""
    if kind.startswith("timestamp"):
        return F.unix_micros(column.cast("timestamp"))
    if kind.startswith("decimal") or kind in ("string", "date", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double"):
        return column
    raise ValueError(f"a dimension is a number, string, truth value, date or time, not {kind}")


def _cuts(df: DataFrame, key: Column, share: Sequence[float], own: Scratch, name: str) -> list:
    """The least values up to which these shares of the rows lie; nulls don't count."""
    values = df.where(key.isNotNull()).groupBy(key.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    values = own.keep(values.repartitionByRange("v").withColumn("p", F.spark_partition_id()), name)
    total, before = 0, {}
    for r in values.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect():
        before[r["p"]] = total
        total += r["n"]
    if not total:
        return []
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("p")]
    upto = values.withColumn("to", F.sum("n").over(Window.partitionBy("p").orderBy("v")) + offset)
    crossed = F.exists(F.array(*[F.lit(x * total) for x in share]), lambda x: (x > F.col("to") - F.col("n")) & (x <= F.col("to")))
    return [r["v"] for r in upto.where(crossed).select("v").collect()]


def levels(df: DataFrame, dimensions: Sequence[str], bits: int = BITS) -> list[Column]:
    """Quantised level of each dimension, null at 0: how many of the column's quantiles lie at or below the value."""
    own, share = Scratch(df.sparkSession, "levels"), [i / (1 << bits) for i in range(1, 1 << bits)]
    kinds = dict(df.dtypes)
    out = []
    for i, c in enumerate(dimensions):
        key = _key(F.col(f"`{c}`"), kinds[c])
        level = sum((F.when(key >= F.lit(b), 1).otherwise(0) for b in _cuts(df, key, share, own, f"values{i}")), F.lit(0))
        out.append(F.when(key.isNull(), 0).otherwise(level).cast("int"))
    return out


def _hash(*columns: Column) -> Column:
    """60 bits of the columns' MD5 as text, nulls apart from empty."""
    return F.conv(F.substring(random_key(*columns), 1, 15), 16, 10).cast("long")


def shard_rows(rows: DataFrame, dimensions: Sequence[str], tie: Sequence[Column], shards: int, bits: int = BITS, together: Sequence[Column] = ()) -> DataFrame:
    """``rows`` with columns ``shard`` (0 to shards-1) and ``slot`` (0, 1, ... inside the shard); counts differ by one at most.

    Rows come by their place on the curve, then by a hash of ``tie``, which
    should tell rows apart; rows equal in all of it are interchangeable.  Rows
    equal in all of ``together`` are neighbours, at the least of their places
    and by a hash of what they share, so that only an end of a shard parts them;
    groups of more than BIG rows come after all others of their place.
    Dimensions are numbers, strings, truth values, dates or times; others are
    refused.  Nulls count as the lowest level, NaN as the highest; an empty
    table stays empty.  Columns named ``shard`` or ``slot`` are replaced.
    """
    spark = rows.sparkSession
    if len(dimensions) * bits > 24:
        raise ValueError("dimensions times bits is at most 24: the curve's cells are counted by one job")
    ship(spark)
    own = Scratch(spark, "sharding")
    shield = Shield(rows, _hash=_hash(*(together or tie)), _sub=F.shiftright(_hash(*tie), 29), **{f"_tie{i}": t for i, t in enumerate(tie)})
    rows, dimensions, tie = shield.inner, [shield(d) for d in dimensions], [F.col(f"_tie{i}") for i in range(len(tie))]

    @pandas_udf("long")
    def curve(packed: pd.Series) -> pd.Series:
        x = packed.to_numpy()[:, None] >> (bits * np.arange(len(dimensions)))
        return pd.Series(hilbert_index(x & ((1 << bits) - 1), bits))

    packed = F.lit(0).cast("long")
    for i, level in enumerate(levels(rows, dimensions, bits)):
        packed = packed + F.shiftleft(level.cast("long"), bits * i)
    # Computed anew wherever it is read, always to the same values: the rows may be wide and aren't written again.
    # The joins' filter by the cell must not make Spark compute it a second time below: each task would take two Python workers.
    placed = rows.withColumn("_cell", curve.asNondeterministic()(packed)).withColumn("_rows", F.lit(1).cast("long"))
    if together:
        groups = placed.groupBy("_hash").agg(F.min("_cell").alias("_at"), F.max("_cell").alias("_to"), F.count(F.lit(1)).alias("_of"))
        groups = own.keep(groups, "groups")
        cells = groups.groupBy(F.col("_at").alias("_cell")).agg(F.sum("_of").alias("_n"))
        # Only groups that lie in several cells or are large have to be told their rows.
        told = own.keep(groups.where((F.col("_at") != F.col("_to")) | (F.col("_of") > BIG)).select("_hash", "_at", "_of"), "told")
        placed = join_told(placed, told, "_hash", "_of", "left", own, "hot")
        placed = placed.withColumn("_cell", F.coalesce("_at", "_cell")).withColumn("_rows", F.coalesce("_of", "_rows")).drop("_at", "_of")
    else:
        cells = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = own.keep(cells, "cells")
    total = cells.agg(F.sum("_n")).first()[0] or 0
    # A bucket holds about an eighth of a shuffle partition's rows; a small cell is one bucket.
    each = max(1, total // (8 * shuffle_partitions(spark)))
    placed = placed.join(small(cells.select("_cell", F.ceil(F.col("_n") / each).cast("long").alias("_of"))), "_cell")
    big = F.col("_rows") > BIG
    # A large group has buckets of its own, by its rows' own hash; 0 stands for no group.
    split = placed.withColumn("_own", F.when(big, F.col("_hash") + 1).otherwise(0))
    split = split.withColumn("_part", F.when(big, F.shiftright(F.col("_sub") * F.ceil(F.col("_rows") / each), 31)).otherwise(F.shiftright(F.shiftright("_hash", 29) * F.col("_of"), 31)))
    split = split.drop("_of", "_rows")
    bucket = ["_cell", "_own", "_part"]
    counts = split.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    # At most one row of counts per eight of a partition's rows: a few bytes each, whatever the texts.
    first = counts.select(*bucket, (F.sum("_n").over(Window.orderBy(*bucket)) - F.col("_n")).alias("_first"))
    first = small(own.keep(first, "first"))
    within = Window.partitionBy(bucket).orderBy("_hash", "_sub", *tie)
    ranked = split.withColumn("_rank", F.row_number().over(within) - 1).join(first, bucket)
    rank = F.col("_rank") + F.col("_first")
    # Shards of q+1 rows first, then of q.
    q, more = divmod(total, shards)
    wide = more * (q + 1)
    shard = F.when(rank < wide, F.floor(rank / (q + 1))).otherwise(more + F.floor((rank - wide) / max(1, q)))
    slot = F.when(rank < wide, rank % (q + 1)).otherwise((rank - wide) % max(1, q))
    return shield.restore(ranked.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long")), "shard", "slot")


def write_shards(sharded: DataFrame, path: str, files: int) -> None:
    """A folder for each shard, with about ``files`` files in all, each a run of slots in their order, so that file statistics prune by every dimension.

    Runs are cut by shard and slot, which no two rows share, so that no file gets more than its part whatever the rows.
    """
    sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
