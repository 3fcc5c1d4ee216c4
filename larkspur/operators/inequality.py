"""Inequality joins: rows without a partner are dropped, and large sides meet range by range.

A join whose condition has no equality between its sides would compare every
pair.  If one of its conjuncts is a comparison ``left.x < right.y`` (or >, <=,
>=), left rows beyond the right side's extreme of ``y`` have no partner, and the
other way round.  The extremes come from one-row aggregates over the scans that
hold the columns, as scalar subqueries, so the filters can reach the scans; an
extreme of no rows is NULL and keeps nothing, as an inner join would.

What is left is compared all with all if a side is small enough to be broadcast.
Otherwise both sides are cut into ranges of the compared columns, rows of the
smaller side go to every range whose rows may be their partners, and the sides
are joined by range: pairs of different ranges mostly are results, so that only
those of one range are compared in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.plans import logical as L

#: Size of a side, by Spark's estimate, up to which it may be broadcast.
BROADCAST_BYTES = 10 << 20
#: Ranges of the compared columns, and values that they are cut by.
RANGES, SAMPLE = 64, 2_048

FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def has_equality(predicate: L.TypedExpr, right: int) -> bool:
    """Whether a conjunct equates an expression of the right side with one of the left."""
    for c in L.conjuncts(predicate):
        if isinstance(c, L.Op) and c.op == "=":
            a, b = L.bindings(c.left), L.bindings(c.right)
            if (a == {right} and b and right not in b) or (b == {right} and a and right not in a):
                return True
    return False


def bound(predicate: L.TypedExpr, right: int) -> tuple[L.ColumnRef, str, L.ColumnRef] | None:
    """The first conjunct that compares a left column with a right one, in that order."""
    for c in L.conjuncts(predicate):
        if isinstance(c, L.Op) and c.op in FLIPPED and isinstance(c.left, L.ColumnRef) and isinstance(c.right, L.ColumnRef):
            if c.right.binding == right != c.left.binding:
                return c.left, c.op, c.right
            if c.left.binding == right != c.right.binding:
                return c.right, FLIPPED[c.op], c.left
    return None


def prune(left: DataFrame, right: DataFrame, found: tuple[L.ColumnRef, str, L.ColumnRef], holds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides without the rows that the comparison rules out; ``holds`` is the scan that the left column comes from."""
    a, op, b = found
    low = op in ("<", "<=")  # left values lie below right ones
    far = right.agg((F.max if low else F.min)(b.internal)).scalar()
    near = holds.agg((F.min if low else F.max)(a.internal)).scalar()
    x, y = F.col(a.internal), F.col(b.internal)
    keep = {"<": (x < far, y > near), "<=": (x <= far, y >= near), ">": (x > far, y < near), ">=": (x >= far, y <= near)}[op]
    return left.where(keep[0]), right.where(keep[1])


def _bytes(df: DataFrame) -> int:
    """Spark's estimate from the sizes of files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _range(column: Column, cuts: list) -> Column:
    """How many of the ascending cuts lie at or below the value."""
    return sum((F.when(column >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))


def join(left: DataFrame, right: DataFrame, found: tuple[L.ColumnRef, str, L.ColumnRef], condition: Column) -> DataFrame:
    """The sides joined on a condition that has the comparison as a conjunct."""
    small = min(left, right, key=_bytes)
    if _bytes(small) <= BROADCAST_BYTES:
        return left.join(right, condition, "inner")
    a, op, b = found
    mine, other = (a, b) if small is left else (b, a)
    # The values with the least hashes: as many wherever the rows lie.
    drawn = small.select(F.col(mine.internal).alias("v")).where("v IS NOT NULL").orderBy(F.xxhash64("v")).limit(SAMPLE).collect()
    values = sorted(r["v"] for r in drawn)
    cuts = sorted({values[len(values) * i // RANGES] for i in range(1, RANGES)} if values else set())
    own = _range(F.col(mine.internal), cuts)
    # Of the small side a row goes to its own range and to all on the side where its partners lie.
    above = (op in ("<", "<=")) == (small is left)
    ranges = F.sequence(own, F.lit(len(cuts))) if above else F.sequence(F.lit(0), own)
    dealt = small.withColumn("_range", F.explode(ranges))
    met = (right if small is left else left).withColumn("_at", _range(F.col(other.internal), cuts))
    return dealt.join(met, (F.col("_range") == F.col("_at")) & condition, "inner").drop("_range", "_at")
