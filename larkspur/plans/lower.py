"""Typed plans to DataFrames.  Catalyst optimises from here on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import aggregates
from larkspur.operators import inequality
from larkspur.plans import logical as L

#: A table's rows under their declared names and types, by table id.
Reader = Callable[[int], DataFrame]
#: The same with a column that tells rows apart in the order of insertion, and its name; None of tables that have none.
Locator = Callable[[int], tuple[DataFrame, str] | None]

_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "AND": lambda a, b: a & b,
    "OR": lambda a, b: a | b,
}


def expression(e: L.TypedExpr) -> Column:
    match e:
        case L.ColumnRef():
            return F.col(e.internal)
        case L.Value():
            return F.lit(e.value).cast(e.type.physical.spark)
        case L.Op():
            return _OPS[e.op](expression(e.left), expression(e.right))
        case L.Negation():
            return ~expression(e.operand)
    tested = expression(e.operand)
    return tested.isNotNull() if e.negated else tested.isNull()


def scan(s: L.Scan, read: Reader, locate: Locator | None = None) -> DataFrame:
    columns = [F.col(f"`{c.name.replace('`', '``')}`").alias(c.internal) for c in s.columns]
    if locate and (found := locate(s.table_id)):
        return found[0].select(*columns, F.col(found[1]).alias(_place(s)))
    return read(s.table_id).select(columns)


def _place(s: L.Scan) -> str:
    return f"b{s.binding}_at"


def _sort_key(k: L.SortKey) -> Column:
    c = F.col(k.column.internal)
    if k.descending:
        return c.desc_nulls_first() if k.nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if k.nulls_first else c.asc_nulls_last()


def plan(p: L.Plan, read: Reader, locate: Locator | None = None, places: bool = False) -> DataFrame:
    """Columns under internal names; of a projection or aggregate ``f0``, ``f1``, ...  With ``places`` rows carry those of their scans, so far as tables have them."""
    here = locate if places else None
    match p:
        case L.Scan():
            return scan(p, read, here)
        case L.Join():
            left, right = plan(p.left, read, locate, places), scan(p.right, read, here)
            if not inequality.has_equality(p.predicate, p.right.binding) and (found := inequality.bound(p.predicate, p.right.binding)):
                holds = next(s for s in L.scans(p.left) if s.binding == found[0].binding)
                left, right = inequality.prune(left, right, found, scan(holds, read))
                return inequality.join(left, right, found, expression(p.predicate))
            return left.join(right, expression(p.predicate), "inner")
        case L.Filter():
            return plan(p.input, read, locate, places).where(expression(p.predicate))
        case L.Sort():
            rows = plan(p.input, read, locate, True)
            # Ties stay in the order of insertion, of a join's left rows first.
            ties = [_place(s) for s in L.scans(p.input) if _place(s) in rows.columns]
            return rows.orderBy([*(_sort_key(k) for k in p.keys), *map(F.col, ties)])
        case L.Project():
            return plan(p.input, read, locate, places).select([F.col(c.internal).alias(f"f{i}") for i, c in enumerate(p.columns)])
        case L.Limit():
            return plan(p.input, read, locate, places).limit(p.rows)
    return _aggregate(p, read, locate)


def _aggregate(p: L.Aggregate, read: Reader, locate: Locator | None) -> DataFrame:
    rows = plan(p.input, read, locate)
    keys = list(dict.fromkeys(k.internal for k in p.keys))
    sums = {f"f{i}": o for i, o in enumerate(p.outputs) if isinstance(o, L.Aggregate_)}
    if sums:
        made = [aggregates.column(o.function, F.col(o.argument.internal) if o.argument else None, o.argument.type if o.argument else None, o.name).alias(name) for name, o in sums.items()]
        rows = rows.groupBy(keys).agg(*made)
    else:
        rows = rows.select(keys).distinct()
    return rows.select([F.col(f"f{i}" if f"f{i}" in sums else o.internal).alias(f"f{i}") for i, o in enumerate(p.outputs)])


def told(f: L.ColumnRef | L.Aggregate_) -> dict:
    """Metadata of a result column.  Counts are unsigned by type and Long by representation."""
    out = {"physical": f.type.physical.value, "semantic": f.type.name, "nullable": f.nullable}
    return out | {"table": f.table_id, "column": f.column_id} if isinstance(f, L.ColumnRef) else out


def query(q: L.Query, read: Reader, locate: Locator | None = None) -> DataFrame:
    rows = plan(q.plan, read, locate)
    rows = rows.select([F.col(f"f{i}").alias(f"f{i}", metadata=told(f)) for i, f in enumerate(q.fields)])
    return rows.toDF(*[f.name for f in q.fields])
