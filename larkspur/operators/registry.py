"""The engine's registered queries over the test tables, with SQL for another engine to check them by."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import inspect
from larkspur.engine import Engine
from larkspur.errors import TransactionError
from larkspur.plans.bind import bind
from larkspur.plans.logical import scans
from larkspur.schema import ColumnDef, Schema, TableDef
from larkspur.sources.storage import shared_dir
from larkspur.sql.parser import parse
from larkspur.types import BOOL, INT64, TEXT, UINT64

_KINDS = {"I": INT64, "T": TEXT, "B": BOOL, "U": UINT64}


def _table(number: int, name: str, columns: str) -> TableDef:
    """``columns``: names with their kind, a question mark for nullable ones."""
    made = []
    for i, c in enumerate(columns.split()):
        column, kind = c.split(":")
        made.append(ColumnDef(i, column, _KINDS[kind[0]], kind.endswith("?")))
    return TableDef(number, name, made)


#: What of the test tables has a type here; doubles, times and lists have none, so that ``SELECT *`` leaves them out.
TABLES = [
    _table(1, "region", "r_regionkey:I r_name:T"),
    _table(2, "nation", "n_nationkey:I n_name:T n_regionkey:I"),
    _table(3, "customer", "c_custkey:I c_name:T c_nationkey:I c_mktsegment:T"),
    _table(4, "supplier", "s_suppkey:I s_name:T s_nationkey:I"),
    _table(5, "part", "p_partkey:I p_name:T p_brand:T p_type:T p_size:I"),
    _table(6, "orders", "o_orderkey:I o_custkey:I o_orderstatus:T o_orderpriority:T"),
    _table(7, "lineitem", "l_orderkey:I l_partkey:I l_suppkey:I l_linenumber:I l_returnflag:T l_linestatus:T"),
    _table(8, "events", "event_id:I user_id:I event_type:T props:T"),
    _table(9, "documents", "doc_id:I text:T? lang:T? source:T? n_chars:I?"),
    _table(10, "labels", "doc_id:I quality:I? toxic:I?"),
    _table(11, "pages", "page_id:I url:T? html:T?"),
    _table(12, "conversations", "conv_id:I turn:I role:T? text:T?"),
    _table(13, "benchmark", "item_id:I text:T?"),
]
#: Orders with NULLs and a truth value, which the test tables lack, and with an unsigned key.
ORDERS_N = _table(20, "orders_n", "o_orderkey:I o_custkey:I? o_orderstatus:T o_orderpriority:T active:B? o_unsigned:U?")
ALL = [*TABLES, ORDERS_N]
ORDERS_N_SQL = """WITH orders_n AS (
  SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS BIGINT) END AS o_custkey, o_orderstatus, o_orderpriority,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 3 = 0 END AS active, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS BIGINT) END AS o_unsigned
  FROM orders)
"""


_ENGINES: dict[tuple[str, int, str], Engine] = {}


def engine(spark: SparkSession, sf_dir: str, sql: str | None = None) -> Engine:
    """An engine with the test tables, or those that a statement reads, bound; one for each session and folder, whose files don't change."""
    used = {t.name for t in ALL} if sql is None else {s.table_name for s in scans(bind(Schema(ALL), parse(sql)).plan)}
    key = spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), sf_dir
    if key not in _ENGINES:
        _ENGINES[key] = Engine(spark)
    found = _ENGINES[key]
    for t in ALL:
        if t.name not in used or t.id in found.tables:
            continue
        if t is ORDERS_N:
            found.bind_frame(t, _orders_n(found.spark.read.parquet(f"{sf_dir}/orders.parquet")))
        else:
            found.bind_parquet(t, f"{sf_dir}/{t.name}.parquet")
    return found


def _orders_n(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.select(
        key,
        F.when(key % 7 != 0, F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus",
        "o_orderpriority",
        F.when(key % 11 != 0, key % 3 == 0).alias("active"),
        F.when(key % 5 != 0, key.cast("decimal(20,0)")).alias("o_unsigned"),
    )


#: Name: statement, and the columns that the other engine's integers are of other widths for.
SQL: dict[str, str] = {
    "scan_star": "SELECT * FROM nation",
    "scan_wide": "SELECT * FROM lineitem",
    "project_reorder": "SELECT n_name, n_nationkey FROM nation",
    "filter_and_or_not": "SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'F' AND (o_custkey < 100 OR o_orderpriority = '1-URGENT')",
    "filter_null_3vl": "SELECT o_orderkey FROM orders_n WHERE o_custkey IS NULL OR NOT active",
    "filter_boolean_column": "SELECT o_orderkey FROM orders_n WHERE active",
    "filter_not_null": "SELECT o_orderkey, o_custkey FROM orders_n WHERE o_custkey IS NOT NULL AND active != FALSE",
    "filter_null_literal": "SELECT o_orderkey FROM orders WHERE o_custkey = NULL OR o_orderkey < 50",
    "filter_is_null_of_comparison": "SELECT o_orderkey FROM orders_n WHERE (o_custkey < 100 OR active) IS NULL",
    "range_scan": "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200",
    "range_contradiction": "SELECT o_orderkey FROM orders WHERE o_orderkey >= 200 AND o_orderkey < 100",
    "point_scan": "SELECT c_name FROM customer WHERE c_custkey = 42",
    "null_scan": "SELECT o_orderkey FROM orders_n WHERE o_custkey IS NULL",
    "count_rows": "SELECT COUNT(*) FROM lineitem",
    "count_multi": "SELECT COUNT(*), COUNT(o_custkey), COUNT(o_orderkey), COUNT(active) FROM orders_n",
    "count_filtered": "SELECT COUNT(*), COUNT(o_custkey) FROM orders_n WHERE active",
    "global_aggs": "SELECT SUM(o_custkey), MIN(o_orderstatus), MAX(o_orderkey), MIN(active) FROM orders_n",
    "empty_global": "SELECT COUNT(*), SUM(o_custkey), MIN(o_orderstatus) FROM orders WHERE o_orderkey < 0",
    "empty_grouped": "SELECT o_custkey, COUNT(*) FROM orders WHERE o_orderkey < 0 GROUP BY o_custkey",
    "group_null_key": "SELECT o_custkey, COUNT(*) FROM orders_n GROUP BY o_custkey",
    "group_hidden_key": "SELECT COUNT(*) FROM orders GROUP BY o_orderstatus",
    "group_multi_interleaved": "SELECT COUNT(*), l_returnflag, SUM(l_partkey), l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_distinct": "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus",
    "group_high_cardinality": "SELECT l_orderkey, COUNT(*), MAX(l_linenumber) FROM lineitem GROUP BY l_orderkey",
    "group_limit_zero": "SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY o_orderstatus LIMIT 0",
    "min_max_bool_text": "SELECT o_orderstatus, MIN(active), MAX(o_orderpriority) FROM orders_n GROUP BY o_orderstatus",
    "unsigned_aggs": "SELECT o_orderstatus, COUNT(o_unsigned), SUM(o_unsigned), MIN(o_unsigned), MAX(o_unsigned) FROM orders_n GROUP BY o_orderstatus",
    "order_limit": "SELECT c_name FROM customer ORDER BY c_mktsegment DESC, c_custkey LIMIT 20",
    "order_null_defaults": "SELECT o_orderkey, o_custkey FROM orders_n ORDER BY o_custkey DESC, o_orderkey ASC LIMIT 50",
    "order_null_explicit": "SELECT o_orderkey, o_custkey FROM orders_n ORDER BY o_custkey ASC NULLS FIRST, o_orderkey LIMIT 50",
    "order_null_last": "SELECT o_orderkey, active FROM orders_n ORDER BY active ASC, o_orderkey DESC NULLS LAST LIMIT 5000",
    "limit_zero": "SELECT o_orderkey FROM orders LIMIT 0",
    "join_equi": "SELECT o_orderkey, c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_residual": "SELECT o_orderkey, c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_mktsegment != 'BUILDING'",
    "join_null_key": "SELECT o_orderkey FROM orders_n o JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_chain_group": "SELECT n.n_name, COUNT(*), SUM(o.o_orderkey), MAX(o.o_orderpriority) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "join_chain_four": "SELECT r.r_name, COUNT(*) FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE l.l_returnflag = 'R' GROUP BY r.r_name",
    "join_self": "SELECT a.n_name, b.n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
    "join_inequality": "SELECT a.n_nationkey, b.s_suppkey FROM nation a JOIN supplier b ON a.n_nationkey > b.s_suppkey",
    "join_inequality_reject": "SELECT COUNT(*) FROM customer c JOIN region r ON c.c_custkey < r.r_regionkey",
    "join_inequality_band": "SELECT COUNT(*) FROM customer c JOIN nation n ON c.c_custkey >= n.n_nationkey AND c.c_custkey <= n.n_regionkey",
    "join_or": "SELECT COUNT(*) FROM nation a JOIN region r ON a.n_regionkey = r.r_regionkey OR a.n_nationkey < r.r_regionkey",
    "join_constant": "SELECT COUNT(*) FROM nation a JOIN region r ON TRUE",
    "join_is_null": "SELECT COUNT(*) FROM region r JOIN nation n ON (r.r_regionkey = n.n_regionkey) IS NULL OR n.n_nationkey = 3",
    "join_text_lt": "SELECT COUNT(*) FROM supplier a JOIN part p ON a.s_name > p.p_type AND a.s_suppkey < p.p_size",
    "documents_by_lang": "SELECT lang, COUNT(*), MIN(doc_id), MAX(n_chars) FROM documents GROUP BY lang",
    "events_by_type": "SELECT event_type, COUNT(*), MIN(user_id) FROM events GROUP BY event_type",
    "labels_join": "SELECT d.lang, COUNT(*), SUM(l.quality) FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang",
    "conversations_by_role": "SELECT role, COUNT(*), MAX(turn) FROM conversations GROUP BY role",
    "pages_range": "SELECT url FROM pages WHERE page_id >= 10 AND page_id <= 60",
}

#: Null order that the other engine has to be told, and sums that it widens.
_ORACLE = {
    "order_null_defaults": ("ORDER BY o_custkey DESC,", "ORDER BY o_custkey DESC NULLS FIRST,"),
    "order_null_last": ("ORDER BY active ASC,", "ORDER BY active ASC NULLS LAST,"),
}


def _unsigned_as_long(rows: DataFrame) -> DataFrame:
    """Unsigned values as Long, for comparison with an engine that holds them so."""
    return rows.select([F.col(f"`{f.name}`").cast("long").alias(f.name) if f.dataType.simpleString() == "decimal(20,0)" else F.col(f"`{f.name}`") for f in rows.schema.fields])


def _statement(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _unsigned_as_long(engine(spark, sf_dir, sql).query(sql).frame)


PAIRS = _table(1, "pairs", "id:I a:I b:I? note:T?")


def _copy(spark: SparkSession, sf_dir: str) -> Engine:
    """A managed table ``pairs`` of the nations, in the session's shared folder."""
    e = Engine(spark)
    e.create([(PAIRS, f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}")])
    rows = e.spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey", "n_name").orderBy("n_nationkey").collect()
    e.insert(1, [(r[0], r[1], None if r[0] % 3 == 0 else r[0] * 2, r[2]) for r in rows])
    return e


def _changed(*statements: str, commit: bool | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """The table after the statements, each by itself or all in a transaction that is ended as told."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _copy(spark, sf_dir)
        if commit is None:
            for s in statements:
                e.execute(s)
        else:
            t = e.begin(1)
            for s in statements:
                e.execute_in(t, s)
            t.commit() if commit else t.rollback()
        return e.query("SELECT * FROM pairs").frame

    return run


def _conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two engines on one table: of changes that started from one version the second to commit is refused."""
    e = _copy(spark, sf_dir)
    other = Engine(spark)
    other.open([(PAIRS, e.tables[1].store.root)])
    t = e.begin(1)
    e.execute_in(t, "DELETE FROM pairs WHERE id < 10")
    other.execute("INSERT INTO pairs (id, a) VALUES (60, 6)")
    try:
        t.commit()
    except TransactionError:
        e.execute("UPDATE pairs SET a = 7 WHERE id = 60")
    return other.query("SELECT * FROM pairs").frame


def _analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an analysis, which is refused while a transaction writes and sees committed rows only."""
    e = _copy(spark, sf_dir)
    e.create_index(1, "b")
    t = e.begin(1)
    e.execute_in(t, "DELETE FROM pairs WHERE id < 10")
    try:
        e.analyze(1)
        refused = False
    except TransactionError:
        refused = True
    t.rollback()
    e.analyze(1)
    m = e.tables[1].manifest
    of = m["indexes"][0]["statistics"]
    return e.spark.createDataFrame([(refused, m["statistics"]["row_count"], of["distinct_non_null_keys"], of["null_count"])], "refused boolean, row_count long, distinct_keys long, null_count long")


def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by a column of many ties, as of a copy of the nations: ties in the order of insertion."""
    return _copy(spark, sf_dir).query("SELECT id, a FROM pairs ORDER BY a DESC LIMIT 8").frame


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point of an indexed column, among rows from before and after the index."""
    e = _copy(spark, sf_dir)
    e.create_index(1, "a")
    e.execute("INSERT INTO pairs (id, a) VALUES (70, 2)")
    return e.query("SELECT id, note FROM pairs WHERE a = 2 AND id > 3").frame


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a statement would reach its rows, which isn't run."""
    e = _copy(spark, sf_dir)
    e.create_index(1, "a")
    told = inspect.statement(e, "SELECT x.id FROM pairs x JOIN pairs y ON x.b < y.b JOIN pairs z ON z.id = y.id WHERE x.a = 2 AND y.id >= 3 AND y.id < 9")
    joins = [None, *(j["strategy"] for j in told["joins"])]
    rows = [(p["binding"], p["access"], p["column_id"], p["index"], j) for p, j in zip(told["access_paths"], joins, strict=True)]
    return e.spark.createDataFrame(rows, "binding long, access string, column_id long, indexed boolean, joined string")


def _row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read by their locators."""
    e = _copy(spark, sf_dir)
    found = [e.read_row(1, r.part, r.file, r.row) for r in e.locators(1).where("id IN (3, 17)").collect()]
    return e.spark.createDataFrame(found, "id long, a long, b long, note string")


_PAIRS_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS a, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey * 2 AS BIGINT) END AS b, n_name AS note FROM nation"
CHANGES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "dml_update_swap": (_changed("UPDATE pairs SET b = a, note = NULL WHERE id >= 5 AND id < 15"), f"WITH p AS ({_PAIRS_SQL}) SELECT id, a, CASE WHEN id >= 5 AND id < 15 THEN a ELSE b END AS b, CASE WHEN id >= 5 AND id < 15 THEN NULL ELSE note END AS note FROM p"),
    "dml_delete_unknown": (_changed("DELETE FROM pairs WHERE b < 20"), f"WITH p AS ({_PAIRS_SQL}) SELECT * FROM p WHERE NOT coalesce(b < 20, FALSE)"),
    "dml_insert_default_null": (_changed("INSERT INTO pairs (id, a) VALUES (100, -7)", "INSERT INTO pairs (a, id, note) VALUES (1, 101, 'x')"), f"{_PAIRS_SQL} UNION ALL SELECT CAST(100 AS BIGINT), CAST(-7 AS BIGINT), NULL, NULL UNION ALL SELECT CAST(101 AS BIGINT), CAST(1 AS BIGINT), NULL, 'x'"),
    "txn_commit": (_changed("DELETE FROM pairs WHERE id = 1", "UPDATE pairs SET a = 9 WHERE id = 2", "INSERT INTO pairs (id, a) VALUES (50, 5)", commit=True), f"WITH p AS ({_PAIRS_SQL}) SELECT id, CASE WHEN id = 2 THEN 9 ELSE a END AS a, b, note FROM p WHERE id <> 1 UNION ALL SELECT 50, 5, NULL, NULL"),
    "txn_conflict": (_conflict, f"{_PAIRS_SQL} UNION ALL SELECT 60, 7, NULL, NULL"),
    "analyze_committed": (_analyzed, f"WITH p AS ({_PAIRS_SQL}) SELECT TRUE AS refused, count(*) AS row_count, count(DISTINCT b) AS distinct_keys, count(*) - count(b) AS null_count FROM p"),
    "index_scan": (_indexed, f"WITH p AS ({_PAIRS_SQL}) SELECT id, note FROM p WHERE a = 2 AND id > 3 UNION ALL SELECT 70, NULL"),
    "inspect_paths": (_paths, "SELECT CAST(b AS BIGINT) AS binding, a AS access, CAST(c AS BIGINT) AS column_id, i AS indexed, j AS joined FROM (VALUES (0, 'point', 1, TRUE, NULL), (1, 'range', 0, FALSE, 'inequality'), (2, 'full', NULL, FALSE, 'equality')) v(b, a, c, i, j)"),
    "order_ties": (_ties, f"WITH p AS ({_PAIRS_SQL}) SELECT id, a FROM p ORDER BY a DESC, id LIMIT 8"),
    "row_by_locator": (_row, f"WITH p AS ({_PAIRS_SQL}) SELECT * FROM p WHERE id IN (3, 17)"),
    "txn_rollback": (_changed("DELETE FROM pairs", "INSERT INTO pairs (id, a) VALUES (50, 5)", commit=False), _PAIRS_SQL),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _statement(sql) for name, sql in SQL.items()} | {name: q for name, (q, _) in CHANGES.items()}


def _oracle(name: str, sql: str) -> str:
    """The same statement over views with this engine's types and names; sums and counts as 64-bit numbers under their names."""
    q = bind(Schema(ALL), parse(sql))
    used = dict.fromkeys(s.table_name for s in scans(q.plan))
    views = []
    for t in TABLES:
        if t.name in used:
            views.append(f"{t.name}_v AS (SELECT " + ", ".join(f"CAST({c.name} AS BIGINT) AS {c.name}" if c.type == INT64 else c.name for c in t.columns) + f" FROM {t.name})")
    out = sql.replace(*_ORACLE[name]) if name in _ORACLE else sql
    for t in TABLES:
        out = re.sub(rf"\b(FROM|JOIN) {t.name}\b", rf"\1 {t.name}_v", out)
    out = re.sub(r"\b(SUM)\(([^)]*)\)", lambda m: f"CAST(SUM({m[2]}) AS BIGINT)", out)
    head, rest = out[len("SELECT ") :].split(" FROM ", 1)
    if head != "*":
        head = ", ".join(f'{item} AS "{f.name}"' for item, f in zip(head.split(", "), q.fields, strict=True))
    derived = ["orders_n AS (" + ORDERS_N_SQL.split("AS (", 1)[1].rstrip().rstrip(")") + ")"] if "orders_n" in used else []
    made = ", ".join([*views, *derived])
    return (f"WITH {made} " if made else "") + f"SELECT {head} FROM {rest}"


ORACLE_SQL: dict[str, str] = {name: _oracle(name, sql) for name, sql in SQL.items()} | {name: sql for name, (_, sql) in CHANGES.items()}
