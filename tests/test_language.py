"""Parser, binder and schema: no data is touched."""

import json

import pytest

from larkspur.errors import Code, CompileError, SchemaError, Span
from larkspur.plans import logical as L
from larkspur.plans.bind import bind
from larkspur.schema import ColumnDef, Schema, TableDef, dump_schema, load_schema
from larkspur.sql import syntax as S
from larkspur.sql.parser import parse
from larkspur.types import BOOL, INT64, TEXT, Physical, ValueType

USER, TEAM = ValueType(Physical.UINT64, "UserId"), ValueType(Physical.UINT64, "TeamId")
FLAG = ValueType(Physical.BOOL, "Flag")
SCHEMA = Schema(
    [
        TableDef(1, "users", [ColumnDef(1, "id", USER), ColumnDef(2, "name", TEXT), ColumnDef(3, "active", BOOL, True), ColumnDef(4, "team_id", TEAM, True), ColumnDef(5, "score", INT64, True), ColumnDef(6, "flag", FLAG)]),
        TableDef(2, "teams", [ColumnDef(1, "id", TEAM), ColumnDef(2, "owner_id", USER), ColumnDef(3, "name", TEXT)]),
        TableDef(3, "plain", [ColumnDef(1, "a", INT64), ColumnDef(2, "b", INT64, True), ColumnDef(3, "count", INT64), ColumnDef(4, "t", TEXT)]),
    ]
)


def shape(e):
    match e:
        case S.ColumnName():
            return e.written
        case S.Literal():
            return repr(e.value)
        case S.Not():
            return f"NOT({shape(e.operand)})"
        case S.IsNull():
            return f"{'NN' if e.negated else 'N'}({shape(e.operand)})"
    return f"({shape(e.left)} {e.op} {shape(e.right)})"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a = 1 OR b = 2 AND c = 3", "((a = 1) OR ((b = 2) AND (c = 3)))"),
        ("NOT a = 1 AND b", "(NOT((a = 1)) AND b)"),
        ("NOT NOT a", "NOT(NOT(a))"),
        ("a = b = c", "((a = b) = c)"),
        ("a = b IS NULL", "N((a = b))"),
        ("a IS NOT NULL IS NULL", "N(NN(a))"),
        ("NOT a IS NULL", "NOT(N(a))"),
        ("(a OR b) AND c", "((a OR b) AND c)"),
        ("a >= -5 AND t != 'x\\n'", "((a >= -5) AND (t != 'x\\\\n'))"),
        ("x.y < TRUE", "(x.y < True)"),
    ],
)
def test_precedence(text, want):
    assert shape(parse(f"SELECT a FROM t WHERE {text}").where) == want


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT a", "SELECT a FROM t WHERE", "SELECT *, a FROM t", "SELECT a FROM t LIMIT -1", "SELECT a FROM t LEFT OUTER JOIN u ON a", "SELECT a FROM t JOIN u", "SELECT avg(a) FROM t", "SELECT a FROM t WHERE a <> 1", "SELECT a + 1 FROM t", "SELECT a FROM t; x", "INSERT INTO t VALUES (1)", "SELECT a FROM t WHERE a = 'x", "SELECT a FROM t WHERE a = 99999999999999999999", "SELECT a FROM t ORDER BY 1", "SELECT a FROM t ORDER BY a NULLS", "UPDATE t SET a", "DELETE t", "SELECT a FROM t WHERE a = -"])
def test_rejected(text):
    with pytest.raises(CompileError) as e:
        parse(text)
    assert e.value.code is Code.PARSE and e.value.span.end <= len(text.encode())


def test_spans_count_bytes():
    with pytest.raises(CompileError) as e:
        parse("SELECT a FROM t WHERE t = 'é' AND é")
    assert e.value.span == Span(35, 37)
    assert parse("select COUNT , count(*) from t").items[0].name.text == "COUNT"


def code(sql):
    try:
        bind(SCHEMA, parse(sql))
    except CompileError as e:
        return e.code.value
    return None


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT id FROM users", None),
        ("SELECT ID FROM users", "unknown_column"),
        ("SELECT id FROM Users", "unknown_table"),
        ("SELECT x.id FROM users u", "unknown_relation_qualifier"),
        ("SELECT users.id FROM users u", "unknown_relation_qualifier"),
        ("SELECT id FROM users JOIN teams ON TRUE", "ambiguous_column"),
        ("SELECT name FROM users JOIN users ON TRUE", "duplicate_relation_name"),
        ("SELECT id FROM users WHERE id = 1", "incompatible_comparison"),
        ("SELECT id FROM users WHERE id = team_id", "incompatible_comparison"),
        ("SELECT u.id FROM users u JOIN teams t ON u.team_id = t.id AND t.owner_id = u.id", None),
        ("SELECT id FROM users WHERE score = 1 AND name < 'x'", None),
        ("SELECT id FROM users WHERE score = '1'", "incompatible_comparison"),
        ("SELECT id FROM users WHERE score", "type_mismatch"),
        ("SELECT id FROM users WHERE flag", "type_mismatch"),
        ("SELECT id FROM users WHERE flag = flag", None),
        ("SELECT id FROM users WHERE NOT flag", "type_mismatch"),
        ("SELECT id FROM users WHERE active AND NULL", None),
        ("SELECT id FROM users WHERE NULL", None),
        ("SELECT id FROM users WHERE NULL = NULL", None),
        ("SELECT id FROM users WHERE NULL IS NULL", None),
        ("SELECT id FROM users WHERE id = NULL", None),
        ("SELECT u.id FROM users u JOIN teams t ON t.id = c.id JOIN teams c ON TRUE", "unknown_relation_qualifier"),
        ("SELECT name, COUNT(*) FROM users", "ungrouped_column"),
        ("SELECT name, COUNT(*) FROM users GROUP BY name", None),
        ("SELECT users.name FROM users GROUP BY name", None),
        ("SELECT * FROM users GROUP BY name", "wildcard_not_supported_with_group_by"),
        ("SELECT COUNT(*) FROM users ORDER BY name", "order_by_not_supported_with_grouping"),
        ("SELECT SUM(*) FROM users", "invalid_aggregate_argument"),
        ("SELECT SUM(name) FROM users", "invalid_aggregate_type"),
        ("SELECT SUM(active) FROM users", "invalid_aggregate_type"),
        ("SELECT MAX(active), MIN(name), SUM(id) FROM users", None),
        ("SELECT count FROM plain WHERE count = 1", None),
        ("INSERT INTO plain (a) VALUES (1, 2)", "value_count_mismatch"),
        ("INSERT INTO plain (a, a) VALUES (1, 2)", "duplicate_column"),
        ("INSERT INTO plain (a) VALUES (1)", "missing_required_column"),
        ("INSERT INTO plain (a, count, t) VALUES (b, 1, 'x')", "insert_value_references_column"),
        ("INSERT INTO plain (a, count, t) VALUES (NULL, 1, 'x')", "null_not_allowed"),
        ("INSERT INTO plain (a, count, t) VALUES (1, 1, 2)", "type_mismatch"),
        ("INSERT INTO plain (a, count, t) VALUES (1, 1, 'x')", None),
        ("UPDATE plain SET a = b", "null_not_allowed"),
        ("UPDATE plain SET b = a, b = 1", "duplicate_column"),
        ("UPDATE users SET flag = TRUE", None),
        ("UPDATE users SET id = 1", "type_mismatch"),
        ("UPDATE users SET active = score = 1", None),
        ("DELETE FROM plain WHERE a", "type_mismatch"),
    ],
)
def test_binding(sql, want):
    assert code(sql) == want


def test_types_of_results():
    q = bind(SCHEMA, parse("SELECT COUNT(*), SUM(id), MAX(id), users.team_id FROM users GROUP BY team_id"))
    assert [(f.name, str(f.type), f.nullable) for f in q.fields] == [("COUNT(*)", "UINT64", False), ("SUM(id)", "UINT64", True), ("MAX(id)", "UserId", True), ("team_id", "TeamId", True)]
    assert [f.name for f in bind(SCHEMA, parse("SELECT min(users.score) FROM users")).fields] == ["MIN(users.score)"]


def test_access():
    s = bind(SCHEMA, parse("SELECT t.id FROM teams t JOIN users u ON TRUE JOIN teams x ON TRUE"))
    assert L.read_tables(s) == [2, 1] and L.write_tables(s) == []
    d = bind(SCHEMA, parse("DELETE FROM plain"))
    assert L.read_tables(d) == [] and L.write_tables(d) == [3]


def test_fingerprint_says_everything():
    t = SCHEMA.tables[0]
    seen = {t.fingerprint()}
    c = t.columns[0]
    for other in (ColumnDef(9, c.name, c.type), ColumnDef(c.id, "other", c.type), ColumnDef(c.id, c.name, TEAM), ColumnDef(c.id, c.name, c.type, True), ColumnDef(c.id, c.name, c.type, False, True)):
        seen.add(TableDef(t.id, t.name, [other, *t.columns[1:]]).fingerprint())
    assert len(seen) == 6 and t.fingerprint() == TableDef(t.id, t.name, t.columns).fingerprint()
    small = TableDef(7, "t", [ColumnDef(1, "c", ValueType(Physical.INT64, "N"), True)])
    assert small.canonical() == b"NBTS\x01\0\0\0\x07\0\0\0\0\0\0\0\x01\0\0\0t\x01\0\0\0\x01\0\0\0\x01\0\0\0c\x02\x01\x01\0\0\0N\x01\0"


def test_schema_documents():
    assert load_schema(dump_schema(SCHEMA)) == SCHEMA
    doc = json.loads(dump_schema(SCHEMA))
    for spoil in (lambda d: d.update(extra=1), lambda d: d.update(version=2), lambda d: d["tables"][0].pop("id"), lambda d: d["tables"][0]["columns"][0].update(physical_type="float"), lambda d: d["tables"][1].update(name="users"), lambda d: d["tables"][0]["columns"][1].update(name="id"), lambda d: d["tables"][0].update(id="1")):
        bad = json.loads(json.dumps(doc))
        spoil(bad)
        with pytest.raises(SchemaError):
            load_schema(json.dumps(bad))
    with pytest.raises(SchemaError):
        load_schema('{"version": 1, "version": 1, "tables": []}')
    with pytest.raises(SchemaError):
        TableDef(1, "", [])
    assert TableDef(1, "none", []).columns == ()
