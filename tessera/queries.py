"""The dialect's queries over the test tables, each beside the same query as plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .errors import TypeMismatch
from .repl import demo

FLAGSHIP = "revenue"

#: name: (table, statement of the dialect, plain SQL)
QUERIES: dict[str, tuple[str, str, str]] = {
    "revenue": (
        "lineitem",
        "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_quantity > 25.0 AND l_returnflag = 'R'",
        "SELECT l_orderkey, l_extendedprice * (CAST(1 AS DOUBLE) - l_discount) AS revenue FROM lineitem WHERE l_quantity > CAST(25.0 AS DOUBLE) AND l_returnflag = 'R'",
    ),
    "scan_star": ("nation", "SELECT * FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"),
    "scan_lineitem": (
        "lineitem",
        "SELECT * FROM lineitem",
        "SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem",
    ),
    "project_cols": ("orders", "SELECT o_orderkey, o_orderstatus FROM orders", "SELECT o_orderkey, o_orderstatus FROM orders"),
    "alias_explicit": ("customer", "SELECT c_custkey AS id FROM customer", "SELECT c_custkey AS id FROM customer"),
    "alias_implicit": ("customer", "SELECT c_custkey id, c_name nm FROM customer", "SELECT c_custkey AS id, c_name AS nm FROM customer"),
    "alias_quoted": ("customer", 'SELECT c_custkey id, c_acctbal AS "Balance" FROM customer', 'SELECT c_custkey AS id, c_acctbal AS "Balance" FROM customer'),
    "default_name": ("orders", "SELECT o_orderkey + 1 FROM orders", 'SELECT o_orderkey + CAST(1 AS BIGINT) AS "?column?" FROM orders'),
    "mixed_star": ("region", "SELECT r_name rn, * FROM region", "SELECT r_name AS rn, CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"),
    "commas_optional": ("orders", "SELECT o_orderkey 5 five FROM orders", "SELECT o_orderkey, CAST(5 AS BIGINT) AS five FROM orders WHERE TRUE"),
    "quoted_reserved": ("documents", 'SELECT doc_id, "text" FROM documents', "SELECT doc_id, text FROM documents"),
    "literals": (
        "supplier",
        "SELECT s_suppkey, 7 AS i, 2.5 AS f, 'x' AS t, TRUE AS b FROM supplier",
        "SELECT s_suppkey, CAST(7 AS BIGINT) AS i, CAST(2.5 AS DOUBLE) AS f, 'x' AS t, TRUE AS b FROM supplier",
    ),
    "arith_add": ("lineitem", "SELECT l_orderkey, l_extendedprice + l_tax AS v FROM lineitem", "SELECT l_orderkey, l_extendedprice + l_tax AS v FROM lineitem"),
    "arith_sub": ("lineitem", "SELECT l_orderkey, l_partkey - l_suppkey AS v FROM lineitem", "SELECT l_orderkey, l_partkey - l_suppkey AS v FROM lineitem"),
    "arith_mul": (
        "lineitem",
        "SELECT l_orderkey, l_extendedprice * (1 - l_discount) + l_tax AS v FROM lineitem",
        "SELECT l_orderkey, l_extendedprice * (CAST(1 AS DOUBLE) - l_discount) + l_tax AS v FROM lineitem",
    ),
    "int_div": ("lineitem", "SELECT l_orderkey, (0 - l_partkey) / 7 AS q FROM lineitem", "SELECT l_orderkey, (CAST(0 AS BIGINT) - l_partkey) // CAST(7 AS BIGINT) AS q FROM lineitem"),
    "float_div": ("orders", "SELECT o_orderkey, o_totalprice / 3 AS q FROM orders", "SELECT o_orderkey, o_totalprice / CAST(3 AS DOUBLE) AS q FROM orders"),
    "cmp_eq_int": ("part", "SELECT p_partkey FROM part WHERE p_size = 10", "SELECT p_partkey FROM part WHERE p_size = 10"),
    "cmp_ne_int": ("part", "SELECT p_partkey FROM part WHERE p_size != 10", "SELECT p_partkey FROM part WHERE p_size <> 10"),
    "cmp_gt": ("part", "SELECT p_partkey FROM part WHERE p_size > 10", "SELECT p_partkey FROM part WHERE p_size > 10"),
    "cmp_lt": ("part", "SELECT p_partkey FROM part WHERE p_size < 10", "SELECT p_partkey FROM part WHERE p_size < 10"),
    "cmp_ge": ("part", "SELECT p_partkey FROM part WHERE p_size >= 10", "SELECT p_partkey FROM part WHERE p_size >= 10"),
    "cmp_le": ("part", "SELECT p_partkey FROM part WHERE p_size <= 10", "SELECT p_partkey FROM part WHERE p_size <= 10"),
    "eq_float_eps": (
        "lineitem",
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount = 0.05",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE abs(l_discount - CAST(0.05 AS DOUBLE)) < CAST(2.220446049250313e-16 AS DOUBLE)",
    ),
    "eq_float_expr": (
        "lineitem",
        "SELECT l_orderkey, (l_discount + 0.1) - 0.1 = l_discount AS same FROM lineitem",
        "SELECT l_orderkey, abs(((l_discount + CAST(0.1 AS DOUBLE)) - CAST(0.1 AS DOUBLE)) - l_discount) < CAST(2.220446049250313e-16 AS DOUBLE) AS same FROM lineitem",
    ),
    "eq_int_float": (
        "part",
        "SELECT p_partkey FROM part WHERE p_size = 10.0",
        "SELECT p_partkey FROM part WHERE abs(CAST(p_size AS DOUBLE) - CAST(10 AS DOUBLE)) < CAST(2.220446049250313e-16 AS DOUBLE)",
    ),
    "int_lt_float": ("customer", "SELECT c_custkey FROM customer WHERE 1000 < c_acctbal", "SELECT c_custkey FROM customer WHERE CAST(1000 AS DOUBLE) < c_acctbal"),
    "eq_text": ("customer", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "ne_text": ("customer", "SELECT c_custkey FROM customer WHERE c_mktsegment != 'BUILDING'", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "text_order": ("nation", "SELECT n_name, n_name > 'M' AS gt, n_name >= 'M' AS ge FROM nation", "SELECT n_name, FALSE AS gt, TRUE AS ge FROM nation"),
    "bool_cmp": ("supplier", "SELECT s_suppkey, (5000.0 < s_acctbal) = TRUE AS rich FROM supplier", "SELECT s_suppkey, (CAST(5000 AS DOUBLE) < s_acctbal) = TRUE AS rich FROM supplier"),
    "and_or_where": (
        "lineitem",
        "SELECT l_orderkey, l_partkey FROM lineitem WHERE (l_quantity > 25.0 AND l_discount < 0.05) OR l_returnflag = 'A'",
        "SELECT l_orderkey, l_partkey FROM lineitem WHERE (l_quantity > CAST(25 AS DOUBLE) AND l_discount < CAST(0.05 AS DOUBLE)) OR l_returnflag = 'A'",
    ),
    "and_or_project": (
        "lineitem",
        "SELECT l_orderkey, l_quantity > 25.0 AND l_tax < 0.04 AS f, l_quantity > 25.0 OR l_tax < 0.04 AS g FROM lineitem",
        "SELECT l_orderkey, COALESCE(l_quantity > CAST(25 AS DOUBLE) AND l_tax < CAST(0.04 AS DOUBLE), FALSE) AS f, COALESCE(l_quantity > CAST(25 AS DOUBLE) OR l_tax < CAST(0.04 AS DOUBLE), FALSE) AS g FROM lineitem",
    ),
    "guarded_div": (
        "region",
        "SELECT r_regionkey FROM region WHERE r_regionkey != 0 AND 10 / r_regionkey > 2",
        "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey FROM region WHERE CASE WHEN r_regionkey <> 0 THEN 10 // r_regionkey > 2 ELSE FALSE END",
    ),
    "is_null": ("events", "SELECT event_id, props IS NULL AS n FROM events", "SELECT event_id, props IS NULL AS n FROM events"),
    "is_not_null": ("events", "SELECT event_id FROM events WHERE props IS NOT NULL", "SELECT event_id FROM events WHERE props IS NOT NULL"),
    "is_true": ("events", "SELECT event_id, (100.0 < value) IS TRUE AS x FROM events", "SELECT event_id, COALESCE(CAST(100 AS DOUBLE) < value, FALSE) AS x FROM events"),
    "is_not_true": ("events", "SELECT event_id, (value > 100.0) IS NOT TRUE AS x FROM events", "SELECT event_id, NOT COALESCE(value > CAST(100 AS DOUBLE), FALSE) AS x FROM events"),
    "is_not_false": ("events", "SELECT event_id, (value > 100.0) IS NOT FALSE AS x FROM events", "SELECT event_id, COALESCE(value > CAST(100 AS DOUBLE), TRUE) AS x FROM events"),
    "is_precedence": ("events", "SELECT event_id, TRUE = event_type IS NOT NULL AS x FROM events", "SELECT event_id, TRUE = (event_type IS NOT NULL) AS x FROM events"),
    "precedence_arith": (
        "orders",
        "SELECT o_orderkey + 2 * 3 - 4 / 2 AS v FROM orders",
        "SELECT o_orderkey + CAST(2 AS BIGINT) * CAST(3 AS BIGINT) - CAST(4 AS BIGINT) // CAST(2 AS BIGINT) AS v FROM orders",
    ),
    "timestamp_passthrough": ("events", "SELECT event_id, ts FROM events WHERE ts IS NOT NULL", "SELECT event_id, ts FROM events WHERE ts IS NOT NULL"),
}

_USERS = "(VALUES (CAST(1 AS BIGINT), 'Alice', CAST(30 AS BIGINT), CAST(NULL AS BOOLEAN)), (2, 'Bob', NULL, FALSE), (3, 'Charlie', 35, TRUE)) AS t(id, name, age, is_active)"
#: The same over the demonstration tables: name: (statement, plain SQL)
CREATED: dict[str, tuple[str, str]] = {
    "create_insert_scan": ("SELECT * FROM users", f"SELECT id, name, age, is_active FROM {_USERS}"),
    "created_filter": ("SELECT id, name, age FROM users WHERE name = 'Alice' AND (10 + 10) < age", f"SELECT id, name, age FROM {_USERS} WHERE id = 1"),
    "created_two_valued": (
        "SELECT id, is_active AND TRUE AS a, (age > 30 OR is_active) = FALSE AS b, is_active IS NOT FALSE AS c FROM users",
        f"SELECT id, COALESCE(is_active, FALSE) AS a, COALESCE(age > 30, FALSE) = FALSE AND COALESCE(is_active, FALSE) = FALSE AS b, COALESCE(is_active, TRUE) AS c FROM {_USERS}",
    ),
}

#: Tables made by statements of the dialect, for what the test tables don't hold: name: (statement, rows)
MADE: dict[str, tuple[str, list[tuple]]] = {
    "nulls": (
        "CREATE TABLE nulls (id INT PRIMARY KEY NOT NULL, a INT, b INT, f FLOAT, p BOOL, q BOOL, t STRING)",
        [
            (1, 0, 2, 0.0, True, True, ""),
            (2, 1, None, 0.1, True, False, "a"),
            (3, -7, 1, 0.30000000000000004, True, None, "B"),
            (4, None, 2, None, False, True, "é"),
            (5, 0, None, 0.3, False, False, None),
            (6, 1, 1, 2.0, False, None, "a"),
            (7, -7, 2, 0.1, None, True, "b"),
            (8, None, None, -0.5, None, False, ""),
            (9, 2, 1, None, None, None, None),
        ],
    ),
    "guards": ("CREATE TABLE guards (x INT)", [(0,), (1,), (2,), (None,)]),
    "vc": ("CREATE TABLE vc (s VARCHAR(3) UNIQUE)", [("abc",), ("é",), ("",), (None,)]),
    "nans": ("CREATE TABLE nans (id INT, f FLOAT)", [(1, float("nan")), (2, 1.0), (3, 2.5), (4, float("inf")), (5, float("-inf")), (6, None)]),
    "case_names": ('CREATE TABLE case_names (Id INT, id INT, "text" TEXT, "a b" INT, u.name TEXT)', [(1, 2, "t", 3, "n")]),
}
#: Rows that a created table turns down, of which none may come up.
TURNED_DOWN: dict[str, list[tuple]] = {"vc": [("éé",), ("abcd",)], "nulls": [(None, 0, 0, 0.0, True, True, "")]}


def _values(name: str, columns: str, kinds: str) -> str:
    """A made table's rows as plain SQL."""

    def literal(v: object, kind: str) -> str:
        return f"CAST({'NULL' if v is None else repr(str(v)) if isinstance(v, (str, float)) else str(v)} AS {kind})"

    rows = ", ".join("(" + ", ".join(literal(v, k) for v, k in zip(r, kinds.split(), strict=True)) + ")" for r in MADE[name][1])
    return f"(VALUES {rows}) AS t({columns})"


_NULLS = _values("nulls", "id, a, b, f, p, q, t", "BIGINT BIGINT BIGINT DOUBLE BOOLEAN BOOLEAN VARCHAR")
_GUARDS = _values("guards", "x", "BIGINT")
_NANS = _values("nans", "id, f", "BIGINT DOUBLE")
_EPS = "CAST(2.220446049250313e-16 AS DOUBLE)"
_TEXT_ORDER = "CASE WHEN t IS NOT NULL THEN {} END"
_BOOL_ORDER = "CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN {} END"
#: The same over tables made by statements: name: (table, statement, plain SQL)
STATEMENTS: dict[str, tuple[str, str, str]] = {
    "create_statement": ("nulls", "SELECT * FROM nulls", f"SELECT * FROM {_NULLS}"),
    "nulls_is_null": ("nulls", "SELECT id, a IS NULL AS an, a IS NOT NULL AS ap, f IS NULL AS fn, t IS NULL AS tn, (a + b) IS NULL AS sn FROM nulls", f"SELECT id, a IS NULL AS an, a IS NOT NULL AS ap, f IS NULL AS fn, t IS NULL AS tn, a + b IS NULL AS sn FROM {_NULLS}"),
    "nulls_is_true": ("nulls", "SELECT id, p IS TRUE AS t1, p IS NOT TRUE AS t2, (a < b) IS TRUE AS t3 FROM nulls", f"SELECT id, COALESCE(p, FALSE) AS t1, NOT COALESCE(p, FALSE) AS t2, COALESCE(a < b, FALSE) AS t3 FROM {_NULLS}"),
    "nulls_is_false": ("nulls", "SELECT id, p IS FALSE AS f1, p IS NOT FALSE AS f2, (a < b) IS FALSE AS f3 FROM nulls", f"SELECT id, NOT COALESCE(p, TRUE) AS f1, COALESCE(p, TRUE) AS f2, NOT COALESCE(a < b, TRUE) AS f3 FROM {_NULLS}"),
    "nulls_where_is": ("nulls", "SELECT id FROM nulls WHERE p IS NOT TRUE AND t IS NOT NULL", f"SELECT id FROM {_NULLS} WHERE NOT COALESCE(p, FALSE) AND t IS NOT NULL"),
    "nulls_and": ("nulls", "SELECT id, p AND q AS x, (p AND q) = FALSE AS z, (p AND q) IS NULL AS n FROM nulls", f"SELECT id, COALESCE(p AND q, FALSE) AS x, COALESCE(p AND q, FALSE) = FALSE AS z, FALSE AS n FROM {_NULLS}"),
    "nulls_or": ("nulls", "SELECT id, p OR q AS x, (p OR q) = FALSE AS z, (p OR q) IS NULL AS n FROM nulls", f"SELECT id, COALESCE(p, FALSE) OR COALESCE(q, FALSE) AS x, NOT (COALESCE(p, FALSE) OR COALESCE(q, FALSE)) AS z, FALSE AS n FROM {_NULLS}"),
    "nulls_where_logic": ("nulls", "SELECT id FROM nulls WHERE (p AND TRUE) = FALSE OR q", f"SELECT id FROM {_NULLS} WHERE NOT COALESCE(p, FALSE) OR COALESCE(q, FALSE)"),
    "nulls_compare_int": ("nulls", "SELECT id, a = b AS eq, a != b AS ne, a < b AS lt, a > b AS gt, a <= b AS le, a >= b AS ge FROM nulls", f"SELECT id, a = b AS eq, a <> b AS ne, a < b AS lt, a > b AS gt, a <= b AS le, a >= b AS ge FROM {_NULLS}"),
    "nulls_compare_float": (
        "nulls",
        "SELECT id, f = 0.3 AS eq, f != 0.3 AS ne, f < 0.1 AS lt, f > 0.1 AS gt, f <= 0.1 AS le, f >= 0.1 AS ge, a < f AS mixed, b != f AS far FROM nulls",
        f"SELECT id, abs(f - CAST(0.3 AS DOUBLE)) < {_EPS} AS eq, NOT abs(f - CAST(0.3 AS DOUBLE)) < {_EPS} AS ne, f < CAST(0.1 AS DOUBLE) AS lt, f > CAST(0.1 AS DOUBLE) AS gt, "
        f"f <= CAST(0.1 AS DOUBLE) AS le, f >= CAST(0.1 AS DOUBLE) AS ge, CAST(a AS DOUBLE) < f AS mixed, NOT abs(CAST(b AS DOUBLE) - f) < {_EPS} AS far FROM {_NULLS}",
    ),
    "nulls_ne_float_where": ("nulls", "SELECT id FROM nulls WHERE f != 0.1", f"SELECT id FROM {_NULLS} WHERE NOT abs(f - CAST(0.1 AS DOUBLE)) < {_EPS}"),
    "nulls_compare_text": (
        "nulls",
        "SELECT id, t = 'a' AS eq, t != 'a' AS ne, t < 'b' AS lt, t > 'A' AS gt, t <= 'A' AS le, t >= 'b' AS ge FROM nulls",
        f"SELECT id, t = 'a' AS eq, t <> 'a' AS ne, {_TEXT_ORDER.format('FALSE')} AS lt, {_TEXT_ORDER.format('FALSE')} AS gt, {_TEXT_ORDER.format('TRUE')} AS le, {_TEXT_ORDER.format('TRUE')} AS ge FROM {_NULLS}",
    ),
    "nulls_compare_bool": (
        "nulls",
        "SELECT id, p = q AS eq, p != q AS ne, p < q AS lt, p > q AS gt, p <= q AS le, p >= q AS ge FROM nulls",
        f"SELECT id, p = q AS eq, p <> q AS ne, {_BOOL_ORDER.format('FALSE')} AS lt, {_BOOL_ORDER.format('FALSE')} AS gt, {_BOOL_ORDER.format('TRUE')} AS le, {_BOOL_ORDER.format('TRUE')} AS ge FROM {_NULLS}",
    ),
    "nulls_arithmetic": (
        "nulls",
        "SELECT id, a + b AS s, a - b AS d, a * b AS m, a / b AS q, a / 2 AS h, f * a AS fm, f / 4 AS fq FROM nulls",
        f"SELECT id, a + b AS s, a - b AS d, a * b AS m, a // b AS q, a // CAST(2 AS BIGINT) AS h, f * CAST(a AS DOUBLE) AS fm, f / CAST(4 AS DOUBLE) AS fq FROM {_NULLS}",
    ),
    "guarded_and": ("guards", "SELECT x FROM guards WHERE x != 0 AND 10 / x > 5", f"SELECT x FROM {_GUARDS} WHERE x = 1"),
    "guarded_or": ("guards", "SELECT x, x = 0 OR 10 / x > 5 AS f FROM guards WHERE x = 0 OR 10 / x > 4", f"SELECT x, CASE WHEN x = 0 THEN TRUE ELSE 10 // nullif(x, 0) > 5 END AS f FROM {_GUARDS} WHERE x IS NOT NULL"),
    "guarded_two_valued": ("guards", "SELECT x FROM guards WHERE ((x > 0) AND TRUE) = FALSE", f"SELECT x FROM {_GUARDS} WHERE NOT COALESCE(x > 0, FALSE)"),
    "varchar_bytes": ("vc", "SELECT s FROM vc WHERE s != 'x'", f"SELECT s FROM {_values('vc', 's', 'VARCHAR')} WHERE s IS NOT NULL"),
    "case_names": ("case_names", 'SELECT Id AS x, id AS y, "text" AS t, "a b" AS ab, u.name AS un FROM case_names', "SELECT CAST(1 AS BIGINT) AS x, CAST(2 AS BIGINT) AS y, 't' AS t, CAST(3 AS BIGINT) AS ab, 'n' AS un"),
    "nan_ieee": (
        "nans",
        "SELECT id, f > 1.0 AS gt, f < 1.0 AS lt, f >= 1.0 AS ge, f <= 1.0 AS le, f = f AS same FROM nans",
        "SELECT id, f > CAST(1 AS DOUBLE) AND NOT isnan(f) AS gt, f < CAST(1 AS DOUBLE) AS lt, f >= CAST(1 AS DOUBLE) AS ge, f <= CAST(1 AS DOUBLE) OR isnan(f) AS le, "
        f"NOT isnan(f) AND NOT isinf(f) AS same FROM {_NANS}",
    ),
}


def _made(spark: SparkSession, name: str) -> DataFrame:
    """A query over a table that a statement makes, after rows that fit it and ones that it turns down."""
    table, text, _ = STATEMENTS[name]
    engine = Engine(spark, ieee_nan=name == "nan_ieee")
    engine.sql(MADE[table][0])
    engine.insert(table, MADE[table][1])
    for row in TURNED_DOWN.get(table, []):
        try:
            engine.insert(table, [row])
        except TypeMismatch:
            continue
        raise AssertionError(f"{table} took {row}")
    return engine.sql(text)


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in STATEMENTS:
        return _made(spark, name)
    engine = Engine(spark)
    if name in CREATED:
        demo(engine)
        return engine.sql(CREATED[name][0])
    table, text, _ = QUERIES[name]
    engine.register_parquet(table, f"{sf_dir}/{table}.parquet")
    return engine.sql(text)


def oracles() -> dict[str, str]:
    return {k: v[-1] for k, v in (QUERIES | CREATED | STATEMENTS).items()}
