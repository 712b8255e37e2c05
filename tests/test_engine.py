"""Binding, evaluation and tables, on small tables with nulls, against a row-at-a-time evaluator."""

import io
import itertools
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from tessera import BOOL, FLOAT64, INT64, TEXT, ColumnNotFound, Engine, EvaluationError, InvalidQuery, SerializationError, StorageError, TableNotFound, TypeMismatch, column, varchar
from tessera.functions.lowering import EPSILON
from tessera.plans.binder import ARITHMETIC, BinaryOp, Col, Const
from tessera.repl import demo, loop
from tessera.types import accepts, render

ROWS = [
    (i, a, b, f, p, q, t)
    for i, ((p, q), a, b, f, t) in enumerate(
        zip(itertools.product((True, False, None), repeat=2), itertools.cycle((0, 1, -7, None)), itertools.cycle((2, None, 1)), itertools.cycle((0.0, 0.1, 0.30000000000000004, None, 2.0)), itertools.cycle(("", "a", "B", "é", None)))
    )
]
COLUMNS = [column("id", INT64, False), column("a"), column("b"), column("f", FLOAT64), column("p", BOOL), column("q", BOOL), column("t", TEXT)]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.create_table("n", COLUMNS)
    e.insert("n", ROWS)
    demo(e)
    return e


def value(expr, row):
    """The dialect's value of a bound expression for one row."""
    if isinstance(expr, Const):
        return expr.value
    if isinstance(expr, Col):
        return row[expr.index]
    if not isinstance(expr, BinaryOp):
        inner = value(expr.expr, row)
        return (inner is expr.what if expr.what is not None else inner is None) != expr.negated
    a = value(expr.left, row)
    if expr.op == "AND":
        return a is True and value(expr.right, row) is True
    if expr.op == "OR":
        return a is True or value(expr.right, row) is True
    b = value(expr.right, row)
    if a is None or b is None:
        return None
    if expr.op in ARITHMETIC:
        if expr.op == "/":
            if b == 0:
                raise ZeroDivisionError
            return a / b if isinstance(a, float) or isinstance(b, float) else int(math.copysign(abs(a) // abs(b), a * b)) if a else 0
        return {"+": a + b, "-": a - b, "*": a * b}[expr.op]
    same = abs(a - b) < EPSILON if isinstance(a, float) or isinstance(b, float) else a == b
    less, more = (a < b, a > b) if expr.left.type.is_numeric else (False, False)
    return {"=": same, "!=": not same, "<": less, ">": more, "<=": not more, ">=": not less}[expr.op]


def check(engine, text):
    plan = engine.plan(text)
    kept = [r for r in ROWS if plan.where is None or value(plan.where, r) is True]
    want = [tuple(value(o.expr, r) for o in plan.outputs) for r in kept]
    got = [tuple(r) for r in engine.sql(text).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)), text


numbers = st.deferred(lambda: st.one_of(st.sampled_from(["a", "b", "f", "0", "1", "2", "0.1", "2.0"]), st.tuples(numbers, st.sampled_from("+-*"), numbers).map(lambda x: f"({x[0]} {x[1]} {x[2]})")))
booleans = st.deferred(
    lambda: st.one_of(
        st.sampled_from(["p", "q", "TRUE", "FALSE", "f = 0.1", "f = 2.0", "f != 0.3", "0.1 = f"]),
        st.tuples(numbers, st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), numbers).map(lambda x: f"({x[0]} {x[1]} {x[2]})"),
        st.tuples(st.sampled_from(["t", "'a'"]), st.sampled_from(["=", "!=", "<", ">="]), st.sampled_from(["t", "'B'"])).map(" ".join).map("({})".format),
        st.tuples(booleans, st.sampled_from(["=", "<", ">=", "AND", "OR"]), booleans).map(lambda x: f"({x[0]}) {x[1]} ({x[2]})"),
        st.tuples(booleans, st.sampled_from(["IS TRUE", "IS NOT TRUE", "IS FALSE", "IS NOT FALSE", "IS NULL", "IS NOT NULL"])).map(lambda x: f"({x[0]}) {x[1]}"),
        st.sampled_from(["a != 0 AND 10 / a > 1", "a = 0 OR 10 / a > 1", "f != 0.0 AND 1 / f < 20.0"]),
    )
)


@settings(max_examples=60, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(booleans, booleans, numbers)
def test_random_expressions(engine, where, shown, number):
    text = f"SELECT id, {shown} AS s, {number} AS v FROM n WHERE {where}"
    try:
        engine.plan(text)
    except TypeMismatch:
        return
    check(engine, text)


@pytest.mark.parametrize("text", ["SELECT id, p AND q AS x, p OR q AS y FROM n", "SELECT id FROM n WHERE ((a > 0) AND TRUE) = FALSE", "SELECT id FROM n WHERE a != 0 AND 10 / a > 1", "SELECT id, t > 'A' AS x, t <= 'A' AS y, p < q AS z FROM n",
                                  "SELECT id, f = 0.1 + 0.2 AS x FROM n WHERE f = 0.3 OR f IS NULL", "SELECT id, (0 - 7) / b AS x FROM n", "SELECT id, a = b IS NULL FROM n WHERE TRUE = a IS NULL", "SELECT FROM n WHERE p"])
def test_semantics(engine, text):
    if "a = b IS NULL" in text:
        with pytest.raises(TypeMismatch):
            engine.plan(text)
    else:
        check(engine, text)


def test_goldens(engine):
    rows = lambda q: sorted(map(tuple, engine.sql(q).collect()))
    assert rows("SELECT * FROM users WHERE age > 25") == [(1, "Alice", 30, None), (3, "Charlie", 35, True)]
    assert rows("SELECT id, name FROM users") == [(1, "Alice"), (2, "Bob"), (3, "Charlie")]
    assert rows("SELECT id, name, age FROM users WHERE name = 'Alice' AND (10 + 10) < age;") == [(1, "Alice", 30)]
    assert rows("SELECT * FROM customers") == []
    assert engine.sql("SELECT id + 1, id x FROM users").columns == ["?column?", "x"]


@pytest.mark.parametrize("text,error", [("SELECT x FROM n", ColumnNotFound), ("SELECT ID FROM n", ColumnNotFound), ("SELECT * FROM x", TableNotFound), ("SELECT id FROM n WHERE a", TypeMismatch), ("SELECT id FROM n WHERE f > 1", TypeMismatch),
                                        ("SELECT t + 1 FROM n", TypeMismatch), ("SELECT a IS TRUE FROM n", TypeMismatch), ("SELECT a AND p FROM n", TypeMismatch), ("SELECT COUNT(*) FROM n", ColumnNotFound), ("SELECT a < b < 1 FROM n", TypeMismatch)])
def test_bind_errors(engine, text, error):
    with pytest.raises(error):
        engine.sql(text)


@pytest.mark.parametrize("text", ["SELECT 1 / a FROM n", "SELECT 1.0 / f FROM n", "SELECT id + 9223372036854775807 + 9223372036854775807 FROM n"])
def test_run_errors(engine, text):
    with pytest.raises(PySparkException):
        engine.sql(text).collect()


def test_extended(spark):
    e = Engine(spark, extended=True)
    e.create_table("n", COLUMNS)
    e.insert("n", ROWS)
    assert e.sql("SELECT id FROM n WHERE f > 1").count() == sum(1 for r in ROWS if r[3] is not None and r[3] > 1)
    assert e.sql("SELECT id FROM n WHERE t > 'A'").count() == sum(1 for r in ROWS if r[6] is not None and r[6] > "A")


def test_nan(spark):
    frame = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.0), (4, None)], "id long, f double")
    for ieee, want in ((False, {1: True, 2: True, 3: False, 4: None}), (True, {1: False, 2: True, 3: False, 4: None})):
        e = Engine(spark, ieee_nan=ieee)
        e.register("x", frame)
        assert {r.id: r.g for r in e.sql("SELECT id, f > 2.0 AS g FROM x").collect()} == want
    assert {r.id: r.g for r in e.sql("SELECT id, f = f AS g FROM x").collect()} == {1: False, 2: False, 3: True, 4: None}


def test_tables(spark, tmp_path):
    e = Engine(spark)
    e.sql('CREATE TABLE c (Id INT NOT NULL, id INT, "text" TEXT, "a b" TEXT, "u.name" VARCHAR(3))')
    assert e.insert("c", [(1, 2, "x", "y", "abc"), (3, None, None, None, "é")]) == 2
    assert [tuple(r) for r in e.sql('SELECT id, Id, "text", "a b", u.name FROM c WHERE u.name = \'abc\'').collect()] == [(2, 1, "x", "y", "abc")]
    for row, error in (((None, 1, "", "", ""), TypeMismatch), ((1, 1, "", "", "éé"), TypeMismatch), ((1, 1, "", "", "abcd"), TypeMismatch), ((1,), SerializationError), ((True, 1, "", "", ""), TypeMismatch)):
        with pytest.raises(error):
            e.insert("c", [row])
    assert e.table("c").count() == 2 and e.tables() == ["c"]
    with pytest.warns(UserWarning):
        e.create_table("c", [column("x", varchar(2))], path=str(tmp_path / "c"))
    e.insert("c", [("a",)])
    e.flush("c")
    e.insert("c", [("b",)])
    assert sorted(r.x for r in e.table("c").collect()) == ["a", "b"] and e.schema("c")[0][0] == "x"
    e.drop_table("c")
    with pytest.raises(TableNotFound):
        e.table("c")
    with pytest.raises(InvalidQuery):
        e.plan("CREATE TABLE x (a INT)")
    e.register("v", spark.range(3))
    with pytest.raises(StorageError):
        e.insert("v", [(1,)])


def test_data_folder(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert e.load() == []
    e.create_table("t", [column("id", INT64, False), column("name", TEXT)])
    e.insert("t", [(1, "a"), (2, None), (3, "a")])
    e.flush("t")
    other = Engine(spark, str(tmp_path))
    assert other.load() == ["t"] and sorted(r.id for r in other.lookup("t", "name", "a").collect()) == [1, 3]
    assert other.lookup("t", "name", None).count() == 0 and e.lookup("t", "id", 2).count() == 1
    with pytest.raises(ColumnNotFound):
        other.lookup("t", "x", 1)
    with pytest.raises(TypeMismatch):
        other.lookup("t", "id", "1")
    with pytest.raises(EvaluationError):
        e.rows("SELECT 1 / (id - 1) FROM t")
    with pytest.raises(StorageError):
        Engine(spark).load()


def test_unsupported_column(spark):
    e = Engine(spark)
    e.register("v", spark.createDataFrame([(1, [1.0])], "id int, v array<float>"))
    assert e.sql("SELECT id FROM v").dtypes == [("id", "bigint")]
    with pytest.raises(TypeMismatch):
        e.sql("SELECT * FROM v")


def test_pushdown(spark):
    e = Engine(spark)
    e.register_parquet("lineitem", "/root/testdata/sf0.001/lineitem.parquet")
    plan = e.explain("SELECT l_orderkey FROM lineitem WHERE l_quantity > 15.0 AND l_returnflag = 'R' AND l_discount = 0.05 AND l_linenumber = 3 AND l_tax >= 0.01")
    for text in ("GreaterThan(l_quantity,15.0)", "EqualTo(l_returnflag,R)", "GreaterThanOrEqual(l_discount,", "EqualTo(l_linenumber,3)", "GreaterThanOrEqual(l_tax,0.01)"):
        assert text in plan
    assert "l_comment" not in plan and "Exchange" not in plan and "l_suppkey" not in plan.split("ReadSchema")[1]


def test_stream(spark, tmp_path):
    from tessera.streaming import start

    spark.range(10).write.parquet(str(tmp_path / "in"))
    e = Engine(spark)
    e.register("s", spark.readStream.schema("id long").parquet(str(tmp_path / "in")))
    q = start(e.sql("SELECT id * 2 AS d FROM s WHERE id > 6"), "parquet", str(tmp_path / "ck"), str(tmp_path / "out"))
    q.awaitTermination()
    assert sorted(r.d for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [14, 16, 18]


def test_prompt(engine):
    out = io.StringIO()
    loop(engine, io.StringIO("SELECT id, name FROM users WHERE id = 1\nSELECT x FROM users\nSELECT 1 / 0 FROM users\nSELECT * FROM customers\n\nexit\nSELECT"), out)
    assert "Row #    | id           | name        \n--------" in out.getvalue().replace("DB: ", "") and "0        | 1            | Alice" in out.getvalue()
    assert "Column not found: x" in out.getvalue() and "Empty set (0 rows)" in out.getvalue() and "Evaluation error" in out.getvalue()


def test_scalars():
    assert [render(x) for x in (None, True, 5.0, 0.1, 7, "x", 1e21)] == ["NULL", "true", "5", "0.1", "7", "x", "1" + "0" * 21]
    assert accepts(varchar(4), "éé") and not accepts(varchar(3), "éé") and not accepts(INT64, True) and not accepts(FLOAT64, 1) and accepts(TEXT, None)


def scanned(engine, name):
    return sorted(r[0] for r in engine.table(name).collect())


def test_created_again_is_empty(spark, tmp_path):
    """Rows of a replaced table are gone, whether they were flushed or not, before a flush and after it."""
    engine = Engine(spark, str(tmp_path))
    engine.create_table("t", [column("x")])
    engine.insert("t", [(1,), (2,)])
    engine.flush("t")
    with pytest.warns(UserWarning):
        engine.create_table("t", [column("x")])
    assert scanned(engine, "t") == [] and Engine(spark, str(tmp_path)).load() == []
    engine.insert("t", [(9,)])
    assert scanned(engine, "t") == [9]
    engine.flush("t")
    engine.insert("t", [(10,)])
    engine.flush("t")
    assert scanned(engine, "t") == [9, 10]


def test_created_over_files_replaces_them_at_its_first_flush(spark, tmp_path):
    old = Engine(spark, str(tmp_path))
    old.create_table("t", [column("x")])
    old.insert("t", [(1,)])
    old.flush("t")
    new = Engine(spark, str(tmp_path))
    new.create_table("t", [column("y")])
    assert scanned(new, "t") == []
    new.flush("t")
    again = Engine(spark, str(tmp_path))
    assert again.load() == ["t"] and [f[0] for f in again.schema("t")] == ["y"] and scanned(again, "t") == []


def test_dropped_rows_do_not_come_back(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.create_table("t", [column("x")])
    engine.insert("t", [(1,)])
    engine.flush("t")
    engine.drop_table("t")
    with pytest.raises(TableNotFound):
        engine.table("t")
    assert engine.load() == []
    spark.range(3).write.parquet(str(tmp_path / "r.parquet"))
    assert engine.load() == ["r"]
    engine.drop_table("r")
    assert engine.load() == ["r"] and scanned(engine, "r") == [0, 1, 2]  # only registered: its files stay


def test_where_sees_no_alias(engine):
    with pytest.raises(ColumnNotFound):
        engine.sql("SELECT a AS other FROM n WHERE other = 1")
    assert [r.a for r in engine.sql("SELECT b AS a FROM n WHERE a = 1").collect()] == [r[2] for r in ROWS if r[1] == 1]
