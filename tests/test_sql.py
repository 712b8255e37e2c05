"""Lexer and parser."""

import pytest

from tessera.errors import InvalidQuery
from tessera.sql import parse
from tessera.sql.lexer import Kind, tokenize
from tessera.sql.syntax import Binary, ColumnDef, Create, Is, Literal, Name, Select, Target
from tessera.types import BOOL, INT64, TEXT, varchar


def kinds(text):
    return [(t.kind, t.value) for t in tokenize(text)[:-1]]


def where(text, **kw):
    return parse(f"SELECT * FROM t WHERE {text}", **kw).where


def test_tokens():
    assert kinds("SELECT  *\tFROM users") == [(Kind.KEYWORD, "SELECT"), (Kind.SYMBOL, "*"), (Kind.KEYWORD, "FROM"), (Kind.WORD, "users")]
    assert kinds("5.0 5 5.") == [(Kind.FLOAT, 5.0), (Kind.INTEGER, 5), (Kind.FLOAT, 5.0)]
    assert kinds("u.name a%b \"Text\" 'it''s'") == [(Kind.WORD, "u.name"), (Kind.WORD, "a%b"), (Kind.WORD, "Text"), (Kind.STRING, "it"), (Kind.STRING, "s")]
    assert kinds("a<=b!=c>=d") == [(Kind.WORD, "a"), (Kind.SYMBOL, "<="), (Kind.WORD, "b"), (Kind.SYMBOL, "!="), (Kind.WORD, "c"), (Kind.SYMBOL, ">="), (Kind.WORD, "d")]
    assert kinds("'é' boolean") == [(Kind.STRING, "é"), (Kind.KEYWORD, "BOOL")]
    for bad in ("'open", "!", ".5", "1.2.3", "9223372036854775808", "_x", "a % 2"):
        assert tokenize(bad)[-2].kind is Kind.BAD


def test_targets():
    assert parse("SELECT * FROM users") == Select((Target(None),), "users")
    assert parse('select id as "Identity", name AS firstName, age a FROM users').targets == (Target(Name("id"), "Identity"), Target(Name("name"), "firstName"), Target(Name("age"), "a"))
    assert parse("SELECT id, * FROM t").targets == (Target(Name("id")), Target(None))
    assert parse("SELECT * id FROM t").targets == (Target(None), Target(Name("id")))
    assert parse("SELECT id 5, FROM t").targets == (Target(Name("id")), Target(Literal(5)))
    assert parse("SELECT FROM t").targets == ()
    assert parse('SELECT "*" FROM t').targets == (Target(None),)


def test_precedence():
    assert where("a + b * c > 10") == Binary(">", Binary("+", Name("a"), Binary("*", Name("b"), Name("c"))), Literal(10))
    assert where("a - b - c = 1").left == Binary("-", Binary("-", Name("a"), Name("b")), Name("c"))
    assert where("a = 1 OR b = 2 AND c = 3").op == "OR"
    assert where("a = b IS NULL") == Binary("=", Name("a"), Is(Name("b"), None, False))
    assert where("(a = b) IS NOT TRUE") == Is(Binary("=", Name("a"), Name("b")), True, True)
    assert where("x = 3.15").right == Literal(3.15) and where("x = TRUE").right == Literal(True)


@pytest.mark.parametrize("text", ["", "SELECT *, id FROM t", "SELECT id FROM", "SELECT * FROM t WHERE", "SELECT * FROM t ORDER BY x", "SELECT * FROM t u WHERE x = 1", "SELECT * FROM t WHERE a = 1 % 2",
                                  "SELECT * FROM t WHERE a BETWEEN 1", "SELECT * FROM t WHERE a = 'x", "INSERT INTO t", "SELECT a AS from FROM t", "SELECT DISTINCT a FROM t", "SELECT * FROM t WHERE a IS 5",
                                  "SELECT * FROM t WHERE (a = 1", "CREATE TABLE t (a VARCHAR)", "CREATE TABLE t (a DATE)", "SELECT -1 FROM t", "SELECT * FROM t;;"])
def test_rejected(text):
    with pytest.raises(InvalidQuery):
        parse(text)


def test_trailing():
    assert parse("SELECT * FROM t;") == parse("SELECT * FROM t")
    assert parse("SELECT * FROM t u WHERE x = 1", allow_trailing=True).where is None
    assert where("a = 1 % 2", allow_trailing=True) == where("a = 1")
    assert where("a = 1 ORDER BY x", allow_trailing=True) == where("a = 1")


def test_create():
    assert parse("CREATE TABLE users (id INT PRIMARY KEY, name TEXT NOT NULL, active BOOL UNIQUE, s VARCHAR(3))") == Create(
        "users",
        (ColumnDef("id", INT64, True, ("PRIMARY KEY",)), ColumnDef("name", TEXT, False, ("NOT NULL",)), ColumnDef("active", BOOL, True, ("UNIQUE",)), ColumnDef("s", varchar(3))),
    )
