"""The closed set of engine types, their Spark counterparts and the typing rules."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import TypeMismatch


@dataclass(frozen=True)
class EngineType:
    """One engine type; ``limit`` is the byte limit of a bounded text."""

    name: str
    limit: int | None = None

    def __str__(self) -> str:
        return f"VarChar({self.limit})" if self.limit is not None else self.name

    @property
    def display(self) -> str:
        return {"Int64": "Integer", "Float64": "Float", "Text": "String", "VarChar": "String", "Bool": "Boolean"}.get(self.name, self.name)

    @property
    def is_text(self) -> bool:
        return self.name in ("Text", "VarChar")

    @property
    def is_numeric(self) -> bool:
        return self.name in ("Int64", "Float64")

    @property
    def spark(self) -> T.DataType:
        return _TO_SPARK[self.name]


INT64, FLOAT64, TEXT, BOOL, TIMESTAMP = (EngineType(n) for n in ("Int64", "Float64", "Text", "Bool", "Timestamp"))


def varchar(limit: int) -> EngineType:
    return EngineType("VarChar", limit)


_TO_SPARK = {
    "Int64": T.LongType(),
    "Float64": T.DoubleType(),
    "Text": T.StringType(),
    "VarChar": T.StringType(),
    "Bool": T.BooleanType(),
    "Timestamp": T.TimestampNTZType(),
}

#: Spark types taken in at a scan, with the engine type that they widen to.
_FROM_SPARK = {
    "tinyint": INT64, "smallint": INT64, "int": INT64, "bigint": INT64,
    "float": FLOAT64, "double": FLOAT64,
    "string": TEXT, "boolean": BOOL, "timestamp": TIMESTAMP, "timestamp_ntz": TIMESTAMP,
}


def from_spark(kind: T.DataType) -> EngineType | None:
    """Engine type of a Spark type; None where the engine has none."""
    return _FROM_SPARK.get(kind.simpleString())


def can_compare(left: EngineType, right: EngineType) -> bool:
    """Whether ``left <op> right`` is a legal comparison. Not symmetric: an integer widens only on the left."""
    return left == right or (left, right) == (INT64, FLOAT64) or (left.is_text and right.is_text)


def arithmetic_type(left: EngineType, right: EngineType) -> EngineType:
    """Result type of + - * /. Only numbers have arithmetic here."""
    if not (left.is_numeric and right.is_numeric):
        raise TypeMismatch(f"{left} and {right} have no sum, difference, product or quotient")
    return FLOAT64 if FLOAT64 in (left, right) else INT64


def accepts(kind: EngineType, value: object) -> bool:
    """Whether a Python value may be stored in a column of this type (NULL is the column's own matter)."""
    if value is None:
        return True
    if kind == BOOL:
        return isinstance(value, bool)
    if kind == INT64:
        return isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63
    if kind == FLOAT64:
        return isinstance(value, float)
    if kind.is_text:
        return isinstance(value, str) and (kind.limit is None or len(value.encode()) <= kind.limit)
    return False


def render(value: object) -> str:
    """A value as the prompt prints it."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        if math.isinf(value) or math.isnan(value):
            return {"inf": "inf", "-inf": "-inf"}.get(str(value), "NaN")
        from decimal import Decimal

        text = format(Decimal(repr(value)), "f")
        return text[:-2] if text.endswith(".0") else text
    return str(value)
