"""Typed expressions to ``Column``.

The dialect differs from Spark SQL in a few places, each handled here and nowhere else:

* AND and OR are two-valued: an unknown operand counts as false, and the left side guards the right one.
* Float equality has an absolute tolerance.
* Integer division truncates; division by zero is an error.
* ``<`` and ``>`` are false, ``<=`` and ``>=`` true, on any two known texts or booleans.

Under the root of a WHERE the two-valued and the three-valued AND/OR keep the same rows (both are monotone,
the dialect has no NOT, and unknown drops a row like false), so there the plain operators are used, which
the Parquet reader can take.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.binder import ARITHMETIC, BinaryOp, Bound, Col, Const, IsTest
from ..types import FLOAT64, INT64, TIMESTAMP

#: Fixed value: two floats closer than this are equal.
EPSILON = 2.220446049250313e-16


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Lowering:
    """``extended`` orders texts and booleans naturally; ``ieee_nan`` gives NaN and infinities their IEEE comparisons."""

    def __init__(self, extended: bool = False, ieee_nan: bool = False):
        self.extended, self.ieee_nan = extended, ieee_nan

    def filter(self, expr: Bound) -> Column:
        """A column that is true for exactly the rows to keep; it may be null for others."""
        return self._spine(expr)

    def value(self, expr: Bound) -> Column:
        if isinstance(expr, Const):
            return F.lit(expr.value).cast(expr.type.spark)
        if isinstance(expr, Col):
            return F.col(quoted(expr.name))
        if isinstance(expr, IsTest):
            inner = self.value(expr.expr)
            test = inner.isNull() if expr.what is None else inner.eqNullSafe(F.lit(expr.what))
            return ~test if expr.negated else test
        if expr.op in ("AND", "OR"):
            return self._two_valued(expr)
        left, right = self.value(expr.left), self.value(expr.right)
        return self._arithmetic(expr, left, right) if expr.op in ARITHMETIC else self._compare(expr, left, right)

    # -- AND, OR

    def _spine(self, expr: Bound) -> Column:
        if isinstance(expr, BinaryOp) and expr.op in ("AND", "OR"):
            left = self._spine(expr.left)
            if not _can_fail(expr.right):
                right = self._spine(expr.right)
                return left & right if expr.op == "AND" else left | right
            guarded = self._two_valued(expr)
            return left & guarded if expr.op == "AND" and not _can_fail(expr.left) else guarded
        if isinstance(expr, BinaryOp) and expr.op == "=" and FLOAT64 in (expr.left.type, expr.right.type):
            return self._near_literal(expr)
        return self.value(expr)

    def _two_valued(self, expr: BinaryOp) -> Column:
        left, right = (F.coalesce(self.value(x), F.lit(False)) for x in (expr.left, expr.right))
        if _can_fail(expr.right):  # CASE keeps the order of evaluation
            return F.when(left, right).otherwise(F.lit(False)) if expr.op == "AND" else F.when(left, F.lit(True)).otherwise(right)
        return left & right if expr.op == "AND" else left | right

    # -- arithmetic

    def _arithmetic(self, expr: BinaryOp, left: Column, right: Column) -> Column:
        if expr.type == INT64:
            if expr.op == "/":
                return F.call_function("div", left, right)
        else:
            left, right = left.cast("double"), right.cast("double")
        return {"+": Column.__add__, "-": Column.__sub__, "*": Column.__mul__, "/": Column.__truediv__}[expr.op](left, right)

    # -- comparisons

    def _compare(self, expr: BinaryOp, left: Column, right: Column) -> Column:
        op, a, b = expr.op, expr.left.type, expr.right.type
        floats = FLOAT64 in (a, b)
        if op in ("=", "!="):
            same = self._near(left, right) if floats else left == right
            return same if op == "=" else ~same
        if not (a.is_numeric or a == TIMESTAMP or self.extended):
            # CASE gives null where an operand is unknown, else a constant
            return F.when(left.isNotNull() & right.isNotNull(), F.lit(op in ("<=", ">=")))
        if floats:
            left, right = left.cast("double"), right.cast("double")
            if self.ieee_nan:
                odd = F.isnan(left) | F.isnan(right)
                less, more = (F.when(left.isNull() | right.isNull(), F.lit(None).cast("boolean")).otherwise(~odd & x) for x in (left < right, left > right))
                return {"<": less, ">": more, ">=": ~less, "<=": ~more}[op]
        return {"<": left < right, ">": left > right, ">=": ~(left < right), "<=": ~(left > right)}[op]

    def _near(self, left: Column, right: Column) -> Column:
        gap = F.abs(left.cast("double") - right.cast("double"))
        return (gap < F.lit(EPSILON)) & ~F.isnan(gap) if self.ieee_nan else (gap < F.lit(EPSILON))

    def _near_literal(self, expr: BinaryOp) -> Column:
        """Equality with a float literal, in a form that the Parquet reader can use too; at the root of WHERE only."""
        sides = [expr.left, expr.right]
        at = next((i for i in (1, 0) if isinstance(sides[i], Const) and isinstance(sides[1 - i], Col)), None)
        if at is None or not math.isfinite(float(sides[at].value)):
            return self.value(expr)
        column, v = self.value(sides[1 - at]).cast("double"), float(sides[at].value)
        if abs(v) > 1.0:  # neighbours of v are at least the tolerance away
            return column == F.lit(v)
        low, high = math.nextafter(v - EPSILON, -math.inf), math.nextafter(v + EPSILON, math.inf)
        return column.between(F.lit(low), F.lit(high)) & (F.abs(column - F.lit(v)) < F.lit(EPSILON))


def _can_fail(expr: Bound) -> bool:
    """Whether evaluating the expression can raise: it holds arithmetic."""
    if isinstance(expr, BinaryOp):
        return expr.op in ARITHMETIC or _can_fail(expr.left) or _can_fail(expr.right)
    return isinstance(expr, IsTest) and _can_fail(expr.expr)

