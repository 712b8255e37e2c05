"""Filter and projection. Both are narrow: no plan of theirs has a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.lowering import Lowering
from ..plans.binder import Bound, BoundSelect, Output


def filter_rows(df: DataFrame, predicate: Bound, lowering: Lowering) -> DataFrame:
    """Rows for which the predicate is true; false and unknown drop."""
    return df.where(lowering.filter(predicate))


def project(df: DataFrame, outputs: tuple[Output, ...], lowering: Lowering) -> DataFrame:
    """One column for each output, in order. Names may repeat, and there may be no column at all."""
    return df.select(*[lowering.value(o.expr).alias(o.name) for o in outputs])


def run(plan: BoundSelect, df: DataFrame, lowering: Lowering) -> DataFrame:
    """The plan over the table's rows, lazily."""
    if plan.where is not None:
        df = filter_rows(df, plan.where, lowering)
    return project(df, plan.outputs, lowering)
