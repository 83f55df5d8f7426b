"""Scalar expressions: rounding, formatting, defaults, boundary tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BOUNDARY_TASKS = ("Start", "End", "start", "end")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is referred to."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def round2(x: Column) -> Column:
    """Two decimals, half to even on the exact binary value."""
    return F.replace(F.format_number(x, 2), F.lit(","), F.lit("")).cast("double")


def fmt2(x: Column) -> Column:
    """Two decimals with thousands separators."""
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(F.format_number(x, 2))


def int_trunc(x: Column) -> Column:
    """Whole part, toward zero; null where the text is no number."""
    number = x.try_cast("double")
    return F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast("long")


def is_boundary(task: Column) -> Column:
    """Null tasks are not boundary tasks."""
    return F.coalesce(task.isin(*BOUNDARY_TASKS), F.lit(False))


def default_text(x: Column, default: str) -> Column:
    return F.coalesce(x.cast("string"), F.lit(default))
