"""Ordering and matching rules of the named questions: null is the largest value, and a pattern matches the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asc(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def desc(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def full_match(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?is)^(?:{pattern})$")


def top(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """The first rows in an order; all of them, unordered, without a limit."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def has_any(labels: str | Column, names: tuple[str, ...]) -> Column:
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.arrays_overlap(c, F.array(*[F.lit(n) for n in names]))
