"""Date expressions used by the window operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def years_before(date: Column, years: int) -> Column:
    """The same calendar day ``years`` earlier; 29 February falls back to 28 February."""
    return F.add_months(date, -12 * years) if years else date


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def in_closed_window(date: Column, start: Column, end: Column) -> Column:
    return date.between(start, end)
