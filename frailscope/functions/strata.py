"""Labels for numeric bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five-year age bands of the published summaries; the last band is closed.
AGE_BREAKS = (40, 45, 50, 55, 60, 65, 70, 75, 80, 100)


def band_labels(breaks: Sequence[int]) -> list[str]:
    """``[a,b)`` for every band, ``[a,b]`` for the last one."""
    pairs = list(zip(breaks, breaks[1:]))
    return [f"[{a},{b})" for a, b in pairs[:-1]] + [f"[{a},{b}]" for a, b in pairs[-1:]]


def band(value: str, breaks: Sequence[int]) -> Column:
    """The band label of the SQL expression ``value``; NULL outside the breaks."""
    bands = list(zip(breaks, breaks[1:], band_labels(breaks)))
    cases = [f"WHEN {value} >= {low} AND {value} < {high} THEN '{name}'" for low, high, name in bands[:-1]]
    low, high, name = bands[-1]
    cases.append(f"WHEN {value} BETWEEN {low} AND {high} THEN '{name}'")
    return F.expr(f"CASE {' '.join(cases)} END")
