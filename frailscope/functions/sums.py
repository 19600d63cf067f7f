"""Sums that do not depend on the order of their terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms are added up with 18 places, and the total is given with 12, so that thirds add up to one.
_TERM, _TOTAL = "decimal(30,18)", "decimal(38,12)"


def exact_sum(value: Column | str) -> Column:
    """The sum of doubles, added up in decimals, so that it is the same however the rows are dealt.

    Where a term does not fit (not a number, infinite, a trillion or more) or the total overflows, the
    terms are added up as doubles. Nulls are left out; a sum of nulls only is null.
    """
    column = F.col(value) if isinstance(value, str) else value
    term = column.try_cast(_TERM)
    total = F.try_sum(term).try_cast(_TOTAL).cast("double")
    return F.coalesce(F.when(F.count(term) == F.count(column), total), F.sum(column))
