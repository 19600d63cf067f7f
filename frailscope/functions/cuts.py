"""Tables cut from a wider one, which readers of several of them may take from it in one pass."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Cut(NamedTuple):
    """Where a table comes from: the rows of ``whole`` that meet ``belongs``, its columns called ``names`` (new: old)."""

    whole: DataFrame
    belongs: Column
    names: Mapping[str, str]


_CUTS: WeakKeyDictionary[DataFrame, Cut] = WeakKeyDictionary()


def cut_table(whole: DataFrame, belongs: Column, names: Mapping[str, str]) -> DataFrame:
    """The rows of ``whole`` that meet ``belongs``, with the columns that are the values of ``names``, called as its keys.

    No row may be in two cuts of one table.
    """
    found = whole.filter(belongs).select(*[F.col(old).alias(new) for new, old in names.items()])
    _CUTS[found] = Cut(whole, belongs, names)
    return found


def cut_of(table: DataFrame) -> Cut | None:
    """How ``table`` was cut by :func:`cut_table`, if it was; what is derived from it is a table of its own."""
    return _CUTS.get(table)
