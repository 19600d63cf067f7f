"""Seeded, reproducible random keys: the same seed picks the same rows on any cluster layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def random_key(seed: int | str, *columns: Column) -> Column:
    """A 32-digit hexadecimal key that orders rows at random for a given seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def key_threshold(fraction: float) -> str:
    """The 8-digit hexadecimal bound below which a ``fraction`` of all random keys falls."""
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction must be between 0 and 1, not {fraction}")
    # 'g' sorts after every hexadecimal digit, so a fraction of 1 keeps every key.
    return "g" if fraction == 1 else f"{int(fraction * 2**32):08x}"
