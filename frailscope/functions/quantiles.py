"""Exact, linearly interpolated quantiles without holding a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from frailscope.functions.joins import null_safe_join
from frailscope.sources.scratch import store

_BUCKETS_PER_OCTAVE = 32
# A bucket with more different values than this is cut again.
MOST_VALUES = 200_000


def ordered_buckets(histogram: DataFrame, keys: Sequence[str], most_values: int) -> DataFrame:
    """The stored ``histogram`` (keys, _v, _freq) with ``_bucket``: buckets in the order of values, none too large.

    The first cut goes by octaves. A bucket of too many values is cut into equal parts between its least and
    greatest value, again and again, so values that crowd together end in several buckets too; its path of cuts
    names it, and paths are ordered like values. Only the largest number of values comes to the driver.
    """
    octave = F.signum("_v") * F.floor(F.log2(F.abs("_v") + 1) * _BUCKETS_PER_OCTAVE)
    cut = histogram.withColumn("_bucket", F.array(octave.cast("long")))
    while True:
        sizes = cut.groupBy(*keys, "_bucket").agg(
            F.count(F.lit(1)).alias("_values"), F.min("_v").alias("_least"), F.max("_v").alias("_greatest")
        )
        large = sizes.filter((F.col("_values") > most_values) & (F.col("_least") < F.col("_greatest")))
        large = store(large, "large_buckets")
        if large.isEmpty():
            return cut
        parts = F.ceil(F.col("_values") * 2 / F.lit(most_values)) + 1
        # Half the width, so that it does not overflow.
        width = F.col("_greatest") / 2 - F.col("_least") / 2
        part = F.floor((F.col("_v") / 2 - F.col("_least") / 2) / width * parts)
        deeper = F.concat("_bucket", F.array(part.cast("long")))
        joined = null_safe_join(cut, large, [*keys, "_bucket"])
        cut = store(
            joined.withColumn("_bucket", F.when(F.col("_values").isNull(), F.col("_bucket")).otherwise(deeper)).select(
                cut.columns
            ),
            "buckets",
        )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], most_values: int = MOST_VALUES
) -> DataFrame:
    """One row per ``keys`` with a column per entry of ``probs`` (name -> probability).

    Rank ``h = (n - 1) p`` is interpolated between the two neighbouring order statistics. Values
    are first counted (so repeats never travel), then ranked inside ordered buckets of at most ``most_values``
    different values, whose starting ranks come from a running total over the buckets of a group.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    histogram = df.filter(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_freq"))
    histogram = ordered_buckets(store(histogram, "histogram"), keys, most_values)
    per_bucket = histogram.groupBy(*keys, "_bucket").agg(F.sum("_freq").alias("_in_bucket"))
    group = W.partitionBy(*keys)
    starts = per_bucket.select(
        *keys,
        "_bucket",
        (F.sum("_in_bucket").over(group.orderBy("_bucket")) - F.col("_in_bucket")).alias("_before"),
        F.sum("_in_bucket").over(group).alias("_n"),
    )
    within = W.partitionBy(*keys, "_bucket").orderBy("_v")
    ranked = null_safe_join(histogram, starts, [*keys, "_bucket"], "inner").select(
        *keys,
        "_v",
        "_n",
        (F.col("_before") + F.sum("_freq").over(within) - F.col("_freq")).alias("_first"),
        (F.col("_before") + F.sum("_freq").over(within) - 1).alias("_last"),
    )
    picks = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("_first") <= rank) & (rank <= F.col("_last"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}_{name}"))
    picked = ranked.groupBy(*keys).agg(F.first("_n").alias("_n"), *picks)
    columns = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        columns.append((low + (h - F.floor(h)) * (high - low)).alias(name))
    return picked.select(*keys, *columns)
