"""How often deficits are recorded per year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frailscope.functions.dates import days_between
from frailscope.functions.joins import null_safe_join
from frailscope.functions.quantiles import exact_quantiles

# The quantiles of the published rate tables.
RATE_QUANTILES = {"median": 0.5, "p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}


def deficit_spans(events: DataFrame) -> DataFrame:
    """Event count, first event and index date per person and category, in one aggregation."""
    return events.groupBy("person_id", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("start_date").alias("first_occ"),
        F.min("person_end_date").alias("index_date"),
    )


def deficit_rates(spans: DataFrame, min_days: int = 365) -> DataFrame:
    """Events per year between first event and index date, for spans longer than ``min_days``."""
    return (
        spans.withColumn("time_to_index", days_between(F.col("first_occ"), F.col("index_date")))
        .filter(F.col("time_to_index") > min_days)
        .withColumn("event_per_year", F.lit(365.25) * F.col("n") / F.col("time_to_index"))
    )


def rate_distribution(rates: DataFrame) -> DataFrame:
    """Mean, standard deviation and exact quantiles of the rates per category.

    ``rates`` is read twice, so pass a stored table.
    """
    rate = "event_per_year"
    moments = rates.groupBy("category").agg(F.avg(rate).alias("avg"), F.stddev_samp(rate).alias("std"))
    return null_safe_join(moments, exact_quantiles(rates, ["category"], rate, RATE_QUANTILES), ["category"], "inner")
