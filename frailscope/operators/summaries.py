"""Population summaries of frailty scores and deficit categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frailscope.functions.joins import null_safe_join, people_join
from frailscope.operators.concepts import concept_set, require_index

STRATA = ("age_group", "is_female")


def summarize_fi(fi: DataFrame, by: Sequence[str] = STRATA) -> DataFrame:
    """Number and share of prefrail, frail and robust people per stratum."""
    n = F.count(F.lit(1))
    counts = {name: F.sum(name) for name in ("prefrail", "frail", "robust")}
    return fi.groupBy(*by).agg(
        n.alias("n"),
        *[total.alias(f"n_{name}") for name, total in counts.items()],
        *[(total / n).alias(name) for name, total in counts.items()],
    )


def category_prevalence(
    events: DataFrame,
    cohort: DataFrame,
    categories: Sequence[str] | DataFrame,
    by: Sequence[str] = STRATA,
    unique_people: bool = False,
    drop_null_strata: bool = False,
) -> DataFrame:
    """People, summed score and their ratio for every stratum and category, zeros included.

    ``events`` holds at most one row per person and category (person_id, category, score). The
    full grid is built from the strata totals, never from people times categories: each stratum
    row carries the short list of category names and unfolds it. ``categories`` is that list or a
    table with a ``category`` column.

    Every cohort row counts, so strata are looked up in the cohort. With ``unique_people`` (one
    cohort row per person, whose strata the events already carry) that join is left out.
    """
    if isinstance(categories, DataFrame):
        names = categories.agg(F.collect_set("category")).scalar()
    else:
        names = F.array(*[F.lit(c) for c in categories])
    grid = (
        cohort.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("N"))
        .withColumn("_names", names)
        .select(*by, "N", F.explode("_names").alias("category"))
    )
    scores = events.select("person_id", "category", "score", *(by if unique_people else []))
    if not unique_people:
        scores = people_join(scores, cohort.select("person_id", *by), spread_by=["category"])
    sums = scores.groupBy(*by, "category").agg(F.sum("score").alias("count"))
    count = F.coalesce("count", F.lit(0.0))
    out = null_safe_join(grid, sums, [*by, "category"]).select(
        *by, "category", "N", count.alias("count"), (count / F.col("N")).alias("percent")
    )
    return out.dropna(subset=list(by)) if drop_null_strata else out


def percent_category(
    events: DataFrame,
    cohort: DataFrame,
    category: str,
    index: str,
    fi_indices: DataFrame,
    by: Sequence[str] = STRATA,
) -> DataFrame:
    """Yes-count and share of one category per stratum; index and category must exist."""
    known = concept_set(fi_indices, require_index(fi_indices, index))
    if known.filter(F.col("category") == category).isEmpty():
        raise ValueError(f"category {category!r} not found in index {index!r}")
    keys = ["person_id", *by]
    yes = events.filter(F.col("category") == category).select(*keys, "score").distinct()
    no = cohort.join(yes.select("person_id"), "person_id", "left_anti").select(*keys, F.lit(0.0).alias("score"))
    return (
        yes.unionByName(no)
        .groupBy(*by)
        .agg(F.sum("score").alias("n_yes"), F.avg("score").alias("prop_yes"))
        .select(*by, F.lit(category).alias("category"), "n_yes", "prop_yes")
    )


def category_totals(events: DataFrame, cohort: DataFrame, by: Sequence[str] = STRATA) -> DataFrame:
    """Summed score per category and stratum, with stratum size and their ratio."""
    totals = events.groupBy("category", *by).agg(F.sum("score").alias("total"))
    sizes = cohort.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return null_safe_join(totals, sizes, by).select(
        "category", *by, "total", "n", (F.col("total") / F.col("n")).alias("prop")
    )


def suppress_small_cells(
    df: DataFrame,
    threshold: int = 20,
    mode: str = "zero",
    count: str = "count",
    share: str = "percent",
    keep_share: bool = False,
) -> DataFrame:
    """Hide counts below ``threshold``: as 0, or with ``label`` as the text ``<threshold``.

    The share of a hidden cell becomes 0 unless ``keep_share``.
    """
    small = F.col(count) < threshold
    hidden_share = df[share] if keep_share else F.when(small, 0.0).otherwise(F.col(share))
    if mode == "zero":
        shown = F.when(small, 0).otherwise(F.col(count)).cast(df.schema[count].dataType)
    elif mode == "label":
        value = F.col(count)
        whole = F.when(value == F.floor(value), value.cast("long").cast("string"))
        shown = F.when(small, F.lit(f"<{threshold}")).otherwise(F.coalesce(whole, value.cast("string")))
    else:
        raise ValueError("mode must be 'zero' or 'label'")
    return df.withColumns({share: hidden_share, count: shown})


def stack_summaries(summaries: Mapping[str, DataFrame], order_by: Sequence[str] | None = None) -> DataFrame:
    """Summaries of several indices in one table, told apart by ``fi``."""
    stacked = None
    for name, df in summaries.items():
        part = df.withColumn("fi", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    if stacked is None:
        raise ValueError("no summaries given")
    return stacked.orderBy(*order_by) if order_by else stacked
