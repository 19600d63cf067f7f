"""Counting drug ingredients near the index date."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from frailscope.functions.dates import days_between, in_closed_window, years_before
from frailscope.functions.joins import lookup_join, measure, people_join

RULES = ("endpoint", "overlap")
POLYPHARMACY = "Polypharmacy"


def drug_exposure_counts(
    drug_era: DataFrame,
    cohort: DataFrame,
    min_days: int,
    rule: str = "endpoint",
    lookback: int | None = None,
    exclude: DataFrame | None = None,
    index_date: str = "index_date",
) -> DataFrame:
    """Distinct ingredients per person, as (person_id, n), for people with at least one.

    Eras count if they last ``min_days`` or more (era end - era start) and

    * ``endpoint``: start or end in the closed window from ``lookback`` years (1) before the
      index date to the index date; an era that spans the whole window does not count;
    * ``overlap``: start in the half-open window of ``lookback`` days (365) before the index date,
      or start earlier and end inside or after it.

    ``exclude`` is a table of ingredients (drug_concept_id) that never count.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    start, end = F.col("drug_era_start_date"), F.col("drug_era_end_date")
    opened, index = F.col("_opens"), F.col("_index")
    if rule == "endpoint":
        opens = years_before(F.col(index_date), 1 if lookback is None else lookback)
        exposed = in_closed_window(start, opened, index) | in_closed_window(end, opened, index)
    else:
        opens = F.date_sub(index_date, 365 if lookback is None else lookback)
        exposed = ((start > opened) & (start <= index)) | ((start <= opened) & (end > opened))
    eras = drug_era.select("person_id", "drug_concept_id", start, end).filter(days_between(start, end) >= min_days)
    if exclude is not None:
        eras = lookup_join(eras, exclude.select("drug_concept_id").distinct(), "drug_concept_id", "left_anti")
    people = cohort.select("person_id", F.col(index_date).alias("_index"), opens.alias("_opens")).distinct()
    # Under either rule an era must start by the last index date and end after the first window opens.
    size = measure(people, F.min("_opens").alias("lo"), F.max("_index").alias("hi"), F.count_distinct("person_id").alias("persons"))
    if size["lo"] is not None and size["hi"] is not None:
        eras = eras.filter((start <= F.lit(size["hi"])) & (end >= F.lit(size["lo"])))
    if size["persons"] == size["rows"]:
        near = people_join(eras, people, spread_by=["drug_concept_id"], measured=size)
    else:
        near = _by_year(eras, merged_windows(people, "_opens", "_index"), rule, size["lo"], size["hi"])
    return (
        near.filter(exposed)
        .select("person_id", "drug_concept_id")
        .distinct()
        .groupBy("person_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merged_windows(windows: DataFrame, opens: str, closes: str) -> DataFrame:
    """(person_id, opens, closes): the windows of each person with those that overlap or touch made one."""
    dated = windows.filter(F.col(opens) <= F.col(closes)).select("person_id", opens, closes)
    order = W.partitionBy("person_id").orderBy(opens, closes)
    reach = F.max(closes).over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = F.when(reach.isNull() | (F.col(opens) > reach), 1).otherwise(0)
    numbered = dated.withColumn("_apart", apart).withColumn("_island", F.sum("_apart").over(order))
    return numbered.groupBy("person_id", "_island").agg(F.min(opens).alias(opens), F.max(closes).alias(closes)).drop("_island")


def _by_year(eras: DataFrame, windows: DataFrame, rule: str, first: date, last: date) -> DataFrame:
    """Eras beside the disjoint windows of their person that share a calendar year with them.

    Both are cut into years and joined by person and year. Windows of a person do not overlap, so a year has few of them, and rows
    grow with the number of eras and windows, not with their product. Pairs may repeat.
    """
    start, end = F.col("drug_era_start_date"), F.col("drug_era_end_date")
    if first is None or last is None:
        years = F.array().cast("array<int>")
    elif rule == "endpoint":
        years = F.array_distinct(F.array(F.year(start), F.year(end)))
    else:
        upto = F.least(F.year(F.greatest(start, end)), F.lit(last.year))
        years = F.sequence(F.greatest(F.year(start), F.lit(first.year)), upto)
    key = F.struct("person_id", "_year").alias("_key")
    keyed = eras.withColumn("_year", F.explode(years)).select("*", key).drop("_year")
    spanned = F.sequence(F.year("_opens"), F.year("_index"))
    cut = windows.withColumn("_year", F.explode(spanned)).select(key, "_opens", "_index")
    return people_join(keyed, cut, spread_by=["drug_concept_id"], on="_key").drop("_key")


def polypharmacy_deficit(
    counts: DataFrame,
    cohort: DataFrame,
    cutoff: int = 10,
    category: str = POLYPHARMACY,
    strata: Sequence[str] = ("age_group", "is_female"),
) -> DataFrame:
    """People with ``cutoff`` or more ingredients, as deficit rows with their strata."""
    many = counts.filter(F.col("n") >= cutoff).select("person_id")
    return cohort.join(many, "person_id").select(
        "person_id", *strata, F.lit(category).alias("category"), F.lit(1.0).alias("score")
    )


def add_deficit(events: DataFrame, deficit: DataFrame) -> DataFrame:
    """Deficit rows joined to the distinct rows of an index."""
    return events.select(*deficit.columns).unionByName(deficit).distinct()


def zero_fill_counts(counts: DataFrame, cohort: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every cohort row with its ingredient count, 0 for people without drugs."""
    return (
        cohort.select("person_id", *keep)
        .join(counts, "person_id", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    )


def polypharmacy_prevalence(counts: DataFrame, cohort: DataFrame, cutoff: int = 5, by: str = "age_group") -> DataFrame:
    """Share of people with ``cutoff`` or more ingredients per stratum; people without drugs count."""
    return (
        zero_fill_counts(counts, cohort, [by])
        .groupBy(by)
        .agg(F.avg(F.when(F.col("n") >= cutoff, 1.0).otherwise(0.0)).alias("pp_ratio"))
    )


def flag_exposure(counts: DataFrame, above: int = 5) -> DataFrame:
    """Add ``pp``: 1 for more than ``above`` ingredients, else 0."""
    return counts.withColumn("pp", F.when(F.col("n") > above, 1).otherwise(0))


def exposure_distribution(
    counts: DataFrame, shares_from: Sequence[int] = (10, 15), flag_above: int = 5
) -> DataFrame:
    """One row about zero-filled counts: deciles, quartiles, mean, extremes and shares.

    People are first counted per number of ingredients; that short table gives every figure.
    """
    table = counts.groupBy("n").agg(F.count(F.lit(1)).alias("people"))
    n, people = F.col("n"), F.col("people")
    total = F.sum("people")
    quantile_names = {f"p{10 * d:02d}": d / 10 for d in range(11)} | {"q1": 0.25, "median": 0.5, "q3": 0.75}
    summary = table.agg(
        F.percentile(n, list(quantile_names.values()), people).alias("q"),
        F.min("n").alias("lowest"),
        F.max("n").alias("highest"),
        (F.sum(n * people) / total).alias("mean"),
        total.alias("people"),
        *[
            (F.sum(F.when(n >= k, people).otherwise(0)) / total).alias(f"share_from_{k}")
            for k in shares_from
        ],
        (F.sum(F.when(n > flag_above, people).otherwise(0)) / total).alias(f"share_above_{flag_above}"),
    )
    quantiles = [F.col("q")[i].alias(name) for i, name in enumerate(quantile_names)]
    return summary.select(*quantiles, *[c for c in summary.columns if c != "q"])
