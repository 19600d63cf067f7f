"""Choosing people, index dates and strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from frailscope.functions.dates import days_between, years_before
from frailscope.functions.joins import lookup_join, null_safe_join
from frailscope.functions.sampling import key_threshold, random_key
from frailscope.functions.strata import AGE_BREAKS, band
from frailscope.schemas import require_columns

# The OMOP concept of male gender, the first birth year that is not coarsened in the
# source data, and the age that stands for everyone born before it.
MALE = 8507
OLDEST_BIRTH_YEAR = 1938
IMPUTED_AGE = 84


def eligible_people(df: DataFrame, lower: int = 50, upper: int = 120, age: str = "age_at_consent") -> DataFrame:
    """Distinct ids of people whose age lies in ``[lower, upper]``."""
    require_columns(df, ["person_id", age], "the people table")
    return df.filter(F.col(age).between(lower, upper)).select("person_id").distinct()


def random_index_visit(person: DataFrame, visit: DataFrame, seed: int | str) -> DataFrame:
    """One visit per person, drawn at random but reproducibly; its date becomes ``index_date``.

    The draw is a minimum, so each task reduces its visits before the shuffle and only one visit
    per person meets the person table.
    """
    key = random_key(seed, F.col("person_id"), F.col("visit_occurrence_id"))
    drawn = visit.groupBy("person_id").agg(
        F.min_by("visit_start_date", F.struct(key, F.col("visit_occurrence_id"))).alias("index_date")
    )
    return person.select("person_id", "year_of_birth", "gender_concept_id").join(drawn, "person_id")


def apply_washout(
    index: DataFrame,
    observation_period: DataFrame,
    min_days: int = 365,
    min_age: int = 40,
    dedupe: bool = True,
) -> DataFrame:
    """People observed for ``min_days`` before their index date and at least ``min_age`` then.

    With ``dedupe`` a person stays once, with the earliest observation period (the longest, if
    several start together); without it once per qualifying period.
    """
    start, end = "observation_period_start_date", "observation_period_end_date"
    periods = observation_period.select("person_id", start, end)
    if dedupe:
        first = F.min(F.struct(F.col(start), F.date_diff(F.lit("1970-01-01").cast("date"), F.col(end)).alias("back")))
        periods = (
            periods.filter(F.col(start).isNotNull())
            .groupBy("person_id")
            .agg(first.alias("p"))
            .select(
                "person_id",
                F.col(f"p.{start}"),
                F.date_sub(F.lit("1970-01-01").cast("date"), F.col("p.back")).alias(end),
            )
        )
        observed = index.join(periods, "person_id")
    else:
        # Both sides are shuffled, so a person with very many periods can be split.
        observed = null_safe_join(periods, index, ["person_id"], "inner").select(*index.columns, start, end)
    age = F.year("index_date") - F.col("year_of_birth")
    return (
        observed.filter(days_between(F.col(start), F.col("index_date")) >= min_days)
        .withColumns(
            {
                "age": age,
                "yob_imputed": F.when(F.col("year_of_birth") < OLDEST_BIRTH_YEAR, 1).otherwise(0),
            }
        )
        .filter(F.col("age") >= min_age)
    )


def derive_strata(
    cohort: DataFrame,
    breaks: Sequence[int] = AGE_BREAKS,
    lookback_years: int = 1,
    drop_null_strata: bool = False,
) -> DataFrame:
    """Sex flag (NULL if unknown), age band (NULL outside the breaks) and the start of the lookback window."""
    age = f"(CASE WHEN yob_imputed = 1 THEN {IMPUTED_AGE} ELSE age END)"
    out = cohort.select(
        "person_id",
        F.when(F.col("gender_concept_id") == MALE, 0)
        .when(F.col("gender_concept_id").isNotNull(), 1)
        .alias("is_female"),
        band(age, breaks).alias("age_group"),
        years_before(F.col("index_date"), lookback_years).alias("visit_lookback_date"),
        "index_date",
        "yob_imputed",
    )
    return out.dropna(subset=["age_group"]) if drop_null_strata else out


def earliest_index(cohort: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The rows with a person's earliest index date (ties stay), for the given ids if any.

    Joins back to the per-person minimum instead of gathering all rows of a person in a window.
    """
    kept = cohort
    if ids is not None:
        kept = lookup_join(cohort, ids.select("person_id").distinct(), "person_id", "left_semi")
    first = kept.groupBy("person_id").agg(F.min("index_date").alias("index_date"))
    return kept.join(first, ["person_id", "index_date"], "left_semi").select(*cohort.columns)


def sample_cohort(cohort: DataFrame, fraction: float, seed: int | str = 0) -> DataFrame:
    """A reproducible random share of the people, without sorting them."""
    key = F.substring(random_key(seed, F.col("person_id")), 1, 8)
    return cohort.filter(key < key_threshold(fraction))


def first_people(cohort: DataFrame, n: int) -> DataFrame:
    """The ids of the first ``n`` people."""
    return cohort.select("person_id").distinct().orderBy("person_id").limit(n)


def cohort_summary(cohort: DataFrame, by: Sequence[str] = ("age_group", "is_female")) -> DataFrame:
    """Count and share of the cohort per stratum, with total size and female share on every row.

    The totals are window sums over the counted strata, a handful of rows.
    """
    everyone = W.partitionBy()
    female = F.sum(F.when(F.col("is_female") == 1, F.col("n")).otherwise(0)).over(everyone)
    total = F.sum("n").over(everyone)
    keys = list(dict.fromkeys([*by, "is_female"]))
    counted = cohort.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        *keys,
        "n",
        (F.col("n") / total).alias("percent_group"),
        total.alias("sample_size"),
        (female / total).alias("percent_female"),
    )
