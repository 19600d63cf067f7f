"""Frailty scores of people."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frailscope.functions.joins import null_safe_join, people_join
from frailscope.functions.sums import exact_sum
from frailscope.schemas import require_columns

GROUPINGS = ("person_id", "category")


def _grouping(by: str) -> str:
    if by not in GROUPINGS:
        raise ValueError(f"group by one of {', '.join(GROUPINGS)}, not {by!r}")
    return by


def _weighted(events: DataFrame, person_id: str, category: str, weight: str | None, *more) -> DataFrame:
    require_columns(events, [person_id, category, *([weight] if weight else [])], "the event table")
    score = F.col(weight).cast("double") if weight else F.lit(1.0)
    return events.select(
        F.col(person_id).alias("person_id"), F.col(category).alias("category"), score.alias("score"), *more
    )


def fi_detail(
    events: DataFrame,
    search: DataFrame,
    person_id: str = "person_id",
    category: str = "category",
    event_date: str = "start_date",
    search_person_id: str = "person_id",
    search_start_date: str = "search_date",
    interval: int = 365,
    weight: str | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Distinct (person_id, category, score) of the searched people.

    An event inside the closed window of ``interval`` days from the search date scores its weight
    (1 without ``weight``); any other event, also one without a date, scores 0.
    """
    dated = _weighted(events, person_id, category, weight, F.col(event_date).cast("date").alias("_date"))
    begin = F.col(search_start_date).cast("date")
    people = search.select(
        F.col(search_person_id).alias("person_id"), begin.alias("_start"), F.date_add(begin, interval).alias("_end")
    )
    inside = F.col("_date").between(F.col("_start"), F.col("_end"))
    rows = (
        people_join(dated, people, spread_by=["category", "_date"])
        .select("person_id", "category", F.when(inside, F.col("score")).otherwise(0.0).alias("score"))
        .distinct()
    )
    return rows.orderBy("person_id", "category", "score") if ordered else rows


def fi_by_person(
    events: DataFrame,
    search: DataFrame,
    search_person_id: str = "person_id",
    person_id: str = "person_id",
    ordered: bool = False,
    rejoin: bool = False,
    **options,
) -> DataFrame:
    """Summed score per searched person, as (person_id, fi, found_ehr).

    People without any event, in or out of the window, get ``fi`` 0 and ``found_ehr`` 0. With
    ``rejoin`` the scores are joined to the rows of the search table. Options as for
    :func:`fi_detail`.
    """
    scored = (
        fi_detail(events, search, person_id=person_id, search_person_id=search_person_id, **options)
        .groupBy("person_id")
        .agg(exact_sum("score").alias("fi"))
        .withColumns({search_person_id: F.col("person_id"), "found_ehr": F.lit(1)})
    )
    wanted = search if rejoin else search.select(search_person_id).distinct()
    seen = F.col("found_ehr").isNotNull()
    found = scored.select(search_person_id, "fi", "found_ehr")
    # Without the search rows both sides have a row per person and are dealt by person already; no
    # event has a NULL person, so a NULL one among the searched finds nothing either way.
    joined = (
        null_safe_join(wanted, found, [search_person_id]) if rejoin else wanted.join(found, search_person_id, "left")
    )
    scores = joined.withColumns(
        {"fi": F.when(seen, F.col("fi")).otherwise(0.0), "found_ehr": F.when(seen, 1).otherwise(0)}
    )
    if not rejoin:
        scores = scores.withColumnRenamed(search_person_id, "person_id")
    return scores.orderBy(F.desc("fi"), search_person_id if rejoin else "person_id") if ordered else scores


def fi_by_category(events: DataFrame, search: DataFrame, ordered: bool = False, **options) -> DataFrame:
    """Summed score per category over the searched people, as (category, fi)."""
    scores = fi_detail(events, search, **options).groupBy("category").agg(exact_sum("score").alias("fi"))
    return scores.orderBy(F.desc("fi"), "category") if ordered else scores


def summarize_events(
    events: DataFrame,
    by: str = "person_id",
    person_id: str = "person_id",
    category: str = "category",
    weight: str | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Summed score of events that were already searched: no cohort, no window."""
    key = _grouping(by)
    scores = (
        _weighted(events, person_id, category, weight).distinct().groupBy(key).agg(exact_sum("score").alias("fi"))
    )
    return scores.orderBy(F.desc("fi"), key) if ordered else scores


def frailty_index(
    events: DataFrame,
    search: DataFrame,
    summary: bool = True,
    by: str = "person_id",
    **options,
) -> DataFrame:
    """One entry point for the three forms: per person, per category, or detail rows."""
    key = _grouping(by)
    if not summary:
        return fi_detail(events, search, **options)
    return (fi_by_person if key == "person_id" else fi_by_category)(events, search, **options)


def _classes(fi: Column, lb: Column, ub: Column) -> dict[str, Column]:
    return {
        "prefrail": F.when((fi >= lb) & (fi < ub), 1).otherwise(0),
        "frail": F.when(fi >= ub, 1).otherwise(0),
        "robust": F.when(fi < lb, 1).otherwise(0),
    }


_WITHOUT_EVENTS = {"fi": 0.0, "prefrail": 0, "frail": 0, "robust": 1}


def fi_with_robust(
    events: DataFrame,
    cohort: DataFrame,
    denominator: float,
    lb: float,
    ub: float,
    strata: Sequence[str] = ("age_group", "is_female"),
) -> DataFrame:
    """Frailty index and class of every cohort member.

    ``fi`` is the sum of the distinct (category, score) of a person over ``denominator``: robust
    below ``lb``, prefrail from ``lb`` to below ``ub``, frail from ``ub``. Scores are added up exactly, so the class
    of a person at a cut-off does not depend on the order of events. Cohort members without
    events are robust with index 0. ``events`` is read twice, so pass a stored table.
    """
    keys = ["person_id", *strata]
    scored = (
        events.select(*keys, "category", "score")
        .distinct()
        .groupBy(*keys)
        .agg((exact_sum("score") / F.lit(float(denominator))).alias("fi"))
        .withColumns(_classes(F.col("fi"), F.lit(lb), F.lit(ub)))
    )
    without = cohort.join(events.select("person_id").distinct(), "person_id", "left_anti").select(
        *keys, *(F.lit(v).alias(c) for c, v in _WITHOUT_EVENTS.items())
    )
    return scored.unionByName(without)


class Cutoffs(NamedTuple):
    """Deficits of an index, and where prefrail and frail begin."""

    denominator: float
    lb: float
    ub: float


def fi_of_indices(
    events: DataFrame,
    cohort: DataFrame,
    cutoffs: Mapping[str, Cutoffs],
    strata: Sequence[str] = ("age_group", "is_female"),
) -> DataFrame:
    """:func:`fi_with_robust` for several indices in one pass, told apart by ``index_name``."""
    keys = ["index_name", "person_id", *strata]

    def of_index(field: str) -> Column:
        out = F.lit(None).cast("double")
        for name, values in cutoffs.items():
            out = F.when(F.col("index_name") == name, F.lit(float(getattr(values, field)))).otherwise(out)
        return out

    scored = (
        events.select(*keys, "category", "score")
        .distinct()
        .groupBy(*keys)
        .agg(exact_sum("score").alias("total"))
        .withColumn("fi", F.col("total") / of_index("denominator"))
        .drop("total")
        .withColumns(_classes(F.col("fi"), of_index("lb"), of_index("ub")))
    )
    names = F.array(*(F.lit(name) for name in cutoffs))
    everyone = cohort.select("person_id", *strata, F.explode(names).alias("index_name"))
    found = events.select("index_name", "person_id").distinct()
    without = everyone.join(found, ["index_name", "person_id"], "left_anti").select(
        *keys, *(F.lit(v).alias(c) for c, v in _WITHOUT_EVENTS.items())
    )
    return scored.unionByName(without)
