"""Rows that the test tables do not contain, and plans for sides that are too large to broadcast."""

import pytest
from pyspark.sql import functions as F

from conftest import day, rows
from frailscope.functions import joins
from frailscope.functions.quantiles import exact_quantiles
from frailscope.operators import agreement, cohort, concepts, rates, summaries


def test_label_mode_keeps_fractions(spark):
    totals = spark.createDataFrame([("a", 37.6, 0.1), ("b", 40.0, 0.2), ("c", 3.5, 0.3)], "category string, count double, percent double")
    shown = summaries.suppress_small_cells(totals, mode="label")
    assert rows(shown, "category", "count") == [("a", "37.6"), ("b", "40"), ("c", "<20")]


def test_a_run_compared_with_itself_has_equal_values_in_the_null_stratum(spark):
    run = spark.createDataFrame([(None, 1, 10, 0.5), ("[40,45)", 0, 20, 0.25)], "age_group string, is_female int, n long, frail double")
    found = agreement.compare_runs(run, run)
    assert rows(found, "age_group", "type", "value") == [
        (None, "new", 0.5),
        (None, "old", 0.5),
        ("[40,45)", "new", 0.25),
        ("[40,45)", "old", 0.25),
    ]


def test_unknown_sex_stays_unknown(spark):
    people = spark.createDataFrame(
        [(1, 8507, 50, 0, day("2020-01-01")), (2, 8532, 50, 0, day("2020-01-01")), (3, None, 50, 0, day("2020-01-01"))],
        "person_id long, gender_concept_id int, age int, yob_imputed int, index_date date",
    )
    assert rows(cohort.derive_strata(people), "person_id", "is_female") == [(1, 0), (2, 1), (3, None)]


def test_null_categories_keep_their_quantiles(spark):
    values = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "category string, event_per_year double")
    assert rows(exact_quantiles(values, ["category"], "event_per_year", {"median": 0.5})) == [(None, 2.0), ("a", 5.0)]
    assert rows(rates.rate_distribution(values), "category", "avg", "median") == [(None, 2.0, 2.0), ("a", 5.0, 5.0)]


def test_lookbacks_find_their_index_in_any_case(spark):
    members = spark.createDataFrame([("x", 1, "VAFI", 1.0)], "category string, concept_id long, fi string, score double")
    years = spark.createDataFrame([("vafi", "x", 3)], "fi string, category string, lookback int")
    assert rows(concepts.attach_lookback(members, years), "fi", "lookback", "chronic") == [("VAFI", 3, 1)]


@pytest.fixture
def joining(spark):
    """A broadcast limit of nothing for the library, Spark's own at its default."""
    spark.conf.set(joins.BROADCAST_CONF, "0")
    yield spark
    spark.conf.unset(joins.BROADCAST_CONF)
    spark.conf.unset(joins.HOT_ROWS_CONF)
    spark.conf.unset(joins.SALT_CONF)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot_rows", [100_000, 50])
def test_large_people_are_never_broadcast(joining, hot_rows):
    """Spark estimates the people below its own limit; hot persons are spread all the same."""
    joining.conf.set(joins.HOT_ROWS_CONF, str(hot_rows))
    joining.conf.set(joins.SALT_CONF, "3")
    facts = joining.range(1000).select(F.when(F.col("id") < 300, 1).otherwise(F.col("id")).alias("person_id"), "id")
    people = joining.range(1000).select(F.col("id").alias("person_id"), (F.col("id") * 2).alias("twice"))
    joined = joins.people_join(facts, people, ["id"])
    assert "SortMergeJoin [person_id" in _plan(joined)
    assert ("_salt" in _plan(joined)) == (hot_rows == 50)
    assert joined.count() == 1000
    assert joined.filter("twice <> person_id * 2").count() == 0


def test_large_lookups_are_never_broadcast(joining):
    facts = joining.range(100).select((F.col("id") % 7).alias("k"), "id")
    lookup = joining.range(5).select(F.col("id").alias("k"), F.lit("x").alias("name"))
    joined = joins.lookup_join(facts, lookup, "k")
    assert "BroadcastHashJoin" not in _plan(joined)
    assert joined.count() == sum(i % 7 < 5 for i in range(100))
