import pytest

from conftest import day, rows
from frailscope.functions.sampling import key_threshold
from frailscope.functions.strata import AGE_BREAKS, band_labels
from frailscope.operators import cohort as c


def test_eligible_people_bounds_are_inclusive(spark):
    df = spark.createDataFrame(
        [(1, 49), (2, 50), (2, 50), (3, 120), (4, 121), (5, None)], "person_id long, age_at_consent int"
    )
    assert rows(c.eligible_people(df)) == [(2,), (3,)]


@pytest.fixture
def indexed(spark):
    return spark.createDataFrame(
        [(1, 1960, 8507, day("2020-06-30")), (2, 1981, 8532, day("2020-06-30")), (3, 1937, 8532, day("2020-06-30"))],
        "person_id long, year_of_birth int, gender_concept_id int, index_date date",
    )


@pytest.fixture
def periods(spark):
    return spark.createDataFrame(
        [
            (1, day("2019-07-01"), day("2020-12-31")),  # exactly 365 days
            (1, day("2018-01-01"), day("2018-12-31")),
            (1, day("2018-01-01"), day("2020-12-31")),
            (2, day("2000-01-01"), day("2020-12-31")),  # 39 years old
            (3, day("2019-07-02"), day("2020-12-31")),  # 364 days
            (3, day("2010-01-01"), day("2011-12-31")),
        ],
        "person_id long, observation_period_start_date date, observation_period_end_date date",
    )


def test_washout_one_row_per_person(indexed, periods):
    kept = c.apply_washout(indexed, periods)
    assert rows(kept, "person_id", "observation_period_start_date", "observation_period_end_date", "age", "yob_imputed") == [
        (1, day("2018-01-01"), day("2020-12-31"), 60, 0),
        (3, day("2010-01-01"), day("2011-12-31"), 83, 1),
    ]


def test_washout_one_row_per_period(indexed, periods):
    kept = c.apply_washout(indexed, periods, dedupe=False)
    assert rows(kept, "person_id") == [(1,), (1,), (1,), (3,)]


def test_strata(spark):
    ages = [(1, 39, 0), (2, 40, 0), (3, 44, 0), (4, 45, 0), (5, 79, 0), (6, 80, 0), (7, 100, 0), (8, 101, 0), (9, 70, 1)]
    df = spark.createDataFrame(
        [(p, 8507 if p % 2 else 8532, day("2021-03-31"), a, i) for p, a, i in ages],
        "person_id long, gender_concept_id int, index_date date, age int, yob_imputed int",
    )
    out = c.derive_strata(df)
    assert rows(out, "person_id", "age_group", "is_female") == [
        (1, None, 0),
        (2, "[40,45)", 1),
        (3, "[40,45)", 0),
        (4, "[45,50)", 1),
        (5, "[75,80)", 0),
        (6, "[80,100]", 1),
        (7, "[80,100]", 0),
        (8, None, 1),
        (9, "[80,100]", 0),
    ]
    assert c.derive_strata(df, drop_null_strata=True).count() == 7
    assert rows(out.select("visit_lookback_date").distinct()) == [(day("2020-03-31"),)]
    assert band_labels(AGE_BREAKS)[-1] == "[80,100]"


def test_earliest_index_keeps_ties(spark, both_joins):
    df = spark.createDataFrame(
        [(1, day("2020-01-02"), "b"), (1, day("2020-01-01"), "a"), (1, day("2020-01-01"), "c"), (2, day("2020-01-01"), "d"), (3, None, "e")],
        "person_id long, index_date date, tag string",
    )
    assert rows(c.earliest_index(df), "tag") == [("a",), ("c",), ("d",)]
    ids = spark.createDataFrame([(1,), (1,)], "person_id long")
    assert rows(c.earliest_index(df, ids), "tag") == [("a",), ("c",)]


def test_earliest_index_changes_nothing_in_a_built_cohort(spark):
    from conftest import DATA
    from frailscope.plans.catalog import SEED
    from frailscope.plans.frailty import build_cohort
    from frailscope.sources.fixtures import FixtureCdm

    built = build_cohort(FixtureCdm(spark, f"{DATA}/sf0.001"), SEED, dedupe=False)
    assert rows(c.earliest_index(built)) == rows(built)


def test_sample_is_reproducible_and_nested(spark):
    df = spark.range(5000).withColumnRenamed("id", "person_id")
    small, again, large = (rows(c.sample_cohort(df, f, 1)) for f in (0.05, 0.05, 0.3))
    assert small == again and set(small) < set(large)
    assert 180 < len(small) < 330
    assert c.sample_cohort(df, 1.0, 1).count() == 5000 and c.sample_cohort(df, 0.0, 1).count() == 0
    with pytest.raises(ValueError):
        key_threshold(1.5)


def test_first_people(spark):
    df = spark.createDataFrame([(3,), (1,), (1,), (2,)], "person_id long")
    assert rows(c.first_people(df, 2)) == [(1,), (2,)]


def test_cohort_summary(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 0), (None, 0)], "age_group string, is_female int")
    assert rows(c.cohort_summary(df)) == [(None, 0, 1, 0.25, 4, 0.5), ("a", 0, 1, 0.25, 4, 0.5), ("a", 1, 2, 0.5, 4, 0.5)]
