"""Window semantics of the event search on hand-made rows."""

import pytest

from conftest import day, rows
from frailscope.functions.joins import BROADCAST_CONF
from frailscope.operators import events

STANDARD = [(1, "S"), (2, "S"), (3, "S"), (9, None)]


@pytest.fixture
def cohort(spark):
    def build(*people):
        return spark.createDataFrame(
            [(p, day(a), day(b), "[40,45)", 1) for p, a, b in people],
            "person_id long, person_start_date date, person_end_date date, age_group string, is_female int",
        )

    return build


def members(spark, *data, chronic=True):
    layout = "category string, concept_id long, score double" + (", chronic int" if chronic else "")
    return spark.createDataFrame([r if chronic else r[:3] for r in data], layout)


def test_window_is_closed_at_both_ends(spark, make_cdm, cohort, both_joins):
    cdm = make_cdm(
        STANDARD,
        condition=[(7, 1, "2019-12-31"), (7, 1, "2020-01-01"), (7, 1, "2021-01-01"), (7, 1, "2021-01-02"), (7, 1, None)],
        device=[(7, 1, "2021-01-01"), (8, 1, "2020-05-05")],
    )
    found = events.find_events(
        cdm, cohort((7, "2020-01-01", "2021-01-01")), members(spark, ("A", 1, 1.0), chronic=False), tag_domain=True
    )
    assert rows(found, "person_id", "start_date", "domain") == [
        (7, day("2020-01-01"), "condition"),
        (7, day("2021-01-01"), "condition"),
        (7, day("2021-01-01"), "device"),
    ]


def test_repeats_go_within_a_domain_and_stay_between_domains(spark, make_cdm, cohort):
    twice = [(7, 1, "2020-05-05"), (7, 1, "2020-05-05")]
    cdm = make_cdm(STANDARD, condition=twice, procedure=twice)
    people, concepts = cohort((7, "2020-01-01", "2021-01-01")), members(spark, ("A", 1, 1.0), chronic=False)
    assert events.find_events(cdm, people, concepts).count() == 2
    assert events.find_events(cdm, people, concepts, "concept").count() == 2
    assert events.find_events(cdm, people, concepts, "category").count() == 1


def test_nonstandard_and_foreign_concepts_are_left_out(spark, make_cdm, cohort):
    cdm = make_cdm(STANDARD, observation=[(7, 9, "2020-05-05"), (7, 2, "2020-05-05"), (7, 1, "2020-05-05")])
    concepts = members(spark, ("A", 9, 1.0), ("A", 1, 1.0), chronic=False)
    found = events.find_events(cdm, cohort((7, "2020-01-01", "2021-01-01")), concepts)
    assert rows(found, "concept_id", "concept_name") == [(1, "name 1")]


def test_chronic_window_and_missing_flag(spark, make_cdm, cohort, both_joins):
    cdm = make_cdm(STANDARD, condition=[(7, c, "2018-06-01") for c in (1, 2, 3)])
    concepts = members(spark, ("Chronic", 1, 1.0, 1), ("Acute", 2, 1.0, 0), ("Unknown", 3, 1.0, None))
    found = events.find_events(
        cdm, cohort((7, "2020-01-01", "2021-01-01")), concepts, "category", acute_lookback=1, chronic_lookback=3
    )
    assert rows(found, "category", "person_start_date") == [("Chronic", day("2018-01-01"))]


def test_acute_category_can_get_the_longer_window(spark, make_cdm, cohort):
    cdm = make_cdm(STANDARD, condition=[(7, 1, "2018-06-01"), (7, 2, "2018-06-01")])
    concepts = members(spark, ("Chronic", 1, 1.0, 1), ("Acute", 2, 1.0, 0))
    found = events.find_events(
        cdm, cohort((7, "2020-01-01", "2021-01-01")), concepts, "category", acute_lookback=3, chronic_lookback=1
    )
    assert rows(found, "category") == [("Acute",)]


def test_concept_in_acute_and_chronic_category_keeps_them_apart(spark, make_cdm, cohort):
    """An event before the acute window must not reach the acute category."""
    cdm = make_cdm(STANDARD, condition=[(7, 1, "2018-06-01")])
    concepts = members(spark, ("Chronic", 1, 1.0, 1), ("Acute", 1, 1.0, 0))
    people = cohort((7, "2020-01-01", "2021-01-01"))
    for output in ("concept", "category"):
        found = events.find_events(cdm, people, concepts, output, chronic_lookback=3)
        assert rows(found, "category") == [("Chronic",)]


def test_leap_day_is_shifted_in_two_steps(spark, make_cdm, cohort):
    from pyspark.sql import functions as F

    from frailscope.operators.cohort import derive_strata

    index = spark.createDataFrame(
        [(7, 8507, day("2020-02-29"), 50, 0)],
        "person_id long, gender_concept_id int, index_date date, age int, yob_imputed int",
    )
    people = events.search_window(derive_strata(index))
    assert rows(people, "person_start_date") == [(day("2019-02-28"),)]
    cdm = make_cdm(STANDARD, condition=[(7, 1, "2016-02-28")])
    found = events.find_events(
        cdm, people, members(spark, ("A", 1, 1.0, 1)), "category", acute_lookback=1, chronic_lookback=4
    )
    assert rows(found, F.col("person_start_date")) == [(day("2016-02-28"),)]


def test_repeated_concept_rows_do_not_repeat_events(spark, make_cdm, cohort):
    cdm = make_cdm(STANDARD, condition=[(7, 1, "2020-05-05")])
    concepts = members(spark, ("A", 1, 1.0), ("A", 1, 1.0), ("B", 1, 1.0), chronic=False)
    found = events.find_events(cdm, cohort((7, "2020-01-01", "2021-01-01")), concepts, "concept")
    assert rows(found, "category") == [("A",), ("B",)]


def test_overlapping_windows_of_one_person_each_get_the_event(spark, make_cdm, cohort, both_joins):
    cdm = make_cdm(STANDARD, condition=[(7, 1, "2020-05-05")])
    people = cohort((7, "2020-01-01", "2021-01-01"), (7, "2020-03-01", "2021-03-01"))
    found = events.find_events(cdm, people, members(spark, ("A", 1, 1.0), chronic=False))
    assert found.count() == 2


def test_one_person_with_most_events(spark, make_cdm, cohort, both_joins):
    """Spreading a hot person over salts neither loses nor repeats events."""
    hot = [(7, 1 + i % 3, f"2020-{1 + i % 12:02d}-{1 + i % 28:02d}") for i in range(600)]
    cdm = make_cdm(STANDARD, condition=hot, observation=[(8, 1, "2020-05-05")])
    people = cohort((7, "2020-01-01", "2021-01-01"), (8, "2020-01-01", "2021-01-01"))
    concepts = members(spark, ("A", 1, 1.0), ("B", 2, 1.0), ("C", 3, 1.0), chronic=False)
    found = events.find_events(cdm, people, concepts)
    assert found.count() == len(set(hot)) + 1
    assert events.find_events(cdm, people, concepts, "category").count() == 4


@pytest.mark.parametrize("limit, first", [("100000", "concept_id"), ("150", "person_id")])
def test_the_broadcast_side_is_joined_first(spark, make_cdm, cohort, limit, first):
    """With few people and a larger concept set the people cut the facts before the concept join."""
    cdm = make_cdm(STANDARD, condition=[(7, 1, "2018-06-01"), (7, 2, "2018-06-01"), (7, 3, "2020-06-01"), (8, 1, "2020-06-01")])
    concepts = members(spark, ("Chronic", 1, 1.0, 1), ("Acute", 2, 1.0, 0), ("Acute", 3, 1.0, 0))
    spark.conf.set(BROADCAST_CONF, limit)
    try:
        found = events.find_events(cdm, cohort((7, "2020-01-01", "2021-01-01")), concepts, "category", chronic_lookback=3)
        assert rows(found, "category", "person_start_date") == [("Acute", day("2020-01-01")), ("Chronic", day("2018-01-01"))]
        joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
        assert (first == "concept_id") == ("person_id" in joins[0])
    finally:
        spark.conf.unset(BROADCAST_CONF)


def test_source_code_search(spark, make_cdm, cohort, both_joins):
    cdm = make_cdm(
        STANDARD,
        condition=[(7, 1, "2020-05-05", "I10"), (7, 77, "2020-05-06", "I10"), (7, 2, "2020-05-05", "X")],
        procedure=[(7, 3, "2020-07-07", "99213"), (7, 3, "2022-07-07", "99213")],
    )
    diagnoses = spark.createDataFrame([("I10", "HTN"), ("I10", "HTN")], "code string, deficit string")
    procedures = spark.createDataFrame([("99213", "Visit")], "code string, deficit string")
    found = events.find_events_by_source_code(cdm, cohort((7, "2020-01-01", "2021-01-01")), [diagnoses, procedures])
    assert rows(found, "concept_id", "concept_name", "deficit", "vocabulary_id") == [
        (1, "name 1", "HTN", "SNOMED"),
        (3, "name 3", "Visit", "SNOMED"),
        (77, None, "HTN", None),
    ]


def test_arguments_are_checked(spark, make_cdm, cohort):
    cdm, people = make_cdm(STANDARD), cohort((7, "2020-01-01", "2021-01-01"))
    concepts = spark.createDataFrame([("A", 1, "vafi", 1.0)], "category string, concept_id long, fi string, score double")
    with pytest.raises(ValueError, match="output"):
        events.find_events(cdm, people, concepts, "everything")
    with pytest.raises(ValueError, match="unknown domains"):
        events.find_events(cdm, people, concepts, domains=["death"])
    with pytest.raises(ValueError, match="lookbacks"):
        events.find_events(cdm, people, concepts, acute_lookback=0)
    with pytest.raises(ValueError, match="choose from"):
        events.code_index_events(cdm, concepts, "efi", people)
    with pytest.raises(ValueError, match="no rows"):
        events.frailty_events(cdm, concepts, "hfrs", people)
    with pytest.raises(ValueError, match="lacks column"):
        events.search_window(people, start="visit_lookback_date")
    assert events.frailty_events(cdm, concepts, "VAFI", people).count() == 0


def test_repeated_events_go_before_codes_unfold_to_deficits(spark, make_cdm):
    found = [(1, 10, "2020-03-01", "A1")] * 3 + [(1, 10, "2020-03-02", "A1"), (1, 11, "2020-03-01", "Z9"), (1, 12, "2020-03-01", None)]
    cdm = make_cdm([(10, "S"), (11, "S"), (12, "S")], condition=found, device=found[:1])
    cohort = spark.createDataFrame([(1, day("2020-01-01"), day("2020-12-31"))], "person_id long, person_start_date date, person_end_date date")
    codes = spark.createDataFrame([("A1", f"d{k}") for k in range(30)] * 2, "code string, deficit string")
    hits = events.find_events_by_source_code(cdm, cohort, [codes, codes])
    got = rows(hits, "concept_id", "start_date", "deficit", "concept_name")
    # Once in the device table too.
    days = ["2020-03-01", "2020-03-01", "2020-03-02"]
    assert got == sorted((10, day(d), f"d{k}", "name 10") for k in range(30) for d in days)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    distinct = [line for line in plan.splitlines() if "Aggregate [" in line and "person_id" in line]
    assert distinct and not any("deficit" in line for line in distinct)
