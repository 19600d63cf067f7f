import pytest

from conftest import day, rows
from frailscope.operators import scoring as s


@pytest.fixture
def events(spark):
    return spark.createDataFrame(
        [
            (1, 10, "A", day("2020-01-01"), 0.5),  # first day
            (1, 10, "A", day("2020-02-01"), 0.5),
            (1, 11, "A", day("2020-02-01"), 0.7),  # other weight, same category
            (1, 12, "B", day("2020-12-31"), 2.0),  # last day: 365 days later
            (1, 13, "C", day("2021-01-01"), 4.0),  # after the window
            (2, 10, "A", day("2019-01-01"), 0.5),  # outside only
            (3, 10, "A", None, 0.5),
            (9, 10, "A", day("2020-02-01"), 0.5),  # not searched
        ],
        "person_id long, concept_id long, category string, start_date date, weight double",
    )


@pytest.fixture
def search(spark):
    return spark.createDataFrame([(i, day("2020-01-01")) for i in (1, 2, 3, 4)], "patient long, search_date date")


OPTIONS = {"search_person_id": "patient"}


def test_by_person(events, search, both_joins):
    assert rows(s.fi_by_person(events, search, **OPTIONS)) == [(1, 2.0, 1), (2, 0.0, 1), (3, 0.0, 1), (4, 0.0, 0)]


def test_by_person_with_row_weights(events, search):
    got = rows(s.fi_by_person(events, search, weight="weight", **OPTIONS))
    assert got[0] == (1, pytest.approx(3.2), 1)


def test_descending_order_and_interval(events, search):
    ordered = s.fi_by_person(events, search, ordered=True, interval=366, **OPTIONS).collect()
    assert [tuple(r) for r in ordered] == [(1, 3.0, 1), (2, 0.0, 1), (3, 0.0, 1), (4, 0.0, 0)]


def test_rejoin_keeps_the_search_rows(events, search, both_joins):
    got = s.fi_by_person(events, search.union(search), rejoin=True, **OPTIONS)
    assert got.columns == ["patient", "search_date", "fi", "found_ehr"]
    assert rows(got, "patient", "fi", "found_ehr")[::2] == [(1, 2.0, 1), (2, 0.0, 1), (3, 0.0, 1), (4, 0.0, 0)]
    assert got.count() == 8


def test_by_category_and_detail(events, search, both_joins):
    assert rows(s.frailty_index(events, search, by="category", **OPTIONS)) == [("A", 1.0), ("B", 1.0), ("C", 0.0)]
    assert rows(s.frailty_index(events, search, summary=False, **OPTIONS)) == [
        (1, "A", 1.0),
        (1, "B", 1.0),
        (1, "C", 0.0),
        (2, "A", 0.0),
        (3, "A", 0.0),
    ]
    with pytest.raises(ValueError, match="group by"):
        s.frailty_index(events, search, by="concept_id", **OPTIONS)


def test_other_column_names(events, search):
    renamed = events.withColumnsRenamed({"person_id": "pid", "category": "cat", "start_date": "d"})
    got = s.fi_by_person(renamed, search, person_id="pid", category="cat", event_date="d", **OPTIONS)
    assert rows(got)[0] == (1, 2.0, 1)
    with pytest.raises(ValueError, match="lacks column"):
        s.fi_by_person(renamed, search, **OPTIONS)


def test_found_events_are_summarized_without_a_window(events):
    assert rows(s.summarize_events(events)) == [(1, 3.0), (2, 1.0), (3, 1.0), (9, 1.0)]
    assert rows(s.summarize_events(events, "category", weight="weight")) == [
        ("A", pytest.approx(2.7)),
        ("B", 2.0),
        ("C", 4.0),
    ]


@pytest.fixture
def cohort(spark):
    people = [(1, "a", 0), (2, "a", 0), (3, "a", 1), (4, "a", 1), (4, "a", 1), (5, None, 1)]
    return spark.createDataFrame(people, "person_id long, age_group string, is_female int")


def test_classes_at_the_cut_offs(spark, cohort):
    found = [(1, "a", 0, "A", 1.0)] + [(2, "a", 0, c, 1.0) for c in "AB"] + [(3, "a", 1, c, 1.0) for c in "ABCA"]
    df = spark.createDataFrame(found, "person_id long, age_group string, is_female int, category string, score double")
    out = s.fi_with_robust(df, cohort, denominator=10, lb=0.2, ub=0.3)
    got = {r["person_id"]: (r["fi"], r["robust"], r["prefrail"], r["frail"]) for r in out.collect()}
    assert got == {
        1: (0.1, 1, 0, 0),
        2: (0.2, 0, 1, 0),
        3: (0.3, 0, 0, 1),
        4: (0.0, 1, 0, 0),
        5: (0.0, 1, 0, 0),
    }
    assert out.count() == 6  # person 4 has two cohort rows and no event
