import pytest

from conftest import day, rows
from frailscope.operators import agreement, rates, summaries

EVENTS = "person_id long, age_group string, is_female int, category string, score double"


@pytest.fixture
def cohort(spark):
    people = [(1, "a", 0), (2, "a", 0), (3, "b", 1), (4, None, 1)]
    return spark.createDataFrame(people, "person_id long, age_group string, is_female int")


@pytest.fixture
def events(spark):
    return spark.createDataFrame([(1, "a", 0, "X", 1.0), (2, "a", 0, "X", 1.0), (1, "a", 0, "Y", 1.0), (4, None, 1, "Y", 1.0)], EVENTS)


GRID = [
    (None, 1, "X", 1, 0.0, 0.0),
    (None, 1, "Y", 1, 1.0, 1.0),
    (None, 1, "Z", 1, 0.0, 0.0),
    ("a", 0, "X", 2, 2.0, 1.0),
    ("a", 0, "Y", 2, 1.0, 0.5),
    ("a", 0, "Z", 2, 0.0, 0.0),
    ("b", 1, "X", 1, 0.0, 0.0),
    ("b", 1, "Y", 1, 0.0, 0.0),
    ("b", 1, "Z", 1, 0.0, 0.0),
]


@pytest.mark.parametrize("unique", [True, False])
def test_prevalence_grid_has_its_zeros(spark, events, cohort, both_joins, unique):
    names = spark.createDataFrame([("X",), ("Y",), ("Z",), ("X",)], "category string")
    assert rows(summaries.category_prevalence(events, cohort, ["X", "Y", "Z"], unique_people=unique)) == GRID
    assert rows(summaries.category_prevalence(events, cohort, names, unique_people=unique)) == GRID
    kept = summaries.category_prevalence(events, cohort, names, unique_people=unique, drop_null_strata=True)
    assert rows(kept) == GRID[3:]


def test_prevalence_counts_repeated_cohort_rows(events, cohort):
    twice = cohort.union(cohort)
    got = summaries.category_prevalence(events, twice, ["X"])
    assert rows(got, "N", "count", "percent") == [(2, 0.0, 0.0), (2, 0.0, 0.0), (4, 4.0, 1.0)]


def test_fi_summary_adds_up(spark):
    fi = spark.createDataFrame(
        [("a", 0, 1, 0, 0), ("a", 0, 0, 1, 0), ("a", 0, 0, 0, 1), ("a", 0, 0, 0, 1)],
        "age_group string, is_female int, prefrail int, frail int, robust int",
    )
    assert rows(summaries.summarize_fi(fi)) == [("a", 0, 4, 1, 1, 2, 0.25, 0.25, 0.5)]


def test_category_report(spark, events, cohort):
    index = spark.createDataFrame([("X", 1, "vafi", 1.0)], "category string, concept_id long, fi string, score double")
    got = summaries.percent_category(events, cohort, "X", "vafi", index)
    assert rows(got) == [(None, 1, "X", 0.0, 0.0), ("a", 0, "X", 2.0, 1.0), ("b", 1, "X", 0.0, 0.0)]
    with pytest.raises(ValueError, match="category"):
        summaries.percent_category(events, cohort, "Y", "vafi", index)
    with pytest.raises(ValueError, match="index"):
        summaries.percent_category(events, cohort, "X", "efi", index)


def test_category_totals(events, cohort):
    assert rows(summaries.category_totals(events, cohort)) == [
        ("X", "a", 0, 2.0, 2, 1.0),
        ("Y", None, 1, 1.0, 1, 1.0),
        ("Y", "a", 0, 1.0, 2, 0.5),
    ]


def test_small_cells(spark):
    df = spark.createDataFrame([(19.0, 0.1), (20.0, 0.2)], "count double, percent double")
    assert rows(summaries.suppress_small_cells(df)) == [(0.0, 0.0), (20.0, 0.2)]
    assert rows(summaries.suppress_small_cells(df, mode="label")) == [("20", 0.2), ("<20", 0.0)]
    assert rows(summaries.suppress_small_cells(df, mode="label", keep_share=True)) == [("20", 0.2), ("<20", 0.1)]
    with pytest.raises(ValueError):
        summaries.suppress_small_cells(df, mode="blur")


def test_stacking_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1,)], "n int"), spark.createDataFrame([(2, 3)], "n int, m int")
    assert [tuple(r) for r in summaries.stack_summaries({"x": a, "y": b}, ["fi"]).collect()] == [(1, "x", None), (2, "y", 3)]
    with pytest.raises(ValueError):
        summaries.stack_summaries({})


def test_rates(spark):
    rows_in = [(1, "A", "2020-01-01"), (1, "A", "2020-06-01"), (1, "B", "2020-01-02"), (2, "A", "2020-01-01")]
    df = spark.createDataFrame(
        [(p, c, day(d), day("2021-01-01")) for p, c, d in rows_in],
        "person_id long, category string, start_date date, person_end_date date",
    )
    spans = rates.deficit_spans(df)
    assert rows(spans, "person_id", "category", "n") == [(1, "A", 2), (1, "B", 1), (2, "A", 1)]
    rate = rates.deficit_rates(spans)  # 366 days pass, 365 do not
    assert rows(rate, "person_id", "category") == [(1, "A"), (2, "A")]
    assert rate.agg({"event_per_year": "min"}).first()[0] == pytest.approx(0.99795, abs=1e-5)
    one = rates.rate_distribution(rate.filter("person_id = 1")).first()
    assert one["std"] is None and one["median"] == one["p95"] == one["avg"]


PAIRS = [("A", 9.0, 2.0), ("B", 6.0, 5.0), ("C", 8.0, 6.0), ("D", 7.0, 1.0), ("E", 10.0, 8.0), ("F", 6.0, 2.0), ("G", 3.0, None)]


def test_agreement(spark):
    pairs = spark.createDataFrame(PAIRS, "category string, score_a double, score_b double")
    complete = [(a, b) for _, a, b in PAIRS if b is not None]
    n = len(complete)
    grand = sum(a + b for a, b in complete) / (2 * n)
    msb = 2 * sum(((a + b) / 2 - grand) ** 2 for a, b in complete) / (n - 1)
    msw = sum((a - (a + b) / 2) ** 2 + (b - (a + b) / 2) ** 2 for a, b in complete) / n
    got = agreement.category_icc(pairs).first()
    assert got["subjects"] == 6 and got["icc"] == pytest.approx((msb - msw) / (msb + msw))
    assert agreement.category_icc(pairs, exclude="A").first()["subjects"] == 5
    straight = spark.createDataFrame([("A", 1.0, 2.0), ("B", 2.0, 4.0), ("C", 3.0, 0.0)], pairs.schema)
    assert agreement.category_correlation(straight, exclude="C").first()[0] == pytest.approx(1.0)


def test_correlation_of_a_score_that_does_not_vary(spark):
    schema = "category string, score_a double, score_b double"
    flat = spark.createDataFrame([("A", 1.0, 2.0), ("B", 2.0, 2.0), ("C", 3.0, 2.0), ("D", 4.0, 5.0)], schema)
    assert agreement.category_correlation(flat, exclude="D").first()[0] is None
    assert agreement.category_correlation(flat).first()[0] == pytest.approx(0.7745966692)
    assert agreement.category_correlation(flat.limit(0)).first()[0] is None
    assert agreement.category_correlation(flat.limit(1)).first()[0] is None


def test_totals_compared(spark, events):
    other = events.filter("category = 'X'").limit(1)
    assert rows(agreement.compare_category_totals(events, other)) == [("X", 2.0, 1.0), ("Y", 2.0, None)]


def test_reconciliation(spark):
    codes = spark.createDataFrame(
        [("A", 1, "I10", 5), ("A", 1, "I11", 3), ("B", 2, "E10", 4)], "category string, concept_id long, source_value string, n long"
    )
    concepts = spark.createDataFrame([("A", 1, 8), ("C", 3, 1)], "category string, concept_id long, n long")
    assert rows(agreement.reconcile_concepts(codes, concepts)) == [
        (1, "A", 16, 8, 2, 0.0),
        (2, "B", None, 4, 1, None),
        (3, "C", 1, None, 1, None),
    ]
    assert rows(agreement.reconcile_concepts(codes, concepts, rows=True), "concept_id", "icd_vs_omop") == [
        (1, -5),
        (1, -3),
        (2, None),
        (3, None),
    ]


def test_runs(spark):
    layout = "age_group string, is_female int, n long, frail double"
    new, old = spark.createDataFrame([("a", 0, 4, 0.5)], layout), spark.createDataFrame([("a", 0, 5, 0.25)], layout)
    assert rows(agreement.compare_runs(new, old)) == [("a", 0, "frail", "new", 0.5), ("a", 0, "frail", "old", 0.25)]
