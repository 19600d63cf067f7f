import random
from datetime import timedelta

import pytest

from conftest import day, rows
from frailscope.operators import polypharmacy as p

# The index date is 2021-01-01: one year back is 2020-01-01, 365 days back is 2020-01-02.
ERAS = [
    (1, 1, "2020-01-01", "2020-01-03"),  # starts on the first day
    (1, 2, "2019-06-01", "2020-01-01"),  # ends on the first day
    (1, 3, "2019-06-01", "2021-06-01"),  # spans the window
    (1, 4, "2021-01-01", "2021-04-05"),  # starts on the index date
    (1, 5, "2021-01-02", "2021-04-05"),  # too late
    (1, 6, "2020-05-01", "2020-05-02"),  # one day
    (1, 7, "2019-06-01", "2020-01-02"),  # ends 365 days before
    (1, 8, "2019-06-01", "2020-01-03"),
    (1, 8, "2020-02-01", "2020-05-03"),  # the same ingredient again
    (2, 1, "2018-01-01", "2018-02-01"),
]


@pytest.fixture
def eras(spark):
    return spark.createDataFrame(
        [(a, b, day(s), day(e)) for a, b, s, e in ERAS],
        "person_id long, drug_concept_id long, drug_era_start_date date, drug_era_end_date date",
    )


@pytest.fixture
def cohort(spark):
    return spark.createDataFrame(
        [(i, day("2021-01-01"), g, 0) for i, g in ((1, "a"), (2, "a"), (3, "b"))],
        "person_id long, index_date date, age_group string, is_female int",
    )


@pytest.mark.parametrize("min_days, n", [(1, 6), (2, 5), (30, 4), (90, 4)])
def test_endpoint_rule(eras, cohort, both_joins, min_days, n):
    assert rows(p.drug_exposure_counts(eras, cohort, min_days)) == [(1, n)]


def test_overlap_rule_sees_spanning_eras(spark, eras, cohort, both_joins):
    counts = p.drug_exposure_counts(eras, cohort, 90, rule="overlap")
    assert rows(counts) == [(1, 3)]  # 3, 4 and 8
    excluded = spark.createDataFrame([(3,), (99,)], "drug_concept_id long")
    assert rows(p.drug_exposure_counts(eras, cohort, 90, rule="overlap", exclude=excluded)) == [(1, 2)]
    with pytest.raises(ValueError, match="rule"):
        p.drug_exposure_counts(eras, cohort, 90, rule="any")


def test_one_person_with_most_eras(spark, cohort, both_joins):
    many = [(1, i % 40, day("2020-03-01"), day(f"2020-06-{1 + i % 28:02d}")) for i in range(400)]
    eras = spark.createDataFrame(
        many, "person_id long, drug_concept_id long, drug_era_start_date date, drug_era_end_date date"
    )
    assert rows(p.drug_exposure_counts(eras, cohort, 1)) == [(1, 40)]


def test_deficit_prevalence_and_distribution(spark, cohort):
    counts = spark.createDataFrame([(1, 10), (2, 4)], "person_id long, n long")
    deficit = p.polypharmacy_deficit(counts, cohort)
    assert rows(deficit) == [(1, "a", 0, "Polypharmacy", 1.0)]
    index = spark.createDataFrame(
        [(1, "a", 0, "X", 1.0), (1, "a", 0, "X", 1.0)],
        "person_id long, age_group string, is_female int, category string, score double",
    )
    assert p.add_deficit(index, deficit).count() == 2
    assert rows(p.zero_fill_counts(counts, cohort)) == [(1, 10), (2, 4), (3, 0)]
    assert rows(p.polypharmacy_prevalence(counts, cohort)) == [("a", 0.5), ("b", 0.0)]
    about = p.exposure_distribution(p.zero_fill_counts(counts, cohort)).first().asDict()
    assert (about["lowest"], about["median"], about["highest"], about["people"]) == (0, 4.0, 10, 3)
    assert about["q1"] == 2.0 and about["p90"] == pytest.approx(8.8) and about["mean"] == pytest.approx(14 / 3)
    assert about["share_from_10"] == pytest.approx(1 / 3) and about["share_from_15"] == 0.0


def brute_counts(eras, windows, min_days, rule, exclude=()):
    found = {}
    for person, drug, start, end in eras:
        if None in (start, end) or (end - start).days < min_days or drug in exclude:
            continue
        for who, index in windows:
            if who != person or index is None:
                continue
            if rule == "endpoint":
                year = 365 if (index.month, index.day) != (2, 29) else None
                opens = index.replace(year=index.year - 1) if year else index.replace(year=index.year - 1, day=28)
                hit = opens <= start <= index or opens <= end <= index
            else:
                opens = index - timedelta(days=365)
                hit = opens < start <= index or (start <= opens and end > opens)
            if hit:
                found.setdefault(person, set()).add(drug)
    return sorted((p, len(d)) for p, d in found.items())


@pytest.mark.parametrize("rule, min_days", [("endpoint", 2), ("overlap", 2), ("overlap", -40), ("endpoint", -40)])
def test_persons_with_many_windows_and_eras(spark, both_joins, rule, min_days):
    """Several index dates a person, overlapping, touching and far apart; long eras and some that end before they start."""
    rng = random.Random(rule)
    base = day("2010-01-01")
    windows = [(p, base + timedelta(days=rng.randrange(4000))) for p in range(1, 9) for _ in range(rng.randrange(1, 12))]
    windows += [(1, day("2016-02-29")), (2, day("2015-01-01")), (2, day("2016-01-01")), (2, day("2016-01-01")), (3, None)]
    eras = []
    for _ in range(1500):
        start = base + timedelta(days=rng.randrange(-900, 4800))
        eras.append((rng.randrange(1, 10), rng.randrange(60), start, start + timedelta(days=rng.choice([-30, 0, 1, 2, 5, 400, 3000]))))
    eras += [(1, 99, None, base), (1, 98, base, None)]
    table = spark.createDataFrame(eras, "person_id long, drug_concept_id long, drug_era_start_date date, drug_era_end_date date")
    cohort = spark.createDataFrame(windows, "person_id long, index_date date")
    assert rows(p.drug_exposure_counts(table, cohort, min_days, rule=rule)) == brute_counts(eras, windows, min_days, rule)
    assert p.drug_exposure_counts(table, cohort.limit(0), min_days, rule=rule).count() == 0


def test_rows_grow_with_eras_and_windows_not_with_their_product(spark, monkeypatch):
    made = []
    joined = p.people_join

    def counted(*args, **options):
        out = joined(*args, **options)
        made.append(out.count())
        return out

    monkeypatch.setattr(p, "people_join", counted)
    base = day("1950-01-01")
    for n in (200, 400):
        eras = [(1, k % 50, base + timedelta(days=60 * k), base + timedelta(days=60 * k + 30)) for k in range(n)]
        windows = [(1, base + timedelta(days=45 * k + 400)) for k in range(n)]
        table = spark.createDataFrame(eras, "person_id long, drug_concept_id long, drug_era_start_date date, drug_era_end_date date")
        cohort = spark.createDataFrame(windows, "person_id long, index_date date")
        assert rows(p.drug_exposure_counts(table, cohort, 2)) == brute_counts(eras, windows, 2, "endpoint")
    assert made[1] <= 2 * made[0] + 10 and made[0] <= 600


def test_merged_windows(spark):
    data = [(1, "2020-01-01", "2020-02-01"), (1, "2020-02-01", "2020-03-01"), (1, "2020-03-02", "2020-04-01"), (1, "2020-01-10", "2020-01-20"), (2, "2020-05-01", "2020-04-01"), (2, None, "2020-04-01")]
    windows = spark.createDataFrame([(a, day(b), day(c)) for a, b, c in data], "person_id long, o date, c date")
    assert rows(p.merged_windows(windows, "o", "c"), "person_id", "o", "c") == [
        (1, day("2020-01-01"), day("2020-03-01")),
        (1, day("2020-03-02"), day("2020-04-01")),
    ]
