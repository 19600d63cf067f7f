"""Control counts of the OMOP-shaped views and of the flagship (FIXTURES.md, section 4)."""

import pytest
from pyspark.sql import functions as F

from conftest import DATA, rows
from frailscope.operators import concepts, events
from frailscope.plans.catalog import CHRONIC_3, ONE_YEAR, SEED, Inputs
from frailscope.plans.frailty import build_cohort
from frailscope.sources.fixtures import FixtureCdm

COUNTS = {
    "person": 150,
    "visit_occurrence": 1500,
    "observation_period": 165,
    "concept": 200,
    "concept_relationship": 286,
    "concept_ancestor": 200,
    "condition_occurrence": 2515,
    "observation": 1717,
    "procedure_occurrence": 850,
    "device_exposure": 918,
    "drug_era": 6000,
    "drug_exclusions": 8,
    "cb_search_person": 150,
}


@pytest.fixture(scope="module")
def small(spark):
    return Inputs(spark, f"{DATA}/sf0.001")


def test_table_counts(small):
    assert {name: small.table(name).count() for name in COUNTS} == COUNTS


def test_index_counts(small):
    got = rows(
        small.fi_indices.groupBy("fi").agg(
            F.count("*").alias("n"), F.countDistinct("category").alias("c"), F.countDistinct("concept_id").alias("k")
        )
    )
    assert got == [("efi", 229, 31, 200), ("hfrs", 107, 25, 107), ("vafi", 165, 25, 165)]


def test_cohort_counts(small):
    everyone = build_cohort(small.cdm, SEED, dedupe=False)
    assert (everyone.count(), everyone.select("person_id").distinct().count()) == (100, 92)
    assert everyone.filter("yob_imputed = 1").count() == 64
    assert small.cohort.count() == 92


@pytest.mark.parametrize(
    "spec, event_rows, people, classes",
    [(ONE_YEAR, 400, 91, (18, 49, 25)), (CHRONIC_3, 653, 91, (3, 25, 64))],
)
def test_flagship_with_repeated_people(small, spec, event_rows, people, classes):
    study = small.study(spec, dedupe=False)
    assert study.events.count() == event_rows
    assert study.events.select("person_id").distinct().count() == people
    got = study.scores.agg(F.sum("robust"), F.sum("prefrail"), F.sum("frail")).first()
    assert tuple(got) == classes


def test_same_seed_same_visits_whatever_the_layout(spark, small):
    from frailscope.operators.cohort import random_index_visit

    person, visit = small.table("person"), small.table("visit_occurrence")
    first = rows(random_index_visit(person, visit, SEED))
    assert rows(random_index_visit(person.repartition(3), visit.repartition(13), SEED)) == first
    assert rows(random_index_visit(person, visit, "43")) != first


def test_like_mapping_count(small):
    mapped = concepts.map_codes_like(
        small.table("code_patterns"), small.table("concept"), small.table("concept_relationship")
    )
    assert mapped.count() == 11


def test_longer_lookback_never_loses_events(small):
    flagged = small.vafi_lookback
    one = events.find_events(small.cdm, small.windows, small.vafi, "category").select("person_id", "category")
    three = events.find_events(small.cdm, small.windows, flagged, "category", chronic_lookback=3)
    assert one.join(three.select("person_id", "category"), ["person_id", "category"], "left_anti").count() == 0


def test_events_are_the_union_of_their_domains(small):
    whole = events.find_events(small.cdm, small.windows, small.vafi).count()
    parts = [events.find_events(small.cdm, small.windows, small.vafi, domains=[d]).count() for d in events.DOMAINS]
    assert whole == sum(parts)


@pytest.fixture
def own_tables(spark, tmp_path):
    """One order of person 7, its lines of every number, of none and of no domain, one of them twice."""
    lines = [(1, 1, n, 1.0, "2020-05-05") for n in (1, 1, 2, 3, 4, 5, 6, 7, 8, None)]
    tables = {
        "customer": ([(7,)], "c_custkey long"),
        "orders": ([(1, 7, "2020-01-01")], "o_orderkey long, o_custkey long, o_orderdate string"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_shipdate string"),
        "part": (
            [(1, "bolt", "Brand#1", "PROMO", 41), (7, "nut", "Brand#2", "LARGE", 20), (20, "cog", None, "LARGE", None)],
            "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
        ),
    }
    for name, (data, layout) in tables.items():
        df = spark.createDataFrame(data, layout)
        dates = {c: F.col(c).cast("timestamp_ntz") for c in df.columns if c.endswith("date")}
        df.withColumns(dates).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("source_values", [False, True])
def test_order_lines_meet_their_orders_once_for_all_domains(spark, own_tables, source_values):
    cdm = FixtureCdm(spark, own_tables, source_values)
    stacked = events.domain_events(cdm, source_values=source_values)
    plan = stacked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1 and plan.count("Relation [o_orderkey") == 1
    one_by_one = [events.domain_events(cdm, [d], source_values) for d in events.DOMAINS]
    assert [df.count() for df in one_by_one] == [4, 2, 1, 1]
    assert rows(stacked) == sorted(r for df in one_by_one for r in rows(df))
    names = events.DOMAINS["condition"]
    assert ("l_linenumber" in cdm.table(names.table).columns, names.source in cdm.table(names.table).columns) == (False, source_values)
    by_name = cdm.table(names.table).select("person_id", names.concept, names.date)
    assert rows(by_name) == rows(one_by_one[0], "person_id", "concept_id", "start_date")


def test_a_domain_asked_for_twice_is_stacked_twice(spark, own_tables):
    assert events.domain_events(FixtureCdm(spark, own_tables), ["device", "device"]).count() == 2


def test_concepts_of_the_indices(spark, own_tables):
    found = FixtureCdm(spark, own_tables).table("fi_indices")
    assert "array_compact" not in found._jdf.queryExecution().analyzed().toString()
    assert rows(found, "concept_id", "fi", "category", "score") == [
        (1, "efi", "Brand#1", 1.0),
        (1, "hfrs", "Brand#1", 4.1),
        (7, "efi", "Brand#2", 1.0),
        (7, "efi", "LARGE", 1.0),
        (7, "vafi", "Brand#2", 1.0),
        (20, "efi", None, 1.0),
    ]
