"""Every registered query against its SQL twin, on the smallest tables."""

import importlib

import duckdb
import pytest

from conftest import DATA
from frailscope.plans import catalog, oracle

entry = importlib.import_module("__spark_entry__")
SF = f"{DATA}/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}
# The search, join and scoring paths that change when nothing may be broadcast.
LARGE_PATHS = [
    "events_raw",
    "events_chronic_lookback_concept",
    "events_by_source_code",
    "ingredients_overlapping",
    "fi_by_person_weighted",
    "category_prevalence_all_periods",
    "pruned_mappings",
    "code_patterns_to_concepts",
    "frailty_summary_chronic_lookback",
    "several_index_events",
    "several_index_scores_all_periods",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("customer", "orders", "lineitem", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def compare(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    columns = sorted(kinds)
    order = [list(kinds).index(c) for c in columns]

    def tidy(value):
        return round(value, 5) + 0.0 if isinstance(value, float) else value

    ours = sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(tidy(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert ours == theirs
    assert ours, "the query returns nothing, so the comparison says nothing"


def test_every_query_has_a_twin():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", LARGE_PATHS)
def test_query_without_broadcast(spark, duck, name, both_joins):
    if both_joins == "shuffled":
        compare(spark, duck, name)


def test_entry_returns_the_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["age_group", "is_female", "n"]
    assert df.count() == 12
