"""Several indices in one search against separate studies, and sums that do not depend on the order of rows."""

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import DATA, day, rows
from frailscope.functions.sums import exact_sum
from frailscope.operators import events, scoring
from frailscope.plans import catalog, frailty

STRATA = ("age_group", "is_female")


@pytest.fixture(scope="module")
def inputs(spark):
    return catalog.Inputs(spark, f"{DATA}/sf0.001")


def test_studies_are_the_separate_ones(spark, inputs, both_joins):
    studies = inputs.studies(catalog.SEVERAL)
    for label, spec in catalog.SEVERAL.items():
        alone, together = inputs.study(spec), studies.study(label)
        assert rows(together.events.select(alone.events.columns)) == rows(alone.events)
        assert rows(together.scores.select(alone.scores.columns)) == rows(alone.scores)
        assert rows(together.summary().select(alone.summary().columns)) == rows(alone.summary())


def test_stacked_reports_search_once(spark, monkeypatch):
    searched = []
    domains = events.domain_events
    monkeypatch.setattr(events, "domain_events", lambda *args, **more: searched.append(args) or domains(*args, **more))
    found = catalog.queries()["stacked_category_reports"](spark, f"{DATA}/sf0.001")
    assert len(searched) == 1 and found.select("fi").distinct().count() == 2


def test_every_domain_is_scanned_once(spark, inputs):
    tables = {t: f"/{t}-marked" for t in ("condition_occurrence", "observation", "procedure_occurrence", "device_exposure")}

    class Counting:
        read: list[str] = []

        def table(self, name):
            self.read.append(name)
            return inputs.table(name)

    cdm = Counting()
    concepts = frailty.index_concepts(inputs.fi_indices, catalog.SEVERAL, inputs.table("lookbacks"))
    found = events.find_index_events(cdm, inputs.windows, concepts, (1, 3))
    assert sorted(cdm.read) == sorted([*tables, "concept"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    single = events.find_events(inputs.cdm, inputs.windows, inputs.vafi, "category")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("l_linenumber", plan)) == len(re.findall("l_linenumber", single))
    assert {r["index_name"] for r in found.select("index_name").distinct().collect()} == set(catalog.SEVERAL)


def test_windows_of_each_index_and_lookback(spark, make_cdm):
    """One concept in two indices with other lookbacks; dates on both edges of each window."""
    cdm = make_cdm([(1, "S"), (2, "S"), (3, None)], condition=[(1, 1, "2019-01-01"), (1, 2, "2017-01-01"), (1, 3, "2019-06-01")], device=[(2, 1, "2016-12-31"), (2, 1, None)])
    cohort = spark.createDataFrame(
        [(p, day("2019-01-01"), day("2020-01-01"), "g", 1) for p in (1, 2)],
        "person_id long, person_start_date date, person_end_date date, age_group string, is_female int",
    )
    indices = spark.createDataFrame(
        [("A", 1, "X", 0.5), ("A", 2, "x", 0.5), ("B", 1, "y", 1.0), ("B", 3, "y", 1.0), ("C", 1, "z", 1.0), (None, 2, "x", None)],
        "category string, concept_id long, fi string, score double",
    )
    lookbacks = spark.createDataFrame([("X", "A", 3), ("y", "B", 1)], "fi string, category string, lookback int")
    specs = {
        "long": frailty.IndexSpec("x", 10, 0.1, 0.2, chronic_lookback=3),
        "short": frailty.IndexSpec("X", 10, 0.1, 0.2),
        "y": frailty.IndexSpec("Y", 10, 0.1, 0.2, acute_lookback=4, chronic_lookback=1),
    }
    concepts = frailty.index_concepts(indices, specs, lookbacks)
    found = events.find_index_events(cdm, cohort, concepts, (1, 3, 4))
    assert rows(found, "person_id", "index_name", "category", "score") == [
        (1, "long", "A", 0.5),
        (1, "short", "A", 0.5),
        (1, "y", "B", 1.0),
        (2, "y", "B", 1.0),
    ]
    with pytest.raises(ValueError, match="lookback table"):
        frailty.index_concepts(indices, specs)
    with pytest.raises(ValueError, match="whole years"):
        events.find_index_events(cdm, cohort, concepts, (0,))
    with pytest.raises(ValueError, match="no indices"):
        frailty.frailty_studies(cdm, indices, {}, 1)
    empty = frailty.index_concepts(indices.limit(0), {"x": replace(specs["short"])})
    assert events.find_index_events(cdm, cohort, empty).count() == 0


@pytest.mark.parametrize("several", [False, True])
def test_classes_do_not_depend_on_the_order_of_rows(spark, several):
    """0.1 three times is 0.3, thirds are one, and 1e16 does not swallow the ones, however the rows are dealt."""
    data = [(1, "g", 1, f"c{k}", 0.1) for k in range(3)] + [(2, "g", 1, f"c{k}", 1 / 3) for k in range(3)]
    data += [(3, "g", 1, f"c{k}", v) for k, v in enumerate([0.7, 0.1, 0.2, 0.3, 0.4, 0.6, 0.05, 0.65])]
    people = spark.createDataFrame([(p, "g", 1) for p in (1, 2, 3, 4)], "person_id long, age_group string, is_female int")
    seen = set()
    for partitions in (1, 7, 200):
        random.Random(partitions).shuffle(data)
        found = spark.createDataFrame(data, "person_id long, age_group string, is_female int, category string, score double")
        found = found.repartition(partitions, F.rand(partitions))
        if several:
            cutoffs = {"a": scoring.Cutoffs(1, 0.3, 1.0), "b": scoring.Cutoffs(1, 1.0, 3.0)}
            tagged = found.withColumn("index_name", F.explode(F.array(F.lit("a"), F.lit("b"))))
            scores = scoring.fi_of_indices(tagged, people, cutoffs)
            got = rows(scores, "index_name", "person_id", "fi", "prefrail", "frail", "robust")
            assert [r[:2] + r[3:] for r in got] == [
                ("a", 1, 1, 0, 0), ("a", 2, 0, 1, 0), ("a", 3, 0, 1, 0), ("a", 4, 0, 0, 1),
                ("b", 1, 0, 0, 1), ("b", 2, 1, 0, 0), ("b", 3, 0, 1, 0), ("b", 4, 0, 0, 1),
            ]
        else:
            got = rows(scoring.fi_with_robust(found, people, 1, 0.3, 1.0), "person_id", "fi", "prefrail", "frail", "robust")
            assert got == [(1, 0.3, 1, 0, 0), (2, 1.0, 0, 1, 0), (3, 3.0, 0, 1, 0), (4, 0.0, 0, 0, 1)]
        seen.add(tuple(got))
    assert len(seen) == 1


def test_sums_that_no_decimal_holds(spark):
    values = [("nan", float("nan")), ("nan", 1.0), ("inf", float("inf")), ("big", 1e30), ("big", 1e30), ("none", None), ("some", None), ("some", 0.25), ("small", 1e-30)]
    found = spark.createDataFrame(values, "k string, v double").groupBy("k").agg(exact_sum("v").alias("s")).collect()
    got = {r["k"]: r["s"] for r in found}
    assert got["nan"] != got["nan"] and got["inf"] == float("inf") and got["big"] == 2e30
    assert got["none"] is None and got["some"] == 0.25 and got["small"] == 0.0
