import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from frailscope.functions.joins import BROADCAST_CONF, SALT_CONF  # noqa: E402
from frailscope.session import local_session  # noqa: E402
from frailscope.sources.cdm import OmopCdm  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session("frailscope-tests", cpus=8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["broadcast", "shuffled"])
def both_joins(request, spark):
    """Runs a test with broadcast lookups and again with shuffled, salted joins only."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if request.param == "shuffled":
        spark.conf.set(BROADCAST_CONF, "0")
        spark.conf.set(SALT_CONF, "3")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.unset(BROADCAST_CONF)
    spark.conf.unset(SALT_CONF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def day(text):
    return date.fromisoformat(text) if text else None


def rows(df, *columns):
    """Rows as sorted tuples, NULLs first."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: [(v is not None, v) for v in t])


@pytest.fixture
def make_cdm(spark):
    """A CDM of hand-made rows: events as (person, concept, date[, source]) per domain."""
    from frailscope.operators.events import DOMAINS

    def build(concepts, source_values=False, **domains):
        tables = {
            "concept": spark.createDataFrame(
                [(i, f"name {i}", f"C{i}", "SNOMED", standard) for i, standard in concepts],
                "concept_id long, concept_name string, concept_code string, vocabulary_id string, standard_concept string",
            )
        }
        for domain, names in DOMAINS.items():
            data = [(r[0], r[1], day(r[2]), r[3] if len(r) > 3 else None) for r in domains.get(domain, [])]
            tables[names.table] = spark.createDataFrame(
                data, f"person_id long, {names.concept} long, {names.date} date, {names.source} string"
            )
        return OmopCdm(spark, tables=tables)

    return build
