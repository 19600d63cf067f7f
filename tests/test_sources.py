import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import day, rows
from frailscope.functions.joins import BROADCAST_CONF, HOT_ROWS_CONF, SALT_CONF, people_join
from frailscope.functions.quantiles import exact_quantiles, ordered_buckets
from frailscope.operators import events
from frailscope.sources import cdm, scratch


@pytest.fixture
def plain_conf(spark):
    """Takes back what a test sets."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    yield
    spark.conf.unset(BROADCAST_CONF)
    spark.conf.unset(SALT_CONF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_tables_by_view_path_and_schema(spark, folder):
    person = spark.createDataFrame([(1, 1960, 8507)], "person_id long, year_of_birth int, gender_concept_id int")
    person.createOrReplaceTempView("person")
    assert cdm.OmopCdm(spark).table("person").count() == 1
    spark.catalog.dropTempView("person")
    cdm.checkpoint_table(person, "person", path=folder)
    assert cdm.OmopCdm(spark, path=folder).table("person").count() == 1
    assert cdm.OmopCdm(spark, tables={"person": person}).table("person").count() == 1
    with pytest.raises(ValueError, match="schema must be a string"):
        cdm.OmopCdm(spark, schema=5)
    with pytest.raises(ValueError, match="not both"):
        cdm.OmopCdm(spark, schema="a", path="b")
    with pytest.raises(ValueError, match="person lacks column"):
        cdm.OmopCdm(spark, tables={"person": person.drop("year_of_birth")}).table("person")


def test_catalog_tables_and_buckets(spark, tmp_path, make_cdm, plain_conf):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS frailscope_test LOCATION '{tmp_path}/db'")
    try:
        names = events.DOMAINS["condition"]
        rows_in = [(p, 1, day("2020-05-05"), "x") for p in range(50)]
        raw = spark.createDataFrame(
            rows_in, f"person_id long, {names.concept} long, {names.date} date, {names.source} string"
        )
        cdm.bucket_by_person(raw, names.table, "frailscope_test", buckets=4, sort_by=names.date)
        stored = cdm.checkpoint_table(spark.range(3), "numbers", schema="frailscope_test")
        assert stored.count() == 3
        assert cdm.checkpoint_table(spark.range(5), "numbers", schema="frailscope_test").count() == 5
        source = cdm.OmopCdm(spark, schema="frailscope_test", tables={"concept": make_cdm([(1, "S")]).table("concept")})
        people = spark.createDataFrame(
            [(p, day("2020-01-01"), day("2021-01-01"), "x" * 40) for p in range(50)],
            "person_id long, person_start_date date, person_end_date date, age_group string",
        )
        members = spark.createDataFrame([("A", 1, 1.0)], "category string, concept_id long, score double")
        # The concepts may be broadcast and the people may not.
        spark.conf.set(BROADCAST_CONF, "1000")
        spark.conf.set(SALT_CONF, "1")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = events.find_events(source, people, members, "category", domains=["condition"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [person_id" in plan
        assert len([line for line in plan.splitlines() if "Exchange hashpartitioning(person_id" in line]) == 1  # people
        assert found.count() == 50
    finally:
        spark.sql("DROP DATABASE frailscope_test CASCADE")


def test_hot_persons_do_not_undo_the_buckets(spark, tmp_path, plain_conf):
    """Facts of all but the hot person are joined where they lie; only the hot one's are salted and shuffled."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS frailscope_hot LOCATION '{tmp_path}/db'")
    try:
        facts = spark.range(900).select(
            F.when(F.col("id") < 300, 7).otherwise(F.col("id") % 97).cast("long").alias("person_id"),
            (F.col("id") % 13).alias("concept_id"),
            F.col("id").alias("n"),
        )
        stored = cdm.bucket_by_person(facts.union(facts.limit(1).withColumn("person_id", F.lit(None).cast("long"))), "facts", "frailscope_hot", buckets=4)
        people = spark.createDataFrame([(p, f"g{p}") for p in range(60)] + [(7, "again"), (None, "x")], "person_id long, age_group string")
        expected = rows(facts.join(people, "person_id").select("person_id", "concept_id", "n", "age_group"))
        spark.conf.set(BROADCAST_CONF, "10")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set(SALT_CONF, "4")
        spark.conf.set(HOT_ROWS_CONF, "100")
        joined = people_join(stored, people, spread_by=["concept_id", "n"])
        assert rows(joined.select("person_id", "concept_id", "n", "age_group")) == expected
        plan = joined._jdf.queryExecution().executedPlan().toString()
        plan = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
        cold = re.split(r"(?=SortMergeJoin \[)", plan)
        assert len(cold) == 3 and "_salt" in cold[2].splitlines()[0] and "_salt" not in cold[1].splitlines()[0]
        dealt = [line for line in cold[1].splitlines() if "Exchange hashpartitioning" in line]
        assert len(dealt) == 1  # the people's
        assert "Bucketed: true" in cold[1]
        # Facts that do not lie by person are salted as a whole, in one pass.
        whole = people_join(facts, people, spread_by=["concept_id", "n"])
        assert rows(whole.select("person_id", "concept_id", "n", "age_group")) == expected
        assert whole._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
        spark.sql("DROP DATABASE frailscope_hot CASCADE")


def test_dated_tables_are_read_for_the_months_of_the_windows(spark, tmp_path, make_cdm):
    names = events.DOMAINS["condition"]
    dates = [f"{y}-{m:02d}-{d:02d}" for y in range(2015, 2021) for m in range(1, 13) for d in (1, 28)]
    condition = [(p, 1, d) for p in (1, 2) for d in dates] + [(1, 1, None), (1, 2, "2019-07-01")]
    plain = make_cdm([(1, "S"), (2, "S")], condition=condition, procedure=[(1, 2, "2016-06-01")], device=[(1, 1, "2019-03-01"), (2, 2, "2014-01-01")])
    folder = str(tmp_path)
    for columns in events.DOMAINS.values():
        table = plain.table(columns.table)
        if columns.table == "observation":
            cdm.checkpoint_table(table, columns.table, path=folder)  # one table in the plain layout
        else:
            stored = cdm.partition_by_month(table, columns.table, columns.date, path=folder)
            assert stored.count() == table.count() and stored.columns[-1] == "event_month"
    cdm.checkpoint_table(plain.table("concept"), "concept", path=folder)
    dated = cdm.OmopCdm(spark, path=folder)
    people = spark.createDataFrame(
        [(1, day("2018-03-15"), day("2019-03-15"), "a", 1), (2, day("2018-05-01"), day("2019-05-01"), "b", 0)],
        "person_id long, person_start_date date, person_end_date date, age_group string, is_female int",
    )
    members = spark.createDataFrame([("A", 1, 1.0), ("B", 2, 1.0)], "category string, concept_id long, score double")
    for options in ({}, {"acute_lookback": 2, "chronic_lookback": 2}):
        found, expected = (events.find_events(c, people, members, "concept", **options) for c in (dated, plain))
        assert rows(found) == rows(expected) and found.columns == expected.columns
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    found = events.find_events(dated, people, members, "concept")
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = [f for f in re.findall(r"PartitionFilters: \[(.*?)\]", plan) if "event_month" in f]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert len(filters) == 3 and all("2018-03-01" in f and "2019-05-01" in f for f in filters)
    everything = dated.table(names.table)
    year = everything.filter("event_month between date'2018-03-01' and date'2019-05-01'")
    files, read = (df.select(F.input_file_name()).distinct().count() for df in (everything, year))
    assert 15 <= read < files / 3
    # Rebuilt from itself.
    again = cdm.partition_by_month(dated.table(names.table), names.table, names.date, path=folder)
    assert again.count() == len(condition)
    with pytest.raises(ValueError):
        cdm.partition_by_month(again, "x", names.date)
    cdm.partition_by_month(again.limit(0), "empty", names.date, path=folder)
    assert spark.read.parquet(f"{folder}/empty").columns == again.columns


def test_checkpoint_needs_one_place(spark, folder):
    with pytest.raises(ValueError):
        cdm.checkpoint_table(spark.range(1), "x")
    with pytest.raises(ValueError):
        cdm.checkpoint_table(spark.range(1), "x", schema="a", path=folder)


def test_every_store_lands_in_the_shared_folder(spark):
    stored = scratch.store(spark.range(10), "numbers")
    measured, seen = scratch.store_and_measure(spark.range(7), "more", rows=F.count(F.lit(1)))
    assert (stored.count(), measured.count(), seen["rows"]) == (10, 7, 7)
    place = scratch.scratch_folder(spark)
    assert place.startswith(spark.conf.get("spark.checkpoint.dir") + "/")
    assert all(place in path for path in [*stored.inputFiles(), *measured.inputFiles()])


def test_stored_tables_can_be_cleared(spark, folder, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_folder", lambda spark: f"{folder}/own")
    scratch.store(spark.range(3), "numbers")
    assert Path(folder, "own").exists()
    scratch.clear_scratch(spark)
    assert not Path(folder, "own").exists()


def test_a_scope_deletes_what_it_stored(spark, folder, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_folder", lambda spark: f"{folder}/own")
    outer = scratch.store(spark.range(4), "outer")
    with scratch.scratch_scope(spark):
        inner = scratch.store(spark.range(3), "inner")
        with scratch.scratch_scope(spark) as keep:
            passed_on = keep(scratch.store(inner, "innermost"), "passed_on")
        assert passed_on.count() == 3
        inner.write.parquet(f"{folder}/kept")
    assert outer.count() == 4 and spark.read.parquet(f"{folder}/kept").count() == 3
    assert len(list(Path(folder, "own").iterdir())) == 1
    with pytest.raises(ZeroDivisionError), scratch.scratch_scope(spark):
        scratch.store(spark.range(3), "lost")
        raise ZeroDivisionError
    assert len(list(Path(folder, "own").iterdir())) == 1


def broken(df):
    """Rows of ``df``, and a failure in the last of several tasks."""
    return df.repartition(4).select(*df.columns).union(
        df.limit(1).select(*(F.raise_error(F.lit("broken")).cast(t).alias(c) for c, t in df.dtypes))
    )


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    """In the catalog, below a path, and as CSV; nothing is left behind."""
    old = spark.createDataFrame([(k, f"n{k}") for k in range(20)], "n long, name string")
    new = broken(spark.createDataFrame([(k, f"x{k}") for k in range(9)], old.schema))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS frailscope_atomic LOCATION '{tmp_path}/db'")
    try:
        cdm.checkpoint_table(old, "t", schema="frailscope_atomic")
        cdm.checkpoint_table(old, "t", path=f"{tmp_path}/tables")
        cdm.write_summary(old, f"{tmp_path}/csv/t")
        with pytest.raises(Exception, match="broken"):
            cdm.checkpoint_table(new, "t", schema="frailscope_atomic")
        with pytest.raises(Exception, match="broken"):
            cdm.bucket_by_person(new.withColumnRenamed("n", "person_id"), "t", "frailscope_atomic", buckets=2)
        with pytest.raises(Exception, match="broken"):
            cdm.checkpoint_table(new, "t", path=f"{tmp_path}/tables")
        with pytest.raises(Exception, match="broken"):
            cdm.write_summary(new, f"{tmp_path}/csv/t")
        expected = sorted(map(tuple, old.collect()))
        for found in (
            spark.table("frailscope_atomic.t"),
            spark.read.parquet(f"{tmp_path}/tables/t"),
            cdm.read_codes(spark, f"{tmp_path}/csv/t", old.schema),
        ):
            assert sorted(map(tuple, found.collect())) == expected
        assert [t.name for t in spark.catalog.listTables("frailscope_atomic")] == ["t"]
        assert [p.name for p in Path(tmp_path, "tables").iterdir()] == ["t"]
        assert [p.name for p in Path(tmp_path, "csv").iterdir()] == ["t"]
    finally:
        spark.sql("DROP DATABASE frailscope_atomic CASCADE")


def test_a_table_may_be_rebuilt_from_itself(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS frailscope_atomic LOCATION '{tmp_path}/db'")
    try:
        for place in ({"schema": "frailscope_atomic"}, {"path": str(tmp_path)}):
            table = cdm.checkpoint_table(spark.range(10), "t", **place)
            for n in (5, 3):
                table = cdm.checkpoint_table(table.filter(F.col("id") < n).withColumn(f"more_{n}", F.lit(n)), "t", **place)
                assert sorted(r["id"] for r in table.collect()) == list(range(n))
            assert table.columns == ["id", "more_5", "more_3"]
        codes = spark.createDataFrame([("a", 1), ("b", 2)], "code string, n int")
        cdm.write_summary(codes, f"{tmp_path}/csv")
        cdm.write_summary(cdm.read_codes(spark, f"{tmp_path}/csv", codes.schema).filter("n > 1"), f"{tmp_path}/csv")
        assert [tuple(r) for r in cdm.read_codes(spark, f"{tmp_path}/csv", codes.schema).collect()] == [("b", 2)]
    finally:
        spark.sql("DROP DATABASE frailscope_atomic CASCADE")


def test_a_replacement_cut_off_between_its_renames_is_put_back(spark, tmp_path, monkeypatch):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS frailscope_atomic LOCATION '{tmp_path}/db'")
    try:
        cdm.checkpoint_table(spark.range(4), "t", schema="frailscope_atomic")
        cdm.checkpoint_table(spark.range(4), "t", path=f"{tmp_path}/tables")
        rename = scratch.Folders.rename
        monkeypatch.setattr(
            scratch.Folders, "rename", lambda self, a, b: rename(self, a, b) if "_new-" not in a else exec("raise KeyboardInterrupt")
        )
        with pytest.raises(KeyboardInterrupt):
            cdm.checkpoint_table(spark.range(9), "t", path=f"{tmp_path}/tables")
        monkeypatch.undo()
        assert not Path(tmp_path, "tables", "t").exists()
        assert cdm.restore_folder(spark, f"{tmp_path}/tables/t") and not cdm.restore_folder(spark, f"{tmp_path}/tables/t")
        assert spark.read.parquet(f"{tmp_path}/tables/t").count() == 4
        spark.sql("ALTER TABLE frailscope_atomic.t RENAME TO frailscope_atomic.t__replaced")
        with pytest.raises(Exception, match="broken"):
            cdm.checkpoint_table(broken(spark.range(3)), "t", schema="frailscope_atomic")
        assert spark.table("frailscope_atomic.t").count() == 4
        assert cdm.checkpoint_table(spark.range(6), "t", schema="frailscope_atomic").count() == 6
    finally:
        spark.sql("DROP DATABASE frailscope_atomic CASCADE")


def test_csv_round_trip(spark, folder):
    df = spark.createDataFrame([("b", 2, 0.5), ("a", 1, None)], "category string, n long, share double")
    cdm.write_summary(df, f"{folder}/out", order_by=["category"])
    back = cdm.read_codes(spark, f"{folder}/out", df.schema)
    assert [tuple(r) for r in back.collect()] == [("a", 1, None), ("b", 2, 0.5)]
    assert len(back.inputFiles()) == 1


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_of_crowded_values_are_ranked_in_several_tasks(spark, keys):
    """One octave holds a thousand times as many values as a bucket may, close together, and one value far off."""
    crowd = spark.range(20_000).select(F.lit("crowd").alias("k"), (1 + F.pow(F.col("id") / 20_000, 9) / 100).alias("v"))
    odd = [("crowd", 1.7e308), ("crowd", -1.7e308), ("two", 5.0), ("two", 5.0), ("two", float("inf")), ("crowd", 1.0), (None, 1.5), (None, 2.5)]
    values = crowd.union(spark.createDataFrame(odd, "k string, v double"))
    probs = {"p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}
    got = rows(exact_quantiles(values, keys, "v", probs, most_values=20))
    expected = rows(values.groupBy(*keys).agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()]))
    assert len(got) == len(expected)
    for ours, theirs in zip(got, expected, strict=True):
        assert ours[: len(keys)] == theirs[: len(keys)]
        assert ours[len(keys) :] == pytest.approx(theirs[len(keys) :], rel=1e-15, nan_ok=True)
    histogram = values.groupBy(*keys, F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_freq"))
    cut = ordered_buckets(scratch.store(histogram, "h"), keys, 20).filter("_v < 1e300")
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    found = sizes.orderBy(*keys, "_bucket").collect()
    assert len(found) > 1000 and max(r["n"] for r in found) <= 20
    in_order = [(r["lo"], r["hi"]) for r in found if not keys or r["k"] == "crowd"]
    assert in_order == sorted(in_order)


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_are_exact(spark, keys):
    """One key holds nearly all rows and many repeats."""
    values = spark.range(4000).select(
        F.when(F.col("id") % 50 == 0, "small").otherwise("hot").alias("k"),
        F.round(F.pow(F.col("id") % 977, 1.3) - 40, 2).alias("v"),
    )
    values = values.union(spark.createDataFrame([("one", 3.0), ("hot", None)], values.schema))
    probs = {"lo": 0.0, "p05": 0.05, "median": 0.5, "p95": 0.95, "hi": 1.0}
    got = exact_quantiles(values, keys, "v", probs).sort(*keys).collect() if keys else exact_quantiles(values, keys, "v", probs).collect()
    expected = values.groupBy(*keys).agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()])
    expected = expected.sort(*keys).collect() if keys else expected.collect()
    for ours, theirs in zip(got, expected, strict=True):
        assert tuple(ours[: len(keys)]) == tuple(theirs[: len(keys)])
        assert tuple(ours[len(keys) :]) == pytest.approx(tuple(theirs[len(keys) :]))
