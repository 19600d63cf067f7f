"""Reading OMOP tables and code lists, storing tables, writing summaries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frailscope.schemas import EVENT_MONTH, TABLES, require_columns
from frailscope.sources.scratch import Folders

# Where the old rows wait while the new ones take their place.
_REPLACED = "__replaced"


class OmopCdm:
    """OMOP tables by name: from a catalog schema, a folder of parquet tables, or given DataFrames.

    ``OmopCdm(spark, schema="cdm")`` reads ``cdm.<table>``; ``OmopCdm(spark, path="/data/cdm")``
    reads ``/data/cdm/<table>``; without either, tables and temporary views of the session are
    read. Tables passed in ``tables`` come first.
    """

    def __init__(
        self,
        spark: SparkSession,
        schema: str | None = None,
        path: str | None = None,
        tables: Mapping[str, DataFrame] | None = None,
    ) -> None:
        if schema is not None and not isinstance(schema, str):
            raise ValueError("schema must be a string")
        if schema is not None and path is not None:
            raise ValueError("give a schema or a path, not both")
        self.spark = spark
        self._schema = schema
        self._path = path
        self._tables = dict(tables or {})

    def table(self, name: str) -> DataFrame:
        if name in self._tables:
            df = self._tables[name]
        elif self._path is not None:
            df = self.spark.read.parquet(f"{self._path.rstrip('/')}/{name}")
        else:
            df = self.spark.table(f"{self._schema}.{name}" if self._schema else name)
        if name in TABLES:
            optional = {c for c in TABLES[name].names if c.endswith("_source_value")}
            require_columns(df, [c for c in TABLES[name].names if c not in optional], name)
        return df


def _replace_table(df: DataFrame, full_name: str, write: Callable[[str], None]) -> DataFrame:
    """Let ``write`` store rows under a fresh catalog name, then put them in the place of ``full_name``."""
    spark = df.sparkSession
    restore_table(spark, full_name)
    fresh, replaced = f"{full_name}__new_{uuid.uuid4().hex}", f"{full_name}{_REPLACED}"
    try:
        write(fresh)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        raise
    if spark.catalog.tableExists(full_name):
        spark.sql(f"DROP TABLE IF EXISTS {replaced}")
        spark.sql(f"ALTER TABLE {full_name} RENAME TO {replaced}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {full_name}")
    spark.sql(f"DROP TABLE IF EXISTS {replaced}")
    return spark.table(full_name)


def restore_table(spark: SparkSession, full_name: str) -> bool:
    """Put back the old rows of a catalog table whose replacement was cut off between its two renames."""
    replaced = f"{full_name}{_REPLACED}"
    if spark.catalog.tableExists(full_name) or not spark.catalog.tableExists(replaced):
        return False
    spark.sql(f"ALTER TABLE {replaced} RENAME TO {full_name}")
    return True


def _replace_folder(spark: SparkSession, target: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a fresh folder beside ``target``, then put it in its place."""
    restore_folder(spark, target)
    files = Folders(spark)
    parent, _, name = target.rpartition("/")
    fresh, replaced = f"{parent}/_new-{name}-{uuid.uuid4().hex}", f"{parent}/{_REPLACED}-{name}"
    try:
        write(fresh)
    except BaseException:
        files.delete(fresh)
        raise
    if files.exists(target):
        files.delete(replaced)
        files.rename(target, replaced)
    files.rename(fresh, target)
    files.delete(replaced)
    spark.catalog.refreshByPath(target)


def restore_folder(spark: SparkSession, target: str) -> bool:
    """Put back the old folder whose replacement was cut off between its two renames."""
    files = Folders(spark)
    parent, _, name = target.rstrip("/").rpartition("/")
    replaced = f"{parent}/{_REPLACED}-{name}"
    if files.exists(target) or not files.exists(replaced):
        return False
    files.rename(replaced, target)
    return True


def checkpoint_table(df: DataFrame, name: str, schema: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table, replacing an older one, and go on from the stored rows.

    With ``schema`` the table goes to the catalog, with ``path`` to a parquet folder below it.
    The new rows are written completely under a fresh name beside the old ones, and take their place by
    two renames. So a write that fails leaves the old rows as they are, and a table may be rebuilt from
    itself. What is lost between the renames, the next call or :func:`restore_table` and
    :func:`restore_folder` put back. Two writers of one table must not run at a time. DataFrames that
    still read the old rows become invalid.
    """
    if (schema is None) == (path is None):
        raise ValueError("give either a schema or a path")
    spark = df.sparkSession
    if schema is not None:
        return _replace_table(df, f"{schema}.{name}", lambda to: df.write.format("parquet").saveAsTable(to))
    target = f"{path.rstrip('/')}/{name}"
    _replace_folder(spark, target, lambda to: df.write.parquet(to))
    return spark.read.schema(df.schema).parquet(target)


def bucket_by_person(df: DataFrame, name: str, schema: str, buckets: int, sort_by: str | None = None) -> DataFrame:
    """Store a clinical table bucketed by person, so that repeated person joins need no shuffle.

    An older table is replaced as by :func:`checkpoint_table`.
    """
    writer = df.write.format("parquet").bucketBy(buckets, "person_id")
    if sort_by is not None:
        writer = writer.sortBy("person_id", sort_by)
    return _replace_table(df, f"{schema}.{name}", writer.saveAsTable)


def partition_by_month(
    df: DataFrame, name: str, date: str, schema: str | None = None, path: str | None = None
) -> DataFrame:
    """Store a clinical table in the dated layout: one folder per month of ``date``, rows by person inside.

    Searches read the months of their windows only. Rows are dealt by month and person into ranges of even size, so
    a busy month is written by several tasks. Rows without a date are kept in a folder of their own. An older
    table is replaced as by :func:`checkpoint_table`.
    """
    if (schema is None) == (path is None):
        raise ValueError("give either a schema or a path")
    dated = df.drop(EVENT_MONTH).withColumn(EVENT_MONTH, F.trunc(F.col(date).cast("date"), "month"))
    order = [EVENT_MONTH, "person_id", date]
    dealt = dated.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = dealt.write.format("parquet").partitionBy(EVENT_MONTH)
    if schema is not None:
        return _replace_table(df, f"{schema}.{name}", writer.saveAsTable)
    spark, target = df.sparkSession, f"{path.rstrip('/')}/{name}"

    def write(to: str) -> None:
        writer.save(to)
        if spark.read.schema(dated.schema).parquet(to).isEmpty():
            # Without a row there is no folder either, and nobody could read the table's columns.
            dated.limit(0).write.mode("overwrite").parquet(to)

    _replace_folder(spark, target, write)
    return spark.read.schema(dated.schema).parquet(target)


def read_codes(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV code list with a header row and a declared schema."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def write_summary(df: DataFrame, path: str, order_by: Sequence[str] = ()) -> None:
    """Write a final summary as one CSV file with a header.

    For aggregated results only: the rows end up in one file. They are gathered by a shuffle, so
    everything before it keeps its parallelism. An older file is replaced as by :func:`checkpoint_table`.
    """
    one = df.repartition(1)
    if order_by:
        one = one.sortWithinPartitions(*order_by)
    _replace_folder(df.sparkSession, path.rstrip("/"), lambda to: one.write.csv(to, header=True))
