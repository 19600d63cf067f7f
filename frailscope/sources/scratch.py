"""Intermediate tables on storage that the driver and every executor share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession


_scope: ContextVar[str] = ContextVar("scratch_scope", default="")


class Folders:
    """Folders on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession) -> None:
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, folder: str):
        path = self._path(folder)
        return path.getFileSystem(self._conf), path

    def exists(self, folder: str) -> bool:
        system, path = self._at(folder)
        return system.exists(path)

    def rename(self, folder: str, to: str) -> None:
        system, path = self._at(folder)
        if not system.rename(path, self._path(to)):
            raise OSError(f"could not rename {folder} to {to}")

    def delete(self, folder: str) -> None:
        """Also of a folder that is not there."""
        system, path = self._at(folder)
        if system.exists(path) and not system.delete(path, True):
            raise OSError(f"could not delete {folder}")


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Only a session on one machine may leave that unset; it gets a folder below its warehouse.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{shared.rstrip('/')}/frailscope-{spark.sparkContext.applicationId}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the scratch folder under a fresh name and go on from the stored rows.

    The rows survive the loss of executors, and nothing computed before them is computed again.
    """
    return _store_in(_scope.get(), df, name)


def _store_in(scope: str, df: DataFrame, name: str) -> DataFrame:
    target = f"{scratch_folder(df.sparkSession)}{scope}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def store_and_measure(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Row]:
    """:func:`store`, and aggregates of the rows that were gathered while they were written."""
    seen = Observation()
    stored = store(df.observe(seen, *(c.alias(k) for k, c in measures.items())), name)
    return stored, Row(**seen.get)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete at the end what was stored inside.

    Results that read it must be written elsewhere before that; the function given, used like :func:`store`, keeps them
    where the scope began.
    """
    outer = _scope.get()
    own = _scope.set(f"{outer}/scope-{uuid.uuid4().hex}")
    folder = f"{scratch_folder(spark)}{_scope.get()}"
    try:
        yield lambda df, name: _store_in(outer, df, name)
    finally:
        _scope.reset(own)
        Folders(spark).delete(folder)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's stored intermediates; results that still read them become invalid."""
    Folders(spark).delete(scratch_folder(spark))
