"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(labels: DataFrame, column: str, held_out: Column, most: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of at most ``most[label]`` training documents, and how many there are of each label.

    A document with several labels counts with the largest. Documents are taken in the order of a
    hash of their ids.
    """
    clean = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col(column) > 0).cast("int")).alias("label"))
    )
    sizes = {int(r["label"]): int(r["count"]) for r in clean.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [clean.filter(F.col("label") == k).orderBy(*order).limit(n) for k, n in most.items()]
    return parts[0].union(parts[1]), sizes
