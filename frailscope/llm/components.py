"""Connected components of a link table, as repeated joins on stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frailscope.functions.joins import lookup_join
from frailscope.sources.scratch import scratch_scope, store, store_and_measure


# Small tables are written by few tasks, one per so many edges.
_EDGES_PER_TASK = 2000


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), component being its smallest node.

    Alternating star operations: every node hands its neighbours over to the smallest one. The
    rounds grow with the logarithm of the longest chain, each edge keeps one row, and only row
    counts and sums reach the driver. Null ends and self-links are ignored. Stored rounds are deleted at the end.
    """
    spark = links.sparkSession
    with scratch_scope(spark) as keep:
        edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        edges, seen = store_and_measure(edges.distinct(), "links", rows=F.count(F.lit(1)))
        tasks = seen["rows"] // _EDGES_PER_TASK + 1

        def small(df: DataFrame, name: str) -> DataFrame:
            return store(df.coalesce(tasks), name)

        before = None
        while True:
            both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            edges = small(_to_smallest(both, small, larger_only=True), "stars")
            edges = small(_to_smallest(edges, small, larger_only=False), "stars")
            state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if tuple(state) == before:
                break
            before = tuple(state)
        members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return keep(members.union(centres).coalesce(tasks), "components")


def merged_components(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` (node, component) with those joined that further ``links`` (a, b) connect.

    Only the components at the ends of the new links are looked at; nodes that are in none yet come in.
    """
    spark = links.sparkSession
    with scratch_scope(spark) as keep:
        ends = store(links.select("a", "b"), "ends")
        new = ends.select(F.col("a").alias("node")).union(ends.select(F.col("b").alias("node"))).distinct()
        alone = new.join(components, "node", "left_anti").withColumn("component", F.col("node"))
        known = store(components.unionByName(alone), "known")
        placed = ends
        for end in ("a", "b"):
            found = known.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
            placed = lookup_join(placed, found, end)
        moved = connected_components(placed.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        moved = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
        joined = lookup_join(known, moved, "component", "left")
        return keep(joined.select("node", F.coalesce("to", "component").alias("component")), "components")


def _to_smallest(edges: DataFrame, small: Callable[[DataFrame, str], DataFrame], larger_only: bool) -> DataFrame:
    """Link the neighbours ``v`` of each ``u`` to the smallest of them and ``u``.

    ``larger_only`` links only neighbours above ``u`` (for edges in both directions); otherwise all
    neighbours and ``u`` itself (for edges that point to the smaller end).
    """
    smallest = small(edges.groupBy("u").agg(F.min("v").alias("least")), "smallest")
    joined = edges.join(smallest, "u").withColumn("least", F.least("least", "u"))
    if larger_only:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        own = smallest.select("u", F.col("least").alias("v"))
        moved = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).union(own)
    moved = moved.filter("u <> v")
    return moved if larger_only else moved.distinct()
