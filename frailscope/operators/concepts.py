"""Building, repairing and looking up concept sets.

A concept set is a table ``(category, concept_id, fi, score)``: which concepts count towards which
deficit of which frailty index, and with what weight.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frailscope.functions.joins import lookup_join, null_safe_join
from frailscope.schemas import CONCEPT_SET, require_columns


def require_index(concepts: DataFrame, index: str, allowed: Sequence[str] | None = None) -> str:
    """The lower-cased index name; ``ValueError`` if it is not allowed or not in the table."""
    name = index.lower()
    if allowed is not None and name not in allowed:
        raise ValueError(f"frailty index {index!r} not found; choose from {', '.join(allowed)}")
    if concepts.filter(F.lower("fi") == name).isEmpty():
        raise ValueError(f"frailty index {index!r} has no rows in the concept table")
    return name


def concept_set(fi_indices: DataFrame, index: str) -> DataFrame:
    """The rows of one index, compared without regard to case."""
    require_columns(fi_indices, CONCEPT_SET.names, "the concept table")
    return fi_indices.filter(F.lower("fi") == index.lower())


def get_concepts(concepts: DataFrame, index: str) -> DataFrame:
    """Distinct (category, concept_id) of an index; for ``hfrs`` the weights come along."""
    name = require_index(concepts, index)
    columns = ["category", "concept_id"] + (["score"] if name == "hfrs" else [])
    return concept_set(concepts, name).select(*columns).distinct()


@dataclass(frozen=True)
class IndexSource:
    """One index table and how its columns map to a concept set.

    ``score`` is a column name or a constant.
    """

    df: DataFrame
    fi: str
    category: str = "category"
    concept_id: str = "concept_id"
    score: str | float = 1.0


def unify_concept_sets(sources: Sequence[IndexSource]) -> DataFrame:
    """Bring several index tables to one layout, each without duplicates, and stack them."""
    if not sources:
        raise ValueError("no index tables given")
    stacked = None
    for source in sources:
        score = F.col(source.score) if isinstance(source.score, str) else F.lit(source.score)
        part = source.df.select(
            F.col(source.category).cast("string").alias("category"),
            F.col(source.concept_id).cast("long").alias("concept_id"),
            F.lit(source.fi).alias("fi"),
            score.cast("double").alias("score"),
        ).distinct()
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def attach_lookback(concepts: DataFrame, lookbacks: DataFrame, chronic_years: int = 3) -> DataFrame:
    """Add lookback years per (fi, category) and the flag ``chronic`` (1 for the long lookback).

    A category without a lookback keeps NULL years and counts as acute. Index names are compared
    without regard to case, as in :func:`concept_set`.
    """
    years = lookbacks.select(F.lower("fi").alias("_fi"), "category", "lookback")
    named = concepts.withColumn("_fi", F.lower("fi"))
    joined = lookup_join(named, years, ["_fi", "category"], "left").select(*concepts.columns, "lookback")
    return joined.withColumn("chronic", F.when(F.col("lookback") == chronic_years, 1).otherwise(0))


def standard_concepts(concept: DataFrame, concepts: DataFrame, mode: str = "join") -> DataFrame:
    """The standard concepts of a set, with their names.

    ``join`` keeps the ``chronic`` flag of the set (a concept in an acute and a chronic category
    gives two rows); ``in`` only tests membership.
    """
    names = concept.filter(F.col("standard_concept") == "S").select("concept_id", "concept_name")
    if mode == "in":
        return lookup_join(names, concepts.select("concept_id").distinct(), "concept_id", "left_semi").distinct()
    if mode != "join":
        raise ValueError("mode must be 'join' or 'in'")
    flags = [c for c in ("chronic",) if c in concepts.columns]
    return lookup_join(names, concepts.select("concept_id", *flags).distinct(), "concept_id").distinct()


# Patterns that begin with a wildcard are looked up by so many characters from their longest literal part.
_INFIX = 3


def _pattern_key(pattern: Column) -> Column:
    """By what part of a LIKE pattern the codes that may match are found, as struct (kind, part).

    Kind 0 is what the pattern says before its first wildcard or escape. If that is empty, it is the beginning of the
    pattern's longest literal part, of kind 1 to 3 by its length. Only a pattern of nothing but wildcards and escapes
    has an empty part, which every code has.
    """
    prefix = F.regexp_extract(pattern, r"^([^%_\\]*)", 1)
    # An escaped character ends a part as well: what it stands for is left to the LIKE test.
    parts = F.split(F.regexp_replace(pattern, r"\\.", "%"), "[%_]")
    longest = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("part"))))["part"]
    infix = F.substring(longest, 1, _INFIX)
    kind = F.when(prefix != "", F.lit(0)).otherwise(F.length(infix))
    return F.struct(kind.alias("kind"), F.when(prefix != "", prefix).otherwise(infix).alias("part"))


def _code_keys(code: str, kinds: set[int]) -> Column:
    """Every key under which a pattern of these kinds that matches the code may be found, each once."""
    def parts(kind: int) -> Column:
        if kind == 0:
            # All prefixes; the empty one belongs to patterns without any literal part.
            return F.transform(F.sequence(F.lit(0), F.length(code)), lambda n: F.substring(F.col(code), F.lit(1), n))
        places = F.sequence(F.lit(1), F.length(code))
        pieces = F.transform(places, lambda n: F.substring(F.col(code), n, F.lit(kind)))
        return F.array_distinct(F.filter(pieces, lambda p: F.length(p) == kind))

    def keys(kind: int) -> Column:
        return F.transform(parts(kind), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("part")))

    return F.concat(*(keys(kind) for kind in sorted(kinds)))


def match_like(codes: DataFrame, patterns: DataFrame, code: str, pattern: str) -> DataFrame:
    """All (code row, pattern row) pairs where the code is LIKE the pattern.

    Every pattern is keyed by its literal prefix, or, if it begins with a wildcard, by a piece of its longest literal
    part; every code by each of its own prefixes and, where such patterns occur, by its pieces of their lengths. So
    this is an equality join with LIKE as a residual test, whatever the number of patterns. Only a pattern of
    nothing but wildcards meets all codes.
    """
    keyed_patterns = patterns.withColumn("_key", _pattern_key(F.col(pattern)))
    kinds = keyed_patterns.agg(F.collect_set("_key.kind")).first()[0]  # four at most
    keyed_codes = codes.withColumn("_key", F.explode(_code_keys(code, set(kinds) or {0})))
    pairs = lookup_join(keyed_codes, keyed_patterns, "_key")
    return pairs.filter(F.expr(f"`{code}` LIKE `{pattern}`")).drop("_key")


def map_codes_like(
    patterns: DataFrame,
    concept: DataFrame,
    concept_relationship: DataFrame,
    source_vocabularies: Sequence[str] = ("ICD10%",),
    target_vocabularies: Sequence[str] = ("SNOMED",),
    keep_names: bool = False,
) -> DataFrame:
    """Map code patterns to target concepts through ``Maps to`` relationships.

    ``patterns`` holds (category, code_pattern). Source vocabularies are LIKE patterns, target
    vocabularies plain names. Returns (category, code, concept_id), or with ``keep_names`` one row
    per mapping with source and target ids, codes and names.
    """
    wanted = F.lit(False)
    for vocabulary in source_vocabularies:
        wanted = wanted | F.col("vocabulary_id").like(vocabulary)
    sources = concept.filter(wanted).select(
        F.col("concept_id").alias("orig_concept_id"),
        F.col("concept_name").alias("source_concept_name"),
        F.col("concept_code").alias("source_code"),
    )
    targets = concept.filter(F.col("vocabulary_id").isin(*target_vocabularies)).select(
        "concept_id", F.col("concept_name").alias("target_concept_name")
    )
    if not keep_names:
        sources, targets = sources.drop("source_concept_name"), targets.drop("target_concept_name")
    matched = match_like(sources, patterns.select("category", "code_pattern").distinct(), "source_code", "code_pattern")
    links = concept_relationship.filter(F.col("relationship_id") == "Maps to").select(
        F.col("concept_id_1").alias("orig_concept_id"), F.col("concept_id_2").alias("concept_id")
    )
    mapped = links.join(matched, "orig_concept_id").join(targets, "concept_id")
    if not keep_names:
        return mapped.select("category", F.col("source_code").alias("code"), "concept_id").distinct()
    return mapped.select(
        "orig_concept_id",
        "concept_id",
        "source_concept_name",
        "source_code",
        "code_pattern",
        F.col("category").alias("deficit"),
        "target_concept_name",
    ).distinct()


def parse_number(text: Column) -> Column:
    """The first number in a text, as a double; NULL if there is none. Grouping commas are skipped."""
    digits = F.regexp_extract(text, r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    return F.regexp_replace(digits, ",", "").try_cast("double")


def clean_codes(
    df: DataFrame,
    code: str = "code",
    code_type: str | None = None,
    keep_types: Iterable[str] | None = None,
    drop_types: Iterable[str] | None = None,
) -> DataFrame:
    """Strip one trailing dot from the codes, keep the wanted code types, drop duplicates."""
    out = df.withColumn(code, F.regexp_replace(code, r"[.]$", ""))
    if keep_types is not None:
        out = out.filter(F.col(code_type).isin(*keep_types))
    if drop_types is not None:
        out = out.filter(~F.col(code_type).isin(*drop_types))
    return out.distinct()


def expand_descendants(concepts: DataFrame, concept_ancestor: DataFrame, new_fi: str) -> DataFrame:
    """All descendants of the concepts, with the category and score of their ancestor."""
    members = concepts.select(F.col("concept_id").alias("ancestor_concept_id"), "category", "score").distinct()
    links = concept_ancestor.select("ancestor_concept_id", F.col("descendant_concept_id").alias("concept_id"))
    return (
        lookup_join(links, members, "ancestor_concept_id")
        .select("category", "concept_id", F.lit(new_fi).alias("fi"), "score")
        .distinct()
    )


def prune_mappings(
    df: DataFrame,
    deficit_regex: Mapping[str, str] | None = None,
    reviewed: DataFrame | None = None,
    blocklist: Iterable[int] | DataFrame | None = None,
) -> DataFrame:
    """Remove bad mappings from (concept_id, deficit, target_concept_name, ...).

    A target of a deficit in ``deficit_regex`` must match its expression (a missing name stays);
    pairs (concept_id, deficit) in ``reviewed`` and concepts in ``blocklist`` go.
    """
    out = df
    for deficit, expression in (deficit_regex or {}).items():
        named_right = F.coalesce(F.col("target_concept_name").rlike(expression), F.lit(True))
        out = out.filter(~F.col("deficit").eqNullSafe(deficit) | named_right)
    if reviewed is not None:
        out = lookup_join(out, reviewed.select("concept_id", "deficit").distinct(), ["concept_id", "deficit"], "left_anti")
    if isinstance(blocklist, DataFrame):
        out = lookup_join(out, blocklist.select("concept_id").distinct(), "concept_id", "left_anti")
    elif blocklist is not None:
        out = out.filter(~F.col("concept_id").isin(*blocklist))
    return out


def finalise_concept_set(df: DataFrame, fi: str, score: float = 1.0, category: str = "deficit") -> DataFrame:
    """Distinct (category, concept_id) with one index name and one score."""
    return (
        df.select(F.col(category).alias("category"), "concept_id")
        .distinct()
        .withColumns({"fi": F.lit(fi), "score": F.lit(float(score))})
    )


def mapping_multiplicity(df: DataFrame, source: str = "orig_concept_id") -> DataFrame:
    """Add ``n_omop_matches``: how many rows share the source concept of a row.

    Counted first and joined back, so a source with very many targets is not one task's work.
    """
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("n_omop_matches"))
    return null_safe_join(df, counts, [source], "inner")
