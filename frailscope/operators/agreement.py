"""Comparing two derivations of the same deficits, or two runs of the same study."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frailscope.functions.joins import null_safe_join
from frailscope.operators.summaries import STRATA


def compare_category_totals(a: DataFrame, b: DataFrame) -> DataFrame:
    """Summed scores per category of ``a`` (``score_a``) with those of ``b`` (``score_b``, may be NULL)."""
    left = a.groupBy("category").agg(F.sum("score").alias("score_a"))
    right = b.groupBy("category").agg(F.sum("score").alias("score_b"))
    return left.join(right, "category", "left")


def _complete(pairs: DataFrame, exclude: str | None) -> DataFrame:
    kept = pairs.dropna(subset=["score_a", "score_b"])
    return kept if exclude is None else kept.filter(F.col("category") != exclude)


def category_correlation(pairs: DataFrame, exclude: str | None = None) -> DataFrame:
    """Pearson correlation over the categories both derivations have; NULL if either score is the same in all of them."""
    spread = F.stddev_pop("score_a") * F.stddev_pop("score_b")
    # Not F.corr, which divides by zero where a score does not vary.
    value = F.try_divide(F.covar_pop("score_a", "score_b"), spread)
    return _complete(pairs, exclude).agg(value.alias("correlation"))


def category_icc(pairs: DataFrame, exclude: str | None = None) -> DataFrame:
    """Intraclass correlation of single scores, one-way model, two raters.

    With two raters the mean square between categories is twice the variance of the pair means
    and the one within is the mean of half the squared differences.
    """
    a, b = F.col("score_a"), F.col("score_b")
    between = 2 * F.var_samp((a + b) / 2)
    within = F.avg((a - b) * (a - b) / 2)
    squares = _complete(pairs, exclude).agg(
        F.count(F.lit(1)).alias("subjects"), between.alias("between"), within.alias("within")
    )
    value = F.try_divide(F.col("between") - F.col("within"), F.col("between") + F.col("within"))
    return squares.select("subjects", value.alias("icc"))


def reconcile_concepts(code_counts: DataFrame, concept_counts: DataFrame, rows: bool = False) -> DataFrame:
    """Counts per concept and category of the code-based and the concept-based derivation.

    ``code_counts`` holds (category, concept_id, source_value, n), several codes per concept;
    ``concept_counts`` holds (category, concept_id, n). With ``rows`` the joined counts and their
    difference, otherwise one row per concept and category: totals, number of joined rows and
    the concept total per row less the code total.
    """
    keys = ["concept_id", "category"]
    joined = (
        code_counts.select(*keys, "source_value", F.col("n").alias("icd_count"))
        .join(concept_counts.select(*keys, F.col("n").alias("omop_count")), keys, "full")
        .withColumn("icd_vs_omop", F.col("icd_count") - F.col("omop_count"))
    )
    if rows:
        return joined
    totals = joined.groupBy(*keys).agg(
        F.sum("omop_count").alias("total_omop"),
        F.sum("icd_count").alias("total_icd"),
        F.count(F.lit(1)).alias("n"),
    )
    return totals.withColumn("diff", F.col("total_omop") / F.col("n") - F.col("total_icd"))


def summary_rows(summary: DataFrame, by: Sequence[str] = STRATA, value: str = "value") -> DataFrame:
    """A summary with one row per stratum and measure."""
    measures = [c for c in summary.columns if c not in by]
    doubles = summary.select(*by, *[F.col(c).cast("double").alias(c) for c in measures])
    return doubles.unpivot(list(by), measures, "name", value)


def compare_runs(
    new: DataFrame, old: DataFrame, by: Sequence[str] = STRATA, skip: Sequence[str] = ("n",)
) -> DataFrame:
    """Two summaries of the same layout as (strata, measure name, type new/old, value)."""
    pairs = null_safe_join(summary_rows(new, by, "new"), summary_rows(old, by, "old"), [*by, "name"])
    return pairs.filter(~F.col("name").isin(*skip)).unpivot([*by, "name"], ["new", "old"], "type", "value")
