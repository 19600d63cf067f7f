"""End-to-end studies: cohort, deficit events, scores and summaries of one frailty index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frailscope.functions.strata import AGE_BREAKS
from frailscope.operators.cohort import apply_washout, derive_strata, earliest_index, random_index_visit
from frailscope.operators.concepts import attach_lookback, concept_set
from frailscope.operators.events import Cdm, find_events, find_index_events, search_window
from frailscope.operators.polypharmacy import add_deficit, drug_exposure_counts, polypharmacy_deficit
from frailscope.operators.scoring import Cutoffs, fi_of_indices, fi_with_robust
from frailscope.operators.summaries import category_prevalence, stack_summaries, summarize_fi
from frailscope.sources.scratch import store


@dataclass(frozen=True)
class IndexSpec:
    """How a frailty index is searched and scored.

    ``polypharmacy_cutoff`` adds the deficit of that many ingredients; an era counts from
    ``polypharmacy_days`` days.
    """

    name: str
    denominator: float
    lb: float
    ub: float
    acute_lookback: int = 1
    chronic_lookback: int = 1
    polypharmacy_cutoff: int | None = None
    polypharmacy_days: int = 2


# Deficits, cut-offs and polypharmacy rule of the published indices.
VAFI = IndexSpec("vafi", 31, 0.11, 0.21)
VAFI_2023 = IndexSpec("vafi", 30, 0.11, 0.21)
EFRAGICAP = IndexSpec("efragicap", 35, 0.12, 0.24)
EFI = IndexSpec("efi", 35, 0.12, 0.24, polypharmacy_cutoff=10)


def build_cohort(
    cdm: Cdm,
    seed: int | str,
    min_days: int = 365,
    min_age: int = 40,
    breaks: Sequence[int] = AGE_BREAKS,
    dedupe: bool = True,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Random index visit, washout and strata.

    A person has one index date here, so the earliest one need not be looked for unless the
    cohort is restricted to ``ids``.
    """
    index = random_index_visit(cdm.table("person"), cdm.table("visit_occurrence"), seed)
    washed = apply_washout(index, cdm.table("observation_period"), min_days, min_age, dedupe)
    cohort = derive_strata(washed, breaks)
    return cohort if ids is None else earliest_index(cohort, ids)


def index_events(
    cdm: Cdm,
    fi_indices: DataFrame,
    cohort: DataFrame,
    spec: IndexSpec,
    lookbacks: DataFrame | None = None,
    keep: Sequence[str] = ("age_group", "is_female"),
) -> DataFrame:
    """Distinct (person_id, strata, category, score) of the cohort, polypharmacy included."""
    concepts = concept_set(fi_indices, spec.name)
    if spec.acute_lookback != spec.chronic_lookback:
        if lookbacks is None:
            raise ValueError("different acute and chronic lookbacks need a lookback table")
        concepts = attach_lookback(concepts, lookbacks)
    events = find_events(
        cdm,
        search_window(cohort, keep=keep),
        concepts,
        output="category",
        acute_lookback=spec.acute_lookback,
        chronic_lookback=spec.chronic_lookback,
    ).select("person_id", *keep, "category", "score")
    if spec.polypharmacy_cutoff is None:
        # The search is already distinct unless one category was searched with two windows.
        return events if spec.acute_lookback == spec.chronic_lookback else events.distinct()
    counts = drug_exposure_counts(cdm.table("drug_era"), cohort, spec.polypharmacy_days)
    return add_deficit(events, polypharmacy_deficit(counts, cohort, spec.polypharmacy_cutoff, strata=keep))


@dataclass(frozen=True)
class Study:
    """Stored cohort and events of one index, with its scores; summaries on request."""

    spec: IndexSpec
    cohort: DataFrame
    events: DataFrame
    scores: DataFrame
    one_row_per_person: bool

    def summary(self, with_lookbacks: bool = False) -> DataFrame:
        """Classes per stratum, on request with the lookbacks of the search."""
        out = summarize_fi(self.scores)
        if not with_lookbacks:
            return out
        spec = self.spec
        return out.withColumns({"acute_lb": F.lit(spec.acute_lookback), "chronic_lb": F.lit(spec.chronic_lookback)})

    def prevalence(self, categories: Sequence[str] | DataFrame) -> DataFrame:
        """Presence-based prevalence of every category."""
        presence = self.events.select("person_id", "age_group", "is_female", "category").distinct()
        presence = presence.withColumn("score", F.lit(1.0))
        return category_prevalence(
            presence, self.cohort, categories, unique_people=self.one_row_per_person, drop_null_strata=True
        )


def frailty_study(
    cdm: Cdm,
    fi_indices: DataFrame,
    spec: IndexSpec,
    seed: int | str,
    lookbacks: DataFrame | None = None,
    dedupe: bool = True,
    cohort: DataFrame | None = None,
    min_days: int = 365,
    min_age: int = 40,
    breaks: Sequence[int] = AGE_BREAKS,
    ids: DataFrame | None = None,
    keep: Sequence[str] = ("age_group", "is_female"),
) -> Study:
    """Run cohort and event search once, store both, and score everyone.

    ``min_days``, ``min_age``, ``breaks`` and ``ids`` shape the cohort, unless a ``cohort`` is given;
    ``keep`` names its columns that events and scores carry.

    The stored tables are small next to the clinical ones. Everything after the event search reads
    them, so the clinical tables are scanned once.
    """
    if cohort is None:
        people = store(build_cohort(cdm, seed, min_days, min_age, breaks, dedupe, ids), "cohort")
    else:
        people = cohort
    events = store(index_events(cdm, fi_indices, people, spec, lookbacks, keep), f"{spec.name}-events")
    scores = fi_with_robust(events, people, spec.denominator, spec.lb, spec.ub, keep)
    return Study(spec, people, events, scores, dedupe)


def index_concepts(
    fi_indices: DataFrame, specs: Mapping[str, IndexSpec], lookbacks: DataFrame | None = None
) -> DataFrame:
    """(index_name, category, concept_id, score, lookback) for :func:`find_index_events`, in one pass over the table."""
    concepts = fi_indices.select("fi", "category", "concept_id", "score")
    if any(s.acute_lookback != s.chronic_lookback for s in specs.values()):
        if lookbacks is None:
            raise ValueError("different acute and chronic lookbacks need a lookback table")
        concepts = attach_lookback(concepts, lookbacks).drop("lookback")
    else:
        concepts = concepts.withColumn("chronic", F.lit(0))
    known = F.array(
        *(
            F.struct(
                F.lit(label).alias("index_name"),
                F.lit(spec.name.lower()).alias("of"),
                F.lit(spec.acute_lookback).alias("acute"),
                F.lit(spec.chronic_lookback).alias("chronic"),
            )
            for label, spec in specs.items()
        )
    )
    own = F.filter(known, lambda s: s["of"] == F.lower("fi"))
    return concepts.select("category", "concept_id", "score", F.col("chronic").alias("flag"), F.explode(own).alias("s")).select(
        "s.index_name",
        "category",
        "concept_id",
        "score",
        F.when(F.col("flag") == 1, F.col("s.chronic")).otherwise(F.col("s.acute")).alias("lookback"),
    )


@dataclass(frozen=True)
class Studies:
    """Stored cohort and events of several indices, with their scores, told apart by ``index_name``."""

    specs: Mapping[str, IndexSpec]
    cohort: DataFrame
    events: DataFrame
    scores: DataFrame
    one_row_per_person: bool

    def study(self, label: str) -> Study:
        """What :func:`frailty_study` gives for one of the indices."""
        events, scores = (
            df.filter(F.col("index_name") == label).drop("index_name") for df in (self.events, self.scores)
        )
        return Study(self.specs[label], self.cohort, events, scores, self.one_row_per_person)

    def summary(self) -> DataFrame:
        """Classes per index and stratum; the index is named in ``fi``."""
        counted = summarize_fi(self.scores, by=("index_name", "age_group", "is_female"))
        return counted.select(*(c for c in counted.columns if c != "index_name"), F.col("index_name").alias("fi"))

    def prevalence(self, categories: Mapping[str, Sequence[str] | DataFrame]) -> DataFrame:
        """Presence-based prevalence of the categories given for each index."""
        return stack_summaries({label: self.study(label).prevalence(names) for label, names in categories.items()})


def frailty_studies(
    cdm: Cdm,
    fi_indices: DataFrame,
    specs: Mapping[str, IndexSpec],
    seed: int | str,
    lookbacks: DataFrame | None = None,
    dedupe: bool = True,
    cohort: DataFrame | None = None,
    keep: Sequence[str] = ("age_group", "is_female"),
    **cohort_options,
) -> Studies:
    """:func:`frailty_study` for several indices at the price of one search.

    ``specs`` names them; the same index may occur twice, with other lookbacks or cut-offs. Clinical domains are scanned
    once, drug eras once for every different ``polypharmacy_days``.
    """
    if not specs:
        raise ValueError("no indices given")
    if cohort is None:
        cohort = store(build_cohort(cdm, seed, dedupe=dedupe, **cohort_options), "cohort")
    years = sorted({n for s in specs.values() for n in (s.acute_lookback, s.chronic_lookback)})
    found = find_index_events(cdm, search_window(cohort, keep=keep), index_concepts(fi_indices, specs, lookbacks), years)
    counts = {
        days: store(drug_exposure_counts(cdm.table("drug_era"), cohort, days), "ingredients")
        for days in {s.polypharmacy_days for s in specs.values() if s.polypharmacy_cutoff is not None}
    }
    extra = [
        polypharmacy_deficit(counts[s.polypharmacy_days], cohort, s.polypharmacy_cutoff, strata=keep).withColumn(
            "index_name", F.lit(label)
        )
        for label, s in specs.items()
        if s.polypharmacy_cutoff is not None
    ]
    for deficit in extra:
        found = found.unionByName(deficit)
    events = store(found.distinct() if extra else found, "index-events")
    cutoffs = {label: Cutoffs(s.denominator, s.lb, s.ub) for label, s in specs.items()}
    return Studies(dict(specs), cohort, events, fi_of_indices(events, cohort, cutoffs, keep), dedupe)
