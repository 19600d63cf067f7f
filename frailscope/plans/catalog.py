"""The registered queries: every operator on the OMOP-shaped views of the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frailscope.functions.joins import lookup_join
from frailscope.functions.strata import AGE_BREAKS
from frailscope.operators import agreement, concepts, events, polypharmacy, rates, scoring, summaries
from frailscope.operators import cohort as people
from frailscope.plans.frailty import IndexSpec, build_cohort, frailty_studies, frailty_study, index_events
from frailscope.session import tune
from frailscope.sources.cdm import OmopCdm, checkpoint_table, read_codes, write_summary
from frailscope.sources.fixtures import FixtureCdm
from frailscope.sources.scratch import scratch_folder, store

SEED = "42"
ONE_YEAR = IndexSpec("vafi", 25, 0.12, 0.24)
CHRONIC_3 = replace(ONE_YEAR, chronic_lookback=3)
EFI_DRUGS = IndexSpec("efi", 31, 0.12, 0.24, polypharmacy_cutoff=10)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


class Inputs:
    """Views and stored intermediates one query needs."""

    def __init__(self, spark: SparkSession, sf_dir: str, source_values: bool = False, store_lines: bool = False) -> None:
        self.spark = tune(spark)
        self.cdm = FixtureCdm(spark, sf_dir, source_values, store_lines)

    def table(self, name: str) -> DataFrame:
        return self.cdm.table(name)

    @cached_property
    def fi_indices(self) -> DataFrame:
        return self.table("fi_indices")

    @cached_property
    def cohort(self) -> DataFrame:
        return store(build_cohort(self.cdm, SEED), "cohort")

    @cached_property
    def cohort_all(self) -> DataFrame:
        """One row per qualifying observation period."""
        return store(build_cohort(self.cdm, SEED, dedupe=False), "cohort-all")

    @cached_property
    def windows(self) -> DataFrame:
        return events.search_window(self.cohort)

    @cached_property
    def vafi(self) -> DataFrame:
        return concepts.concept_set(self.fi_indices, "vafi")

    @cached_property
    def vafi_lookback(self) -> DataFrame:
        return concepts.attach_lookback(self.vafi, self.table("lookbacks"))

    def study(self, spec: IndexSpec, dedupe: bool = True):
        cohort = self.cohort if dedupe else self.cohort_all
        return frailty_study(self.cdm, self.fi_indices, spec, SEED, self.table("lookbacks"), dedupe, cohort)

    def studies(self, specs: dict[str, IndexSpec], dedupe: bool = True):
        cohort = self.cohort if dedupe else self.cohort_all
        return frailty_studies(self.cdm, self.fi_indices, specs, SEED, self.table("lookbacks"), dedupe, cohort)

    def dated_events(self, index: str) -> DataFrame:
        """All clinical events with the categories of an index, whatever their date."""
        members = concepts.concept_set(self.fi_indices, index).select("concept_id", "category", "score")
        return lookup_join(events.domain_events(self.cdm), members.distinct(), "concept_id")

    @cached_property
    def search(self) -> DataFrame:
        return self.cohort.select("person_id", F.col("visit_lookback_date").alias("search_date"))

    @cached_property
    def named_mappings(self) -> DataFrame:
        return concepts.map_codes_like(
            self.table("code_patterns"),
            self.table("concept"),
            self.table("concept_relationship"),
            ("ICD10CM", "ICD10PCS", "CPT4", "HCPCS"),
            ("SNOMED", "CPT4", "HCPCS"),
            keep_names=True,
        )

    @cached_property
    def exposure_counts(self) -> DataFrame:
        return polypharmacy.drug_exposure_counts(self.table("drug_era"), self.cohort, min_days=2)

    @cached_property
    def deficit_spans(self) -> DataFrame:
        tagged = events.find_events(
            self.cdm,
            self.windows,
            self.vafi,
            "concept",
            tag_domain=True,
            acute_lookback=3,
            chronic_lookback=3,
        )
        return rates.deficit_spans(tagged)

    @cached_property
    def code_lists(self) -> list[DataFrame]:
        """Diagnosis and procedure codes of the index, as two lists (code, deficit)."""
        coded = self.table("concept").join(self.vafi, "concept_id")
        return [
            coded.filter(F.col("vocabulary_id") == vocabulary).select(
                F.col("concept_code").alias("code"), F.col("category").alias("deficit")
            )
            for vocabulary in ("ICD10CM", "CPT4")
        ]

    @cached_property
    def code_events(self) -> DataFrame:
        return events.find_events_by_source_code(self.cdm, self.windows, self.code_lists)

    @cached_property
    def category_pairs(self) -> DataFrame:
        by_concept = index_events(self.cdm, self.fi_indices, self.cohort, ONE_YEAR)
        by_code = self.code_events.select(
            "person_id", F.col("deficit").alias("category"), F.lit(1.0).alias("score")
        ).distinct()
        return agreement.compare_category_totals(by_concept, by_code)


def query(build: Callable[[Inputs], DataFrame] | None = None, *, name: str | None = None, **inputs: bool):
    """Register a function of :class:`Inputs`, under its own name; doubles are rounded to 6 places."""
    if build is None:
        return lambda function: query(function, name=name, **inputs)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(Inputs(spark, sf_dir, **inputs)))

    _QUERIES[name or build.__name__] = run
    return build


def rounded(df: DataFrame) -> DataFrame:
    doubles = [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, 6) for c in doubles}) if doubles else df


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- concept sets -------------------------------------------------------------------------------


@query
def concepts_of_index(q: Inputs):
    return concepts.get_concepts(q.fi_indices, "EFI")


@query
def concepts_of_weighted_index(q: Inputs):
    return concepts.get_concepts(q.fi_indices, "hfrs")


@query
def concept_set_rows(q: Inputs):
    return concepts.concept_set(q.fi_indices, "vafi")


@query
def unified_concept_sets(q: Inputs):
    hfrs = concepts.concept_set(q.fi_indices, "hfrs").select(
        F.col("category").alias("hfrs_category"), F.col("concept_id").alias("hfrs_concept_id"), F.col("score").alias("hfrs_score")
    )
    vafi = q.vafi.select(F.col("category").alias("vafi_category"), F.col("concept_id").cast("string").alias("vafi_concept_id"))
    return concepts.unify_concept_sets(
        [
            concepts.IndexSource(vafi, "vafi", "vafi_category", "vafi_concept_id"),
            concepts.IndexSource(concepts.concept_set(q.fi_indices, "efi"), "efi"),
            concepts.IndexSource(hfrs, "hfrs", "hfrs_category", "hfrs_concept_id", "hfrs_score"),
        ]
    )


@query
def concepts_with_lookback(q: Inputs):
    return concepts.attach_lookback(q.fi_indices, q.table("lookbacks"))


@query
def standard_concepts_joined(q: Inputs):
    return concepts.standard_concepts(q.table("concept"), q.vafi_lookback)


@query
def standard_concepts_listed(q: Inputs):
    return concepts.standard_concepts(q.table("concept"), q.vafi, mode="in")


@query
def code_patterns_to_concepts(q: Inputs):
    return concepts.map_codes_like(q.table("code_patterns"), q.table("concept"), q.table("concept_relationship"))


@query
def code_patterns_with_names(q: Inputs):
    return q.named_mappings


@query
def code_infixes_to_concepts(q: Inputs):
    """Every fortieth concept's code, its first letter and a digit left open."""
    code = F.col("concept_code")
    patterns = q.table("concept").filter(F.col("concept_id") % 40 == 0).select(
        F.concat(F.lit("open "), F.substring(code, 1, 1)).alias("category"),
        F.concat(F.lit("%"), F.substring(code, 2, 1), F.lit("_"), F.substring(code, 4, 2)).alias("code_pattern"),
    )
    return concepts.map_codes_like(patterns, q.table("concept"), q.table("concept_relationship"))


@query
def cleaned_codes(q: Inputs):
    dot = F.when(F.col("concept_id") % 3 == 0, ".").otherwise("")
    codes = q.table("concept").select(F.concat("concept_code", dot).alias("code"), F.col("vocabulary_id").alias("code_type"))
    cleaned = concepts.clean_codes(codes, "code", "code_type", keep_types=["ICD10CM", "CPT4"], drop_types=["CPT4"])
    return cleaned.withColumn("number", concepts.parse_number(F.col("code")))


@query
def expanded_descendants(q: Inputs):
    return concepts.expand_descendants(q.vafi, q.table("concept_ancestor"), "vafi_expanded")


def _pruned(q: Inputs) -> DataFrame:
    reviewed = q.named_mappings.filter(F.col("source_code").endswith(".5"))
    blocked = q.table("concept").filter(F.col("standard_concept").isNull())
    return concepts.prune_mappings(q.named_mappings, {"Heart": "red|blue|small|widget"}, reviewed, blocked)


@query
def pruned_mappings(q: Inputs):
    return _pruned(q)


@query
def finalised_concept_set(q: Inputs):
    return concepts.finalise_concept_set(_pruned(q), "repaired")


@query
def mapping_multiplicity(q: Inputs):
    return concepts.mapping_multiplicity(q.named_mappings)


# ---- cohort -------------------------------------------------------------------------------------


@query
def eligible_people(q: Inputs):
    return people.eligible_people(q.table("cb_search_person"))


@query
def random_index_visit(q: Inputs):
    return people.random_index_visit(q.table("person"), q.table("visit_occurrence"), SEED)


def _washed(q: Inputs, dedupe: bool) -> DataFrame:
    index = people.random_index_visit(q.table("person"), q.table("visit_occurrence"), SEED)
    return people.apply_washout(index, q.table("observation_period"), dedupe=dedupe)


@query
def washout_cohort(q: Inputs):
    return _washed(q, True)


@query
def washout_cohort_all_periods(q: Inputs):
    return _washed(q, False)


@query
def cohort_strata(q: Inputs):
    return people.derive_strata(_washed(q, True))


@query
def earliest_index(q: Inputs):
    visits = q.table("visit_occurrence").withColumnRenamed("visit_start_date", "index_date")
    eligible = people.eligible_people(q.table("cb_search_person"))
    return people.earliest_index(visits, eligible)


@query
def sampled_cohort(q: Inputs):
    return people.sample_cohort(q.table("person").select("person_id"), 0.05, SEED)


@query
def first_people(q: Inputs):
    return people.first_people(q.table("visit_occurrence"), 500)


@query
def cohort_summary(q: Inputs):
    return people.cohort_summary(build_cohort(q.cdm, SEED, dedupe=False))


# ---- events -------------------------------------------------------------------------------------


@query
def search_window(q: Inputs):
    return events.search_window(build_cohort(q.cdm, SEED))


def _domain_query(domain: str) -> None:
    @query(name=f"events_{domain}")
    def domain_events(q: Inputs):
        return events.find_events(q.cdm, q.windows, q.vafi, "raw", domains=[domain])


for _domain in events.DOMAINS:
    _domain_query(_domain)


@query
def events_raw(q: Inputs):
    return events.frailty_events(q.cdm, q.fi_indices, "VAFI", q.windows, "raw")


@query
def events_by_concept(q: Inputs):
    return events.frailty_events(q.cdm, q.fi_indices, "efi", q.windows, "concept")


@query
def events_by_category(q: Inputs):
    return events.frailty_events(q.cdm, q.fi_indices, "efi", q.windows, "category")


@query
def events_by_weighted_category(q: Inputs):
    return events.frailty_events(q.cdm, q.fi_indices, "hfrs", q.windows, "category")


def _lookback_query(output: str) -> None:
    @query(name=f"events_chronic_lookback_{output}")
    def lookback_events(q: Inputs):
        efi = concepts.attach_lookback(concepts.concept_set(q.fi_indices, "efi"), q.table("lookbacks"))
        return events.find_events(q.cdm, q.windows, efi, output, acute_lookback=1, chronic_lookback=3)


for _output in events.OUTPUTS:
    _lookback_query(_output)


@query
def code_index_events(q: Inputs):
    return events.code_index_events(q.cdm, q.fi_indices, "vafi", q.windows)


@query
def code_index_categories(q: Inputs):
    return events.code_index_events(q.cdm, q.fi_indices, "vafi", q.windows, unique_categories=True)


@query(source_values=True, store_lines=True)
def events_by_source_code(q: Inputs):
    return q.code_events


@query
def events_with_domain(q: Inputs):
    return events.find_events(q.cdm, q.windows, q.vafi, "concept", tag_domain=True)


# ---- polypharmacy -------------------------------------------------------------------------------


@query
def ingredients_over_1_day(q: Inputs):
    return q.exposure_counts


@query
def ingredients_from_30_days(q: Inputs):
    return polypharmacy.drug_exposure_counts(q.table("drug_era"), q.cohort, min_days=30)


@query
def ingredients_from_1_day(q: Inputs):
    return polypharmacy.drug_exposure_counts(q.table("drug_era"), q.cohort, min_days=1)


def _overlap_counts(q: Inputs) -> DataFrame:
    return polypharmacy.drug_exposure_counts(
        q.table("drug_era"), q.cohort, min_days=90, rule="overlap", exclude=q.table("drug_exclusions")
    )


@query
def ingredients_overlapping(q: Inputs):
    return _overlap_counts(q)


@query
def polypharmacy_deficit(q: Inputs):
    return polypharmacy.polypharmacy_deficit(q.exposure_counts, q.cohort, cutoff=10)


@query
def index_with_polypharmacy(q: Inputs):
    return index_events(q.cdm, q.fi_indices, q.cohort, EFI_DRUGS)


@query
def ingredients_flagged(q: Inputs):
    return polypharmacy.flag_exposure(q.exposure_counts)


@query
def ingredients_zero_filled(q: Inputs):
    return polypharmacy.zero_fill_counts(q.exposure_counts, q.cohort, ["age_group"])


@query
def polypharmacy_prevalence(q: Inputs):
    return polypharmacy.polypharmacy_prevalence(_overlap_counts(q), q.cohort, cutoff=5)


@query
def ingredient_distribution(q: Inputs):
    return polypharmacy.exposure_distribution(polypharmacy.zero_fill_counts(q.exposure_counts, q.cohort))


# ---- scoring ------------------------------------------------------------------------------------


@query
def fi_by_person(q: Inputs):
    return scoring.fi_by_person(q.dated_events("vafi"), q.search)


@query
def fi_by_person_weighted(q: Inputs):
    return scoring.fi_by_person(q.dated_events("hfrs"), q.search, weight="score", ordered=True)


@query
def fi_by_person_rejoined(q: Inputs):
    search = q.cohort.withColumnsRenamed({"person_id": "patient", "visit_lookback_date": "search_date"})
    return scoring.fi_by_person(q.dated_events("efi"), search, search_person_id="patient", rejoin=True)


@query
def fi_by_category(q: Inputs):
    return scoring.frailty_index(q.dated_events("hfrs"), q.search, by="category", weight="score")


@query
def fi_detail(q: Inputs):
    return scoring.frailty_index(q.dated_events("vafi"), q.search, summary=False, ordered=True)


def _found(q: Inputs) -> DataFrame:
    return events.frailty_events(q.cdm, q.fi_indices, "hfrs", q.windows, "concept")


@query
def event_scores_by_person(q: Inputs):
    return scoring.summarize_events(_found(q), "person_id", weight="score")


@query
def event_scores_by_category(q: Inputs):
    return scoring.summarize_events(_found(q), "category")


@query
def person_fi_classes(q: Inputs):
    return q.study(ONE_YEAR).scores


@query
def person_fi_classes_all_periods(q: Inputs):
    return q.study(ONE_YEAR, dedupe=False).scores


# ---- summaries ----------------------------------------------------------------------------------


@query
def frailty_summary(q: Inputs):
    return q.study(ONE_YEAR).summary()


@query
def frailty_summary_all_periods(q: Inputs):
    return q.study(ONE_YEAR, dedupe=False).summary()


@query
def frailty_summary_to_age_120(q: Inputs):
    """The same with the band set whose last band ends at 120, for a longer washout."""
    breaks = (*AGE_BREAKS[:-1], 120)
    study = frailty_study(q.cdm, q.fi_indices, ONE_YEAR, SEED, q.table("lookbacks"), min_days=730, min_age=45, breaks=breaks)
    return study.summary()


@query
def frailty_summary_chronic_lookback(q: Inputs):
    return q.study(CHRONIC_3).summary()


@query
def frailty_summary_chronic_lookback_all_periods(q: Inputs):
    return q.study(CHRONIC_3, dedupe=False).summary()


@query
def frailty_summary_with_polypharmacy(q: Inputs):
    return q.study(EFI_DRUGS).summary()


@query
def frailty_summary_with_lookbacks(q: Inputs):
    return q.study(CHRONIC_3).summary(with_lookbacks=True)


@query
def category_prevalence(q: Inputs):
    return q.study(ONE_YEAR).prevalence(q.vafi.select("category"))


@query
def category_prevalence_all_periods(q: Inputs):
    return q.study(ONE_YEAR, dedupe=False).prevalence(q.vafi.select("category"))


@query
def category_report(q: Inputs):
    found = q.study(ONE_YEAR)
    return summaries.percent_category(found.events, found.cohort, "Brand#7", "vafi", q.fi_indices)


@query(store_lines=True)
def stacked_category_reports(q: Inputs):
    reports = {}
    studies = q.studies({spec.name: spec for spec in (ONE_YEAR, EFI_DRUGS)})
    for name, category in ((ONE_YEAR.name, "Brand#7"), (EFI_DRUGS.name, "PROMO")):
        found = studies.study(name)
        reports[name] = summaries.percent_category(found.events, found.cohort, category, name, q.fi_indices)
    return summaries.stack_summaries(reports)


def _totals(q: Inputs) -> DataFrame:
    return summaries.category_totals(index_events(q.cdm, q.fi_indices, q.cohort, EFI_DRUGS), q.cohort)


@query
def category_totals(q: Inputs):
    return _totals(q)


@query
def small_cells_as_zero(q: Inputs):
    return summaries.suppress_small_cells(_totals(q), count="total", share="prop")


@query
def small_cells_as_label(q: Inputs):
    return summaries.suppress_small_cells(_totals(q), mode="label", count="total", share="prop")


@query
def small_cells_share_kept(q: Inputs):
    return summaries.suppress_small_cells(_totals(q), mode="label", count="total", share="prop", keep_share=True)


@query
def stacked_summaries(q: Inputs):
    return q.studies({"vafi": ONE_YEAR, "efi": EFI_DRUGS}).summary().orderBy("fi", "age_group", "is_female")


SEVERAL = {"vafi": ONE_YEAR, "vafi chronic 3": CHRONIC_3, "efi": EFI_DRUGS, "efi chronic 3": replace(EFI_DRUGS, chronic_lookback=3)}


@query
def several_index_events(q: Inputs):
    return q.studies(SEVERAL).events


@query
def several_index_scores(q: Inputs):
    return q.studies(SEVERAL).scores


@query
def several_index_scores_all_periods(q: Inputs):
    return q.studies(SEVERAL, dedupe=False).scores


@query
def several_index_prevalence(q: Inputs):
    efi = concepts.concept_set(q.fi_indices, "efi").select("category")
    return q.studies({"vafi": ONE_YEAR, "efi": EFI_DRUGS}).prevalence({"vafi": q.vafi.select("category"), "efi": efi})


# ---- deficit rates ------------------------------------------------------------------------------


@query
def deficit_spans(q: Inputs):
    return q.deficit_spans


@query
def deficit_rates(q: Inputs):
    return rates.deficit_rates(q.deficit_spans)


@query
def rate_distribution(q: Inputs):
    return rates.rate_distribution(store(rates.deficit_rates(q.deficit_spans), "rates"))


# ---- agreement ----------------------------------------------------------------------------------


@query(source_values=True, store_lines=True)
def category_totals_compared(q: Inputs):
    return q.category_pairs


@query(source_values=True, store_lines=True)
def category_correlation(q: Inputs):
    return agreement.category_correlation(q.category_pairs)


@query(source_values=True, store_lines=True)
def category_correlation_without_one(q: Inputs):
    return agreement.category_correlation(q.category_pairs, exclude="Brand#7")


@query(source_values=True, store_lines=True)
def category_icc(q: Inputs):
    return agreement.category_icc(q.category_pairs)


@query(source_values=True, store_lines=True)
def category_icc_without_one(q: Inputs):
    return agreement.category_icc(q.category_pairs, exclude="Brand#7")


def _reconciled(q: Inputs, rows: bool) -> DataFrame:
    n = F.count(F.lit(1)).alias("n")
    by_code = q.code_events.groupBy("source_value", F.col("deficit").alias("category"), "concept_id").agg(n)
    found = events.frailty_events(q.cdm, q.fi_indices, "vafi", q.windows, "concept")
    return agreement.reconcile_concepts(by_code, found.groupBy("concept_id", "category").agg(n), rows)


@query(source_values=True, store_lines=True)
def reconciled_concepts(q: Inputs):
    return _reconciled(q, rows=False)


@query(source_values=True, store_lines=True)
def reconciled_concept_rows(q: Inputs):
    return _reconciled(q, rows=True)


@query
def runs_compared(q: Inputs):
    return agreement.compare_runs(q.study(CHRONIC_3).summary(), q.study(ONE_YEAR).summary())


# ---- sources and sinks --------------------------------------------------------------------------


@query
def cdm_from_files(q: Inputs):
    folder = f"{scratch_folder(q.spark)}/cdm-{uuid4().hex}"
    checkpoint_table(q.table("concept"), "concept", path=folder)
    return OmopCdm(q.spark, path=folder).table("concept")


@query
def cdm_from_views(q: Inputs):
    name = f"frailscope_person_{uuid4().hex}"
    q.table("person").createOrReplaceTempView(name)
    try:
        return OmopCdm(q.spark).table(name)
    finally:
        q.spark.catalog.dropTempView(name)  # the table found does not need it any more


@query
def stored_cohort(q: Inputs):
    return q.cohort


@query
def summary_written_and_read(q: Inputs):
    target = f"{scratch_folder(q.spark)}/cohort-summary-{uuid4().hex}"
    write_summary(people.cohort_summary(q.cohort), target)
    layout = "age_group string, is_female int, n long, percent_group double, sample_size long, percent_female double"
    return read_codes(q.spark, target, layout)
