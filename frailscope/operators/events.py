"""Finding deficit events of a cohort in the clinical tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from frailscope.functions.cuts import Cut, cut_of
from frailscope.functions.dates import in_closed_window, years_before
from frailscope.functions.joins import fits_broadcast, lookup_join, measure, people_join
from frailscope.operators.concepts import concept_set, require_index
from frailscope.schemas import EVENT_MONTH, require_columns


class Cdm(Protocol):
    def table(self, name: str) -> DataFrame: ...


class DomainColumns(NamedTuple):
    table: str
    concept: str
    date: str
    source: str


# Table and column names of the OMOP Common Data Model.
DOMAINS: dict[str, DomainColumns] = {
    "condition": DomainColumns(
        "condition_occurrence", "condition_concept_id", "condition_start_date", "condition_source_value"
    ),
    "observation": DomainColumns(
        "observation", "observation_concept_id", "observation_date", "observation_source_value"
    ),
    "procedure": DomainColumns(
        "procedure_occurrence", "procedure_concept_id", "procedure_date", "procedure_source_value"
    ),
    "device": DomainColumns(
        "device_exposure", "device_concept_id", "device_exposure_start_date", "device_source_value"
    ),
}

# Fixed value: the longest concept name the data model allows.
_NAME_BYTES = 255

OUTPUTS = ("raw", "concept", "category")
_WINDOW = ("person_id", "person_start_date", "person_end_date")


def search_window(
    df: DataFrame,
    person_id: str = "person_id",
    start: str = "visit_lookback_date",
    end: str = "index_date",
    keep: Sequence[str] = ("age_group", "is_female"),
) -> DataFrame:
    """A cohort as (person_id, person_start_date, person_end_date, kept columns)."""
    require_columns(df, [person_id, start, end, *keep], "the cohort")
    return df.select(
        F.col(person_id).alias("person_id"),
        F.col(start).cast("date").alias("person_start_date"),
        F.col(end).cast("date").alias("person_end_date"),
        *keep,
    )


def domain_events(
    cdm: Cdm, domains: Sequence[str] = tuple(DOMAINS), source_values: bool = False, months: bool = False
) -> DataFrame:
    """The clinical domains as one table (person_id, concept_id, start_date, domain[, source_value][, event_month]).

    ``event_month`` is the partition column of tables in the dated layout, and null for others. Domains that are cut
    from one wider table are taken from it in one pass, so that what builds it runs once and not once a domain.
    """
    unknown = [d for d in domains if d not in DOMAINS]
    if unknown or not domains:
        raise ValueError(f"unknown domains {unknown}; choose from {', '.join(DOMAINS)}")
    tables = {domain: cdm.table(DOMAINS[domain].table) for domain in domains}
    cuts: dict[DataFrame, dict[str, Cut]] = {}
    parts = []
    for domain in domains:
        names, cut = DOMAINS[domain], cut_of(tables[domain])
        if cut is None or domain in cuts.get(cut.whole, {}):
            parts.append((tables[domain], names, F.lit(domain)))
        else:
            cuts.setdefault(cut.whole, {})[domain] = cut
    for whole, found in cuts.items():
        tag = F.coalesce(*[F.when(cut.belongs, F.lit(domain)) for domain, cut in found.items()])
        wanted = whole.filter(reduce(Column.__or__, [cut.belongs for cut in found.values()]))
        first = next(iter(found))
        old = found[first].names
        parts.append((wanted, DomainColumns(*[old.get(name, name) for name in DOMAINS[first]]), tag))
    stacked = None
    for table, names, tag in parts:
        month = F.col(EVENT_MONTH) if EVENT_MONTH in table.columns else F.lit(None)
        part = table.select(
            "person_id",
            F.col(names.concept).alias("concept_id"),
            F.col(names.date).alias("start_date"),
            tag.alias("domain"),
            *([F.col(names.source).alias("source_value")] if source_values else []),
            *([month.cast("date").alias(EVENT_MONTH)] if months else []),
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def _kept(cohort: DataFrame) -> list[str]:
    return [c for c in cohort.columns if c not in _WINDOW]


def _search(
    facts: DataFrame, lookup: DataFrame, on: str, bound: Row, cohort: DataFrame, acute: int, chronic: int
) -> DataFrame:
    """:func:`_search_windows` with one lookback, or with two that the column ``chronic`` of ``lookup`` tells apart."""
    years = F.when(F.col("chronic") == 1, F.lit(chronic)).otherwise(F.lit(acute))
    return _search_windows(facts, lookup, on, bound, cohort, [acute, chronic], years)


def _search_windows(
    facts: DataFrame,
    lookup: DataFrame,
    on: str,
    bound: Row,
    cohort: DataFrame,
    lookbacks: Sequence[int],
    years: Column,
) -> DataFrame:
    """Facts whose ``on`` is in the lookup and whose date is in the window of their person.

    ``person_start_date`` is moved back by the lookback: ``years``, one of ``lookbacks``, an expression over ``lookup``
    that matters only if there are several. All window starts are worked out once per person, and the span of
    all windows is handed to the scan of the facts, as dates and, for the dated layout, as months.

    A broadcast lookup goes first, it costs no shuffle. A large one (by its ``bound``) goes last, so
    that only facts inside a window are shuffled to it.
    """
    start, date = F.col("person_start_date"), F.col("start_date")
    known = sorted(set(lookbacks))
    starts = {f"_start_{n}": years_before(start, n - 1) for n in known}
    moved = earliest = F.col(f"_start_{known[0]}")
    for n in known[1:]:
        moved = F.when(years == n, F.col(f"_start_{n}")).otherwise(moved)
    if len(known) > 1:
        earliest = F.least(*starts)
    people = cohort.withColumns(starts).drop("person_start_date")
    size = measure(people, F.min(earliest).alias("lo"), F.max("person_end_date").alias("hi"))
    if size["lo"] is not None and size["hi"] is not None:
        facts = facts.filter(date.between(F.lit(size["lo"]), F.lit(size["hi"])))
        if EVENT_MONTH in facts.columns:
            # Tables in the dated layout are read for the months of the windows only.
            month, least = F.col(EVENT_MONTH), F.lit(size["lo"].replace(day=1))
            facts = facts.filter(month.isNull() | month.between(least, F.lit(size["hi"].replace(day=1))))
    facts = facts.drop(EVENT_MONTH)

    def near_people(df: DataFrame) -> DataFrame:
        joined = people_join(df, people, spread_by=[on, "start_date"], measured=size)
        return joined.filter(in_closed_window(date, earliest, F.col("person_end_date")))

    if fits_broadcast(lookup, bound):
        hits = near_people(lookup_join(facts, lookup, on, measured=bound))
    else:
        hits = lookup_join(near_people(facts), lookup, on, measured=bound)
    return hits.withColumn("person_start_date", moved).filter(
        in_closed_window(date, F.col("person_start_date"), F.col("person_end_date"))
    )


def find_index_events(
    cdm: Cdm,
    cohort: DataFrame,
    concepts: DataFrame,
    lookbacks: Sequence[int] = (1,),
    domains: Sequence[str] = tuple(DOMAINS),
) -> DataFrame:
    """Distinct (person_id, kept columns, index_name, category, score) of several indices, in one search.

    ``concepts`` (index_name, category, concept_id, score, lookback) says which index and category a concept belongs
    to and how many years back it is looked for, one of ``lookbacks``. Every clinical domain is scanned once
    and joined to the cohort once, however many indices there are. ``cohort`` comes from :func:`search_window`.
    """
    require_columns(cohort, _WINDOW, "the cohort")
    if not lookbacks or min(lookbacks) < 1:
        raise ValueError("lookbacks are whole years from 1 upwards")
    wanted = concepts.select("concept_id", "index_name", "category", "score", F.col("lookback").cast("int"))
    bound = measure(wanted)
    standard = cdm.table("concept").filter(F.col("standard_concept") == "S").select("concept_id")
    lookup = standard.join(wanted.distinct(), "concept_id")
    hits = _search_windows(
        domain_events(cdm, domains, months=True), lookup, "concept_id", bound, cohort, lookbacks, F.col("lookback")
    )
    return hits.select("person_id", *_kept(cohort), "index_name", "category", "score").distinct()


def find_events(
    cdm: Cdm,
    cohort: DataFrame,
    concepts: DataFrame,
    output: str = "raw",
    domains: Sequence[str] = tuple(DOMAINS),
    acute_lookback: int = 1,
    chronic_lookback: int = 1,
    tag_domain: bool = False,
) -> DataFrame:
    """Events of the cohort whose standard concept is in the set and whose date is in the window.

    ``cohort`` comes from :func:`search_window`. A lookback of n years starts n - 1 years before
    the given window; chronic concepts (``concepts.chronic`` = 1) use ``chronic_lookback``, all
    others ``acute_lookback``. A concept in an acute and a chronic category is searched with both.

    ``output`` is ``raw`` (events with concept names), ``concept`` (one row per event and
    category) or ``category`` (distinct categories of a person). The same event in two domains
    counts twice, except in ``category``. ``tag_domain`` keeps the domain, and for ``concept``
    the event date.
    """
    if output not in OUTPUTS:
        raise ValueError(f"output must be one of {', '.join(OUTPUTS)}")
    if min(acute_lookback, chronic_lookback) < 1:
        raise ValueError("lookbacks are whole years from 1 upwards")
    require_columns(cohort, _WINDOW, "the cohort")
    flag = ["chronic"] if acute_lookback != chronic_lookback else []
    if flag and "chronic" in concepts.columns:
        members = concepts.withColumn("chronic", F.coalesce("chronic", F.lit(0)))
    else:
        members = concepts.withColumn("chronic", F.lit(0))
    carried = flag + ([] if output == "raw" else ["category", "score"])
    names = ["concept_name"] if output == "raw" else []

    # One lookup of concept -> what the output needs. Concept ids are unique in the vocabulary, so the
    # lookup has no more rows than the set measured here.
    wanted = members.select("concept_id", *carried)
    bound = measure(wanted, more_bytes_per_row=_NAME_BYTES if names else 0)
    standard = cdm.table("concept").filter(F.col("standard_concept") == "S").select("concept_id", *names)
    lookup = standard.join(wanted.distinct(), "concept_id")
    hits = _search(
        domain_events(cdm, domains, months=True), lookup, "concept_id", bound, cohort, acute_lookback, chronic_lookback
    )

    kept = _kept(cohort)
    window = ["person_start_date", "person_end_date"]
    tag = ["domain"] if tag_domain else []
    if output == "category":
        return hits.select("person_id", *kept, *window, "category", "score", *tag).distinct()
    event = ["person_id", *kept, "concept_id", *names, "start_date", *window, *carried]
    events = hits.select(*event, "domain").distinct()
    if output == "raw":
        return events.select(*event, *tag)
    dated = ["start_date"] if tag_domain else []
    return events.select("person_id", *kept, *dated, *window, "category", "concept_id", "score", *tag)


def frailty_events(
    cdm: Cdm,
    fi_indices: DataFrame,
    index: str,
    cohort: DataFrame,
    output: str = "category",
    allowed: Sequence[str] | None = None,
    **search,
) -> DataFrame:
    """:func:`find_events` for the concepts of one index of a combined concept table."""
    name = require_index(fi_indices, index, allowed)
    return find_events(cdm, cohort, concept_set(fi_indices, name), output=output, **search)


# The indices that have a code-based derivation.
CODE_BASED_INDICES = ("efragicap", "vafi")


def code_index_events(
    cdm: Cdm, fi_indices: DataFrame, index: str, cohort: DataFrame, unique_categories: bool = False
) -> DataFrame:
    """Events of a code-based index, as categories without concept ids."""
    output = "category" if unique_categories else "concept"
    found = frailty_events(cdm, fi_indices, index, cohort, output, allowed=CODE_BASED_INDICES)
    return found.drop("concept_id")


def find_events_by_source_code(
    cdm: Cdm,
    cohort: DataFrame,
    codes: Sequence[DataFrame],
    domains: Sequence[str] = tuple(DOMAINS),
) -> DataFrame:
    """Events whose source value is one of the codes, whatever concept it was mapped to.

    ``codes`` are tables (code, deficit), stacked without looking for repeats. Names and
    vocabularies are looked up last, for the events found.
    """
    stacked = codes[0].select("code", "deficit")
    for more in codes[1:]:
        stacked = stacked.unionByName(more.select("code", "deficit"))
    wanted = stacked.select(F.col("code").alias("source_value"), "deficit").distinct()
    facts = domain_events(cdm, domains, source_values=True, months=True)
    kept = _kept(cohort)
    # A code may stand for many deficits, so repeated events go before they are unfolded to them.
    codes = wanted.select("source_value").distinct()
    hits = _search(facts, codes, "source_value", measure(codes), cohort, 1, 1)
    event = ["person_id", *kept, "concept_id", "start_date", "source_value", "person_start_date", "person_end_date", "domain"]
    found = lookup_join(hits.select(*event).distinct().drop("domain"), wanted, "source_value", measured=measure(wanted))
    named = cdm.table("concept").select("concept_id", "concept_name", "vocabulary_id")
    return found.join(named, "concept_id", "left").select(
        "person_id",
        *kept,
        "concept_id",
        "concept_name",
        "start_date",
        "deficit",
        "source_value",
        "person_start_date",
        "person_end_date",
        "vocabulary_id",
    )
