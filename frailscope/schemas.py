"""Declared schemas of the OMOP tables the operators read, and the column check at the API edge."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The partition column of clinical tables in the dated layout: the first day of the event's month.
EVENT_MONTH = "event_month"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_ID, _INT, _DATE, _TEXT, _NUM = T.LongType(), T.IntegerType(), T.DateType(), T.StringType(), T.DoubleType()

# Column names are fixed by the OMOP Common Data Model.
TABLES: dict[str, T.StructType] = {
    "person": _struct(person_id=_ID, year_of_birth=_INT, gender_concept_id=_INT),
    "visit_occurrence": _struct(visit_occurrence_id=_ID, person_id=_ID, visit_start_date=_DATE),
    "observation_period": _struct(
        person_id=_ID, observation_period_start_date=_DATE, observation_period_end_date=_DATE
    ),
    "condition_occurrence": _struct(
        person_id=_ID, condition_concept_id=_ID, condition_start_date=_DATE, condition_source_value=_TEXT
    ),
    "observation": _struct(
        person_id=_ID, observation_concept_id=_ID, observation_date=_DATE, observation_source_value=_TEXT
    ),
    "procedure_occurrence": _struct(
        person_id=_ID, procedure_concept_id=_ID, procedure_date=_DATE, procedure_source_value=_TEXT
    ),
    "device_exposure": _struct(
        person_id=_ID, device_concept_id=_ID, device_exposure_start_date=_DATE, device_source_value=_TEXT
    ),
    "drug_era": _struct(
        person_id=_ID, drug_concept_id=_ID, drug_era_start_date=_DATE, drug_era_end_date=_DATE
    ),
    "concept": _struct(
        concept_id=_ID, concept_name=_TEXT, concept_code=_TEXT, vocabulary_id=_TEXT, standard_concept=_TEXT
    ),
    "concept_relationship": _struct(concept_id_1=_ID, concept_id_2=_ID, relationship_id=_TEXT),
    "concept_ancestor": _struct(ancestor_concept_id=_ID, descendant_concept_id=_ID),
    "cb_search_person": _struct(person_id=_ID, age_at_consent=_INT),
}

CONCEPT_SET = _struct(category=_TEXT, concept_id=_ID, fi=_TEXT, score=_NUM)
LOOKBACKS = _struct(fi=_TEXT, category=_TEXT, lookback=_INT)
CODE_PATTERNS = _struct(category=_TEXT, code_pattern=_TEXT)


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    """Raise ``ValueError`` naming every column that ``what`` lacks."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {', '.join(missing)}; it has {', '.join(df.columns)}")
