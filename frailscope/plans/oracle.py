"""SQL twins of the registered queries, over the same test tables."""

from __future__ import annotations

_VIEWS = """
person AS (
  SELECT c_custkey AS person_id, CAST(1910 + c_custkey % 60 AS INTEGER) AS year_of_birth,
         CASE WHEN c_custkey % 2 = 0 THEN 8507 ELSE 8532 END AS gender_concept_id
  FROM customer),
visit_occurrence AS (
  SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id, CAST(o_orderdate AS DATE) AS visit_start_date
  FROM orders),
visit_spans AS (
  SELECT person_id, min(visit_start_date) AS first_visit, max(visit_start_date) AS last_visit
  FROM visit_occurrence GROUP BY person_id),
observation_period AS (
  SELECT person_id, first_visit AS observation_period_start_date, last_visit AS observation_period_end_date
  FROM visit_spans
  UNION ALL
  SELECT person_id, first_visit + 180, last_visit FROM visit_spans WHERE person_id % 10 = 0),
concept AS (
  SELECT p_partkey AS concept_id, p_name AS concept_name,
         substr(p_type, 1, 1) || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || CAST(p_partkey % 10 AS VARCHAR) AS concept_code,
         CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 'ICD10CM' WHEN p_type = 'PROMO' THEN 'CPT4' ELSE 'SNOMED' END AS vocabulary_id,
         CASE WHEN p_partkey % 20 <> 0 THEN 'S' END AS standard_concept
  FROM part),
concept_relationship AS (
  SELECT concept_id AS concept_id_1, concept_id + 1 AS concept_id_2, 'Maps to' AS relationship_id FROM concept WHERE vocabulary_id = 'ICD10CM'
  UNION ALL
  SELECT concept_id, concept_id + 2, 'Maps to' FROM concept WHERE vocabulary_id = 'ICD10CM' AND concept_id % 3 = 0
  UNION ALL
  SELECT concept_id, concept_id + 3, 'Is a' FROM concept),
concept_ancestor AS (
  SELECT concept_id - concept_id % 10 AS ancestor_concept_id, concept_id AS descendant_concept_id FROM concept),
facts AS (
  SELECT o_custkey AS person_id, l_partkey AS concept_id, CAST(l_shipdate AS DATE) AS start_date,
         CASE WHEN l_linenumber <= 3 THEN 'condition' WHEN l_linenumber <= 5 THEN 'observation'
              WHEN l_linenumber = 6 THEN 'procedure' ELSE 'device' END AS domain,
         concept_code AS source_value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN concept ON concept_id = l_partkey
  WHERE l_linenumber BETWEEN 1 AND 7),
drug_era AS (
  SELECT o_custkey AS person_id, l_partkey % 200 AS drug_concept_id, CAST(l_shipdate AS DATE) AS drug_era_start_date,
         CAST(l_shipdate AS DATE) + 3 * CAST(l_quantity AS INTEGER) AS drug_era_end_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
drug_exclusions AS (
  SELECT DISTINCT drug_concept_id FROM drug_era WHERE drug_concept_id % 25 = 0),
cb_search_person AS (
  SELECT c_custkey AS person_id, CAST(20 + c_custkey % 110 AS INTEGER) AS age_at_consent FROM customer),
fi_indices AS (
  SELECT p_brand AS category, p_partkey AS concept_id, 'vafi' AS fi, CAST(1 AS DOUBLE) AS score FROM part WHERE p_size <= 40
  UNION ALL
  SELECT p_brand, p_partkey, 'hfrs', p_size / CAST(10 AS DOUBLE) FROM part WHERE p_size > 20
  UNION ALL
  SELECT p_brand, p_partkey, 'efi', CAST(1 AS DOUBLE) FROM part
  UNION ALL
  SELECT p_type, p_partkey, 'efi', CAST(1 AS DOUBLE) FROM part WHERE p_partkey % 7 = 0),
lookbacks AS (
  SELECT DISTINCT fi, category,
         CASE WHEN category LIKE 'Brand#%' AND fi <> 'hfrs' AND TRY_CAST(substr(category, 7) AS INTEGER) % 2 = 1 THEN 3 ELSE 1 END AS lookback
  FROM fi_indices),
flagged AS (
  SELECT i.category, i.concept_id, i.fi, i.score, l.lookback, CASE WHEN l.lookback = 3 THEN 1 ELSE 0 END AS chronic
  FROM fi_indices i LEFT JOIN lookbacks l ON i.fi = l.fi AND i.category = l.category),
code_patterns AS (
  SELECT * FROM (VALUES ('Heart', 'E0%'), ('Heart', 'L1%'), ('Kidney', 'E2_.3'), ('Single', 'L40.1')) v(category, code_pattern)),
named_mappings AS (
  SELECT DISTINCT s.concept_id AS orig_concept_id, t.concept_id AS concept_id, s.concept_name AS source_concept_name,
         s.concept_code AS source_code, p.code_pattern, p.category AS deficit, t.concept_name AS target_concept_name
  FROM code_patterns p
  JOIN concept s ON s.concept_code LIKE p.code_pattern AND s.vocabulary_id IN ('ICD10CM', 'ICD10PCS', 'CPT4', 'HCPCS')
  JOIN concept_relationship r ON r.concept_id_1 = s.concept_id AND r.relationship_id = 'Maps to'
  JOIN concept t ON t.concept_id = r.concept_id_2 AND t.vocabulary_id IN ('SNOMED', 'CPT4', 'HCPCS')),
pruned AS (
  SELECT m.* FROM named_mappings m
  WHERE NOT (deficit = 'Heart' AND NOT regexp_matches(target_concept_name, 'red|blue|small|widget'))
    AND NOT EXISTS (SELECT 1 FROM named_mappings r
                    WHERE r.source_code LIKE '%.5' AND r.concept_id = m.concept_id AND r.deficit = m.deficit)
    AND m.concept_id NOT IN (SELECT concept_id FROM concept WHERE standard_concept IS NULL)),
index_visit AS (
  SELECT p.person_id, p.year_of_birth, p.gender_concept_id, v.visit_start_date AS index_date
  FROM person p JOIN (
    SELECT *, row_number() OVER (
      PARTITION BY person_id
      ORDER BY md5(concat_ws('|', '42', CAST(person_id AS VARCHAR), CAST(visit_occurrence_id AS VARCHAR))), visit_occurrence_id) AS draw
    FROM visit_occurrence) v ON v.person_id = p.person_id AND v.draw = 1),
washed_all AS (
  SELECT i.person_id, i.year_of_birth, i.gender_concept_id, i.index_date,
         o.observation_period_start_date, o.observation_period_end_date,
         CAST(year(i.index_date) AS INTEGER) - i.year_of_birth AS age,
         CASE WHEN i.year_of_birth < 1938 THEN 1 ELSE 0 END AS yob_imputed
  FROM index_visit i JOIN observation_period o ON o.person_id = i.person_id
  WHERE i.index_date - o.observation_period_start_date >= 365 AND year(i.index_date) - i.year_of_birth >= 40),
washed AS (
  SELECT * EXCLUDE (pick) FROM (
    SELECT *, row_number() OVER (PARTITION BY person_id
                                 ORDER BY observation_period_start_date, observation_period_end_date DESC) AS pick
    FROM washed_all) w WHERE pick = 1),
strata AS (
  SELECT person_id, CASE WHEN gender_concept_id = 8507 THEN 0 ELSE 1 END AS is_female,
         CASE WHEN a BETWEEN 40 AND 44 THEN '[40,45)' WHEN a BETWEEN 45 AND 49 THEN '[45,50)'
              WHEN a BETWEEN 50 AND 54 THEN '[50,55)' WHEN a BETWEEN 55 AND 59 THEN '[55,60)'
              WHEN a BETWEEN 60 AND 64 THEN '[60,65)' WHEN a BETWEEN 65 AND 69 THEN '[65,70)'
              WHEN a BETWEEN 70 AND 74 THEN '[70,75)' WHEN a BETWEEN 75 AND 79 THEN '[75,80)'
              WHEN a BETWEEN 80 AND 100 THEN '[80,100]' END AS age_group,
         CAST(index_date - INTERVAL 12 MONTH AS DATE) AS visit_lookback_date, index_date, yob_imputed, copy
  FROM (SELECT *, CASE WHEN yob_imputed = 1 THEN 84 ELSE age END AS a, 'one' AS copy FROM washed
        UNION ALL
        SELECT *, CASE WHEN yob_imputed = 1 THEN 84 ELSE age END AS a, 'all' AS copy FROM washed_all) w),
cohort AS (SELECT * EXCLUDE (copy) FROM strata WHERE copy = 'one'),
cohort_all AS (SELECT * EXCLUDE (copy) FROM strata WHERE copy = 'all'),
standard AS (SELECT DISTINCT concept_id, concept_name FROM concept WHERE standard_concept = 'S'),
codes AS (
  SELECT DISTINCT c.concept_code AS source_value, i.category AS deficit
  FROM concept c JOIN fi_indices i ON i.concept_id = c.concept_id AND i.fi = 'vafi'
  WHERE c.vocabulary_id IN ('ICD10CM', 'CPT4')),
code_events AS (
  SELECT e.person_id, e.age_group, e.is_female, e.concept_id, c.concept_name, e.start_date, e.deficit, e.source_value,
         e.person_start_date, e.person_end_date, c.vocabulary_id
  FROM (SELECT DISTINCT f.person_id, k.age_group, k.is_female, f.concept_id, f.start_date, codes.deficit, f.source_value,
               k.visit_lookback_date AS person_start_date, k.index_date AS person_end_date, f.domain
        FROM facts f JOIN cohort k ON k.person_id = f.person_id JOIN codes ON codes.source_value = f.source_value
        WHERE f.start_date BETWEEN k.visit_lookback_date AND k.index_date) e
  LEFT JOIN concept c ON c.concept_id = e.concept_id)
"""


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([_VIEWS.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


def _events(name: str, fi: str, cohort: str = "cohort", acute: int = 1, chronic: int = 1) -> str:
    """A CTE of distinct events (with category and domain) of one index."""
    flag = "chronic" if acute != chronic else "0"
    back = f"CASE WHEN m.chronic = 1 THEN {12 * (chronic - 1)} ELSE {12 * (acute - 1)} END"
    opens = f"CAST(k.visit_lookback_date - to_months(CAST({back} AS INTEGER)) AS DATE)"
    return f"""
{name} AS (
  SELECT DISTINCT f.person_id, k.age_group, k.is_female, f.concept_id, s.concept_name, f.start_date,
         {opens} AS person_start_date, k.index_date AS person_end_date, m.category, m.score, m.chronic, f.domain
  FROM facts f
  JOIN (SELECT person_id, age_group, is_female, visit_lookback_date, index_date FROM {cohort}) k ON k.person_id = f.person_id
  JOIN standard s ON s.concept_id = f.concept_id
  JOIN (SELECT DISTINCT concept_id, category, score, {flag} AS chronic FROM flagged WHERE fi = '{fi}') m ON m.concept_id = f.concept_id
  WHERE f.start_date BETWEEN {opens} AND k.index_date)"""


def _scores(name: str, source: str, cohort: str = "cohort", denominator: int = 25, lb: float = 0.12, ub: float = 0.24) -> str:
    """A CTE of frailty classes from (person_id, age_group, is_female, category, score)."""
    return f"""
{name} AS (
  SELECT person_id, age_group, is_female, fi,
         CASE WHEN fi >= CAST({lb} AS DOUBLE) AND fi < CAST({ub} AS DOUBLE) THEN 1 ELSE 0 END AS prefrail,
         CASE WHEN fi >= CAST({ub} AS DOUBLE) THEN 1 ELSE 0 END AS frail,
         CASE WHEN fi < CAST({lb} AS DOUBLE) THEN 1 ELSE 0 END AS robust
  FROM (SELECT person_id, age_group, is_female, sum(score) / CAST({denominator} AS DOUBLE) AS fi
        FROM (SELECT DISTINCT person_id, age_group, is_female, category, score FROM {source}) d
        GROUP BY person_id, age_group, is_female) s
  UNION ALL
  SELECT person_id, age_group, is_female, CAST(0 AS DOUBLE), 0, 0, 1 FROM {cohort}
  WHERE person_id NOT IN (SELECT person_id FROM {source}))"""


def _summary(source: str) -> str:
    return f"""
SELECT age_group, is_female, count(*) AS n,
       CAST(sum(prefrail) AS BIGINT) AS n_prefrail, CAST(sum(frail) AS BIGINT) AS n_frail, CAST(sum(robust) AS BIGINT) AS n_robust,
       round(sum(prefrail) / CAST(count(*) AS DOUBLE), 6) AS prefrail,
       round(sum(frail) / CAST(count(*) AS DOUBLE), 6) AS frail,
       round(sum(robust) / CAST(count(*) AS DOUBLE), 6) AS robust
FROM {source} GROUP BY age_group, is_female"""


def _ingredients(name: str, min_days: int, rule: str = "endpoint") -> str:
    """A CTE of distinct ingredient counts per person."""
    if rule == "endpoint":
        exposed = (
            "(d.drug_era_start_date BETWEEN k.visit_lookback_date AND k.index_date"
            " OR d.drug_era_end_date BETWEEN k.visit_lookback_date AND k.index_date)"
        )
    else:
        exposed = (
            "((d.drug_era_start_date > k.index_date - 365 AND d.drug_era_start_date <= k.index_date)"
            " OR (d.drug_era_start_date <= k.index_date - 365 AND d.drug_era_end_date > k.index_date - 365))"
            " AND d.drug_concept_id NOT IN (SELECT drug_concept_id FROM drug_exclusions)"
        )
    return f"""
{name} AS (
  SELECT d.person_id, count(DISTINCT d.drug_concept_id) AS n
  FROM drug_era d JOIN cohort k ON k.person_id = d.person_id
  WHERE {exposed} AND d.drug_era_end_date - d.drug_era_start_date >= {min_days}
  GROUP BY d.person_id)"""


_DEFICIT = """
efi_drugs AS (
  SELECT DISTINCT person_id, age_group, is_female, category, score FROM ev
  UNION
  SELECT k.person_id, k.age_group, k.is_female, 'Polypharmacy', CAST(1 AS DOUBLE)
  FROM cohort k JOIN drugs d ON d.person_id = k.person_id WHERE d.n >= 10)"""

_EFI_DRUGS = (_events("ev", "efi"), _ingredients("drugs", 2), _DEFICIT)

_ZERO_FILLED = """
filled AS (
  SELECT k.person_id, k.age_group, CAST(coalesce(d.n, 0) AS BIGINT) AS n
  FROM cohort k LEFT JOIN drugs d ON d.person_id = k.person_id)"""

_TOTALS = """
totals AS (
  SELECT t.category, t.age_group, t.is_female, t.total, s.n, round(t.total / s.n, 6) AS prop
  FROM (SELECT category, age_group, is_female, sum(score) AS total FROM efi_drugs GROUP BY category, age_group, is_female) t
  LEFT JOIN (SELECT age_group, is_female, count(*) AS n FROM cohort GROUP BY age_group, is_female) s
    ON s.age_group IS NOT DISTINCT FROM t.age_group AND s.is_female = t.is_female)"""


def _detail(name: str, fi: str, weighted: bool) -> str:
    """A CTE of distinct (person, category, score) in the forward window of a year."""
    score = "m.score" if weighted else "CAST(1 AS DOUBLE)"
    return f"""
{name} AS (
  SELECT DISTINCT f.person_id, m.category,
         CASE WHEN f.start_date BETWEEN k.visit_lookback_date AND k.visit_lookback_date + 365 THEN {score} ELSE CAST(0 AS DOUBLE) END AS score
  FROM facts f
  JOIN cohort k ON k.person_id = f.person_id
  JOIN (SELECT DISTINCT concept_id, category, score FROM fi_indices WHERE fi = '{fi}') m ON m.concept_id = f.concept_id)"""


def _known(name: str, fi: str) -> str:
    return f"""
{name} AS (SELECT DISTINCT person_id FROM facts WHERE concept_id IN (SELECT concept_id FROM fi_indices WHERE fi = '{fi}'))"""


_BY_PERSON = """
by_person AS (
  SELECT person_id, round(sum(score), 6) AS fi, 1 AS found_ehr FROM detail GROUP BY person_id
  UNION ALL
  SELECT DISTINCT person_id, CAST(0 AS DOUBLE), 0 FROM cohort WHERE person_id NOT IN (SELECT person_id FROM known))"""

_SPANS = """
spans AS (
  SELECT person_id, category, count(*) AS n, min(start_date) AS first_occ, min(person_end_date) AS index_date
  FROM ev GROUP BY person_id, category)"""

_RATES = """
rates AS (
  SELECT *, CAST(index_date - first_occ AS INTEGER) AS time_to_index,
         CAST(365.25 AS DOUBLE) * n / (index_date - first_occ) AS event_per_year
  FROM spans WHERE index_date - first_occ > 365)"""

_PAIRS = """
pairs AS (
  SELECT a.category, a.score_a, b.score_b
  FROM (SELECT category, sum(score) AS score_a FROM (SELECT DISTINCT person_id, category, score FROM ev) x GROUP BY category) a
  LEFT JOIN (SELECT deficit AS category, CAST(count(*) AS DOUBLE) AS score_b
             FROM (SELECT DISTINCT person_id, deficit FROM code_events) y GROUP BY deficit) b ON b.category = a.category)"""

_RECONCILED = """
joined AS (
  SELECT coalesce(a.concept_id, b.concept_id) AS concept_id, coalesce(a.category, b.category) AS category,
         a.source_value, a.n AS icd_count, b.n AS omop_count, a.n - b.n AS icd_vs_omop
  FROM (SELECT source_value, deficit AS category, concept_id, count(*) AS n FROM code_events GROUP BY source_value, deficit, concept_id) a
  FULL JOIN (SELECT concept_id, category, count(*) AS n FROM ev GROUP BY concept_id, category) b
    ON a.concept_id = b.concept_id AND a.category = b.category)"""


def _prevalence_of(fi: str, cohort: str, events: str) -> str:
    return f"""
SELECT g.age_group, g.is_female, g.category, count(*) AS "N", CAST(count(e.person_id) AS DOUBLE) AS "count",
       round(count(e.person_id) / CAST(count(*) AS DOUBLE), 6) AS percent
FROM (SELECT k.person_id, k.age_group, k.is_female, c.category
      FROM {cohort} k, (SELECT DISTINCT category FROM fi_indices WHERE fi = '{fi}') c) g
LEFT JOIN (SELECT DISTINCT person_id, category FROM {events}) e ON e.person_id = g.person_id AND e.category = g.category
WHERE g.age_group IS NOT NULL
GROUP BY g.age_group, g.is_female, g.category"""


def _prevalence(cohort: str) -> str:
    return _sql(_prevalence_of("vafi", cohort, "ev"), _events("ev", "vafi", cohort))


def _several(cohort: str = "cohort") -> tuple[str, ...]:
    """CTEs of the distinct events of two indices with one and three years of chronic lookback."""

    def with_drugs(name: str, source: str) -> str:
        return f"""
{name} AS (
  SELECT DISTINCT person_id, age_group, is_female, category, score FROM {source}
  UNION
  SELECT k.person_id, k.age_group, k.is_female, 'Polypharmacy', CAST(1 AS DOUBLE)
  FROM {cohort} k JOIN drugs d ON d.person_id = k.person_id WHERE d.n >= 10)"""

    return (
        _events("vafi_1", "vafi", cohort),
        _events("vafi_3", "vafi", cohort, chronic=3),
        _events("efi_1_found", "efi", cohort),
        _events("efi_3_found", "efi", cohort, chronic=3),
        _ingredients("drugs", 2),
        with_drugs("efi_1", "efi_1_found"),
        with_drugs("efi_3", "efi_3_found"),
    )


_SEVERAL = {"vafi_1": ("vafi", 25), "vafi_3": ("vafi chronic 3", 25), "efi_1": ("efi", 31), "efi_3": ("efi chronic 3", 31)}


def _several_scores(cohort: str = "cohort") -> str:
    return _sql(
        " UNION ALL ".join(
            f"SELECT * REPLACE (round(fi, 6) AS fi), '{label}' AS index_name FROM scored_{name}"
            for name, (label, _) in _SEVERAL.items()
        ),
        *_several(cohort),
        *(_scores(f"scored_{name}", name, cohort, denominator=n) for name, (_, n) in _SEVERAL.items()),
    )


def _category_report(category: str, source: str) -> str:
    return f"""
SELECT k.age_group, k.is_female, '{category}' AS category, CAST(count(e.person_id) AS DOUBLE) AS n_yes,
       round(count(e.person_id) / CAST(count(*) AS DOUBLE), 6) AS prop_yes
FROM cohort k LEFT JOIN (SELECT DISTINCT person_id FROM {source} WHERE category = '{category}') e ON e.person_id = k.person_id
GROUP BY k.age_group, k.is_female"""


def _cohort_summary(cohort: str) -> str:
    return _sql(
        f"""
SELECT age_group, is_female, count(*) AS n, round(count(*) / CAST(total AS DOUBLE), 6) AS percent_group,
       total AS sample_size, round(female / CAST(total AS DOUBLE), 6) AS percent_female
FROM {cohort}, (SELECT count(*) AS total, count(*) FILTER (WHERE is_female = 1) AS female FROM {cohort}) t
GROUP BY age_group, is_female, total, female"""
    )


def _frailty(cohort: str = "cohort", chronic: int = 1) -> str:
    return _sql(_summary("scored"), _events("ev", "vafi", cohort, 1, chronic), _scores("scored", "ev", cohort))


_RAW = "person_id, age_group, is_female, concept_id, concept_name, start_date, person_start_date, person_end_date"
_STORED = "person_id, is_female, age_group, visit_lookback_date, index_date, yob_imputed"


def _raw(where: str = "TRUE") -> str:
    return _sql(
        f"SELECT {_RAW} FROM (SELECT DISTINCT {_RAW}, domain FROM ev WHERE {where}) e", _events("ev", "vafi")
    )


def _per_event(fi: str, chronic: int = 1, extra: str = "concept_id,") -> str:
    return _sql(
        f"SELECT person_id, age_group, is_female, person_start_date, person_end_date, category, {extra} score FROM ev",
        _events("ev", fi, chronic=chronic),
    )


def _per_category(fi: str, chronic: int = 1) -> str:
    return _sql(
        "SELECT DISTINCT person_id, age_group, is_female, person_start_date, person_end_date, category, score FROM ev",
        _events("ev", fi, chronic=chronic),
    )


def _icc(where: str = "TRUE") -> str:
    return _sql(
        f"""
SELECT subjects, round((b - w) / (b + w), 6) AS icc
FROM (SELECT count(*) AS subjects, 2 * var_samp((score_a + score_b) / 2) AS b, avg((score_a - score_b) * (score_a - score_b) / 2) AS w
      FROM pairs WHERE score_b IS NOT NULL AND {where}) m""",
        _events("ev", "vafi"),
        _PAIRS,
    )


def oracle_sql() -> dict[str, str]:
    deciles = ", ".join(f"quantile_cont(n, {d / 10}) AS p{10 * d:02d}" for d in range(11))
    lookback = _events("ev", "efi", chronic=3)
    return {
        # concept sets
        "concepts_of_index": _sql("SELECT DISTINCT category, concept_id FROM fi_indices WHERE fi = 'efi'"),
        "concepts_of_weighted_index": _sql(
            "SELECT DISTINCT category, concept_id, round(score, 6) AS score FROM fi_indices WHERE fi = 'hfrs'"
        ),
        "concept_set_rows": _sql("SELECT category, concept_id, fi, score FROM fi_indices WHERE fi = 'vafi'"),
        "unified_concept_sets": _sql("SELECT DISTINCT category, concept_id, fi, round(score, 6) AS score FROM fi_indices"),
        "concepts_with_lookback": _sql(
            "SELECT category, concept_id, fi, round(score, 6) AS score, lookback, chronic FROM flagged"
        ),
        "standard_concepts_joined": _sql(
            "SELECT DISTINCT s.concept_id, s.concept_name, f.chronic FROM standard s"
            " JOIN flagged f ON f.concept_id = s.concept_id WHERE f.fi = 'vafi'"
        ),
        "standard_concepts_listed": _sql(
            "SELECT * FROM standard WHERE concept_id IN (SELECT concept_id FROM fi_indices WHERE fi = 'vafi')"
        ),
        "code_patterns_to_concepts": _sql(
            """
SELECT DISTINCT p.category, s.concept_code AS code, t.concept_id
FROM concept_relationship r
JOIN concept s ON s.concept_id = r.concept_id_1 AND s.vocabulary_id LIKE 'ICD10%'
JOIN concept t ON t.concept_id = r.concept_id_2 AND t.vocabulary_id = 'SNOMED'
JOIN code_patterns p ON s.concept_code LIKE p.code_pattern
WHERE r.relationship_id = 'Maps to'"""
        ),
        "code_patterns_with_names": _sql("SELECT * FROM named_mappings"),
        "code_infixes_to_concepts": _sql(
            """
SELECT DISTINCT p.category, s.concept_code AS code, t.concept_id
FROM concept_relationship r
JOIN concept s ON s.concept_id = r.concept_id_1 AND s.vocabulary_id LIKE 'ICD10%'
JOIN concept t ON t.concept_id = r.concept_id_2 AND t.vocabulary_id = 'SNOMED'
JOIN infixes p ON s.concept_code LIKE p.code_pattern
WHERE r.relationship_id = 'Maps to'""",
            """
infixes AS (
  SELECT 'open ' || substr(concept_code, 1, 1) AS category,
         '%' || substr(concept_code, 2, 1) || '_' || substr(concept_code, 4, 2) AS code_pattern
  FROM concept WHERE concept_id % 40 = 0)""",
        ),
        "cleaned_codes": _sql(
            """
SELECT DISTINCT code, code_type,
       TRY_CAST(replace(regexp_extract(code, '(-?[0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', '') AS DOUBLE) AS number
FROM (SELECT regexp_replace(concept_code || CASE WHEN concept_id % 3 = 0 THEN '.' ELSE '' END, '[.]$', '') AS code,
             vocabulary_id AS code_type FROM concept) c
WHERE code_type = 'ICD10CM'"""
        ),
        "expanded_descendants": _sql(
            """
SELECT DISTINCT i.category, a.descendant_concept_id AS concept_id, 'vafi_expanded' AS fi, i.score
FROM concept_ancestor a JOIN fi_indices i ON i.concept_id = a.ancestor_concept_id WHERE i.fi = 'vafi'"""
        ),
        "pruned_mappings": _sql("SELECT * FROM pruned"),
        "finalised_concept_set": _sql(
            "SELECT DISTINCT deficit AS category, concept_id, 'repaired' AS fi, CAST(1 AS DOUBLE) AS score FROM pruned"
        ),
        "mapping_multiplicity": _sql(
            "SELECT *, count(*) OVER (PARTITION BY orig_concept_id) AS n_omop_matches FROM named_mappings"
        ),
        # cohort
        "eligible_people": _sql("SELECT DISTINCT person_id FROM cb_search_person WHERE age_at_consent BETWEEN 50 AND 120"),
        "random_index_visit": _sql("SELECT * FROM index_visit"),
        "washout_cohort": _sql("SELECT * FROM washed"),
        "washout_cohort_all_periods": _sql("SELECT * FROM washed_all"),
        "cohort_strata": _sql(f"SELECT {_STORED} FROM cohort"),
        "earliest_index": _sql(
            """
SELECT visit_occurrence_id, person_id, visit_start_date AS index_date
FROM (SELECT *, min(visit_start_date) OVER (PARTITION BY person_id) AS earliest FROM visit_occurrence) v
WHERE visit_start_date = earliest
  AND person_id IN (SELECT person_id FROM cb_search_person WHERE age_at_consent BETWEEN 50 AND 120)"""
        ),
        "sampled_cohort": _sql(
            f"""
SELECT person_id FROM person
WHERE substr(md5(concat_ws('|', '42', CAST(person_id AS VARCHAR))), 1, 8) < '{int(0.05 * 2**32):08x}'"""
        ),
        "first_people": _sql("SELECT DISTINCT person_id FROM visit_occurrence ORDER BY person_id LIMIT 500"),
        "cohort_summary": _cohort_summary("cohort_all"),
        # events
        "search_window": _sql(
            "SELECT person_id, visit_lookback_date AS person_start_date, index_date AS person_end_date, age_group, is_female FROM cohort"
        ),
        **{f"events_{d}": _raw(f"domain = '{d}'") for d in ("condition", "observation", "procedure", "device")},
        "events_raw": _raw(),
        "events_by_concept": _per_event("efi"),
        "events_by_category": _per_category("efi"),
        "events_by_weighted_category": _per_category("hfrs"),
        "events_chronic_lookback_raw": _sql(
            f"SELECT {_RAW}, chronic FROM (SELECT DISTINCT {_RAW}, chronic, domain FROM ev) e", lookback
        ),
        "events_chronic_lookback_concept": _per_event("efi", chronic=3),
        "events_chronic_lookback_category": _per_category("efi", chronic=3),
        "code_index_events": _per_event("vafi", extra=""),
        "code_index_categories": _per_category("vafi"),
        "events_by_source_code": _sql("SELECT * FROM code_events"),
        "events_with_domain": _per_event("vafi", extra="concept_id, start_date, domain,"),
        # polypharmacy
        "ingredients_over_1_day": _sql("SELECT * FROM drugs", _ingredients("drugs", 2)),
        "ingredients_from_30_days": _sql("SELECT * FROM drugs", _ingredients("drugs", 30)),
        "ingredients_from_1_day": _sql("SELECT * FROM drugs", _ingredients("drugs", 1)),
        "ingredients_overlapping": _sql("SELECT * FROM drugs", _ingredients("drugs", 90, "overlap")),
        "polypharmacy_deficit": _sql(
            """
SELECT k.person_id, k.age_group, k.is_female, 'Polypharmacy' AS category, CAST(1 AS DOUBLE) AS score
FROM cohort k JOIN drugs d ON d.person_id = k.person_id WHERE d.n >= 10""",
            _ingredients("drugs", 2),
        ),
        "index_with_polypharmacy": _sql("SELECT * FROM efi_drugs", *_EFI_DRUGS),
        "ingredients_flagged": _sql("SELECT *, CASE WHEN n > 5 THEN 1 ELSE 0 END AS pp FROM drugs", _ingredients("drugs", 2)),
        "ingredients_zero_filled": _sql("SELECT * FROM filled", _ingredients("drugs", 2), _ZERO_FILLED),
        "polypharmacy_prevalence": _sql(
            "SELECT age_group, round(avg(CASE WHEN n >= 5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS pp_ratio FROM filled GROUP BY age_group",
            _ingredients("drugs", 90, "overlap"),
            _ZERO_FILLED,
        ),
        "ingredient_distribution": _sql(
            f"""
SELECT {deciles}, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q3,
       min(n) AS lowest, max(n) AS highest, round(avg(n), 6) AS mean, count(*) AS people,
       round(count(*) FILTER (WHERE n >= 10) / CAST(count(*) AS DOUBLE), 6) AS share_from_10,
       round(count(*) FILTER (WHERE n >= 15) / CAST(count(*) AS DOUBLE), 6) AS share_from_15,
       round(count(*) FILTER (WHERE n > 5) / CAST(count(*) AS DOUBLE), 6) AS share_above_5
FROM filled""",
            _ingredients("drugs", 2),
            _ZERO_FILLED,
        ),
        # scoring
        "fi_by_person": _sql("SELECT * FROM by_person", _detail("detail", "vafi", False), _known("known", "vafi"), _BY_PERSON),
        "fi_by_person_weighted": _sql(
            "SELECT * FROM by_person", _detail("detail", "hfrs", True), _known("known", "hfrs"), _BY_PERSON
        ),
        "fi_by_person_rejoined": _sql(
            """
SELECT k.person_id AS patient, k.is_female, k.age_group, k.visit_lookback_date AS search_date, k.index_date, k.yob_imputed,
       b.fi, b.found_ehr
FROM cohort k LEFT JOIN by_person b ON b.person_id = k.person_id""",
            _detail("detail", "efi", False),
            _known("known", "efi"),
            _BY_PERSON,
        ),
        "fi_by_category": _sql(
            "SELECT category, round(sum(score), 6) AS fi FROM detail GROUP BY category", _detail("detail", "hfrs", True)
        ),
        "fi_detail": _sql("SELECT * FROM detail", _detail("detail", "vafi", False)),
        "event_scores_by_person": _sql(
            "SELECT person_id, round(sum(score), 6) AS fi FROM (SELECT DISTINCT person_id, category, score FROM ev) d GROUP BY person_id",
            _events("ev", "hfrs"),
        ),
        "event_scores_by_category": _sql(
            "SELECT category, CAST(count(*) AS DOUBLE) AS fi FROM (SELECT DISTINCT person_id, category FROM ev) d GROUP BY category",
            _events("ev", "hfrs"),
        ),
        "person_fi_classes": _sql(
            "SELECT * REPLACE (round(fi, 6) AS fi) FROM scored", _events("ev", "vafi"), _scores("scored", "ev")
        ),
        "person_fi_classes_all_periods": _sql(
            "SELECT * REPLACE (round(fi, 6) AS fi) FROM scored",
            _events("ev", "vafi", "cohort_all"),
            _scores("scored", "ev", "cohort_all"),
        ),
        # summaries
        "frailty_summary": _frailty(),
        "frailty_summary_to_age_120": _frailty()
        .replace(">= 365 AND", ">= 730 AND")
        .replace(">= 40),", ">= 45),")
        .replace("BETWEEN 80 AND 100 THEN '[80,100]'", "BETWEEN 80 AND 120 THEN '[80,120]'"),
        "frailty_summary_all_periods": _frailty("cohort_all"),
        "frailty_summary_chronic_lookback": _frailty(chronic=3),
        "frailty_summary_chronic_lookback_all_periods": _frailty("cohort_all", chronic=3),
        "frailty_summary_with_polypharmacy": _sql(
            _summary("scored"), *_EFI_DRUGS, _scores("scored", "efi_drugs", denominator=31)
        ),
        "frailty_summary_with_lookbacks": _sql(
            f"SELECT s.*, 1 AS acute_lb, 3 AS chronic_lb FROM ({_summary('scored')}) s",
            _events("ev", "vafi", chronic=3),
            _scores("scored", "ev"),
        ),
        "category_prevalence": _prevalence("cohort"),
        "category_prevalence_all_periods": _prevalence("cohort_all"),
        "category_report": _sql(_category_report("Brand#7", "ev"), _events("ev", "vafi")),
        "stacked_category_reports": _sql(
            f"SELECT r.*, 'vafi' AS fi FROM ({_category_report('Brand#7', 'ev_vafi')}) r"
            f" UNION ALL SELECT r.*, 'efi' FROM ({_category_report('PROMO', 'ev_efi')}) r",
            _events("ev_vafi", "vafi"),
            _events("ev_efi", "efi"),
        ),
        "category_totals": _sql("SELECT * FROM totals", *_EFI_DRUGS, _TOTALS),
        "small_cells_as_zero": _sql(
            """
SELECT * REPLACE (CASE WHEN total < 20 THEN CAST(0 AS DOUBLE) ELSE total END AS total,
                  CASE WHEN total < 20 THEN CAST(0 AS DOUBLE) ELSE prop END AS prop) FROM totals""",
            *_EFI_DRUGS,
            _TOTALS,
        ),
        "small_cells_as_label": _sql(
            """
SELECT * REPLACE (CASE WHEN total < 20 THEN '<20' ELSE CAST(CAST(total AS BIGINT) AS VARCHAR) END AS total,
                  CASE WHEN total < 20 THEN CAST(0 AS DOUBLE) ELSE prop END AS prop) FROM totals""",
            *_EFI_DRUGS,
            _TOTALS,
        ),
        "small_cells_share_kept": _sql(
            "SELECT * REPLACE (CASE WHEN total < 20 THEN '<20' ELSE CAST(CAST(total AS BIGINT) AS VARCHAR) END AS total) FROM totals",
            *_EFI_DRUGS,
            _TOTALS,
        ),
        "stacked_summaries": _sql(
            f"SELECT s.*, 'vafi' AS fi FROM ({_summary('scored_vafi')}) s UNION ALL SELECT s.*, 'efi' FROM ({_summary('scored_efi')}) s",
            *_EFI_DRUGS,
            _events("ev_vafi", "vafi"),
            _scores("scored_vafi", "ev_vafi"),
            _scores("scored_efi", "efi_drugs", denominator=31),
        ),
        "several_index_events": _sql(
            " UNION ALL ".join(
                f"SELECT DISTINCT person_id, age_group, is_female, category, score, '{label}' AS index_name FROM {name}"
                for name, (label, _) in _SEVERAL.items()
            ),
            *_several(),
        ),
        "several_index_scores": _several_scores(),
        "several_index_scores_all_periods": _several_scores("cohort_all"),
        "several_index_prevalence": _sql(
            f"SELECT p.*, 'vafi' AS fi FROM ({_prevalence_of('vafi', 'cohort', 'vafi_1')}) p"
            f" UNION ALL SELECT p.*, 'efi' FROM ({_prevalence_of('efi', 'cohort', 'efi_1')}) p",
            *_several(),
        ),
        # deficit rates
        "deficit_spans": _sql("SELECT * FROM spans", _events("ev", "vafi", acute=3, chronic=3), _SPANS),
        "deficit_rates": _sql(
            "SELECT * REPLACE (round(event_per_year, 6) AS event_per_year) FROM rates",
            _events("ev", "vafi", acute=3, chronic=3),
            _SPANS,
            _RATES,
        ),
        "rate_distribution": _sql(
            """
SELECT category, round(avg(event_per_year), 6) AS avg, round(stddev_samp(event_per_year), 6) AS std,
       round(quantile_cont(event_per_year, 0.5), 6) AS median, round(quantile_cont(event_per_year, 0.05), 6) AS p05,
       round(quantile_cont(event_per_year, 0.25), 6) AS p25, round(quantile_cont(event_per_year, 0.75), 6) AS p75,
       round(quantile_cont(event_per_year, 0.95), 6) AS p95
FROM rates GROUP BY category""",
            _events("ev", "vafi", acute=3, chronic=3),
            _SPANS,
            _RATES,
        ),
        # agreement
        "category_totals_compared": _sql("SELECT * FROM pairs", _events("ev", "vafi"), _PAIRS),
        "category_correlation": _sql(
            "SELECT round(corr(score_a, score_b), 6) AS correlation FROM pairs", _events("ev", "vafi"), _PAIRS
        ),
        "category_correlation_without_one": _sql(
            "SELECT round(corr(score_a, score_b), 6) AS correlation FROM pairs WHERE category <> 'Brand#7'",
            _events("ev", "vafi"),
            _PAIRS,
        ),
        "category_icc": _icc(),
        "category_icc_without_one": _icc("category <> 'Brand#7'"),
        "reconciled_concepts": _sql(
            """
SELECT concept_id, category, CAST(sum(omop_count) AS BIGINT) AS total_omop, CAST(sum(icd_count) AS BIGINT) AS total_icd,
       count(*) AS n, round(sum(omop_count) / CAST(count(*) AS DOUBLE) - sum(icd_count), 6) AS diff
FROM joined GROUP BY concept_id, category""",
            _events("ev", "vafi"),
            _RECONCILED,
        ),
        "reconciled_concept_rows": _sql("SELECT * FROM joined", _events("ev", "vafi"), _RECONCILED),
        "runs_compared": _sql(
            """
SELECT a.age_group, a.is_female, m.name, t.type,
       round(CASE m.name WHEN 'n_prefrail' THEN x.n_prefrail WHEN 'n_frail' THEN x.n_frail WHEN 'n_robust' THEN x.n_robust
                         WHEN 'prefrail' THEN x.prefrail WHEN 'frail' THEN x.frail WHEN 'robust' THEN x.robust END, 6) AS value
FROM new_run a
CROSS JOIN (VALUES ('n_prefrail'), ('n_frail'), ('n_robust'), ('prefrail'), ('frail'), ('robust')) m(name)
CROSS JOIN (VALUES ('new'), ('old')) t(type)
LEFT JOIN (SELECT *, 'new' AS run FROM new_run UNION ALL SELECT *, 'old' FROM old_run) x
  ON x.run = t.type AND x.age_group = a.age_group AND x.is_female = a.is_female""",
            _events("ev3", "vafi", chronic=3),
            _events("ev1", "vafi"),
            _scores("scored3", "ev3"),
            _scores("scored1", "ev1"),
            f"new_run AS ({_summary('scored3')})",
            f"old_run AS ({_summary('scored1')})",
        ),
        # sources and sinks
        "cdm_from_files": _sql("SELECT * FROM concept"),
        "cdm_from_views": _sql("SELECT * FROM person"),
        "stored_cohort": _sql(f"SELECT {_STORED} FROM cohort"),
        "summary_written_and_read": _cohort_summary("cohort"),
    }
