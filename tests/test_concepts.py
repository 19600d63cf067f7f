import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from frailscope.operators import concepts as c


@pytest.fixture
def table(spark):
    return spark.createDataFrame(
        [("A", 1, "vafi", 1.0), ("A", 1, "vafi", 1.0), ("B", 2, "vafi", 1.0), ("A", 1, "hfrs", 0.4), ("A", 1, "hfrs", 1.2)],
        "category string, concept_id long, fi string, score double",
    )


def test_concepts_of_an_index(table):
    assert rows(c.get_concepts(table, "VAFI")) == [("A", 1), ("B", 2)]
    assert rows(c.get_concepts(table, "hfrs")) == [("A", 1, 0.4), ("A", 1, 1.2)]
    with pytest.raises(ValueError, match="no rows"):
        c.get_concepts(table, "efi")


def test_index_tables_are_unified(spark, table):
    other = spark.createDataFrame([("X", "5"), ("X", "5")], "cat string, id string")
    unified = c.unify_concept_sets(
        [c.IndexSource(c.concept_set(table, "hfrs"), "hfrs", score="score"), c.IndexSource(other, "efi", "cat", "id")]
    )
    assert rows(unified) == [("A", 1, "hfrs", 0.4), ("A", 1, "hfrs", 1.2), ("X", 5, "efi", 1.0)]
    with pytest.raises(ValueError):
        c.unify_concept_sets([])


def test_lookbacks_and_flag(spark, table, both_joins):
    lookbacks = spark.createDataFrame([("vafi", "A", 3), ("hfrs", "A", 1)], "fi string, category string, lookback int")
    flagged = c.attach_lookback(table, lookbacks)
    assert rows(flagged.select("fi", "category", "lookback", "chronic").distinct()) == [
        ("hfrs", "A", 1, 0),
        ("vafi", "A", 3, 1),
        ("vafi", "B", None, 0),
    ]


def test_standard_concepts(spark, both_joins):
    concept = spark.createDataFrame(
        [(1, "one", "S"), (2, "two", None), (3, "three", "S")], "concept_id long, concept_name string, standard_concept string"
    )
    members = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "concept_id long, chronic int")
    assert rows(c.standard_concepts(concept, members)) == [(1, "one", 0), (1, "one", 1)]
    assert rows(c.standard_concepts(concept, members, "in")) == [(1, "one")]
    with pytest.raises(ValueError):
        c.standard_concepts(concept, members, "list")


CODES = ["E07.3", "E0", "E10.3", "L40.1", "L40.11", "a%b", "axb", "a_b", "ab", "", "xE07"]
PATTERNS = ["E0%", "E_7.3", "L40.1", "%", "%7%", "_", "a\\%b", "a\\_b", "a_b", "%.3", "", "L4%1"]


def test_like_join_equals_brute_force(spark, both_joins):
    codes = spark.createDataFrame([(x,) for x in CODES], "code string")
    patterns = spark.createDataFrame([(x,) for x in PATTERNS], "pattern string")
    brute = codes.join(patterns, F.expr("code LIKE pattern"))
    assert rows(c.match_like(codes, patterns, "code", "pattern")) == rows(brute)


def test_like_join_with_any_pattern_equals_brute_force(spark, both_joins):
    """Random patterns over few letters, wildcards and escapes; codes of the same letters, repeated ones among them."""
    rng = random.Random(5)
    codes = ["".join(rng.choice("ab%_.é") for _ in range(rng.randrange(8))) for _ in range(60)] + ["ab", "ab", None]
    parts = ["a", "b", "é", ".", "%", "_", "\\%", "\\_", "ab", "%%"]
    patterns = {"".join(rng.choice(parts) for _ in range(rng.randrange(6))) for _ in range(150)} | {"%ab%", "%%", "_%", None}
    codes = spark.createDataFrame([(k, x) for k, x in enumerate(codes)], "n int, code string")
    patterns = spark.createDataFrame([(x,) for x in patterns], "pattern string")
    brute = codes.join(patterns, F.expr("code LIKE pattern"))
    assert rows(c.match_like(codes, patterns, "code", "pattern")) == rows(brute)
    assert c.match_like(codes, patterns.limit(0), "code", "pattern").count() == 0


def test_only_wildcards_meet_every_code(spark):
    keys = spark.createDataFrame([(p,) for p in ("%07.3", "_a%", "%x_yz%", "\\%ab", "%", "_%", "E0%")], "p string")
    got = {r["p"]: tuple(r["k"]) for r in keys.select("p", c._pattern_key(F.col("p")).alias("k")).collect()}
    assert got == {
        "%07.3": (3, "07."), "_a%": (1, "a"), "%x_yz%": (2, "yz"), "\\%ab": (2, "ab"), "%": (0, ""), "_%": (0, ""), "E0%": (0, "E0"),
    }


def test_map_codes_follows_maps_to_only(spark):
    concept = spark.createDataFrame(
        [(1, "dm", "E10", "ICD10CM"), (2, "dm2", "E11", "ICD10"), (3, "cpt", "E10", "CPT4"), (10, "sn", "100", "SNOMED"), (11, "rx", "7", "RxNorm")],
        "concept_id long, concept_name string, concept_code string, vocabulary_id string",
    )
    links = spark.createDataFrame(
        [(1, 10, "Maps to"), (1, 10, "Maps to"), (2, 10, "Is a"), (2, 11, "Maps to"), (3, 10, "Maps to")],
        "concept_id_1 long, concept_id_2 long, relationship_id string",
    )
    patterns = spark.createDataFrame([("DM", "E1%"), ("DM", "E10")], "category string, code_pattern string")
    assert rows(c.map_codes_like(patterns, concept, links)) == [("DM", "E10", 10)]
    named = c.map_codes_like(patterns, concept, links, ["CPT4"], ["SNOMED"], keep_names=True)
    assert rows(named, "orig_concept_id", "code_pattern", "source_concept_name", "target_concept_name") == [
        (3, "E1%", "cpt", "sn"),
        (3, "E10", "cpt", "sn"),
    ]


def test_codes_are_cleaned(spark):
    raw = spark.createDataFrame(
        [("I10.", "ICD10"), ("I10", "ICD10"), ("I10..", "ICD10"), ("401.", "ICD9"), (None, "ICD10")], "code string, kind string"
    )
    assert rows(c.clean_codes(raw, "code", "kind", keep_types=["ICD10"])) == [(None, "ICD10"), ("I10", "ICD10"), ("I10.", "ICD10")]
    assert rows(c.clean_codes(raw, "code", "kind", drop_types=["ICD10"])) == [("401", "ICD9")]


def test_numbers_in_text(spark):
    texts = spark.createDataFrame([("SCT 1,234.5 x",), ("-7",), ("none",), (None,)], "t string")
    got = {r[0]: r[1] for r in texts.select("t", c.parse_number(F.col("t"))).collect()}
    assert got == {"SCT 1,234.5 x": 1234.5, "-7": -7.0, "none": None, None: None}


def test_descendants(spark, both_joins):
    members = spark.createDataFrame(
        [("A", 1, "x", 1.0), ("B", 2, "x", 2.0)], "category string, concept_id long, fi string, score double"
    )
    links = spark.createDataFrame(
        [(1, 1), (1, 5), (2, 5), (2, 6), (3, 7), (1, 5)], "ancestor_concept_id long, descendant_concept_id long"
    )
    assert rows(c.expand_descendants(members, links, "y")) == [
        ("A", 1, "y", 1.0), ("A", 5, "y", 1.0), ("B", 5, "y", 2.0), ("B", 6, "y", 2.0)
    ]


def test_pruning(spark, both_joins):
    mapped = spark.createDataFrame(
        [(1, "DM", "type 1 diabetes"), (2, "DM", "retinopathy"), (2, "Eye", "retinopathy"), (3, "DM", None), (4, "Eye", "x"), (5, None, "y")],
        "concept_id long, deficit string, target_concept_name string",
    )
    reviewed = spark.createDataFrame([(2, "Eye")], "concept_id long, deficit string")
    blocked = spark.createDataFrame([(4,)], "concept_id long")
    kept = [(1, "DM"), (3, "DM"), (5, None)]
    for block in (blocked, [4]):
        out = c.prune_mappings(mapped, {"DM": "diabetes|Diabetes"}, reviewed, block)
        assert rows(out, "concept_id", "deficit") == kept
    assert rows(c.finalise_concept_set(mapped.filter("deficit = 'Eye'"), "vafi")) == [("Eye", 2, "vafi", 1.0), ("Eye", 4, "vafi", 1.0)]


def test_multiplicity_counts_null_sources_too(spark, both_joins):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "z"), (None, "z")], "orig_concept_id long, t string")
    assert rows(c.mapping_multiplicity(df)) == [(None, "z", 2), (None, "z", 2), (1, "a", 2), (1, "b", 2), (2, "a", 1)]
