"""OMOP-shaped views over the TPC-H-like test tables (FIXTURES.md, section 3)."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frailscope.functions.cuts import cut_table
from frailscope.operators.events import DOMAINS
from frailscope.sources.cdm import OmopCdm
from frailscope.sources.scratch import store

# Which order lines play which clinical domain.
_DOMAIN_LINES = {"condition": (1, 2, 3), "observation": (4, 5), "procedure": (6,), "device": (7,)}

# The columns of the test tables that the views use.
_RAW = {
    "customer": "c_custkey long",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
}


class FixtureCdm(OmopCdm):
    """Serves OMOP tables derived from ``customer``, ``orders``, ``lineitem`` and ``part``.

    The source codes of clinical rows cost a join to ``part``, so they come only on request. With ``store_lines`` order
    lines meet their orders once, and all clinical domains and drug eras read the stored rows.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, source_values: bool = False, store_lines: bool = False) -> None:
        super().__init__(spark)
        self._store_lines = store_lines
        self._dir = sf_dir.rstrip("/")
        self._source_values = source_values
        self._built: dict[str, DataFrame] = {}
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.schema(_RAW[name]).parquet(f"{self._dir}/{name}.parquet")
        return self._raw[name]

    def table(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = getattr(self, f"_{name}")()
        return self._built[name]

    def _person(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("person_id"),
            (1910 + key % 60).cast("int").alias("year_of_birth"),
            F.when(key % 2 == 0, 8507).otherwise(8532).alias("gender_concept_id"),
        )

    def _visit_occurrence(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("visit_occurrence_id"),
            F.col("o_custkey").alias("person_id"),
            F.col("o_orderdate").cast("date").alias("visit_start_date"),
        )

    def _observation_period(self) -> DataFrame:
        spans = (
            self.table("visit_occurrence")
            .groupBy("person_id")
            .agg(F.min("visit_start_date").alias("first"), F.max("visit_start_date").alias("last"))
        )
        starts = F.when(
            F.col("person_id") % 10 == 0, F.array(F.col("first"), F.date_add("first", 180))
        ).otherwise(F.array(F.col("first")))
        return spans.select(
            "person_id",
            F.explode(starts).alias("observation_period_start_date"),
            F.col("last").alias("observation_period_end_date"),
        )

    def _concept(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey AS concept_id",
            "p_name AS concept_name",
            "concat(left(p_type, 1), lpad(string(p_size), 2, '0'), '.', string(p_partkey % 10)) AS concept_code",
            "CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 'ICD10CM' WHEN p_type = 'PROMO' THEN 'CPT4' ELSE 'SNOMED' END"
            " AS vocabulary_id",
            "CASE WHEN p_partkey % 20 <> 0 THEN 'S' END AS standard_concept",
        )

    def _concept_relationship(self) -> DataFrame:
        key = F.col("concept_id")
        icd = F.col("vocabulary_id") == "ICD10CM"
        links = F.array_compact(
            F.array(
                F.when(icd, F.struct((key + 1).alias("to"), F.lit("Maps to").alias("kind"))),
                F.when(icd & (key % 3 == 0), F.struct((key + 2).alias("to"), F.lit("Maps to").alias("kind"))),
                F.struct((key + 3).alias("to"), F.lit("Is a").alias("kind")),
            )
        )
        return (
            self.table("concept")
            .select(key.alias("concept_id_1"), F.explode(links).alias("link"))
            .select("concept_id_1", F.col("link.to").alias("concept_id_2"), F.col("link.kind").alias("relationship_id"))
        )

    def _concept_ancestor(self) -> DataFrame:
        key = F.col("concept_id")
        return self.table("concept").select(
            (key - key % 10).alias("ancestor_concept_id"), key.alias("descendant_concept_id")
        )

    def _owned_lines(self) -> DataFrame:
        """Order lines with the person of their order."""
        people = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("person_id"))
        lines = self.raw("lineitem").withColumn("start_date", F.col("l_shipdate").cast("date")).join(people, "l_orderkey")
        found = lines.select("person_id", "l_partkey", "l_linenumber", "l_quantity", "start_date")
        return store(found, "lines") if self._store_lines else found

    def _clinical(self) -> DataFrame:
        """Order lines as clinical events; their line number tells the domain."""
        lines = self.table("owned_lines")
        rows = lines.select("person_id", F.col("l_partkey").alias("concept_id"), "start_date", "l_linenumber")
        if self._source_values:
            codes = self.table("concept").select("concept_id", F.col("concept_code").alias("source_value"))
            rows = rows.join(codes, "concept_id")
        return rows

    def _domain(self, domain: str) -> DataFrame:
        columns = DOMAINS[domain]
        names = {"person_id": "person_id", columns.concept: "concept_id", columns.date: "start_date"}
        if self._source_values:
            names[columns.source] = "source_value"
        return cut_table(self.table("clinical"), F.col("l_linenumber").isin(*_DOMAIN_LINES[domain]), names)

    def _condition_occurrence(self) -> DataFrame:
        return self._domain("condition")

    def _observation(self) -> DataFrame:
        return self._domain("observation")

    def _procedure_occurrence(self) -> DataFrame:
        return self._domain("procedure")

    def _device_exposure(self) -> DataFrame:
        return self._domain("device")

    def _drug_era(self) -> DataFrame:
        return self.table("owned_lines").select(
            "person_id",
            (F.col("l_partkey") % 200).alias("drug_concept_id"),
            F.col("start_date").alias("drug_era_start_date"),
            F.date_add("start_date", 3 * F.col("l_quantity").cast("int")).alias("drug_era_end_date"),
        )

    def _drug_exclusions(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .select((F.col("l_partkey") % 200).alias("drug_concept_id"))
            .filter(F.col("drug_concept_id") % 25 == 0)
            .distinct()
        )

    def _cb_search_person(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("person_id"), (20 + key % 110).cast("int").alias("age_at_consent")
        )

    def _fi_indices(self) -> DataFrame:
        rows = F.expr(
            """
            array(
              CASE WHEN p_size <= 40 THEN struct('vafi' AS fi, p_brand AS category, 1.0D AS score) END,
              CASE WHEN p_size > 20 THEN struct('hfrs' AS fi, p_brand AS category, p_size / 10.0D AS score) END,
              struct('efi' AS fi, p_brand AS category, 1.0D AS score),
              CASE WHEN p_partkey % 7 = 0 THEN struct('efi' AS fi, p_type AS category, 1.0D AS score) END)
            """
        )
        return (
            self.raw("part")
            .select(F.col("p_partkey").alias("concept_id"), F.explode(rows).alias("r"))
            .filter(F.col("r").isNotNull())  # cheaper than compacting each array, which is not compiled
            .select("r.category", "concept_id", "r.fi", "r.score")
        )

    def _lookbacks(self) -> DataFrame:
        brand = F.col("category").startswith("Brand#")
        number = F.substring("category", 7, 10).try_cast("int")
        long = brand & (F.col("fi") != "hfrs") & (number % 2 == 1)
        return (
            self.table("fi_indices")
            .select("fi", "category")
            .distinct()
            .withColumn("lookback", F.when(long, 3).otherwise(1))
        )

    def _code_patterns(self) -> DataFrame:
        rows = [("Heart", "E0%"), ("Heart", "L1%"), ("Kidney", "E2_.3"), ("Single", "L40.1")]
        return self.spark.createDataFrame(rows, "category string, code_pattern string")
