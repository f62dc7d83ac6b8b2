"""Exam feeds, catalogues and candidates derived from the driver's tables.

The same portable SQL text builds them in Spark and in the oracle, so the work
of every query grows with `part`, `orders` and the other tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MODALITY = ("CT", "MRI", "XR", "US", "NM", "PET/CT", "Mammogram MG", "Fluoroscopy", "MR MRI", "DEXA", "Biopsy", "Venogram")
CODE = ("CT", "MR", "XR", "US", "NM", "PET", "MG", "FL", "Other", "DEXA", "Other", "IR")
ANATOMY = ("Chest", "Abdomen Pelvis", "Head", "Knee", "Shoulder", "Lumbar Spine", "Liver", "Kidney", "Breast", "Prostate", "Lung", "Hip", "Carotid Artery", "Pelvis - Female")
SIDE = ("", "left", "right", "bilateral", "left and right", "", "")
CONTRAST = ("", "with contrast", "without contrast", "with contrast and without contrast", "", "C+")
EXTRA = ("", "(mobile)", "- NO REPORT", "standard", "3rd trimester", "paediatric", "guided", "angiography", "HRCT 3 phase", "screening & follow-up", "for conference", "[stat]", "obstetric", "with IV line")


def pick(values: tuple[str, ...], index: str) -> str:
    """A CASE that picks by a non-negative integer expression."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE CAST({index} AS BIGINT) % {len(values)} {cases} END"


def named(key: str, shift: int = 0) -> str:
    k = f"({key} + {shift})"
    parts = (pick(MODALITY, k), pick(ANATOMY, f"floor({k} / 5)"), pick(SIDE, f"floor({k} / 3)"), pick(CONTRAST, f"floor({k} / 7)"), pick(EXTRA, f"floor({k} / 11)"))
    return "concat(" + ", ' ', ".join(parts) + ")"


FEED = f"""SELECT p_partkey AS row_id, p_brand AS data_source, {pick(CODE, 'p_partkey')} AS modality_code,
    concat('E', CAST(p_size AS STRING)) AS exam_code, {named('p_partkey')} AS exam_name FROM part"""
CATALOGUE = f"""SELECT 1000000 + floor(p_partkey / 2) AS concept_id, p_partkey AS entry_id,
    trim({named('p_partkey * 3', 4)}) AS primary_name, concat(trim({named('p_partkey * 3', 4)}), ' (procedure)') AS fsn FROM part"""


def duck(sql: str) -> str:
    """The same text for the oracle."""
    return sql.replace("AS STRING", "AS VARCHAR")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    views(spark, sf_dir, *tables)
    return spark.sql(sql)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt by its key. A file that compresses well is read by a task or two, which would then do all that follows on its rows."""
    return df.repartition(key)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(run(spark, sf_dir, FEED, "part"), "row_id")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(run(spark, sf_dir, CATALOGUE, "part"), "entry_id")

ENTRIES = f"""SELECT 1000000 + floor(s_suppkey / 2) AS concept_id, s_suppkey AS entry_id, trim({named('s_suppkey * 7', 2)}) AS primary_name,
    concat(trim({named('s_suppkey * 7', 2)}), ' (procedure)') AS fsn FROM supplier"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small catalogue: it grows with `supplier`, far slower than the feed."""
    return dealt(run(spark, sf_dir, ENTRIES, "supplier"), "entry_id")


_B = "floor(p_partkey / 3)"
#: Three rows of each concept that differ in their side alone.
SIDED = f"""SELECT 5000 + CAST({_B} AS BIGINT) AS concept_id, p_partkey AS entry_id,
    concat({pick(MODALITY, _B)}, ' ', {pick(ANATOMY, _B)}, ' ', {pick(("left", "", "bilateral"), 'p_partkey')}) AS primary_name FROM part"""


def sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(run(spark, sf_dir, SIDED, "part"), "entry_id")
