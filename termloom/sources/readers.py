"""Readers and writers of feeds, catalogues, decisions and satellite tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def shared_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; a local one only for local masters without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/termloom-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared folder."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def yes(c: Column) -> Column:
    return F.upper(F.trim(c)) == "Y"


def blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def coalesced(df: DataFrame, *names: str) -> Column:
    """The first of several spellings of a column that the table has."""
    have = [n for n in names if n in df.columns]
    return F.coalesce(*[F.col(f"`{n}`").cast("string") for n in have]) if have else F.lit(None).cast("string")


def read_feed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Exam rows (one JSON array per file, or `lines`) under upper or lower-case keys; the name has five aliases, and rows may be bare strings; nameless rows go."""
    text = spark.read.text(path, wholetext=not lines)
    listed = F.concat(F.lit("["), F.col("value"), F.lit("]")) if lines else F.col("value")
    item = text.select(F.explode(F.from_json(listed, "array<string>")).alias("x")).filter("x is not null")
    value = lambda *keys: F.coalesce(*[F.get_json_object("x", f"$.{k}") for k in keys])
    bare = F.when(~F.trim("x").startswith("{"), F.col("x"))
    rows = item.select(
        value("DATA_SOURCE", "data_source").alias("data_source"), value("MODALITY_CODE", "modality_code").alias("modality_code"), value("EXAM_CODE", "exam_code").alias("exam_code"),
        F.coalesce(value("EXAM_NAME", "exam_name", "name", "description", "title"), bare).alias("exam_name"),
    )
    return rows.filter("exam_name is not null")


CATALOGUE = "snomed_concept_id string, snomed_fsn string, snomed_laterality_concept_id string, snomed_laterality_fsn string, is_diagnostic string, is_interventional string, primary_source_name string"


def read_catalogue(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Catalogue rows, every variant of an id kept; empty text is null, Y and N are booleans."""
    c = spark.read.schema(CATALOGUE).json(path, multiLine=not lines)
    return c.select(
        F.col("snomed_concept_id").try_cast("long").alias("concept_id"), F.col("snomed_fsn").alias("fsn"), blank(F.col("snomed_laterality_concept_id")).try_cast("long").alias("laterality_id"),
        blank(F.col("snomed_laterality_fsn")).alias("laterality_fsn"), yes(F.col("is_diagnostic")).alias("is_diagnostic"), yes(F.col("is_interventional")).alias("is_interventional"), F.col("primary_source_name").alias("primary_name"),
    )


def read_legacy_catalogue(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Older files: headers with stray blanks and a byte-order mark, ids that may not be numbers (0), rows without names skipped."""
    raw = spark.read.csv(path, header=True) if fmt == "csv" else spark.read.json(path, multiLine=True)
    raw = raw.toDF(*[c.replace("﻿", "").strip().lower().replace(" ", "_") for c in raw.columns])
    rows = raw.select(
        F.coalesce(coalesced(raw, "snomed_ct_concept-id", "snomed_ct_id", "snomed_id").try_cast("long"), F.lit(0)).alias("concept_id"), F.trim(coalesced(raw, "snomed_ct_fsn", "fsn")).alias("fsn"),
        F.trim(coalesced(raw, "clean_name", "primary_name")).alias("primary_name"), F.coalesce(yes(coalesced(raw, "diagnostic", "is_diagnostic")), F.lit(False)).alias("is_diagnostic"),
    )
    return rows.filter("fsn <> '' and primary_name <> ''")


def read_abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """key, value from CSV files with two header rows each; blanks go, the first of equal keys stays (files by path)."""
    n = F.monotonically_increasing_id()  # grows along a stretch of a file
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), n.alias("n"))
    first = lines.filter("block = 0").groupBy("file").agg(F.min("n").alias("_first"))  # a row per file
    parts = F.from_csv(F.col("value"), F.lit("key string, meaning string"))
    rows = lines.join(F.broadcast(first), "file").filter("block > 0 or n - _first >= 2").select("file", "block", "n", parts.alias("p"))
    rows = rows.select(F.struct("file", "block", "n").alias("at"), F.trim("p.key").alias("key"), F.trim("p.meaning").alias("value")).filter("key <> '' and value <> ''")
    return rows.groupBy("key").agg(F.min_by("value", "at").alias("value"))


def load_rules(spark: SparkSession, path: str, sections: list[str]) -> DataFrame:
    """kind, key, value, ord of the dictionaries of a JSON configuration, each under a dotted path; ord is their order of expansion (longest key first)."""
    return dictionaries(spark.read.text(path, wholetext=True), sections)


def dictionaries(text: DataFrame, sections: list[str]) -> DataFrame:
    rows = [text.select(F.lit(s).alias("kind"), F.explode(F.from_json(F.get_json_object("value", f"$.{s}"), "map<string,string>")).alias("key", "value")) for s in sections]
    every = reduce(DataFrame.unionByName, rows)
    return every.withColumn("ord", F.row_number().over(Window.partitionBy("kind").orderBy(F.length("key").desc(), "key")) - 1)


@F.udf(StringType())
def yaml_to_json(text: str) -> str:
    """A YAML document as JSON; keys become text."""
    import json

    import yaml

    return json.dumps(yaml.safe_load(text), default=str)


def load_yaml_rules(spark: SparkSession, path: str, sections: list[str]) -> DataFrame:
    """`load_rules` of a YAML configuration. Each file is one short document, read by the `yaml` package where the tasks run."""
    text = spark.read.text(path, wholetext=True).select(yaml_to_json("value").alias("value"))
    return dictionaries(text, sections)


def read_decisions(spark: SparkSession, path: str, kind: str = "approved") -> DataFrame:
    """request_hash and payload (JSON) from every layout of a decision cache: `entries` as a map or a list, or a flat map; values under `mapping_data`, `result` or bare."""
    text = spark.read.text(path, wholetext=True)
    body = F.coalesce(F.get_json_object("value", "$.entries"), F.col("value"))
    as_map = F.from_json(body, "map<string,string>")
    listed = F.from_json(body, "array<string>")
    from_map = text.filter(~body.startswith("[")).select(F.explode(as_map).alias("request_hash", "entry")).filter(~F.col("request_hash").isin("meta", "entries"))
    from_list = text.filter(body.startswith("[")).select(F.explode(listed).alias("entry")).select(F.coalesce(F.get_json_object("entry", "$.hash"), F.get_json_object("entry", "$.request_hash")).alias("request_hash"), "entry")
    rows = from_map.unionByName(from_list)
    value = F.coalesce(F.get_json_object("entry", "$.mapping_data"), F.get_json_object("entry", "$.result"), F.col("entry"))
    if kind == "approved":
        return rows.select("request_hash", value.alias("payload"))
    ids = F.coalesce(F.from_json(F.get_json_object("entry", "$.rejected_snomed_ids"), "array<long>"), F.from_json("entry", "array<long>"), F.array().cast("array<long>"))
    return rows.select("request_hash", F.get_json_object("entry", "$.reason").alias("reason"), ids.alias("rejected_ids"))


def read_cases(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Training cases of many files; unreadable lines and files are passed over, and each row names its file."""
    schema = "input_exam string, expected_output string, _corrupt string"
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("ignoreCorruptFiles", True).json(paths)
    return raw.filter("input_exam is not null").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).drop("_corrupt")


def read_valueset(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """code, display of an expansion; null codes go, the later of equal codes stays."""
    raw = spark.read.schema("expansion struct<contains: array<struct<code: string, display: string>>>").json(path, multiLine=not lines)
    items = raw.select(F.posexplode("expansion.contains").alias("n", "x")).filter("x.code is not null and x.display is not null")
    return items.groupBy(F.col("x.code").alias("code")).agg(F.max_by("x.display", "n").alias("display"))


PATHWAY = "id string, title string, description string, startStep string, status string, steps map<string, struct<id: string, title: string, options: array<struct<text: string, action: struct<type: string, nextStep: string>>>>>, guides array<struct<id: string, title: string>>"


def read_pathways(spark: SparkSession, folder: str) -> DataFrame:
    """Every JSON file of a folder but the manifest, with its name, size and time; those without title or steps go."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select("value", "_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time")
    parsed = files.filter("file_name <> 'manifest.json'").select(F.from_json("value", PATHWAY).alias("p"), "file_name", "file_size", "file_modification_time")
    return parsed.select("p.*", "file_name", "file_size", "file_modification_time").filter("title is not null and steps is not null")


SITE = "map<string, map<string, struct<site_name: string, equipment: map<string, struct<machines: array<struct<id: string, name: string>>, count: int>>, staffing: map<string, struct<total_fte: double, current_vacancies: double>>>>>"


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sites, machines, staffing) of a nested profile file."""
    return profile_tables(spark.read.text(path, wholetext=True), "value")


def profile_tables(docs: DataFrame, column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    regions = docs.select(F.explode(F.from_json(column, SITE)).alias("region", "sites"))
    sites = regions.select("region", F.explode("sites").alias("site", "s"))
    machines = sites.select("region", "site", F.explode("s.equipment").alias("modality", "e")).select("region", "site", "modality", F.coalesce(F.size("e.machines"), F.col("e.count"), F.lit(0)).alias("machines"))
    staffing = sites.select("region", "site", F.explode("s.staffing").alias("role", "f")).select("region", "site", "role", "f.total_fte", "f.current_vacancies")
    return sites.select("region", "site", "s.site_name"), machines, staffing


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario rows; blank and trailing notes rows go."""
    return spark.read.csv(path, header=True).filter("modality is not null and archetype is not null")


def read_triage(docs: DataFrame, column: str) -> DataFrame:
    """section, subheading, idx, rule of a rule set: only array-valued children count, ordered without case."""
    sections = docs.select(F.explode(F.from_json(column, "map<string, map<string, string>>")).alias("section", "children"))
    subs = sections.select("section", F.explode("children").alias("subheading", "body")).filter(F.trim("body").startswith("["))
    rules = subs.select("section", "subheading", F.posexplode(F.from_json("body", "array<string>")).alias("idx", "rule"))
    return rules.orderBy(F.lower("section"), F.lower("subheading"), "idx")


def write_results(df: DataFrame, path: str, run_id: str) -> DataFrame:
    """Result lines as JSON, and one row about the run."""
    df.write.mode("overwrite").json(f"{path}/results")
    stats = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "ok").alias("ok")).withColumn("run_id", F.lit(run_id))
    stats.write.mode("overwrite").parquet(f"{path}/run")
    return df.sparkSession.read.parquet(f"{path}/run")


def write_decisions(df: DataFrame, path: str, version: int = 1, updated: str | None = None) -> DataFrame:
    """A decision store with its version, schema and the time of its last update (now, if none is given) on every row."""
    stamp = F.current_timestamp() if updated is None else F.lit(updated).cast("timestamp")
    df.withColumn("version", F.lit(version)).withColumn("last_updated", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")).withColumn("schema", F.lit(df.schema.simpleString())).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def export_final(approved: DataFrame, summary: DataFrame, rejected: DataFrame, path: str) -> DataFrame:
    """Three tables of a finished review, and a row count of each."""
    for name, df in (("mappings", approved), ("summary", summary), ("rejected", rejected)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    read = approved.sparkSession.read.parquet
    counts = [read(f"{path}/{n}").agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("rows")) for n in ("mappings", "summary", "rejected")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
