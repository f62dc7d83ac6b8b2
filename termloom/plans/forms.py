"""Queries of names, orders, labels and queues as the interfaces show them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import reports as rp
from ..operators import scoring as sc
from ..sources import readers as rd
from . import derive
from .more import dumped, t
from .registry import query
from .scores import rounded

C = F.col


@query("g35_named_consensus", """WITH r AS (SELECT user_id AS row_id, concat('vendor/m', event_id % 5) AS model, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS choice, (event_id % 100) / 100.0::DOUBLE AS confidence FROM events),
    p AS (SELECT row_id, choice, count(*) AS votes, avg(confidence) AS mean, array_to_string(list_sort(list(split_part(model, '/', 2))), ',') AS models FROM r WHERE choice IS NOT NULL GROUP BY 1, 2)
    SELECT row_id, choice, round(mean, 6) AS confidence, CASE WHEN choice <> 'error' OR row_id % 2 = 0 THEN upper(choice) ELSE 'Unknown Procedure' END AS name, CASE WHEN choice <> 'error' OR row_id % 2 = 0 THEN concat(choice, ' (procedure)') END AS fsn, models
    FROM p QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, mean DESC, choice) = 1""")  # fmt: skip
def g35(spark, sf):
    """The vote with names; an error is a candidate of every other row only."""
    e = t(spark, sf, "events")
    choice = F.when(C("event_id") % 9 == 0, None).otherwise(C("event_type"))
    r = e.select("event_id", C("user_id").alias("row_id"), F.concat(F.lit("vendor/m"), F.coalesce((C("event_id") % 5).cast("string"), F.lit(""))).alias("model"), choice.alias("choice"), ((C("event_id") % 100) / 100.0).alias("confidence"))
    cands = e.select(C("user_id").alias("row_id"), C("event_type").alias("choice"), F.upper("event_type").alias("name"), F.concat("event_type", F.lit(" (procedure)")).alias("fsn")).filter("choice <> 'error' or row_id % 2 = 0").distinct()
    return sc.named_consensus(r, cands, "event_id").select("row_id", "choice", rounded("confidence"), "name", "fsn", F.array_join("models", ",").alias("models"))


@query("a5_load_yaml", """WITH k AS (SELECT 'scoring.brands' AS kind, p_brand AS key FROM part UNION SELECT 'scoring.types', p_type FROM part)
    SELECT kind, key, lower(key) AS value, CAST(row_number() OVER (PARTITION BY kind ORDER BY length(key) DESC, key) - 1 AS INTEGER) AS ord FROM k""")  # fmt: skip
def a5(spark, sf):
    """A YAML configuration of every brand and type, read back."""
    p = t(spark, sf, "part")
    lines = lambda name, c: p.select(F.concat(F.lit("    "), F.lit('"'), c, F.lit('": "'), F.lower(c), F.lit('"')).alias("x")).distinct().agg(F.concat(F.lit(f"  {name}:\n"), F.array_join(F.array_sort(F.collect_list("x")), "\n")).alias(name))
    config = lines("brands", "p_brand").crossJoin(lines("types", "p_type")).select(F.concat(F.lit("# weights\nversion: 3\nscoring:\n"), "brands", F.lit("\n"), "types").alias("value"))
    return rd.load_yaml_rules(spark, dumped(config, spark, "text"), ["scoring.brands", "scoring.types"])


@query("a9_stamped_decisions", "SELECT o_orderkey AS request_hash, o_orderstatus AS decision, 3 AS version, '2024-05-01T10:30:00' AS last_updated FROM orders")
def a9(spark, sf):
    d = t(spark, sf, "orders").select(C("o_orderkey").alias("request_hash"), C("o_orderstatus").alias("decision"))
    return rd.write_decisions(d, rd.shared_path(spark), 3, "2024-05-01 10:30:00").select("request_hash", "decision", "version", "last_updated")


_FEEDBACK = """SELECT event_id AS id, ts AS created_at, CASE event_id % 3 WHEN 0 THEN 'pending' ELSE 'processed' END AS status, event_type AS category,
    concat('{"clean_name": "', event_type, '", "snomed_id": "', user_id, '", "confidence": 0.5}') AS original_mapping, CASE WHEN event_id % 5 <> 0 THEN concat('{"clean_name": "new ', event_type, '"}') ELSE 'broken' END AS corrected_mapping FROM events"""


@query("f20_pending_feedback", f"""WITH f AS ({_FEEDBACK} WHERE event_id % 3 = 0) SELECT 'mapping' AS queue, id, CAST(row_number() OVER (ORDER BY created_at DESC, id) AS INTEGER) AS place, category AS original, CASE WHEN id % 5 <> 0 THEN concat('new ', category) END AS corrected FROM f WHERE id % 2 = 0
    UNION ALL SELECT 'general', id, CAST(row_number() OVER (ORDER BY created_at DESC, id) AS INTEGER), category, NULL FROM f WHERE id % 2 = 1""")  # fmt: skip
def f20(spark, sf):
    """The pending rows of both queues, with their mappings parsed and numbered from the newest."""
    from pyspark.sql import Window

    f = derive.run(spark, sf, _FEEDBACK, "events")
    mappings, general = rp.pending_feedback(f.filter("id % 2 = 0"), f.filter("id % 2 = 1").select("id", "created_at", "status", "category"))
    place = F.row_number().over(Window.partitionBy("queue").orderBy(F.desc("created_at"), "id"))
    both = mappings.select(F.lit("mapping").alias("queue"), "id", "created_at", C("original_mapping.clean_name").alias("original"), C("corrected_mapping.clean_name").alias("corrected"))
    both = both.unionByName(general.select(F.lit("general").alias("queue"), "id", "created_at", C("category").alias("original"), F.lit(None).cast("string").alias("corrected")))
    return both.select("queue", "id", place.alias("place"), "original", "corrected")


_CONS = "SELECT p_name AS clean_name, count(*) AS n, round(avg(p_size / 50.0), 6) AS mean FROM part GROUP BY 1"
_SORTS = {"count": "n DESC", "name": "clean_name", "confidence": "mean DESC"}


@query("h19_consolidated_orders", f"WITH g AS ({_CONS}) " + " UNION ALL ".join(f"SELECT '{n}' AS by, clean_name, CAST(row_number() OVER (ORDER BY {o}, clean_name) AS INTEGER) AS position FROM g QUALIFY position <= 50" for n, o in _SORTS.items()))
def h19(spark, sf):
    """The first fifty names in each order of the consolidated view."""
    p = t(spark, sf, "part").select(C("p_name").alias("clean_name"), (C("p_size") / 50.0).alias("confidence"), C("p_brand").alias("source"), F.lit(False).alias("second"))
    g = rp.consolidate(p)
    return reduce(DataFrame.unionByName, [rp.ranked(g, 50, *rp.order_by(o, "clean_name")).select(F.lit(n).alias("by"), "clean_name", "position") for n, o in rp.CONSOLIDATED_ORDERS.items()])


_DOCS = """SELECT s_suppkey AS k, concat('g', s_suppkey) AS id, s_name AS title, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('about ', s_name) END AS description, CASE WHEN s_suppkey % 2 = 0 THEN 'published' END AS status,
    s_suppkey % 5 AS n, s_suppkey % 3 AS g, concat('2024-01-', lpad(CAST(1 + s_suppkey % 28 AS STRING), 2, '0')) AS modified FROM supplier"""


@query("h42_manifest_files", f"""WITH d AS ({derive.duck(_DOCS)}) SELECT ord AS by, id, concat(id, '.json') AS filename, title, CAST(n AS INTEGER) AS step_count, CAST(g AS INTEGER) AS guide_count, coalesce(status, 'draft') AS status, modified,
      CASE WHEN coalesce(description, '') <> '' THEN description ELSE concat('A clinical decision support pathway with ', n, ' decision step', CASE WHEN n = 1 THEN '' ELSE 's' END, CASE WHEN g > 0 THEN concat(' and ', g, ' protocol guide', CASE WHEN g = 1 THEN '' ELSE 's' END) ELSE '' END, '.') END AS description,
      CAST(strlen(concat(id, title)) AS INTEGER) AS size, CAST(CASE WHEN ord = 'title' THEN row_number() OVER (PARTITION BY ord ORDER BY lower(title), title, id) ELSE row_number() OVER (PARTITION BY ord ORDER BY modified DESC, id) END AS INTEGER) AS place FROM d, (VALUES ('title'), ('modified')) AS o(ord)""")  # fmt: skip
def h42(spark, sf):
    """The manifest of all files in both orders."""
    from pyspark.sql import Window

    d = derive.run(spark, sf, _DOCS, "supplier")
    keys = lambda c, word: F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < c), lambda i: F.concat(F.lit(word), i.cast("string")))
    files = d.select("id", "title", "description", "status", "modified", F.concat("id", "title").alias("raw"), F.map_from_arrays(keys(C("n"), "s"), keys(C("n"), "t")).alias("steps"), keys(C("g"), "g").alias("guides"))
    place = lambda by: F.row_number().over(Window.orderBy(*gr.MANIFEST_ORDERS[by]())).alias("place")
    return reduce(DataFrame.unionByName, [gr.manifest_files(files, by).select(F.lit(by).alias("by"), "*", place(by)) for by in gr.MANIFEST_ORDERS])


_STAFF = "SELECT c_nationkey AS site, CASE c_custkey % 5 WHEN 0 THEN 'radiologist' WHEN 1 THEN 'mit' WHEN 2 THEN 'radiology_healthcare_assistant' WHEN 3 THEN 'clerk' ELSE 'nurse' END AS role, sum(c_custkey % 4) AS fte, sum(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) AS vacant FROM customer GROUP BY 1, 2"


@query("h48_key_roles", f"""WITH s AS ({_STAFF}), r AS (SELECT site, CASE role WHEN 'radiologist' THEN 'Radiologist' WHEN 'mit' THEN 'MIT' ELSE 'RA/HCA' END AS role, round(100 * (fte - vacant) / fte::DOUBLE, 4) AS rate FROM s WHERE fte > 0 AND role NOT IN ('clerk', 'nurse'))
    SELECT site, role, rate, CASE WHEN rate >= 80 THEN 'good' WHEN rate >= 60 THEN 'fair' ELSE 'poor' END AS band FROM r""")  # fmt: skip
def h48(spark, sf):
    """Fill rates of the three key roles of each site."""
    return rp.key_fill_rates(derive.run(spark, sf, _STAFF, "customer")).select("site", "role", "rate", "band")


_MACHINES = "SELECT c_nationkey AS site, CASE c_custkey % 4 WHEN 0 THEN 'ultrasound' WHEN 1 THEN 'mammography' WHEN 2 THEN 'ct' ELSE 'mri' END AS modality, sum(CASE WHEN c_custkey % 4 = 3 THEN 0 ELSE 1 END) AS machines FROM customer GROUP BY 1, 2"


@query("h47_display_names", f"SELECT site, CASE modality WHEN 'ultrasound' THEN 'Ultrasound' WHEN 'mammography' THEN 'Mammography' ELSE upper(modality) END AS modality, machines FROM ({_MACHINES}) WHERE machines > 0")
def h47(spark, sf):
    """Machines of each site, by the names shown; modalities without any are left out."""
    return rp.equipment_counts(derive.run(spark, sf, _MACHINES, "customer"))
