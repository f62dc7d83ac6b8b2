"""Queries of joins, decisions and the review loop (F1-F15, H1-H19), over orders, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as dc
from . import derive
from .registry import query

C = F.col
#: A mapping per order: portable SQL for both engines.
STATE = """SELECT o_orderkey AS mapping_id, o_custkey AS key, o_orderpriority AS clean_name, o_orderstatus AS source, (o_orderkey % 100) / 100.0 AS confidence, o_orderkey % 5 = 0 AS ambiguous,
    o_orderkey % 7 <> 0 AS found, o_orderkey % 11 <> 0 AS components, o_orderkey % 13 = 0 AS second, (o_orderkey % 90) / 100.0 AS s1, (o_orderkey % 97) / 100.0 AS s2,
    CASE WHEN o_orderkey % 17 = 0 THEN 'approved' WHEN o_orderkey % 19 = 0 THEN 'rejected' ELSE 'pending' END AS status FROM orders"""
FLAGGED = f"""SELECT *, list_filter([CASE WHEN confidence < 0.85 THEN 'low_confidence' END, CASE WHEN ambiguous THEN 'ambiguous' END, CASE WHEN NOT found THEN 'snomed_not_found' END, CASE WHEN NOT components THEN 'missing_components' END,
    CASE WHEN second THEN 'secondary_pipeline_used' END, CASE WHEN s1 > 0.8 AND s2 > 0.8 THEN 'multiple_high_confidence' END, CASE WHEN count(*) OVER (PARTITION BY key) = 1 THEN 'singleton_mapping' END], lambda x: x IS NOT NULL) AS flags FROM ({STATE})"""
PRIORITY = """CASE WHEN status <> 'pending' THEN 'completed' WHEN len(flags) >= 3 OR list_contains(flags, 'snomed_not_found') OR (list_contains(flags, 'low_confidence') AND list_contains(flags, 'ambiguous')) THEN 'high'
    WHEN list_has_any(flags, ['low_confidence', 'ambiguous', 'multiple_high_confidence']) THEN 'medium' WHEN len(flags) > 0 THEN 'low' ELSE 'ready' END"""


def state(spark, sf):
    return derive.run(spark, sf, STATE, "orders")


def flagged(spark, sf, ruleset="offline"):
    s = dc.singletons(state(spark, sf), "key")
    return s.withColumn("flags", dc.attention_flags(ruleset, C("confidence"), C("ambiguous"), C("found"), C("components"), C("second"), F.array("s1", "s2"), C("is_singleton")))


def tables(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars")
    lb = spark.read.parquet(f"{sf}/labels.parquet")
    return d, lb.filter("quality = 1"), lb.filter("toxic = 1")


_DL = "documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) a USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) r USING (doc_id)"
_A, _R = "doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", "doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"


@query("f1_preflight", f"SELECT doc_id, CASE WHEN {_R} THEN 'rejected' WHEN {_A} THEN 'approved' ELSE 'process' END AS cache_type, CAST({_R} OR {_A} AS INTEGER) AS cached_skip FROM documents")
def f1(spark, sf):
    d, a, r = tables(spark, sf)
    return dc.preflight(d, a, r, "doc_id").select("doc_id", "cache_type", C("cached_skip").cast("int").alias("cached_skip"))


@query("f2_early_approval", f"SELECT doc_id, CAST({_A} AS INTEGER) AS by_human, CASE WHEN {_A} THEN 1.0 END AS confidence FROM documents")
def f2(spark, sf):
    d, a, _ = tables(spark, sf)
    done, rest = dc.early_approval(d, a, "doc_id")
    return done.select("doc_id", F.lit(1).alias("by_human"), "confidence").unionByName(rest.select("doc_id", F.lit(0).alias("by_human"), F.lit(None).cast("double").alias("confidence")))


@query("f3_drop_rejected", """WITH c AS (SELECT l_orderkey AS row_id, l_partkey AS concept_id FROM lineitem), r AS (SELECT o_orderkey AS row_id, p_partkey AS concept_id FROM orders, part WHERE p_partkey % 3 = 0 AND o_orderkey % 2 = 0),
    k AS (SELECT DISTINCT * FROM c WHERE NOT (row_id % 2 = 0 AND concept_id % 3 = 0)) SELECT row_id, concept_id, NULL::VARCHAR AS error FROM k
    UNION ALL SELECT DISTINCT row_id, NULL, 'all candidates were rejected' FROM c WHERE row_id NOT IN (SELECT row_id FROM k)""")  # fmt: skip
def f3(spark, sf):
    c = spark.read.parquet(f"{sf}/lineitem.parquet").select(C("l_orderkey").alias("row_id"), C("l_partkey").alias("concept_id")).distinct()
    rejected = c.filter("row_id % 2 = 0 and concept_id % 3 = 0")
    left, lost = dc.drop_rejected(c, rejected, ["row_id", "concept_id"])
    return left.withColumn("error", F.lit(None).cast("string")).unionByName(lost.withColumn("concept_id", F.lit(None).cast("long")))


@query("f6_override", f"""SELECT doc_id, CASE WHEN {_A} THEN 'human' ELSE lang END AS result, CASE WHEN {_A} THEN 1.0 ELSE (n_chars % 100) / 100.0::DOUBLE END AS confidence, CASE WHEN {_A} THEN (n_chars % 100) / 100.0::DOUBLE END AS original_confidence,
    CASE WHEN {_A} THEN 'approved' WHEN {_R} THEN 'rejected' ELSE 'pending' END AS status FROM documents""")  # fmt: skip
def f6(spark, sf):
    d, a, r = tables(spark, sf)
    d = d.select("doc_id", C("lang").alias("result"), ((C("n_chars") % 100) / 100.0).alias("confidence"))
    return dc.override(d, a.select("doc_id").distinct().withColumn("result", F.lit("human")), r, "doc_id")


@query("f14_f15_second_opinion", f"""WITH s AS ({STATE}), i AS (SELECT mapping_id, least(confidence + 0.2, 1.0) AS c2 FROM s WHERE ambiguous OR confidence < 0.8 OR second)
    SELECT mapping_id, CASE WHEN c2 IS NULL THEN clean_name ELSE 'improved' END AS result, round(coalesce(c2, confidence), 6) AS confidence, round(confidence, 6) AS was, CAST(c2 IS NOT NULL AS INTEGER) AS second_opinion FROM s LEFT JOIN i USING (mapping_id)""")  # fmt: skip
def f14(spark, sf):
    s = state(spark, sf).select("mapping_id", C("clean_name").alias("result"), C("confidence").cast("double").alias("confidence"), "ambiguous", "second")
    better = s.filter(dc.needs_second_opinion(C("ambiguous"), C("confidence"), C("second"))).select("mapping_id", F.lit("improved").alias("result"), F.least(C("confidence") + 0.2, F.lit(1.0)).alias("confidence"))
    m = dc.merge_improved(s, better, "mapping_id")
    return m.select("mapping_id", "result", F.round("confidence", 6).alias("confidence"), F.round("was", 6).alias("was"), C("second_opinion").cast("int").alias("second_opinion"))


@query("h1_singletons", f"SELECT mapping_id, CAST(count(*) OVER (PARTITION BY key) = 1 AS INTEGER) AS is_singleton FROM ({STATE})")
def h1(spark, sf):
    return dc.singletons(state(spark, sf), "key").select("mapping_id", C("is_singleton").cast("int").alias("is_singleton"))


@query("h2_flags_offline", f"SELECT mapping_id, array_to_string(flags, ',') AS flags FROM ({FLAGGED})")
def h2(spark, sf):
    return flagged(spark, sf).select("mapping_id", F.array_join("flags", ",").alias("flags"))


@query("h2_flags_online", f"""SELECT mapping_id, concat_ws(',', CASE WHEN confidence < 0.85 THEN 'low_confidence' END, CASE WHEN ambiguous THEN 'ambiguous' END, CASE WHEN round(greatest(s1, s2) - least(s1, s2), 6) > 0.15 THEN 'high_confidence_gap' END, CASE WHEN second THEN 'secondary_pipeline' END) AS flags FROM ({STATE})""")
def h2o(spark, sf):
    return flagged(spark, sf, "online").select("mapping_id", F.array_join("flags", ",").alias("flags"))


@query("h3_init_review", """WITH l AS (SELECT o_custkey AS key, max(o_orderkey) AS seq FROM orders GROUP BY 1) SELECT key, seq, o_orderpriority AS clean_name, CASE WHEN key % 4 = 0 THEN 'rejected' WHEN key % 3 = 0 THEN 'approved' ELSE 'pending' END AS status FROM l JOIN orders ON o_orderkey = seq""")
def h3(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(C("o_custkey").alias("key"), C("o_orderkey").alias("seq"), C("o_orderpriority").alias("clean_name"))
    keys = o.select("key").distinct()
    return dc.init_review(o, keys.filter("key % 3 = 0"), keys.filter("key % 4 = 0"))


@query("h4_init_stats", f"""SELECT count(*) AS total, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (len(flags) > 0) AS flagged,
    count(*) FILTER (list_contains(flags, 'singleton_mapping')) AS singletons, count(*) FILTER (ambiguous) AS ambiguous, count(*) FILTER (confidence < 0.85) AS low, count(*) FILTER (NOT found) AS missing, count(*) FILTER (second) AS second,
    round(100.0 * count(*) FILTER (status <> 'pending') / count(*), 4) AS completion, round(100.0 * count(*) FILTER (len(flags) > 0) / count(*), 4) AS attention FROM ({FLAGGED})""")  # fmt: skip
def h4(spark, sf):
    n = F.count(F.lit(1))
    done, bad = F.count_if(C("status") != "pending"), F.count_if(F.size("flags") > 0)
    return flagged(spark, sf).agg(
        n.alias("total"), *[F.count_if(C("status") == s).alias(s) for s in ("approved", "rejected", "pending")], bad.alias("flagged"), F.count_if(F.array_contains("flags", "singleton_mapping")).alias("singletons"),
        F.count_if("ambiguous").alias("ambiguous"), F.count_if(C("confidence") < 0.85).alias("low"), F.count_if(~C("found")).alias("missing"), F.count_if("second").alias("second"),
        F.round(100 * done / n, 4).alias("completion"), F.round(100 * bad / n, 4).alias("attention"),
    )


@query("h5_priority", f"SELECT mapping_id, {PRIORITY} AS category FROM ({FLAGGED})")
def h5(spark, sf):
    return flagged(spark, sf).select("mapping_id", dc.priority(C("flags"), C("status")).alias("category"))


@query("h6_progress", f"""SELECT *, CASE WHEN completion < 50 THEN 'keep reviewing' WHEN mean < 0.8 THEN 'improve the dictionary' ELSE 'ready to export' END AS advice FROM (SELECT count(*) AS total, count(*) FILTER (status <> 'pending') AS done, round(avg(confidence), 6) AS mean,
    count(*) FILTER (confidence < 0.5) AS below_50, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS "50_to_80", count(*) FILTER (confidence >= 0.8 AND confidence < 0.9) AS "80_to_90", count(*) FILTER (confidence >= 0.9) AS above_90,
    round(100.0 * count(*) FILTER (status <> 'pending') / count(*), 4) AS completion, count(*) FILTER (len(flags) > 0) AS flagged FROM ({FLAGGED}))""")  # fmt: skip
def h6(spark, sf):
    return dc.progress(flagged(spark, sf))


@query("h6_flag_counts", f"SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM ({FLAGGED})) GROUP BY 1")
def h6f(spark, sf):
    return dc.flag_counts(flagged(spark, sf))


_Q = f"SELECT mapping_id, {PRIORITY} AS category, confidence FROM ({FLAGGED})"
_P = "list_position(['high', 'medium', 'low', 'ready', 'completed'], category)"
_CF = "CASE WHEN category IN ('high', 'medium', 'low') THEN confidence ELSE 0 END"


@query("h7_review_queue", f"SELECT mapping_id, category, round(confidence, 6) AS confidence, row_number() OVER (ORDER BY {_P}, {_CF}, mapping_id) AS position FROM ({_Q}) ORDER BY position LIMIT 50")
def h7(spark, sf):
    s = flagged(spark, sf).select("mapping_id", dc.priority(C("flags"), C("status")).alias("category"), "confidence")
    return dc.review_queue(s).withColumn("confidence", F.round("confidence", 6))


@query("h8_package_summary", f"SELECT {PRIORITY} AS category, count(*) AS n, round(avg(len(flags)), 6) AS flags_per_mapping FROM ({FLAGGED}) GROUP BY 1")
def h8(spark, sf):
    return flagged(spark, sf).groupBy(dc.priority(C("flags"), C("status")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size("flags")), 6).alias("flags_per_mapping"))


_DEC = "SELECT conv_id AS mapping_id, turn AS seq, CASE turn % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'modify' WHEN 3 THEN 'approve' ELSE 'maybe' END AS decision, CASE WHEN turn % 2 = 0 THEN role END AS correction FROM conversations"
_ST = "SELECT DISTINCT conv_id AS mapping_id, 'pending' AS status, 'initial' AS value FROM conversations WHERE conv_id % 7 <> 0"


@query("h9_apply_decisions", f"""WITH d AS ({_DEC}), s AS ({_ST}), j AS (SELECT d.*, CASE WHEN s.mapping_id IS NULL THEN 'unknown mapping' WHEN decision NOT IN ('approve', 'reject', 'modify') THEN 'unknown decision' WHEN decision = 'modify' AND correction IS NULL THEN 'no correction' END AS error FROM d LEFT JOIN s USING (mapping_id)),
    l AS (SELECT * FROM j WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY mapping_id ORDER BY seq DESC) = 1)
    SELECT 'state' AS kind, s.mapping_id, coalesce(CASE decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'modify' THEN 'modified' END, status) AS status, coalesce(CASE WHEN decision = 'modify' THEN correction END, value) AS value FROM s LEFT JOIN l USING (mapping_id)
    UNION ALL SELECT 'error', mapping_id, decision, error FROM j WHERE error IS NOT NULL""")  # fmt: skip
def h9(spark, sf):
    new, errors = dc.apply_decisions(derive.run(spark, sf, _ST, "conversations"), derive.run(spark, sf, _DEC, "conversations"))
    a = new.select(F.lit("state").alias("kind"), "mapping_id", "status", "value")
    return a.unionByName(errors.select(F.lit("error").alias("kind"), "mapping_id", C("decision").alias("status"), C("error").alias("value")))


_BD = "SELECT CASE WHEN turn % 3 = 0 THEN conv_id END AS key, conv_id AS original_key, turn AS seq, CASE turn % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'approve' ELSE 'unapprove' END AS decision FROM conversations"
_STORE = "SELECT DISTINCT conv_id AS key FROM conversations WHERE conv_id % 2 = 0"


@query("h10_batch_decisions", f"""WITH d AS (SELECT coalesce(key, original_key) AS key, seq, decision FROM ({_BD})), l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
    SELECT 'approved' AS kind, CAST(key AS VARCHAR) AS what, 1 AS n FROM (SELECT key FROM ({_STORE}) UNION SELECT key FROM l WHERE decision = 'approve') WHERE key NOT IN (SELECT key FROM l WHERE decision IN ('unapprove', 'reject'))
    UNION ALL SELECT 'rejected', CAST(key AS VARCHAR), 1 FROM l WHERE decision = 'reject' UNION ALL SELECT 'count', decision, CAST(count(*) AS INTEGER) FROM d GROUP BY decision""")  # fmt: skip
def h10(spark, sf):
    kept, rejected, counts = dc.batch_decisions(derive.run(spark, sf, _BD, "conversations"), derive.run(spark, sf, _STORE, "conversations"))
    row = lambda df, kind, what, n: df.select(F.lit(kind).alias("kind"), what.cast("string").alias("what"), n.cast("int").alias("n"))
    return row(kept, "approved", C("key"), F.lit(1)).unionByName(row(rejected, "rejected", C("key"), F.lit(1))).unionByName(row(counts, "count", C("decision"), C("n")))


_EV = "SELECT conv_id AS key, turn AS seq, CASE (conv_id + turn) % 6 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'skip' WHEN 3 THEN 'unskip' WHEN 4 THEN 'reviewed' ELSE 'unapprove' END AS event FROM conversations"
_TR = f"""SELECT key, CASE event WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'skip' THEN 'skipped' WHEN 'reviewed' THEN 'reviewed' ELSE 'pending' END AS status FROM ({_EV}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"""


def transitioned(spark, sf):
    keys = derive.run(spark, sf, "SELECT DISTINCT conv_id AS key, 'pending' AS status FROM conversations", "conversations")
    return dc.transition(keys, derive.run(spark, sf, _EV, "conversations"), "key")


@query("h11_transitions", _TR)
def h11(spark, sf):
    return transitioned(spark, sf)


@query("h12_decision_counts", f"SELECT *, CAST(approved + rejected + skipped > 0 AS INTEGER) AS committable FROM (SELECT {', '.join(f'count(*) FILTER (status = {chr(39)}{s}{chr(39)}) AS {s}' for s in ('approved', 'rejected', 'skipped', 'pending'))}, count(*) FILTER (key % 5 = 0) AS flagged FROM ({_TR}))")
def h12(spark, sf):
    return dc.decision_counts(transitioned(spark, sf).withColumn("flagged", C("key") % 5 == 0))


@query("h13_manual_flags", f"SELECT coalesce(t.key, f.key) AS key, coalesce(status, 'pending') AS status, reason, CAST(reason IS NOT NULL AS INTEGER) AS flagged FROM ({_TR}) t FULL JOIN (SELECT o_orderkey AS key, o_orderpriority AS reason FROM orders WHERE o_orderkey % 10 = 0) f ON t.key = f.key")
def h13(spark, sf):
    flags = derive.run(spark, sf, "SELECT o_orderkey AS key, o_orderpriority AS reason FROM orders WHERE o_orderkey % 10 = 0", "orders")
    return dc.flag_mappings(transitioned(spark, sf), flags, "key").select("key", "status", "reason", C("flagged").cast("int").alias("flagged"))


@query("h14_final_export", f"SELECT mapping_id, round(least(0.98, confidence + 0.1), 6) AS final_confidence, round(confidence, 6) AS was FROM ({STATE}) WHERE status = 'approved'")
def h14(spark, sf):
    return dc.final_export(state(spark, sf).filter("status = 'approved'")).select("mapping_id", F.round("final_confidence", 6).alias("final_confidence"), F.round("validated.was", 6).alias("was"))


@query("h15_flag_matrix", f"SELECT flag, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'pending') AS pending FROM (SELECT status, unnest(flags) AS flag FROM ({FLAGGED})) GROUP BY 1")
def h15(spark, sf):
    return dc.flag_matrix(flagged(spark, sf))


@query("h16_export_partition", f"SELECT status, count(*) AS n, round(1 - (SELECT count(*) FILTER (status = 'pending') / count(*)::DOUBLE FROM ({STATE})), 6) AS completion FROM ({STATE}) GROUP BY 1")
def h16(spark, sf):
    return dc.export_partition(state(spark, sf))


_GRP = f"""SELECT key AS group_name, count(*) AS members, round(avg(confidence), 6) AS mean, count(*) FILTER (len(flags) > 0) AS flagged, array_to_string(list_sort(list_distinct(flatten(list(flags)))), ',') AS flags,
    string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) FILTER (status = 'approved') AS approved FROM ({FLAGGED}) GROUP BY key"""


def grouped(spark, sf):
    from ..operators.reports import review_groups

    return review_groups(flagged(spark, sf), "key")


@query("h17_h19_review_groups", _GRP)
def h17(spark, sf):
    return grouped(spark, sf)


@query("h18_group_order", f"SELECT group_name, row_number() OVER (ORDER BY flagged > 0 DESC, members DESC, mean, group_name) AS position FROM ({_GRP}) ORDER BY position LIMIT 100")
def h18(spark, sf):
    from ..operators.reports import ranked

    return ranked(grouped(spark, sf), 100, (C("flagged") > 0).desc(), C("members").desc(), C("mean"), C("group_name")).select("group_name", "position")
