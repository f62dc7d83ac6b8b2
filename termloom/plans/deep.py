"""Queries of order statistics, checks, random search, totals of changes, all tags at once, and streams with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import complexity as cx
from ..functions import components as cp
from ..operators import graph as gr
from ..operators import learning as ln
from ..operators import ranks as rk
from ..operators import reports as rp
from ..sources import readers as rd
from ..streaming import jobs
from . import derive
from .extra import t
from .more import stream
from .names import _WEAK, lit, structural_sql, terminology_sql
from .registry import query

C = F.col
_CAT = derive.duck(derive.CATALOGUE)
_total = lambda c: f"least({structural_sql(c)} + {terminology_sql(c)}, 1.0)"


@query("d6_complexity_report", f"""WITH x AS (SELECT {_total('fsn')} AS f, {_total('primary_name')} AS s FROM ({_CAT})),
    v AS (SELECT 'full' AS series, f AS v FROM x UNION ALL SELECT 'short', s FROM x UNION ALL SELECT 'difference', greatest(0.0, f - s) FROM x),
    g AS (SELECT series, count(*) AS n, avg(v) AS mean, median(v) AS median, coalesce(stddev_samp(v), 0.0) AS stdev, min(v) AS low, max(v) AS high, count(*) FILTER (v < 0.3) AS simple, count(*) FILTER (v >= 0.3 AND v < 0.6) AS moderate, count(*) FILTER (v >= 0.6) AS complex FROM v GROUP BY 1)
    SELECT series, n, round(mean, 6) AS mean, round(median, 6) AS median, round(stdev, 6) AS stdev, round(low, 6) AS low, round(high, 6) AS high, round(high - low, 6) AS span, CASE WHEN series = 'full' THEN simple END AS simple,
      CASE WHEN series = 'full' THEN moderate END AS moderate, CASE WHEN series = 'full' THEN complex END AS complex, CASE WHEN series = 'full' THEN round(CASE WHEN mean > 0 THEN stdev / mean ELSE 0 END, 6) END AS variation,
      CASE WHEN series = 'full' THEN CASE WHEN stdev > 0.15 THEN 'good' WHEN stdev > 0.10 THEN 'moderate' ELSE 'poor' END END AS spread, CASE WHEN series = 'full' THEN CASE WHEN high - low > 0.5 THEN 'wide' WHEN high - low > 0.3 THEN 'moderate' ELSE 'narrow' END END AS range,
      CASE WHEN series = 'difference' THEN CASE WHEN mean > 0.1 THEN 'significant' ELSE 'limited' END END AS gain FROM g""")  # fmt: skip
def d6_report(spark, sf):
    c = rd.checkpointed(derive.catalogue(spark, sf).select(cx.total_complexity(C("fsn")).alias("full"), cx.total_complexity(C("primary_name")).alias("short")))
    return rp.complexity_report(c)


@query("d6_exact_medians", "SELECT o_orderpriority AS priority, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1")
def d6_medians(spark, sf):
    """Medians of many different values, by counts in bins."""
    found = rk.medians(t(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return spark.createDataFrame(sorted(found.items()), "priority string, median double").withColumn("median", F.round("median", 4))


@query("h22_far_page", """WITH n AS (SELECT count(*) AS total FROM lineitem), r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS place FROM lineitem)
    SELECT l_orderkey, l_linenumber, total FROM r, n WHERE place >= 54000 AND place < 54250""")  # fmt: skip
def h22_far(spark, sf):
    """A page far into an order of all line items."""
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rp.page(li, 54_000, 250, rk.By("l_extendedprice", True), rk.By("l_orderkey"), rk.By("l_linenumber")).select("l_orderkey", "l_linenumber", "total")


@query("h29_sources", "SELECT p_brand AS source, min(p_partkey) AS first FROM part GROUP BY 1 ORDER BY 2, 1")
def h29(spark, sf):
    return rp.distinct_sources(t(spark, sf, "part").select(C("p_brand").alias("source"), "p_partkey"), "source", "p_partkey")


#: Suppliers with their parts as pathways: some lack a field, some start or lead elsewhere.
_PATHS = "SELECT s_suppkey AS key, CASE WHEN s_suppkey % 13 <> 0 THEN CAST(s_suppkey AS STRING) END AS id, CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 11 <> 0 THEN s_name END AS title, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 9 END AS start FROM supplier"
_NODES = "SELECT l_suppkey AS key, l_linenumber AS step, CASE WHEN max(l_orderkey) % 10 <> 0 THEN 'step' END AS title, CASE WHEN min(l_orderkey) % 10 = 0 THEN '' ELSE 'question' END AS type FROM lineitem GROUP BY l_suppkey, l_linenumber"
_TO = "SELECT DISTINCT l_suppkey AS key, l_linenumber AS src, CASE WHEN l_orderkey % 4 <> 0 THEN CAST(l_orderkey % 9 AS INT) END AS dst, l_partkey % 3 AS option FROM lineitem"


@query("h44_reference_checks", f"""WITH p AS ({derive.duck(_PATHS)}), n AS ({_NODES}), e AS ({_TO})
    SELECT key AS id, NULL AS step, f.field, f.problem FROM p, LATERAL (VALUES ('title', title, 'Title is required'), ('id', id, 'ID is required'), ('start', CAST(start AS VARCHAR), 'Start step must be specified')) AS f(field, v, problem) WHERE coalesce(v, '') = ''
    UNION ALL SELECT key, step, f.field, f.problem FROM n, LATERAL (VALUES ('title', title, 'missing title'), ('type', type, 'missing type')) AS f(field, v, problem) WHERE coalesce(v, '') = ''
    UNION ALL SELECT p.key, start, 'start', {lit(gr.NO_START)} FROM p WHERE start IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.key = p.key AND n.step = p.start)
    UNION ALL SELECT e.key, src, concat('option ', option, ' to ', dst), {lit(gr.NO_TARGET)} FROM e WHERE dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.key = e.key AND n.step = e.dst)""")  # fmt: skip
def h44(spark, sf):
    """All seven checks on pathways, steps and options."""
    tables = [derive.run(spark, sf, sql, name) for sql, name in ((_PATHS, "supplier"), (_NODES, "lineitem"), (_TO, "lineitem"))]
    nodes, edges = (x.withColumns({c: C(c).cast("long") for c in cs}) for x, cs in ((tables[1], ("step",)), (tables[2], ("src", "dst"))))
    return gr.reference_checks(tables[0].withColumn("start", C("start").cast("long")), nodes, edges)


_WEIGHTS = {"anatomy": 50, "modality": 40, "contrast": 30, "semantic": 25, "penalty": 20, "bonus": 10}


@query("h37_random_search", f"""WITH {', '.join(f"l{i} AS (SELECT list(v ORDER BY v) AS v FROM (SELECT DISTINCT (p_size % {m}) / 100.0::DOUBLE AS v FROM part))" for i, m in enumerate(_WEIGHTS.values()))},
    d AS (SELECT range AS draw, CAST('0x' || substr(md5('7:' || range), 1, 15) AS BIGINT) % ({' * '.join(f'len(l{i}.v)' for i in range(6))}) AS o FROM range(2000), {', '.join(f'l{i}' for i in range(6))}),
    x AS (SELECT draw, {', '.join(f"l{i}.v[CAST((o // ({' * '.join(['1', *(f'len(l{j}.v)' for j in range(i + 1, 6))])})) % len(l{i}.v) AS INTEGER) + 1] AS {n}" for i, n in enumerate(_WEIGHTS))} FROM d, {', '.join(f'l{i}' for i in range(6))})
    SELECT * FROM x WHERE round(anatomy + modality + contrast, 9) <= 0.8""")  # fmt: skip
def h37_random(spark, sf):
    """Two thousand draws from a grid of all combinations of six lists, which isn't made. The lists are the sizes of all parts, a few dozen values."""
    p = t(spark, sf, "part")
    lists = {n: [r.v for r in p.select(((C("p_size") % m) / 100.0).alias("v")).distinct().orderBy("v").collect()] for n, m in _WEIGHTS.items()}
    return ln.random_params(lists, ["anatomy", "modality", "contrast"], 0.8, 2000, spark)


_CHANGES = "SELECT o_orderpriority AS section, o_orderstatus AS subheading, CASE WHEN o_orderkey % 10 = 0 THEN 'added' WHEN o_orderkey % 10 = 1 THEN 'removed' WHEN o_orderkey % 7 = 0 THEN 'modified' END AS change FROM orders"


def order_changes(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    new = o.filter("o_orderkey % 10 <> 1").withColumn("o_totalprice", F.when(C("o_orderkey") % 7 == 0, C("o_totalprice") + 1).otherwise(C("o_totalprice")))
    keys = ["o_orderpriority", "o_orderstatus", "o_orderkey"]
    return rp.changelog(o.filter("o_orderkey % 10 <> 0"), new, keys, ["o_totalprice"]).select(C("o_orderpriority").alias("section"), C("o_orderstatus").alias("subheading"), "change")


@query("h51_totals", f"""WITH c AS ({_CHANGES}) SELECT section, subheading, CAST(2 - (grouping(section) + grouping(subheading)) AS INTEGER) AS depth, count(*) AS changes, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified
    FROM c WHERE change IS NOT NULL GROUP BY GROUPING SETS ((section, subheading), (section), ())""")  # fmt: skip
def h51_totals(spark, sf):
    return rp.changelog_totals(order_changes(spark, sf), ["section", "subheading"])


@query("h51_stamps", f"WITH c AS (SELECT DISTINCT section FROM ({_CHANGES}) WHERE change IS NOT NULL) SELECT c_custkey, seg, CASE WHEN seg IN (SELECT section FROM c) THEN '2024-06-01' ELSE '2020-01-01' END AS last_updated FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE c_mktsegment END AS seg FROM customer)")
def h51_stamps(spark, sf):
    """The sections in which something changed get a new date."""
    c = t(spark, sf, "customer").select("c_custkey", F.when(C("c_custkey") % 7 == 0, "1-URGENT").when(C("c_custkey") % 7 == 1, "2-HIGH").otherwise(C("c_mktsegment")).alias("seg")).withColumn("last_updated", F.lit("2020-01-01"))
    return rp.stamped(c, order_changes(spark, sf).withColumnRenamed("section", "seg"), "seg", "2024-06-01").select("c_custkey", "seg", "last_updated")


#: Words without stop words, and their runs of one to three.
_KW = "list_filter(regexp_split_to_array(lower(primary_name), '[^A-Za-z0-9_]+'), lambda x: x <> '' AND x NOT IN ('the', 'of', 'and'))"


@query("k5_all_tags", f"""WITH d AS (SELECT entry_id, entry_id % 5 <> 0 AS train, {_KW} AS w, list_distinct(list_filter([{_WEAK}], lambda x: x IS NOT NULL)) AS tags FROM ({_CAT})),
    g AS (SELECT entry_id, train, array_to_string(w[i + 1 : i + n], ' ') AS term, count(*) AS tf FROM (SELECT entry_id, train, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n) GROUP BY ALL),
    m AS (SELECT count(*) AS m FROM d WHERE train), idf AS (SELECT term, ln((m + 1) / (count(*) + 1)::DOUBLE) AS idf FROM g, m WHERE train GROUP BY term, m),
    w AS (SELECT entry_id, train, term, tf * idf AS w FROM g JOIN idf USING (term)), tot AS (SELECT term, sum(w) AS al FROM w WHERE train GROUP BY 1), z AS (SELECT count(*) AS v, sum(al) AS t FROM tot),
    tg AS (SELECT entry_id, unnest(tags) AS tag FROM d WHERE train), p AS (SELECT tag, term, sum(w) AS p FROM w JOIN tg USING (entry_id) WHERE train GROUP BY 1, 2),
    mo AS (SELECT tag, ln((t - tp + 0.1 * v) / (tp + 0.1 * v)) AS per, ln((nt + 0.1) / (m - nt + 0.1)) AS prior FROM (SELECT tag, count(*) AS nt FROM tg GROUP BY 1) JOIN (SELECT tag, sum(p) AS tp FROM p GROUP BY 1) USING (tag), z, m),
    s AS (SELECT x.entry_id, mo.tag, coalesce(sum(w.w * (ln((coalesce(p.p, 0) + 0.1) / (tot.al - coalesce(p.p, 0) + 0.1)) + per)), 0) + any_value(prior) AS score
      FROM d x CROSS JOIN mo LEFT JOIN w ON w.entry_id = x.entry_id LEFT JOIN tot ON tot.term = w.term LEFT JOIN p ON p.tag = mo.tag AND p.term = w.term WHERE NOT x.train GROUP BY 1, 2)
    SELECT s.entry_id, tag, round(score, 4) AS score, CAST(score > 0 AS INTEGER) AS predicted, CAST(list_contains(d.tags, tag) AS INTEGER) AS actual FROM s JOIN d USING (entry_id)""")  # fmt: skip
def k5_all(spark, sf):
    """Every label of the catalogue, learned from four rows in five and told of the fifth."""
    from ..operators.tagger import tag_all

    c = derive.catalogue(spark, sf).select("entry_id", C("primary_name").alias("text"), cp.weak_tags(C("fsn"), C("primary_name")).alias("tags"))
    return tag_all(c, C("entry_id") % 5 != 0).select("entry_id", "tag", F.round("score", 4).alias("score"), "predicted", "actual")


@query("j2_progress", """SELECT user_id, count(*) AS processed, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS errors, CAST(100 + user_id % 50 AS BIGINT) AS total, round(100 * count(*) / (100 + user_id % 50)::DOUBLE, 1) AS percentage,
    CASE WHEN count(*) < 100 + user_id % 50 THEN 'processing' ELSE 'completed' END AS status FROM events GROUP BY 1""")  # fmt: skip
def j2(spark, sf):
    """Progress with successes and percentage of what each user was to do."""
    at = rd.shared_path(spark)
    todo = t(spark, sf, "events").select("user_id").distinct().select("user_id", (100 + C("user_id") % 50).cast("long").alias("total"))
    return jobs.upsert_batches(jobs.progress_stream(stream(spark, sf), "user_id", todo), f"{at}/out", f"{at}/state")


#: Every seventh event is a decision on its user.
_DECIDED = "SELECT user_id, event_id, ts, CASE WHEN event_id % 7 = 0 THEN event_type END AS decision FROM events"


@query("j3_decisions_in_state", f"""WITH e AS ({_DECIDED}), k AS (SELECT user_id, ts, max(event_id) AS last, arg_max(decision, event_id) AS decision FROM e WHERE decision IS NOT NULL GROUP BY 1, 2)
    SELECT e.user_id, e.event_id, coalesce(k.decision, 'pending') AS decision FROM (SELECT * FROM e WHERE decision IS NULL) e ASOF LEFT JOIN k ON e.user_id = k.user_id AND e.ts >= k.ts""")  # fmt: skip
def j3(spark, sf):
    """Decisions and events as streams: each event meets the newest decision on its user before it."""
    at = rd.shared_path(spark)
    e = stream(spark, sf).filter("event_id % 7 <> 0")
    d = stream(spark, sf).filter("event_id % 7 = 0").select("user_id", "ts", C("event_type").alias("decision"))
    jobs.run_available(jobs.decided_stream(e, d, "user_id", 86_400 * 3650), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select("user_id", "event_id", "decision")


@query("j6_spaced_events", """WITH RECURSIVE e AS (SELECT user_id, event_type, ts FROM events), r AS (SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY 1, 2
    UNION SELECT r.user_id, r.event_type, (SELECT min(e.ts) FROM e WHERE e.user_id = r.user_id AND e.event_type = r.event_type AND e.ts > r.ts + INTERVAL 1 DAY) FROM r WHERE r.ts IS NOT NULL)
    SELECT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM r WHERE ts IS NOT NULL""")  # fmt: skip
def j6(spark, sf):
    """Of each user's events of a kind, the first and then those over a day after the last one kept."""
    at = rd.shared_path(spark)
    jobs.run_available(jobs.spaced_stream(stream(spark, sf), ["user_id", "event_type"], 86_400), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select("user_id", "event_type", F.unix_seconds("ts").alias("ts"))


@query("e5_index_topk")
def e5_index(spark, sf):
    """The top five of each query from an index over all items; recall and scored pairs are tested against the exact join."""
    from ..operators import index as ix
    from .more import sides

    q, c = sides(spark, sf)
    return ix.search(q, ix.build(c, rd.shared_path(spark)), 5, but_itself=True)
