"""Order statistics, pages, checks, random search, all tags, streams with state and the whole chain."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.operators import chain as ch
from termloom.operators import graph as gr
from termloom.operators import learning as ln
from termloom.operators import ranks as rk
from termloom.operators import reports as rp
from termloom.streaming import jobs


@pytest.mark.parametrize("bins", [3, 1024])
def test_exact_medians(spark, bins):
    rng = random.Random(bins)
    groups = {"one": [5.0], "ties": [1.0] * 50 + [2.0] * 50, "near": [1.0 + k * 2**-52 for k in range(40)], "wide": [rng.uniform(-1e300, 1e300) for _ in range(101)], "mixed": [rng.choice([0.1, -0.1, 1e-9, 7.0, rng.random()]) for _ in range(300)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("none", None), ("one", float("nan"))]
    got = rk.medians(spark.createDataFrame(rows, "g string, v double").repartition(3), "g", "v", bins)
    assert got == {g: statistics.median(v) for g, v in groups.items()}


def test_pages_anywhere(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", "b", "c"]), rng.choice([None, 1.0, 2.5, rng.random()])) for i in range(3000)]
    d = spark.createDataFrame(rows, "id int, name string, x double").repartition(4)
    order = [rk.By("x", True), rk.By("name"), rk.By("id")]
    whole = [r.id for r in d.orderBy(*[b.order() for b in order]).collect()]
    for offset in (0, 1, 700, 1499, 2690, 2995, 3000, 9000):
        assert [r.id for r in rk.page_rows(d, order, offset, 30, most=100).collect()] == whole[offset : offset + 30]
    same = spark.range(500).select(F.lit(1).alias("k"), "id")
    assert rk.page_rows(same, [rk.By("k")], 100, 20, most=50).count() == 20


def test_every_check_of_a_pathway(spark):
    paths = spark.createDataFrame([(1, "p1", "t", 1), (2, None, "", None), (3, "p3", "t", 9)], "key int, id string, title string, start int")
    nodes = spark.createDataFrame([(1, 1, "s", "question"), (1, 2, None, ""), (3, 1, "s", "end")], "key int, step int, title string, type string")
    edges = spark.createDataFrame([(1, 1, 1, 2), (1, 1, 2, 7), (1, 2, 1, None)], "key int, src int, option int, dst int")
    got = {(r.id, r.step, r.field, r.problem) for r in gr.reference_checks(paths, nodes, edges).collect()}
    assert got == {
        (2, None, "title", "Title is required"), (2, None, "id", "ID is required"), (2, None, "start", "Start step must be specified"), (1, 2, "title", "missing title"), (1, 2, "type", "missing type"),
        (3, 9, "start", "Start step does not exist in steps"), (1, 1, "option 2 to 7", "references non-existent step"),
    }


def test_random_search_draws_from_a_huge_grid(spark):
    lists = {n: [k / 100 for k in range(m)] for n, m in (("a", 97), ("b", 89), ("c", 83), ("d", 79), ("e", 73), ("f", 71))}
    draw = lambda seed: sorted(map(tuple, ln.random_params(lists, ["a", "b", "c"], 0.8, 3000, spark, seed).collect()))
    one = draw(1)
    assert one == draw(1) != draw(2) and 300 < len(one) < 1500
    assert all(round(r[1] + r[2] + r[3], 9) <= 0.8 for r in one) and all(len({r[k] for r in one}) > 60 for k in (5, 6))


def test_changelog_totals_and_stamps(spark):
    c = spark.createDataFrame([("x", "p", "added"), ("x", "q", "removed"), ("x", "q", "modified"), (None, "p", "added")], "section string, subheading string, change string")
    got = {(r.section, r.subheading, r.depth): (r.changes, r.added, r.removed, r.modified) for r in rp.changelog_totals(c, ["section", "subheading"]).collect()}
    assert got == {("x", "p", 2): (1, 1, 0, 0), ("x", "q", 2): (2, 0, 1, 1), (None, "p", 2): (1, 1, 0, 0), ("x", None, 1): (3, 1, 1, 1), (None, None, 1): (1, 1, 0, 0), (None, None, 0): (4, 2, 1, 1)}
    s = spark.createDataFrame([("x", "old"), ("y", "old")], "section string, last_updated string")
    assert {tuple(r) for r in rp.stamped(s, c, "section", "new").collect()} == {("x", "new"), ("y", "old")}


def test_all_tags_equal_a_model_for_each(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.linalg import Vectors

    from termloom.operators import tagger as tg

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["ct", "mr", "left", "right", "the", "knee", "hip"], k=rng.randrange(1, 6)))) for i in range(120)]
    d = spark.createDataFrame([(i, t, [w for w in ("left", "knee") if w in t]) for i, t in rows], "entry_id int, text string, tags array<string>")
    train = F.col("entry_id") % 4 != 0
    got = {(r.entry_id, r.tag): (r.score, r.predicted) for r in tg.tag_all(d, train).collect()}
    weights = tg.term_weights(d, train).collect()
    place = {t: k for k, t in enumerate(sorted({r.term for r in weights}))}
    vectors = {}
    for r in weights:
        vectors.setdefault(r.entry_id, {})[place[r.term]] = r.w
    for tag in ("left", "knee"):
        data = [(i, float(tag in t), Vectors.sparse(len(place), vectors.get(i, {}))) for i, t in rows]
        frame = spark.createDataFrame(data, ["entry_id", "label", "features"])
        model = NaiveBayes(smoothing=0.1).fit(frame.filter(train))
        for r in model.transform(frame.filter(~train)).collect():
            raw = r.rawPrediction
            assert got[r.entry_id, tag][0] == pytest.approx(raw[1] - raw[0], abs=1e-6) and got[r.entry_id, tag][1] == r.prediction


def test_decisions_between_batches_change_the_same_key(spark, tmp_path):
    at = lambda s: np.datetime64("2024-01-01T00:00:00") + np.timedelta64(s, "s")
    write = lambda rows, schema, name, n: spark.createDataFrame([(*r[:-1], at(r[-1]).item()) for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    events, marks = "k string, event_id long, ts timestamp", "k string, decision string, ts timestamp"

    def run():
        e, d = (spark.readStream.schema(s).parquet(f"{tmp_path}/{n}") for s, n in ((events, "e"), (marks, "d")))
        jobs.run_available(jobs.decided_stream(e, d, "k", 3600), f"{tmp_path}/out", f"{tmp_path}/state")
        return {r.event_id: r.decision for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    write([("a", 1, 10), ("b", 2, 10)], events, "e", 1)
    write([("b", "rejected", 5)], marks, "d", 1)
    assert run() == {1: "pending", 2: "rejected"}
    write([("a", "approved", 15), ("a", "withdrawn", 40)], marks, "d", 2)
    write([("a", 3, 20), ("a", 4, 50), ("b", 5, 60)], events, "e", 2)
    assert run() == {1: "pending", 2: "rejected", 3: "approved", 4: "withdrawn", 5: "rejected"}


def test_spaced_rows_over_batches(spark, tmp_path):
    at = lambda s: (np.datetime64("2024-01-01T00:00:00") + np.timedelta64(s, "s")).item()

    def run(seconds):
        spark.createDataFrame([("a", at(s)) for s in seconds], "k string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.run_available(jobs.spaced_stream(spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in"), ["k"], 100), f"{tmp_path}/out", f"{tmp_path}/state")
        return sorted((r.ts - at(0)).total_seconds() for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run([0, 30, 101, 150]) == [0, 101]
    assert run([201, 202, 330]) == [0, 101, 202, 330]


def test_the_chain_takes_every_branch(spark):
    """Golden rows: one for each way out of the chain."""
    from termloom.functions import complexity as cx
    from termloom.functions import components as cp
    from termloom.functions import text as tx

    entries = [(1, 10, "left", "CT knee left"), (1, 11, "bilateral", "CT knee"), (2, 12, None, "MRI knee"), (3, 13, None, "XR hip"), (4, 14, None, "US hip")]
    e = spark.createDataFrame(entries, "concept_id long, entry_id long, entry_side string, cat_text string").withColumn("cat_fsn", F.concat("cat_text", F.lit(" (procedure)")))
    e = e.withColumn("c", cp.components(F.col("cat_text"), F.lit("OTHER"))).select("*", *[F.col(f"c.{n}").alias(f"cat_{n}") for n in ("modality", "anatomy", "laterality", "contrast", "technique")]).drop("c")
    e = e.withColumn("cat_complex", cx.total_complexity(F.col("cat_fsn")) > 0.67)
    asked = [(1, "k1", "CT knee left", "CT"), (2, "k2", "CT knee", "CT"), (3, "k3", "XR hip", "XR"), (4, "k4", "MRI hip", "MR"), (5, "k5", "XR hip", "XR"), (6, "k6", "XR hip", "XR"), (7, "k7", "XR hip", "XR"), (8, "k8", "CT elbow", "CT"), (9, None, "XR hip", "XR"), (10, "k10", "CT knee bilateral", "CT")]
    i = spark.createDataFrame(asked, "row_id long, key string, in_text string, code string").withColumn("c", cp.components(F.col("in_text"), F.col("code")))
    i = i.select("row_id", "key", "in_text", *[F.col(f"c.{n}").alias(f"in_{n}") for n in ("modality", "anatomy", "laterality", "contrast", "technique")])
    text = F.col("in_text")
    i = i.withColumns({"in_simple": cx.qualifier(text) < cx.SIMPLE_INPUT, "in_gender": cp.gender_context(text, F.col("in_anatomy")), "in_age": cp.age_context(text), "in_clinical": cp.clinical_context(text)})
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    d = ch.Decisions(
        table([("k3", "known hip"), ("k3", "other")], "key string, approved_name string"), table([("k5", 3), ("k5", 4), (None, 3)], "key string, concept_id long"),
        table([("k6|XR hip", "approved hip")], "result_key string, approved_name string"), table([("k7|XR hip",)], "result_key string"),
    )
    scores = lambda c: c.withColumn("rerank", F.when(F.col("row_id") == 9, 0.0).when(F.col("entry_id") == 10, 0.9).when(F.col("entry_id") != 12, 0.5))
    got = {r.row_id: r for r in ch.standardise(i, e, d, tx.ABBREVIATIONS, scores).collect()}
    assert len(got) == 10
    assert (got[1].snomed.entry_id, got[1].clean_name, got[1].by_peer, got[1].ambiguous) == (10, "CT knee left", False, False)
    assert (got[2].snomed.entry_id, got[2].clean_name, got[2].by_peer, got[2].ambiguous, got[2].snomed.laterality) == (11, "CT knee", True, True, "bilateral")
    assert (got[3].clean_name, got[3].confidence, got[3].early, got[3].status, got[3].candidates) == ("known hip", 1.0, True, "approved_by_human", None)
    assert (got[4].error, got[4].confidence, got[4].status) == (ch.NO_MODALITY, 0.0, "failed")
    assert (got[5].error, got[5].clean_name) == (ch.REJECTED, None)
    assert (got[6].clean_name, got[6].confidence, got[6].status) == ("approved hip", 1.0, "approved_by_human") and 0 < got[6].original_confidence < 1.2
    assert (got[7].clean_name, got[7].status) == ("XR hip", "rejected_by_human")
    assert got[8].error == ch.NO_MODALITY and got[9].error == ch.NOT_CLINICAL
    assert (got[10].snomed.entry_id, got[10].by_peer) == (11, True)
    assert got[1].components.clinical_context == [] and got[1].components.modality == ["CT"]


def test_variants_without_a_sort_of_the_expanded(spark):
    """Positions are right with shared ranks and concepts without entries, and nothing expanded is shuffled or sorted."""
    from termloom.operators import retrieval as rt

    rng = random.Random(5)
    found = [(r, rng.randrange(9), rng.choice([None, 0, 1, 2, 3])) for r in range(40) for _ in range(6)]
    entries = [(rng.randrange(7), e) for e in range(60)]
    want = []
    for r in range(40):
        ranks = {}
        for _, c, rank in [f for f in found if f[0] == r]:
            ranks[c] = rank if ranks.get(c) is None else min(ranks[c], rank if rank is not None else ranks[c])
        order = sorted((-1 if ranks[c] is None else ranks[c], e, c) for c, e in entries if c in ranks)
        want += [(r, c, e, at) for at, (_, e, c) in enumerate(order)]
    v = rt.expand_variants(spark.createDataFrame(found, "row_id long, concept_id long, rank int"), spark.createDataFrame(entries, "concept_id long, entry_id long"))
    assert sorted(tuple(x) for x in v.select("row_id", "concept_id", "entry_id", "cand_pos").collect()) == sorted(want)
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan.split("Join")[0], plan
    s = spark.createDataFrame([(1, 0.25)], "entry_id long, rerank double")
    assert {x.rerank for x in rt.attach_rerank(v, s).filter("entry_id = 1").collect()} <= {0.25} and {x.rerank for x in rt.attach_rerank(v, s).filter("entry_id <> 1").collect()} == {0.5}
    pairs = spark.createDataFrame([(1, want[0][2], 0.75)], "row_id long, entry_id long, rerank double")
    assert {x.rerank for x in rt.attach_rerank(v, pairs).filter("row_id <> 1").collect()} == {0.5}


def test_consensus_adds_up_in_order(spark):
    """Means that tie but for the order of their sums: the vote is the same however the rows lie."""
    from functools import reduce

    from termloom.operators import scoring as sc

    rng = random.Random(2)
    rows = [(r, i, "m", rng.choice("ab"), rng.randrange(100) / 100.0) for r in range(300) for i in range(14)]
    rows += [(r, 20 + i, "m", "a" if i % 2 else "b", x) for r in range(300, 500) for i, x in enumerate([v for k in rng.sample(range(100), 8) for v in (k / 100.0, 0.99 - k / 100.0)])]
    want = {}
    for r in {x[0] for x in rows}:
        by = {c: [x[4] for x in sorted(rows) if x[0] == r and x[3] == c] for c in "ab"}
        want[r] = min((-len(v), -(reduce(float.__add__, v) / len(v)), c) for c, v in by.items() if v)
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        d = spark.createDataFrame(rows, "row_id long, at long, model string, choice string, confidence double").repartition(1 + 3 * seed)
        got = {x.row_id: (-x.votes, -x.confidence, x.choice) for x in sc.consensus(d, "at").collect()}
        assert got == want
        none = spark.createDataFrame([], "row_id long, choice string, name string, fsn string")
        assert {x.row_id: x.choice for x in sc.named_consensus(d, none, "at").collect()} == {r: w[2] for r, w in want.items()}


@pytest.mark.parametrize("name", ["g35_g36_consensus", "g35_named_consensus"])
def test_votes_without_ids_count(spark, tmp_path, name):
    """Events without an id, a user, a type or all confidences, against the SQL."""
    import duckdb

    import __spark_entry__ as entry

    rng = random.Random(4)
    rows = [(None if i % 6 == 5 else i, rng.choice([None, 1, 2, 3]), rng.choice(["click", "error", "view", None])) for i in range(120)]
    rows += [(None, 4, "view"), (None, 4, "view"), (None, 4, "click"), (None, 5, "error"), (900, 6, "view"), (None, 7, "view"), (1, 7, "click")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    expected = c.sql(entry.oracle_sql()[name]).select(*got.columns).fetchall()
    assert {r[0] for r in expected} == {None, 1, 2, 3, 4, 5, 7}
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize("name", ["g35_g36_consensus", "g35_named_consensus"])
def test_means_at_a_half_round_as_the_sql(spark, tmp_path, name):
    """Means of 32 confidences may end at half a unit of the sixth place."""
    import duckdb

    import __spark_entry__ as entry

    rows = []
    for user in range(200):
        for i in range(32):
            cents = min(99, max(0, 2 * user + 1 - 99 * i))
            rows.append((100 * (9 * len(rows) + (1 - cents) % 9) + cents, user, "view"))  # the hundreds keep ids off multiples of nine
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    expected = c.sql(entry.oracle_sql()[name]).select(*got.columns).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    assert len(expected) == 200 and len(rows) == c.sql("select count(*) from events where event_id % 9 <> 0").fetchall()[0][0]


def test_answers_are_asked_where_ways_lead(spark):
    """A function that gives the answers at some steps is asked for the steps on the ways alone, and the ways are the same."""
    rng = random.Random(8)
    edges = spark.createDataFrame([(i, s, o, rng.choice([None, *range(1, 40)])) for i in (1, 2) for s in range(1, 30) for o in (0, 1)], "id int, src long, option int, dst long")
    starts = spark.createDataFrame([(1, 1), (2, 3)], "id int, step long")
    given = spark.createDataFrame([(c, c % 3, s, rng.randrange(3)) for c in range(60) for s in range(1, 30) if rng.random() < 0.9], "case int, id int, step long, option int")
    asked = spark.sparkContext.accumulator(0)

    def answers(front):
        asked.add(front.count())
        return given.join(front, ["case", "id", "step"], "left_semi")

    rows = lambda d: sorted(tuple(r) for r in d.collect())
    some = rows(gr.evaluate_pathways(answers, edges, starts, given.select("case", "id").distinct()))
    assert some == rows(gr.evaluate_pathways(given, edges, starts)) and len(some) == 40
    assert asked.value < given.count()


def test_tags_broadcast_no_table_of_entries(spark):
    from termloom.operators import tagger

    d = spark.createDataFrame([(i, f"ct head {i % 3} scan", ["a", "b"][: 1 + i % 2]) for i in range(40)], "entry_id long, text string, tags array<string>")
    plan = tagger.tag_all(d, F.col("entry_id") % 5 != 0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_candidates_of_repeated_names(spark):
    """The same candidates as by all pairs, where entries share names and names share overlaps; a name is compared once however many entries have it."""
    from termloom.operators import retrieval as rt

    rng = random.Random(4)
    parts = [["chest"], ["knee"], ["chest", "knee"], ["hip", "chest"], []]
    names = [(" ".join(rng.sample(["ct", "mr", "left", "right", "with", "of"], rng.randrange(1, 4))), rng.choice(parts)) for _ in range(12)]
    entries = [(e, *rng.choice(names)) for e in rng.sample(range(1000), 150)]
    inputs = [(r, *rng.choice(names + [("ct left with", ["chest"])])) for r in range(30)]
    jac = lambda a, b: round(len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())), 9)
    i = spark.createDataFrame(inputs, "row_id long, in_text string, in_anatomy array<string>")
    c = spark.createDataFrame(entries, "entry_id long, cat_text string, cat_anatomy array<string>")
    for k in (1, 4, 15, 200):
        want = []
        for r, text, anatomy in {x[1]: x for x in inputs}.values():
            found = sorted((-jac(text, t), e) for e, t, a in entries if set(a) & set(anatomy))[:k]
            want += [(text, tuple(anatomy), e, at) for at, (_, e) in enumerate(found)] if len({tuple(x[2]) for x in inputs if x[1] == text}) == 1 else []
        alone = {w[:2] for w in want}
        got = {(x.in_text, tuple(x.in_anatomy), x.entry_id, x.cand_pos) for x in rt.blocked_candidates(i, c, k).collect()}
        assert {g for g in got if g[:2] in alone} == set(want) and want
    many = spark.createDataFrame([(e, "ct left", ["chest"]) for e in range(3000)], c.schema)
    df = rt.blocked_candidates(i, many, 5)
    assert {x.entry_id for x in df.collect()} <= set(range(5))
