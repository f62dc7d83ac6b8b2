"""The whole chain makes and scores candidates once for each exam, and takes scores from a table or an expression."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from termloom.functions import complexity as cx
from termloom.functions import components as cp
from termloom.functions import text as tx
from termloom.operators import chain as ch

PARTS = ("modality", "anatomy", "laterality", "contrast", "technique")


@pytest.fixture(scope="module")
def tables(spark):
    entries = [(1, 10, "left", "CT knee left"), (1, 11, "bilateral", "CT knee"), (2, 12, None, "MRI knee"), (3, 13, None, "XR hip"), (3, 14, None, "XR hip right"), (4, 15, None, "US hip")]
    e = spark.createDataFrame(entries, "concept_id long, entry_id long, entry_side string, cat_text string").withColumn("cat_fsn", F.concat("cat_text", F.lit(" (procedure)")))
    e = e.withColumn("c", cp.components(F.col("cat_text"), F.lit("OTHER"))).select("*", *[F.col(f"c.{n}").alias(f"cat_{n}") for n in PARTS]).drop("c")
    e = e.withColumn("cat_complex", cx.total_complexity(F.col("cat_fsn")) > 0.67)
    asked = [("CT knee left", "CT"), ("CT knee", "CT"), ("XR hip", "XR"), ("CT elbow", "CT"), ("XR hip", "CR")]
    rows = [(i, None if i % 9 == 0 else f"k{i % 40}", *asked[i % 5]) for i in range(200)]
    i = spark.createDataFrame(rows, "row_id long, key string, in_text string, code string").withColumn("c", cp.components(F.col("in_text"), F.col("code")))
    i = i.select("row_id", "key", "in_text", *[F.col(f"c.{n}").alias(f"in_{n}") for n in PARTS])
    text = F.col("in_text")
    i = i.withColumns({"in_simple": cx.qualifier(text) < cx.SIMPLE_INPUT, "in_gender": cp.gender_context(text, F.col("in_anatomy")), "in_age": cp.age_context(text), "in_clinical": cp.clinical_context(text)})
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    d = ch.Decisions(
        table([("k3", "known"), ("k3", "other")], "key string, approved_name string"), table([("k2", 3), ("k7", 3), ("k7", 4), ("k1", 1), (None, 3), ("k8", None)], "key string, concept_id long"),
        table([("k12|XR hip", "approved hip")], "result_key string, approved_name string"), table([("k17|XR hip",)], "result_key string"),
    )
    return i, e, d


def test_candidates_are_scored_once_for_each_exam(spark, tables):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        seen.add(len(a))
        return (a == b).astype(float)

    i, e, d = tables
    got = ch.standardise(i, e, d, tx.ABBREVIATIONS, lambda c: c.withColumn("rerank", F.lit(0.5)), like=like).collect()
    assert len({r.row_id for r in got}) == len(got) == 200
    assert 0 < seen.value <= 5 * 6 * 3  # five exams and six entries; before, every row's candidates


def test_scores_by_table_and_by_expression(tables):
    i, e, d = tables
    rule = lambda entry: F.when(F.col("row_id") % 11 == 0, 0.0).when((F.col("row_id") + entry) % 7 != 0, ((F.col("row_id") * 31 + entry * 17) % 100) / 100.0)
    run = lambda rerank, **more: {r.row_id: r for r in ch.standardise(i, e, d, tx.ABBREVIATIONS, rerank, **more).collect()}
    by_table = run(lambda c: c.withColumn("rerank", rule(F.col("entry_id"))))
    by_expression = run(lambda x: rule(x["entry_id"]), by_expression=True)
    assert by_table == by_expression and len(by_table) == 200
    assert {r.error for r in by_table.values()} == {None, ch.REJECTED, ch.NO_MODALITY, ch.NOT_CLINICAL}
    assert {r.status for r in by_table.values()} == {"failed", "approved_by_human", "rejected_by_human", "pending"}
    assert {r.by_peer for r in by_table.values()} == {None, False, True}
