"""What depends on a name is found once for each different name, whatever is asked of it later."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from termloom.operators.distinct import once_each
from termloom.operators.retrieval import rerank


@pytest.mark.parametrize("later", ["join", "filter"])
def test_names_are_worked_on_once(spark, later):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def upper(names: pd.Series) -> pd.Series:
        seen.add(len(names))
        return names.str.upper()

    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 != 9, F.concat(F.lit("n"), F.col("id") % 10)).alias("name"))
    got = once_each(rows, ["name"], lambda names: names.withColumn("up", upper("name")))
    assert got.count() == 1000 and got.filter("name is null").count() == 100  # nulls are a name like others
    seen.value = 0
    if later == "join":
        assert got.join(spark.createDataFrame([("N1",)], "up string"), "up").count() == 100
    else:
        assert got.filter("up = 'N1'").count() == 100
    assert seen.value <= 20


def test_patterns_stay_above_the_distinct_names(spark):
    """Filters on join keys used to bring all patterns down to the scan, for every row of a file in one task."""
    import __spark_entry__ as entry

    def lines(name):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        return [(len(x) - len(x.lstrip(" :+-")), x) for x in plan.splitlines()]

    for name in ("g30_peer_same_concept", "g31_peer_in_catalogue", "g1_g20_component_score", "f5_complexity_reorder"):
        rows = lines(name)
        for i, (depth, text) in enumerate(rows):
            if "RLIKE" in text:
                below = []
                for d, t in rows[i + 1 :]:
                    if d <= depth:
                        break
                    below.append(t)
                assert any("Generate" in t for t in below), (name, text[:200])


def test_every_row_of_an_exam_is_reranked(spark, tmp_path):
    """Names repeat every 4,620 parts. Of rows with equal exams, only the first used to have scores."""
    import duckdb

    import __spark_entry__ as entry

    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    p = spark.read.parquet(f"{sf}/part.parquet").limit(40)
    p.unionByName(p.withColumn("p_partkey", F.col("p_partkey") + 4620)).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{sf}/supplier.parquet").write.parquet(f"{tmp_path}/supplier.parquet")
    for name in ("part", "supplier"):
        c.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    expected = sorted(c.sql(entry.oracle_sql()["k2_rerank"]).select("row_id", "entry_id", "rerank").fetchall())
    got = sorted(tuple(r) for r in entry.queries()["k2_rerank"](spark, str(tmp_path)).select("row_id", "entry_id", "rerank").collect())
    assert {r[0] for r in got} & set(range(4620)) and {r[0] for r in got} & set(range(4620, 9240))
    assert [r[:2] for r in got] == [r[:2] for r in expected] and [r[2] for r in got] == pytest.approx([r[2] for r in expected])


def test_a_model_is_asked_once_for_each_key(spark):
    data = [("CT", None, 1, 1, "b"), ("CT", None, 2, 0, "aa"), ("MR", "x", 2, 0, "aa")]
    c = spark.createDataFrame(data, "code string, exam string, entry_id long, cand_pos int, cat_text string").withColumn("in_text", F.lit("q"))
    got = {(r.code, r.exam, r.entry_id): r.rerank for r in rerank(c, lambda q, docs: [len(d) + len(docs) / 10 for d in docs], ["code", "exam"]).collect()}
    assert got == {("CT", None, 1): 1.2, ("CT", None, 2): 2.2, ("MR", "x", 2): 2.1}
