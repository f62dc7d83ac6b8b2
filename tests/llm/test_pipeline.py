"""The pipeline's stages, one after the other, against what each must keep."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

SENT = "The quick brown fox number {i} jumps over the lazy dog while {i} wizards watch quietly from hill {j}. "


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = []
    for i in range(60):
        text = "".join(SENT.format(i=i * 7 + k, j=i) for k in range(12))
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    rows += [(100 + i, rows[i][1], "en", "s0", rows[i][4]) for i in range(5)]
    rows += [(200, None, None, None, None), (201, "1234 5678", "en", "s1", 9), (202, "Write to bob@corp.example.com now. " + rows[9][1][:600], "en", "s2", 0)]
    path = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("size", F.lit(1)).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, folder)
        if i < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = docs
    language, dedup, private, mixed, packed = (seen[n] for n, _ in cp.STAGES)
    assert sorted(r.doc_id for r in language.select("doc_id").collect()) == [*range(60), *range(100, 105), 202]
    assert sorted(r.doc_id for r in dedup.select("doc_id").collect()) == [*range(60), 202]
    assert private.filter(F.col("text").contains("bob@corp")).count() == 0 and private.count() == 61
    assert set(r.doc_id for r in packed.select("doc_id").collect()) == set(r.doc_id for r in mixed.select("doc_id").collect())


def test_run(spark, folder):
    assert cp.run(spark, folder).count() > 0 and cp.ORACLE_SQL is None


EDGES = [(None, "A text without an id that is long enough to be read as English by its letters.", "en", "a", 10), (1, None, None, None, None), (2, "", "en", None, 0), (3, "12 34", "de", "b", 5), (3, "12 34", "de", "b", 5), (4, "The same words again and again, as English as it gets, for a while.", "en", "a", 7), (4, "The same words again and again, as English as it gets, for a while.", "en", "a", 7)]


@pytest.mark.parametrize("rows", [[], EDGES])
def test_every_stage_on_empty_tables_and_nulls(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("size", "score", "kind", "rank", "md5")})
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert all(r["size"] == r.score == r.kind == r["rank"] == r.md5 == "x" for r in found)
        if not rows:
            assert not found
    if rows:
        kept = sorted(str(r.doc_id) for r in cp.near_duplicates(spark, docs, folder).collect())
        assert kept == ["1", "3", "4", "None"]
        assert sorted(str(r.doc_id) for r in cp.language(spark, docs, folder).collect()) == ["4", "4", "None"]
        assert cp.personal_data(spark, docs, folder).count() == len(rows)
        assert {str(r.doc_id) for r in cp.mix(spark, docs, folder).collect()} <= {"None", "3", "4"}
    packed = cp.pack(spark, docs, folder)
    assert packed.count() == len(rows) and "sequence_id" in packed.columns
