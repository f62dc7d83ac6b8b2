"""Columns of empty tables equal those of full ones; rows without an id."""

import pytest
from pyspark.sql import functions as F

from termloom.llm import fingerprints, neardup, quality, urls, warc
from termloom.llm.common import shared_folder
from termloom.llm.queries import URL_RULES

DOCS = [(1, "some words of a text\nand more of them", "s"), (None, None, None)]
PAGES = [(1, "http://a.com/x", "<p>"), (None, None, None), (None, "http://b.net/es/1", "<p>")]


@pytest.mark.parametrize("make", [
    lambda s, d, p: fingerprints.fingerprints(d), lambda s, d, p: neardup.classes(d), lambda s, d, p: warc.round_trip(p, shared_folder(s)), lambda s, d, p: urls.judge(p, urls.rule_table(s, URL_RULES)),
])
def test_empty_tables_have_the_same_columns(spark, make):
    d, p = spark.createDataFrame(DOCS, "doc_id long, text string, source string"), spark.createDataFrame(PAGES, "page_id long, url string, html string")
    full, none = make(spark, d, p), make(spark, d.limit(0), p.limit(0))
    assert none.count() == 0 and none.dtypes == full.dtypes and full.count() in (len(DOCS), len(PAGES))


def test_urls_without_a_page_id(spark):
    p = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(p, urls.rule_table(spark, URL_RULES)).collect()}
    assert got == {(1, "a.com", "/x", "com/", "allow"), (None, "", "", None, "allow"), (None, "b.net", "/es/1", "net/es/", "block")}


@pytest.mark.parametrize("end", ["\n", "\r\n", " \t\n", "\x0b\n", "\x0c\n"])
def test_white_space_before_a_line_break_closes_no_line(spark, end):
    text = end.join(["Hello there.", "Home", "A line of several words"])
    lost = spark.createDataFrame([(1, text)], "doc_id int, text string").select(quality.words_in(quality.failed_lines(F.col("text"))).alias("n")).first().n
    assert lost == 1
