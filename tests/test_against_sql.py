"""Rows on which queries differed from their SQL."""

import duckdb
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.operators import documents, gathering, page_fields, table_functions


def test_key_words_end_at_other_letters(spark):
    cases = {"mit underäverber": "under consideration", "éaccepted": "accepted", "rejected_": "n/a", "2rejected": "n/a", "(rejected)": "rejected"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.reply_category(F.col("t"))).collect()
    assert {t: c for t, c in got} == cases


def test_numbered_lines_are_trimmed(spark, tmp_path):
    rows = [(0, "  one \ntwo  ", "s", "en"), (1, " one\n two ", "s", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    told = {r["report_id"]: r["told"] for r in documents.numbered_texts(spark, str(tmp_path)).collect()}
    assert told == {"TAIC_a_2000_000000": "1.1 one\n1.2 two", "ATSB_a_2001_000001": "1.1.1  one\n1.1.2  two"}
    for query in (documents.q_extract_sections, table_functions.q_sections_lateral):
        assert {(r["report_id"], r["section"], r["section_text"]) for r in query(spark, str(tmp_path)).collect()} == {(k, "p0.0", v) for k, v in told.items()}


def test_references_without_semicolon(spark, tmp_path):
    html = "<html><head><title>a &amp; b &#38;&lt c &amp</title></head><body><div class='ad'>x & y &copy;</div></body></html>"
    spark.createDataFrame([(1, "https://a.example/", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r["field"], r["value"]) for r in page_fields.q_page_fields(spark, str(tmp_path)).collect()}
    assert got == {("title", "a & b &&lt c &amp"), ("advert", "x & y ©")}


def test_summaries_of_odd_texts(spark, tmp_path):
    odd = ["", " ", "\n", "a ", "a\n", " a", "a\u00a0b", "\u00a0", "a\x0bb", "\x1ca", "a\u2003", "a\x85 b", "a\u3000\n", None, "a &amp; b <p>c</p> &lt", "<h2>Summary</h2>x", "a\r\n b\f", "\x00a", "&", "]]> -->"]
    rows = [(i * 3 + k, t, "s", "en") for i, t in enumerate(odd) for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(gathering.ORACLES["summary_block"]).fetchall()
    assert sorted(gathering.q_summary_block(spark, str(tmp_path)).collect()) == sorted(want)
