"""Files, pages, crawls, workbooks and models, by worked examples."""

import io
import zipfile
import zlib
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import analytics, gathering, joins, retrieval
from tidewater.plans import providers, workbook
from tidewater.plans.catalog import Catalog
from tidewater.sources import crawl, files


def pdf(*pages, deflate=True):
    out = [b"%PDF-1.4"]
    for k, page in enumerate(pages):
        raw = b"BT /F1 12 Tf " + b" T* ".join(b"(" + x.encode("latin-1").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)") + b") Tj" for x in page) + b" ET" if page is not None else b"broken"
        body = zlib.compress(raw) if deflate and page is not None else raw
        head = b"<< /Length %d /Filter /FlateDecode >>" % len(body) if deflate else b"<< /Length %d >>" % len(body)
        out.append(b"%d 0 obj\n%s\nstream\n%s\nendstream\nendobj" % (k + 1, head, body))
    return b"\n".join(out)


def test_pdf_texts(spark, tmp_path):
    (tmp_path / "TAIC_a_2001_001.pdf").write_bytes(pdf(["First (page)", "two \\ lines"], None, ["third"]))
    (tmp_path / "plain.pdf").write_bytes(pdf(["no filter"], deflate=False))
    (tmp_path / "other.txt").write_text("x")
    got = {r["report_id"]: (r["text"], r["n_pages"]) for r in files.pdf_texts(spark, f"file://{tmp_path}").collect()}
    assert got["TAIC_a_2001_001"] == ("\n\n--- Page 1 start ---\nFirst (page)\ntwo \\ lines\n\n--- Page 2 start ---\n\n\n--- Page 3 start ---\nthird", 3)
    assert got["plain"] == ("\n\n--- Page 1 start ---\nno filter", 1) and len(got) == 2

    class Broken:
        def pages(self, content):
            raise RuntimeError("unreadable")

    assert {r["text"] for r in files.pdf_texts(spark, f"file://{tmp_path}", Broken()).collect()} == {None}


def test_office_tables(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook.workbook({"One": [["id", "name"], [1, "a <b>"], [2.5, None]], "Two": [["x"], ["y"]]}))
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda x: f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"
    rows = "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in (("n", "m"), ("p", "q")))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:tbl>{rows}</w:tbl></w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(raw.getvalue())
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    got = {tuple(r) for r in files.office_tables(spark, f"file://{tmp_path}").collect()}
    assert got == {("b.xlsx", 0, 0, "id", "1"), ("b.xlsx", 0, 0, "name", "a <b>"), ("b.xlsx", 0, 1, "id", "2.5"), ("b.xlsx", 0, 1, "name", ""), ("b.xlsx", 1, 0, "x", "y"), ("c.docx", 0, 0, "n", "p"), ("c.docx", 0, 0, "m", "q")}
    assert {r["file"] for r in files.office_tables(spark, f"file://{tmp_path}", [1]).collect()} == {"b.xlsx"}


def test_yaml_files(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("- query: a\n  expected_reports: [r1, r2]\n  settings: {min_year: 2000, modes: [0]}\n- query: b\n")
    rows = files.evaluation_searches(spark, f"file://{tmp_path}/s.yaml").collect()
    assert [(r["query"], r["expected_reports"], r["min_year"], r["modes"], r["cutoff"]) for r in rows] == [("a", ["r1", "r2"], 2000, [0], 0.0), ("b", [], None, None, 0.0)]
    (tmp_path / "c.yaml").write_text("engine:\n  agencies: [TAIC]\n")
    assert files.configuration(spark, f"file://{tmp_path}/c.yaml") == {"engine": {"agencies": ["TAIC"]}}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.configuration(spark, f"file://{tmp_path}/none.yaml")


class Site:
    """Two pages of ids, then the last again; one page fails at first."""

    def __init__(self):
        self.failed = False

    def get(self, url):
        if url.endswith("flaky/1") and not self.failed:
            self.failed = True
            raise OSError("reset")
        if "gone" in url:
            return 404, ""
        page = int(url.rpartition("/")[2])
        return (200, " ".join(f"{url.split('/')[2]}-{k}" for k in range(min(page, 2) * 2))) if page < 9 else (500, "")


def test_crawl(spark):
    listings = spark.createDataFrame([("a", "x://a/{page}"), ("f", "x://flaky/{page}"), ("g", "x://gone/{page}")], "listing string, url string")
    got = sorted(tuple(r) for r in crawl.crawl(listings, Site(), str.split, pause=0).collect())
    assert got == [
        ("a", 1, "a-0"),
        ("a", 1, "a-1"),
        ("a", 2, "a-2"),
        ("a", 2, "a-3"),
        ("f", 1, "flaky-0"),
        ("f", 1, "flaky-1"),
        ("f", 2, "flaky-2"),
        ("f", 2, "flaky-3"),
    ]
    urls = spark.createDataFrame([("x://a/1",), ("x://gone/1",), ("x://a/9",)], "url string")
    assert [r["outcome"] for r in crawl.fetched(urls, Site(), pause=0).collect()] == ["ok", "missing", "failed"]


def test_workbook_and_publish(spark, tmp_path):
    results = spark.createDataFrame([("r1", 0.5), ("r2", 0.25)], "report_id string, relevance double").orderBy("report_id")
    (tmp_path / "out.xlsx").write_bytes(workbook.result_workbook(results, {"Query": "a & b"}))
    got = {(r["table"], r["row"], r["column"], r["text"]) for r in files.office_tables(spark, f"file://{tmp_path}/out.xlsx").collect()}
    assert got == {(0, 0, "Query", "Results"), (0, 0, "a & b", "2"), (1, 0, "report_id", "r1"), (1, 0, "relevance", "0.5"), (1, 1, "report_id", "r2"), (1, 1, "relevance", "0.25")}
    to = workbook.publish(spark, f"file://{tmp_path}/out.xlsx", f"file://{tmp_path}/store", datetime(2024, 1, 31, 12, tzinfo=timezone.utc))
    assert to.endswith("2024-02-01_01-00-00") and [p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")] == ["2024-02-01_01-00-00"]
    with pytest.raises(Exception):
        workbook.publish(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/store")


def test_compaction(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    for k in range(2):
        c.write(spark.range(100 + k).repartition(8), "t")
    c.compact("t", days=1)
    assert len(c.versions("t")) == 3 and c.read("t").count() == 101 and len(c.read("t").inputFiles()) == 1
    c.compact("t", days=0)
    assert len(c.versions("t")) == 1 and c.read("t").count() == 101


class Scripted:
    """Gives its replies one after the other; an exception is raised."""

    def __init__(self, *replies):
        self.replies, self.warmth = list(replies), []

    def query(self, system, user, temperature=0.0, max_tokens=1024):
        self.warmth.append(temperature)
        got = self.replies.pop(0)
        if isinstance(got, Exception):
            raise got
        return got


def test_models(spark):
    assert providers.ask(Scripted(ConnectionError(), "a", "b"), "", "", n=2, pause=0) == ["a", "b"]
    assert providers.ask(Scripted(None), "", "") is None and providers.ask(Scripted(), "x" * 600_000, "") is None
    with pytest.raises(ConnectionError):
        providers.ask(Scripted(*[ConnectionError()] * 3), "", "", pause=0)
    twice = Scripted(
        "- {safety_issue: a, quality: exact}\n- {safety_issue: a, quality: exact}",
        "not: [",
        "```yaml\n- {safety_issue: ' a ', quality: exact}\n```",
    )
    assert providers.extract_issues(twice, "", "") == [{"safety_issue": "a", "quality": "exact"}] and twice.warmth == [0, 0.01, 0.02]
    assert providers.extract_issues(Scripted(*["x"] * 10), "", "") is None and providers.extract_issues(Scripted(None), "", "") is None
    assert providers.recommendations_from("None") is None and providers.recommendations_from(None) is None and providers.recommendations_from("[") is None
    assert providers.recommendations_from(
        "- recommendation: |\n    do it\n  made: 2001-02-03",
    )[0] == {"recommendation": "do it", "recommendation_id": None, "recommendation_context": None, "recipient": None, "made": "2001-02-03"}
    assert providers.tidy_contents(Scripted("```\n1 a 2\n```"), "1 a .. 2") == "1 a 2" and providers.tidy_contents(None, "raw") == "raw"
    df = spark.createDataFrame([("What failed?\nthe brake failed\nrain", 1), (None, 2)], "prompt string, answers int")
    got = providers.answer_column(df, {"m": providers.ExtractiveModel(1)}, "m", "", "prompt", n=2).collect()
    assert [r["answers"] for r in got] == [["the brake failed"] * 2, None]
    with pytest.raises(ValueError, match="unknown model"):
        providers.answer_column(df, {}, "m", "", "prompt")


def test_settings_titles_and_samples(spark):
    df = spark.createDataFrame([("['a', \"b c\", -1]",), ("[]",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(gathering.list_setting(F.col("t"))).collect()] == [["a", "b c", "-1"], [], None, None]
    df = spark.createDataFrame([([" a ", "", None, "2 b"], "1 May"), (["x"], None)], "p array<string>, d string")
    assert [r[0] for r in df.select(gathering.joined_title(F.col("p"), F.col("d"))).collect()] == ["a, 2 b, 1 May", "x"]
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("x"))
    some = gathering.rows_with_nulls(rows, "id").collect()
    assert len(some) == 200 and all(r["x"] is None for r in some) and gathering.rows_with_nulls(rows.filter("id < 10"), "id").count() == 5


def test_nearest_rows_in_blocks(spark):
    r = np.random.default_rng(1)
    rows = r.standard_normal((300, 5))
    rows[40:60] = rows[0]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(900, [0.0] * 5), (901, None)], "vec_id long, embedding array<double>")
    queries = docs.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = set()
    for q in range(0, 300, 10):
        order = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(300) if i != q)[:7]
        want |= {(q, i, k + 1) for k, (_, i) in enumerate(order)}
    for values in (1_000_000, 40):
        got = {(x["query_id"], x["vec_id"], x["rank"]) for x in retrieval.knn(docs, queries, 7, block_values=values).collect()}
        assert got == want
    assert retrieval.knn(docs, queries.filter("1 = 0"), 7).count() == 0 and retrieval.knn(docs.filter("1 = 0"), queries, 7).count() == 0
    assert retrieval.bm25(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), []).count() == 0


def test_quantiles_and_first_ranks(spark):
    r = np.random.default_rng(2)
    values = {"a": [1.0] * 50, "b": r.standard_normal(501).tolist(), "c": [3.0], "d": np.round(r.exponential(10, 400)).tolist()}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("e", None)], "k string, x double")
    got = {x["k"]: x for x in analytics.describe_by(df, "k", "x").collect()}
    for k, v in values.items():
        assert np.allclose([got[k]["p25"], got[k]["p50"], got[k]["p75"]], np.quantile(v, [0.25, 0.5, 0.75]), atol=1e-6)
    assert got["e"]["n"] == 0 and got["e"]["p50"] is None
    rows = spark.createDataFrame([("q", m, s) for m, s in (("x", 3), ("y", 5), ("x", 9), ("z", 1), ("y", 9))], "query string, report string, score int")
    ranks = analytics.first_ranks(rows, "query", "report", -F.col("score"), F.col("report"))
    assert {(x["report"], x["first_rank"]) for x in ranks.collect()} == {("x", 1), ("y", 2), ("z", 5)}
    pairs = joins.worded_pairs(
        spark.createDataFrame([("r", "1", "A b c")], "report_id string, recommendation_id string, recommendation string"),
        spark.createDataFrame([("r", "2", "b C d"), ("r", "3", None)], "report_id string, safety_issue_id string, safety_issue string"),
    )
    assert {x["safety_issue_id"]: x["score"] for x in pairs.collect()}["2"] == 0.5
