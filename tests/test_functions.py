"""Functions and operators that SQL can't express, by worked examples."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import ids, pages, sections, text
from tidewater.operators import analytics, documents, joins, retrieval, sources


def test_previous_section(spark):
    cases = {"5.3.2": "5.3.1", "5.3": "5.2", "5.3.1": "5.2", "5.1": "4", "1.1": "1", "1": "1", "7": "6"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r[0]: r[1] for r in df.select("s", ids.previous_section(F.col("s"))).collect()} == cases


def test_numerals():
    assert [pages.to_roman(n) for n in (1, 4, 9, 14, 40, 399)] == ["i", "iv", "ix", "xiv", "xl", "cccxcix"]
    assert pages.from_roman("XIV") == 14 and pages.from_roman("abc") is None


def test_page_labels():
    starts = [k * 100 for k in range(14)]
    found = [(210, "i"), (310, "ii"), (610, "3"), (710, "4"), (1010, "7"), (1310, "10")]
    assert pages.sync_pages(found, starts) == ["", "", "i", "ii", *map(str, range(1, 11))]
    assert pages.sync_pages([], starts[:3]) == ["1", "2", "3"]
    assert pages.sync_pages([(110, "ii"), (510, "3")], starts[:7]) == ["i", "ii", "iii", "1", "2", "3", "4"]
    body = "".join(f"--- Page {k} start ---\nsome words\nPage {k} |\n" for k in range(1, 4))
    assert pages.label_pages(body, "TAIC")[0].startswith("<< Page 1 >>\nsome words\nPage 1 |\n<< Page 2 >>")
    assert pages.printed_numbers("- 3 -\nx\n- 4 -", "TSB") == [(0, "3"), (8, "4")]
    with pytest.raises(ValueError):
        pages.printed_numbers("x", "?")


def test_contents_and_sections():
    body = "Contents of it\nlist ........ 1\n1.1 First ...... 2\n1.2 Second ...... 3\n" + "prose " * 200
    start, end = sections.contents_span(body)
    assert start == 0 and body[:end].endswith("3")
    assert sections.contents_span("nothing here") is None
    far = "word " * 2000 + "Contents of it\nlist ........ 1\n" + "prose " * 200
    assert sections.contents_span(far) is None
    told = "<< Page 1 >>\n" + "\n".join(f"{a}.{b} words of part {a} and {b}" for a in (1, 2) for b in (1, 2, 3))
    assert [n for n, _ in sections.sections(told)] == ["1.1", "1.2", "1.3", "2.1", "2.2"]
    assert sections.sections("<< Page 4 >> one\n\ntwo\n\n\n<< Page 5 >> three") == [
        ("p4.0", "<< Page 4 >> one"),
        ("p4.1", "two"),
        ("p5.0", "<< Page 5 >> three"),
    ]
    assert sections.sections(None) == []


def test_numbered_sections():
    lines = lambda *numbers: "\n".join(f"{n} words on {n.replace('.', ' and ')}" for n in numbers)
    found = lambda text: [n for n, _ in sections.numbered_sections(text)]
    # Paragraphs without a heading of their section; the last of each section has no end.
    assert found(
        lines("1.1.1", "1.1.2", "1.1.3", "1.2.1", "1.2.2", "1.2.3", "1.3.1", "1.3.2", "1.3.3"),
    ) == ["1.1.1", "1.1.2", "1.2.1", "1.2.2", "1.3.1", "1.3.2"]
    # A part that begins with its second section.
    assert found(lines("1.2", "1.3", "1.4", "1.5", "1.6", "1.7")) == ["1.2", "1.3", "1.4", "1.5", "1.6"]
    # One missing section of a part is stepped over, a second one ends the part.
    assert found(lines("1.1", "1.2", "1.4", "1.5", "1.7", "2.1", "2.2", "2.3")) == ["1.1", "1.2", "1.4", "1.5", "2.1", "2.2"]
    # The earliest follower ends a section, also where a later one stands before the next.
    odd = "1.1 a\n1.3 b\n1.4 c 1.2 d\n" + lines("2.1", "2.2", "2.3", "2.4", "2.5", "2.6")
    assert sections.numbered_sections(odd)[0] == ("1.1", "1.1 a") and found(odd) == ["1.1", "2.1", "2.2", "2.3", "2.4", "2.5"]
    assert found("just 1.1 one and\n1.9 nine") == []
    # Headings within a line, measures, entries of the contents list, a full stop behind the number.
    told = "1.1 ...... 3\n1.2 ..... 4\n" + "x" * 120 + "\n<< Page 1 >>\nSee 1.2 m of rope. 1.1. Start of it 1.2 next\n1.3 third\n1.4 fourth\n1.5 fifth\n1.6 sixth\n2.1 end"
    assert sections.numbered_sections(told)[:2] == [("1.1", "1.1. Start of it"), ("1.2", "1.2 next")]
    assert [sections.previous_number(n) for n in ("5.3.2", "5.3.1", "5.3", "5.1", "1.1", "1")] == ["5.3.1", "5.2", "5.2", "4", "1", "1"]


def test_issue_statements(spark):
    rows = [
        "Safety issue: the brake\nfailed 2.1 more",
        "S a f e t y issues - one safety issue - two 3.2.1",
        "safety issue: a Safety issue - b safety issue: c 1.",
        "safety issue: never ended",
        "none",
        None,
    ]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(text.issue_statements(F.col("t"))).collect()]
    assert got == [["the brake\nfailed "], ["one ", "two "], ["a ", "c "], [], [], None]


def test_reply_categories(spark):
    cases = {"We accept it": "accepted", "accepted and implemented": "accepted and implemented", "under review": "under consideration", "REJECTED, was considered": "rejected", "unacceptable, misunderstood": "n/a", "": "n/a"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.reply_category(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_label_validity(spark):
    many = [pages.to_roman(k) for k in range(1, 42)]
    cases = [
        ([], False),
        ([""], False),
        (["", "i", "ii", "1", "2"], True),
        ([*many, "1"], True),
        ([*many, "42"], True),
        ([*many, "43"], False),
        (["1", "", "2"], False),
        (["i", "iii", "1"], False),
        (["1", "3"], False),
        (["2", "3"], True),
        (["1", "i"], False),
    ]
    got = documents.validate_labels(spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "report_id int, labels array<string>")).collect()
    assert {r["report_id"]: r["valid"] for r in got} == {k: v for k, (_, v) in enumerate(cases)}


def test_yaml(spark):
    df = spark.createDataFrame([("```yaml\n- safety_issue: a\n  quality: exact\n```",), ("not: [",), (None,)], "t string")
    got = [r[0] for r in df.select(documents.issues_from_yaml("t")).collect()]
    assert got[0][0]["safety_issue"] == "a" and got[1] is None and got[2] is None


def test_batches(spark):
    df = spark.createDataFrame([(f"r{i}", 10 * (i + 1)) for i in range(9)] + [("none", None)], "k string, w int")
    for shard_rows in (10_000, 3):
        rows = documents.lpt_batches(df, "k", "w", 3, shard_rows).collect()
        load = {}
        for r in rows:
            load[r["batch"]] = load.get(r["batch"], 0) + (10 * (int(r["k"][1:]) + 1) if r["k"] != "none" else 0)
        assert len(rows) == 10 and set(load) == {0, 1, 2} and max(load.values()) - min(load.values()) <= (20 if shard_rows > 10 else 100)
    assert documents.lpt_batches(df.filter("1 = 0"), "k", "w", 3).count() == 0


def test_search_settings(spark):
    s = retrieval.SearchSettings(document_types=("report_text", "section"))
    assert s.document_types == ("summary", "section")
    for bad in ({"modes": ("9",)}, {"years": (2010, 2000)}, {"agencies": ("X",)}):
        with pytest.raises(ValueError):
            retrieval.SearchSettings(**bad)
    assert [retrieval.search_type(q) for q in (" ", '"a b"', "a b", '"')] == ["none", "fts", "vector", "vector"]
    found = retrieval.plan(spark, "/root/testdata/sf0.001", '"reserved"', retrieval.SearchSettings())
    assert found.count() >= 0 and "relevance" in found.columns


def test_index_recall(spark):
    got = {r["probes"]: r["recall"] for r in retrieval.QUERIES["ivf_recall"](spark, "/root/testdata/sf0.01").collect()}
    print(got)
    assert sorted(got) == list(range(1, 17)) and got[16] == 1.0 and all(got[k] <= got[k + 1] for k in range(1, 16))


def test_link_upgrade(spark):
    rows = [("r", "a", "1", "Possible"), ("r", "a", "2", "None"), ("r", "b", "1", "Confirmed"), ("r", "b", "2", "Possible")]
    got = joins.upgrade_links(spark.createDataFrame(rows, "report_id string, recommendation_id string, safety_issue_id string, link string"))
    assert {(r[1], r[2]): r[3] for r in got.select("report_id", "recommendation_id", "safety_issue_id", "link").collect()} == {("a", "1"): "Confirmed", ("a", "2"): "None", ("b", "1"): "Confirmed", ("b", "2"): "Possible"}


def test_null_safe_filter_and_top(spark):
    df = spark.createDataFrame([(None,), ("short",), ("full",)], "t string")
    assert df.filter(~F.col("t").eqNullSafe("short")).count() == 2
    assert {r["t"]: r["n"] for r in analytics.top_with_others(df, "t").collect()} == {"short": 1, "full": 1, "Others": 0}


def test_stage_tables_and_versions(spark, tmp_path):
    assert sources.stage_table(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sources.stage_table(spark, str(tmp_path / "none"), "a int", required=True)
    listing = spark.createDataFrame([("2024-01-02_03:04:05/a",), ("2024-01-02_03:04:06/b",), ("notes/c",)], "path string")
    assert sources.latest_version(listing).first()[0] == "2024-01-02_03:04:06"
    (tmp_path / "t.csv").write_text('Value,mode\n"Fire, smoke",rail\n')
    assert sources.event_types(spark, str(tmp_path / "t.csv")).first()["Value"] == "Fire, smoke"
