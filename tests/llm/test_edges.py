"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from tidewater.llm import bpe, decontam, jaccard, langid, quality, toxicity, urlfilter

LONG = "word another third " * 40_000
TEXTS = [
    (1, None),
    (2, ""),
    (3, "a"),
    (4, LONG),
    (5, "same text of six plain words"),
    (5, "same text of six plain words"),
    (6, " \n\t "),
    (None, "no id at all here today"),
    (7, "\x00 odd � \U0001f600 text"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if t else None, "src0", 0, 0.5, "x", "und", 1) for i, t in TEXTS]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, lang_pred string, n_items int",
    )


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("1 = 0")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 0), (4, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_urlfilter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y", "ftp://com/fr/", "http://xcom/de/", "x://example.org", "x://example.org/en/1#z", "x://u:p@b.com:80/de/", "x://casino.net/", "x://org/../"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls[:1])], "page_id int, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[4] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[5] == ("com", "/fr/", "com/fr/", "allow")
    assert got[6] == ("xcom", "/de/", None, "allow")
    assert got[7] == ("example.org", "", None, "allow")
    assert got[8] == ("example.org", "/en/1", "example.org/en/1", "block")
    assert got[9][2] is None and got[9][3] == "allow"
    assert got[10][3] == "block" and got[11][2] == "org/"
    joined = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, inline=0).collect()}
    assert joined == got
    assert urlfilter.judge_urls(pages.filter("1 = 0")).count() == 0
    assert {r["verdict"] for r in urlfilter.judge_urls(pages, rules=()).collect()} == {"allow"}
    long = spark.createDataFrame([(1, "http://example.org/en/1" + "x" * 300_000), (2, "http://a.net/?" + "q=casino&" * 10_000)], "page_id int, url string")
    assert [(r["rule"], r["verdict"]) for r in urlfilter.judge_urls(long).orderBy("page_id").collect()] == [("example.org/en/1", "block"), (None, "allow")]
    with pytest.raises(ValueError):
        urlfilter.judge_urls(pages, rules=(urlfilter.Rule("x", "block", "x", (), 1),))


def test_url_rules_from_a_table(spark):
    rows = [
        ("block", "Example.org/Docs/", None),
        ("allow", "example.org/Docs/Free/", None),
        ("block", None, "C++ Tips"),
        ("block", None, "a.b"),
        ("block", "x.com", None),
        ("allow", "x.com", None),
        ("block", "q.net/a\\Eb/", None),
        ("block", None, " "),
        ("block", "x.com", None),
    ]
    written = spark.createDataFrame(rows, "action string, place string, words string")
    plain = tuple({urlfilter.place_rule(a, p) if p else urlfilter.word_rule(a, w) for a, p, w in rows if p or w.strip()})
    urls = [
        "http://example.org/Docs/x",
        "http://example.org/docs/x",
        "http://www.EXAMPLE.org/Docs/Free/y",
        "http://h/c++-tips",
        "http://h/c-tips",
        "http://h/a.b/",
        "http://h/axb/",
        "http://x.com/",
        "http://x.com",
        "http://q.net/a\\Eb/c",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {}
    for rules in (urlfilter.rules_from(written), plain, urlfilter.rules_table(spark, plain)):
        for inline in (100, 0):
            got[len(got)] = [(r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, rules, inline=inline).orderBy("page_id").collect()]
    assert got[0] == [
        ("Example.org/Docs/", "block"),
        (None, "allow"),
        ("example.org/Docs/Free/", "allow"),
        (None, "block"),
        (None, "allow"),
        (None, "block"),
        (None, "allow"),
        ("x.com", "allow"),
        (None, "allow"),
        ("q.net/a\\Eb/", "block"),
    ]
    assert all(x == got[0] for x in got.values())
    joined = urlfilter.judge_urls(pages, urlfilter.rules_from(written), inline=0)
    assert "Python" not in joined._jdf.queryExecution().toString()
    assert urlfilter.judge_urls(pages, urlfilter.rules_from(written.filter("1 = 0"))).filter("verdict = 'allow'").count() == len(urls)


def test_langid(spark, docs, empty):
    langs, prototypes = langid.learn(docs)
    got = langid.predict(docs, langs, prototypes)
    assert got.columns[-2:] == ["lang_pred", "score"] and got.columns.count("score") == 1
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(TEXTS) and by_id[1]["lang_pred"] == by_id[2]["lang_pred"] == by_id[6]["lang_pred"] == "und" and by_id[3]["lang_pred"] == "en"
    assert langid.learn(empty)[0] == [] and {r["lang_pred"] for r in langid.predict(docs, *langid.learn(empty)).collect()} == {"und"}


def test_quality_and_toxicity(spark, docs, empty):
    for learn, apply in ((quality.learn, quality.score), (toxicity.learn, toxicity.score)):
        for table in (docs, empty):
            model = learn(table, labels(spark))
            rows = apply(docs, model).collect()
            assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
            assert apply(empty, model).count() == 0
        assert apply(docs, learn(docs, labels(spark).filter("1 = 0"))).count() == len(TEXTS)


def test_bpe(docs, empty):
    path = bpe.default_path()
    out = bpe.decode(bpe.encode(docs, path), path).collect()
    assert all((r["text"] or "") == r["decoded"] for r in out)
    assert {len(r["token_ids"]) for r in out if not r["text"]} == {0}
    assert bpe.round_trip(empty, path).count() == 0 and bpe.codec(path).decode_batch([[-1, 99_999_999]]) == [""]


def test_decontam(spark, docs, empty):
    items = spark.createDataFrame(
        [(1, "plain words"), (2, None), (3, ""), (None, "no id at all here today"), (1, "plain words"), (4, "word another third " * 10)],
        "item_id long, text string",
    )
    got = {r["doc_id"]: r for r in decontam.find(docs, items).collect()}
    assert got[1]["n_words"] == got[2]["n_hit"] == 0 and not got[1]["contaminated"]
    assert (got[5]["n_hit"], got[5]["n_items"], got[5]["items"]) == (2, 1, ["1"]) and got[5]["contaminated"]
    assert got[4]["n_hit"] == got[4]["n_words"] == 120_000 and got[None]["n_hit"] == 6
    many = {r["doc_id"]: r for r in decontam.find(docs, items, block_chars=40).collect()}
    assert many == got
    assert {r["n_items"] for r in decontam.find(docs, items.filter("1 = 0")).collect()} == {0} and decontam.find(empty, items).count() == 0


def test_jaccard(spark, docs, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 3, 4), (5, 2, 5), (6, 0, 6), (7, 1, 7)} <= got
    assert jaccard.near_duplicates(empty).count() == 0
    kept = jaccard.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.filter("doc_id = 5").count() == 1 and kept.filter(F.col("doc_id").isNull()).count() == 1


def test_decontam_stage_leaves_clashing_columns(spark, tmp_path):
    """What the documents bring along stays, whatever it is called."""
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    spark.createDataFrame([(1, item)], "item_id int, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = [(1, None), (2, ""), (3, item), (4, "a clean text"), (4, "a clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' AS n_words", "7 AS n_hit", "'i' AS items", "'no' AS contaminated", "'s' AS _state", "1.5 AS items_sha256", "2 AS n_items")
    kept = decontam.stage(spark, docs, f"file://{tmp_path}")
    assert kept.dtypes == docs.dtypes and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 4]
    assert set(kept.drop("doc_id", "text").collect()) == set(docs.drop("doc_id", "text").limit(1).collect())
    assert decontam.stage(spark, docs.filter("1 = 0"), f"file://{tmp_path}").count() == 0
