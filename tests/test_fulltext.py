"""Stems against a plain version and the SQL, folding, positional postings against plain search."""

import random
import re
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.functions import analysis
from tidewater.operators import fulltext, retrieval
from tidewater.plans.catalog import Catalog
from tidewater.plans.index import SearchIndex, postings_of

DIR = "/root/testdata/sf0.001"
VOWELS = "aeiouy"


def plain_stem(word):
    """The published rules step by step, on positions of a string."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    if word in analysis.IRREGULAR:
        return analysis.IRREGULAR[word]
    w = list(word)
    for i, c in enumerate(w):
        if c == "y" and (i == 0 or w[i - 1] in VOWELS):
            w[i] = "Y"
    w = "".join(w)

    def region(start):
        for i in range(start + 1, len(w)):
            if w[i] not in VOWELS and w[i - 1] in VOWELS:
                return i + 1
        return len(w)

    p1 = next((len(b) for b in analysis.BEGINNINGS if w.startswith(b)), None) or region(0)
    p2 = region(p1)
    short = lambda s: (len(s) == 2 and s[0] in VOWELS and s[1] not in VOWELS) or (len(s) > 2 and s[-1] not in VOWELS + "wxY" and s[-2] in VOWELS and s[-3] not in VOWELS)
    longest = lambda suffixes: next((s for s in sorted(suffixes, key=len, reverse=True) if w.endswith(s)), None)
    voiced = lambda s: any(c in VOWELS for c in s)

    end = longest(["sses", "ied", "ies", "us", "ss", "s"])
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and voiced(w[:-2]):
        w = w[:-1]
    if w in analysis.FINAL:
        return w
    end = longest(["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= p1:
            w = w[: -len(end)] + "ee"
    elif end and voiced(w[: -len(end)]):
        w = w[: -len(end)]
        if w[-2:] in ("at", "bl", "iz"):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif p1 >= len(w) and short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for table in (analysis.STEP_2, analysis.STEP_3):
        end = longest(table)
        if end is not None and len(w) - len(end) >= p1:
            rest = w[: -len(end)]
            if not (end == "ogi" and not rest.endswith("l") or end == "li" and rest[-1:] not in set("cdeghkmnrt") or end == "ative" and len(rest) < p2):
                w = rest + table[end]
    end = longest(analysis.STEP_4)
    if end is not None and len(w) - len(end) >= p2 and (end != "ion" or w[-4] in "st"):
        w = w[: -len(end)]
    if w[-1] == "e" and (len(w) - 1 >= p2 or (len(w) - 1 >= p1 and not short(w[:-1]))) or w[-1] == "l" and len(w) - 1 >= p2 and w[-2] == "l":
        w = w[:-1]
    return w.lower()


#: Words with their published stems.
KNOWN = {
    "consign": "consign", "consigned": "consign", "consistency": "consist", "consolation": "consol", "consolatory": "consolatori",
    "knightly": "knight", "knots": "knot", "kneeling": "kneel", "generously": "generous", "communication": "communic",
    "relational": "relat", "hopping": "hop", "hoping": "hope", "cries": "cri", "ties": "tie", "by": "by", "say": "say", "cry": "cri",
    "luxuriated": "luxuri", "luxuriating": "luxuri", "agreed": "agre", "feed": "feed", "caresses": "caress", "gas": "gas", "this": "this",
    "gaps": "gap", "kiwis": "kiwi", "adoption": "adopt", "adjustment": "adjust", "effective": "effect", "rate": "rate", "controlling": "control",
    "rolled": "roll", "skies": "sky", "news": "news", "inning": "inning", "innings": "inning", "youth": "youth", "boyish": "boyish",
}


def made_words(n=4000):
    rng = random.Random(8)
    ends = [*analysis.STEP_2, *analysis.STEP_3, *analysis.STEP_4, "s", "sses", "ies", "ied", "us", "ed", "ing", "eed", "eedly", "edly", "ingly", "y", "e", "l", "ll", "e's"]
    starts = ["hop", "gener", "commun", "arsen", "y", "yy", "ay", "tr", "bl", "relat", "control", "a", "be", "sky", "on", "st", "oo", "log", "rat", "nt"]
    return ["".join(rng.choice(starts) for _ in range(rng.randint(1, 3))) + "".join(rng.choice(ends) for _ in range(rng.randint(0, 3))) for _ in range(n)]


def test_stems(spark):
    for word, want in KNOWN.items():
        assert plain_stem(word) == want, word
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select(F.explode(analysis.words(F.col("text"))).alias("term")).distinct()
    extra = spark.createDataFrame([(w,) for w in [*KNOWN, *made_words(), *analysis.IRREGULAR, *analysis.FINAL, "", "a", "ab", "été", "naïve", "x1ing"]] + [(None,)], "term string")
    terms = docs.union(extra)
    got = {r["term"]: r["stem"] for r in analysis.stems(terms).collect()}
    assert got.pop(None) is None
    assert {t: s for t, s in got.items() if s != plain_stem(t)} == {}
    con = duckdb.connect()
    con.register("terms", terms.filter("term is not null").toPandas())
    assert dict(con.execute(f"WITH {analysis.stem_sql('terms')} SELECT term, stem FROM stems").fetchall()) == got


def test_folding(spark):
    letters = "".join(chr(c) for c in range(0xA1, 0x250) if chr(c) not in "İ")
    texts = ["Crème BRÛLÉE, naïve Ærø; straße № 5", "café été", "ﬁ x²", "Ελλάδα мир 漢字", None, "", letters]
    got = [r["w"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(analysis.words(F.col("t")).alias("w")).collect()]
    assert got[0] == ["creme", "brulee", "naive", "aero", "strasse", "5"] and got[1] == ["cafe", "ete"] and got[4] is None and got[5] == []
    con = duckdb.connect()
    for t, w in zip(texts, got, strict=True):
        if t != letters:
            assert con.execute(f"SELECT {analysis.words_sql('t')} FROM (SELECT ?::VARCHAR AS t)", [t]).fetchone()[0] == w
    base = lambda c: "".join(x for x in unicodedata.normalize("NFD", c.lower()) if not unicodedata.combining(x))
    folded = dict(zip(*analysis.accents(), strict=True))
    assert all(folded.get(c.lower(), c.lower()) == base(c) for c in letters if len(base(c)) == 1) and folded["é"] == "e" and folded["ά"] == "α"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "vec_id long, document string")


def test_postings(spark):
    texts = ["a b a a", None, "", "b", "c a " * 5000, "a b a a"]
    cut = docs_of(spark, texts).select("vec_id", analysis.words(F.col("document")).alias("w"))
    got = {(r["vec_id"], r["term"]): (r["tf"], r["gaps"], r["len"]) for r in postings_of(cut).collect()}
    assert got[0, "a"] == (3, [0, 2, 1], 4) and got[0, "b"] == (1, [1], 4) and got[5, "a"] == got[0, "a"]
    assert got[4, "a"] == (5000, [1] + [2] * 4999, 10_000) and len(got) == 7
    assert postings_of(cut.filter("1 = 0")).count() == 0


def plain_phrase(texts, words, key=lambda w: w):
    asked, found = [key(w) for w in words], {}
    for i, t in enumerate(texts):
        own = [key(w) for w in re.findall("[a-z]+", (t or "").lower())]
        if n := sum(own[k : k + len(asked)] == asked for k in range(len(own))):
            found[i] = n
    return found


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = ["the", "rights", "right", "reserved", "reserving", "all", "relational", "relate", "of"]
    return [None, "", "of", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(150)), "the " * 3000 + "rights"]


@pytest.mark.parametrize("phrase", [["all"], ["the", "the"], ["rights", "reserved"], ["all", "rights", "reserved"], ["of", "all", "of"], ["none"], ["all", "none"]])
def test_phrases_in_segments(spark, tmp_path_factory, texts, phrase):
    index = SearchIndex(Catalog(spark, f"file://{tmp_path_factory.getbasetemp()}/phrases"))
    if not index.log.versions():
        docs = docs_of(spark, texts)
        index.build(docs.filter("vec_id < 60"))
        index.add(docs.filter("vec_id < 100"))
        index.add(docs)
    assert {r["vec_id"]: r["n"] for r in index.phrase(phrase).collect()} == plain_phrase(texts, phrase)
    assert {r["vec_id"]: r["n"] for r in index.phrase(phrase, stemmed=True).collect()} == plain_phrase(texts, phrase, plain_stem)
    plain = {r["vec_id"]: r["score"] for r in index.bm25(phrase).collect()}
    assert plain == pytest.approx({r["vec_id"]: r["score"] for r in retrieval.bm25(docs_of(spark, texts), phrase, "vec_id", "document").collect()}, abs=2e-6)
    assert index.phrase([]).collect() == [] and index.bm25([]).collect() == []


def test_only_the_terms_asked_for_are_read(spark, tmp_path):
    index = SearchIndex(Catalog(spark, f"file://{tmp_path}"))
    index.build(docs_of(spark, ["brakes failed", "braking failure"]))
    plan = index.postings(["brakes"], stemmed=True)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(stem), EqualTo(stem,brake)]" in plan or "In(stem" in plan or "EqualTo(stem" in plan
    assert {r["vec_id"] for r in index.bm25(["brake"], stemmed=True).collect()} == {0, 1} and index.bm25(["brake"]).count() == 0


def test_inflected_words_find_more(spark):
    got = {r["word"]: (r["plain"], r["stemmed"]) for r in fulltext.q_inflected_recall(spark, DIR).collect()}
    assert all(a <= b for a, b in got.values()) and got["licensing"][0] < got["licensing"][1]


def test_the_index_is_stored_and_opened_again(spark, monkeypatch):
    first = fulltext.documents_index(spark, DIR)
    monkeypatch.setattr(SearchIndex, "build", lambda *a, **k: pytest.fail("built anew"))
    assert fulltext.documents_index(spark, DIR).folder == first.folder
