"""Searches of many queries and an index's building in bounded memory."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions import analysis
from tidewater.operators import retrieval
from tidewater.plans import index
from tidewater.plans.catalog import Catalog
from tidewater.plans.index import Best, SearchIndex, bounded


def test_words_at_once(monkeypatch):
    monkeypatch.setattr(index, "WORDS_AT_ONCE", 3)
    rows = [["a"], None, ["b", "c"], ["d"] * 9, [], ["e", "f"], ["g", "h"]]
    cut = list(bounded([pa.RecordBatch.from_pydict({"vec_id": list(range(7)), "w": rows})]))
    assert [b.column("vec_id").to_pylist() for b in cut] == [[0, 1, 2], [3], [4, 5], [6]]
    assert [w for b in cut for w in b.column("w").to_pylist()] == rows


def test_best():
    best = Best(2, 2)
    best.add(np.array([0, 0, 1]), np.array([7, 3, 1]), np.array([5, 5, 9]))
    best.add(np.array([0, 0]), np.array([2, 9]), np.array([5, 6]))
    assert sorted(zip(best.query.tolist(), best.key.tolist(), best.score.tolist())) == [(0, 2, 5), (0, 9, 6), (1, 1, 9)]
    assert best.least.tolist() == [5, 0]


def test_queries_in_blocks_and_many_terms(spark, tmp_path, monkeypatch):
    rows = [(1, "Licenses and licensing of reports"), (2, "a licence, licensed twice licensed"), (3, "nothing of it"), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "vec_id long, document string")
    few = SearchIndex(Catalog(spark, f"file://{tmp_path}/few"), cut=analysis.words)
    few.build(docs)
    # Beyond the checked number of terms they are stemmed in place, with the same postings.
    write = SearchIndex._write
    monkeypatch.setattr(SearchIndex, "_write", lambda self, d, c: write(self, d, c, most_terms=0))
    many = SearchIndex(Catalog(spark, f"file://{tmp_path}/many"), cut=analysis.words)
    many.build(docs)
    read = lambda i: sorted(map(tuple, i.postings(["licensing", "of", "nothing"], True).collect()))
    assert read(few) == read(many) and len(read(few)) == 6
    asked = spark.createDataFrame([(10, ["licensing"]), (20, ["of", "licenses", "licensing"]), (30, ["absent"]), (40, [])], "query_id long, w array<string>")
    for at_once in (1, 100):
        got = few.bm25_many(asked, 2, at_once)
        assert sorted((r["query_id"], r["rank"]) for r in got.collect()) == [(10, 1), (10, 2), (20, 1), (20, 2)]
        one = {r["vec_id"]: r["score"] for r in few.bm25(["licensing"], stemmed=True).collect()}
        assert {r["vec_id"]: r["score"] for r in got.filter(F.col("query_id") == 10).collect()} == one
        # Pairs of queries and documents aren't shuffled: what is ranked was written already.
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_leading_terms_against_all_weights(spark):
    """Each document's first terms out of all weights, with few and many weights known, ids that several rows
    share, ties, documents without words; each text's postings aren't shuffled."""
    words = ["the", "of", *(f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop")]
    texts = [" ".join(words[(i * j + j * j) % (7 + i)] for j in range(i)) for i in range(60)] + ["", None, "Étude KELVİN the", "zz yy xx ww vv uu tt", "12"]
    docs = spark.createDataFrame([(i % 55, t) for i, t in enumerate(texts)] + [(99, "solo the term"), (99, "Solo again")], "doc_id long, text string")
    all_ = retrieval.tfidf(docs, ["the", "of"]).withColumn("tfidf", F.round("tfidf", 6))
    w = Window.partitionBy("doc_id").orderBy(F.desc("tfidf"), "term")
    want = sorted(tuple(r) for r in all_.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("doc_id", "term", "tfidf", "rank").collect())
    for most in (1000, 20, 0):
        got = retrieval.top_terms(docs, ["the", "of"], 5, most)
        assert sorted(tuple(r) for r in got.select("doc_id", "term", "tfidf", "rank").collect()) == want


def test_top_terms_of_a_table_shuffle_no_postings(spark):
    docs = spark.createDataFrame([(i, f"word{'abc'[i % 3]} other the") for i in range(40)], "doc_id long, text string")
    plan = retrieval.top_terms(docs, ["the"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_building_an_index_shuffles_no_postings(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{'abc'[i % 3]} other the" if i % 5 else None) for i in range(40)], "vec_id long, document string")
    plans, store = [], SearchIndex._store
    monkeypatch.setattr(SearchIndex, "_store", lambda self, part, rows, path: plans.append((part, rows._jdf.queryExecution().executedPlan().toString())) or store(self, part, rows, path))
    built = SearchIndex(Catalog(spark, f"file://{tmp_path}"), cut=analysis.words)
    built.build(docs)
    plan = dict(plans)["postings"]
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan and "Sort" not in plan
    # Texts are cut by one of the stored parts alone.
    assert [part for part, p in plans if "regexp_extract_all" in p] == ["postings"]
    segment = built.segments[0]
    assert (segment["docs"], segment["filled"], segment["words"]) == (40, 32, 96) and built._read("stems", [segment]).count() == 5


def test_runs(spark, monkeypatch):
    rows = [["b", "a"], None, ["a", "c", "a"], [], ["b"]]
    batches = [pa.RecordBatch.from_pydict({"vec_id": [i], "w": pa.array([w], pa.list_(pa.string()))}) for i, w in enumerate(rows)]
    monkeypatch.setattr(index, "RUN_WORDS", 4)
    assert [(a.to_pylist(), b.to_pylist()) for a, b in index.runs(iter(batches))] == [([0, 1, 2], rows[:3]), ([3, 4], rows[3:])]


def test_terms_that_many_queries_ask_for(spark, tmp_path, monkeypatch):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    docs = spark.createDataFrame([(i, " ".join(words[(i * j + j) % 8] for j in range(1 + i % 9))) for i in range(300)], "vec_id long, document string")
    built = SearchIndex(Catalog(spark, f"file://{tmp_path}"), cut=analysis.words)
    built.build(docs)
    asked = spark.createDataFrame([(q, [words[q % 8], words[q % 3], words[-1 - q % 2]]) for q in range(40)], "query_id long, w array<string>")
    got = {}
    for often in (10**9, 8, 0):
        monkeypatch.setattr(index, "OFTEN", often)
        got[often] = sorted(map(tuple, built.bm25_many(asked, 5).collect()))
    assert got[10**9] == got[8] == got[0] and len(got[0]) == 200
