"""Versioned tables, incremental runs, providers and the stream."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import retrieval
from tidewater.plans import providers
from tidewater.plans.catalog import Catalog, ledger_rows, run_incremental
from tidewater.plans.index import SearchIndex
from tidewater.streaming.incremental import stream_new


def test_versions(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    with pytest.raises(FileNotFoundError):
        c.read("t")
    assert c.read("t", "a int").count() == 0
    for k in range(4):
        c.write(spark.range(k + 1), "t")
    assert len(c.versions("t")) == 2 and c.read("t").count() == 4
    with pytest.raises(Exception):
        c.write(spark.range(3).select(F.raise_error(F.lit("broken")).alias("id")), "t")
    assert c.read("t").count() == 4


def test_incremental(spark, tmp_path):
    c, seen = Catalog(spark, f"file://{tmp_path}"), []

    def step(df):
        seen.append(df.count())
        return df.withColumn("x", F.col("id") * 2)

    assert run_incremental(c, "s", spark.range(3), step, "id").count() == 3
    assert run_incremental(c, "s", spark.range(5), step, "id").count() == 5
    assert run_incremental(c, "s", spark.range(4), step, "id", refresh=True).count() == 4
    assert seen == [3, 2, 4]
    assert ledger_rows(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "document_id int, v string")).count() == 2


def test_checkpoints_within_a_run(spark, tmp_path):
    c, seen = Catalog(spark, f"file://{tmp_path}"), []

    def step(df):
        seen.append(df.count())
        if len(seen) == 3:
            raise RuntimeError("broken off")
        return df

    with pytest.raises(RuntimeError):
        run_incremental(c, "s", spark.range(200), step, "id", every=50)
    done = c.read("s").count()
    assert done == sum(seen[:2]) > 0
    assert run_incremental(c, "s", spark.range(200), step, "id", every=50).count() == 200 and sum(seen[3:]) == 200 - done


def test_stored_index(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").join(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet"),
        F.col("vec_id") == F.col("doc_id"),
    ).select("vec_id", F.col("text").alias("document"), "embedding")
    index, half = SearchIndex(Catalog(spark, f"file://{tmp_path}")), docs.filter("vec_id % 2 = 0")
    index.build(half, cells=4)
    index.add(docs)
    index.add(docs)
    words = ["licensed", "reserved", "the"]
    want = {r["vec_id"]: r["score"] for r in retrieval.bm25(docs, words, "vec_id", "document").collect()}
    assert {r["vec_id"]: r["score"] for r in index.bm25(words).collect()} == pytest.approx(want, abs=2e-6) and want
    q = docs.filter("vec_id = 3").first()["embedding"]
    asked = spark.createDataFrame([(-1, list(map(float, q)))], "query_id long, q array<double>")
    exact = [r["vec_id"] for r in retrieval.knn(docs, asked, 5).orderBy("rank").collect()]
    assert [r["vec_id"] for r in index.nearest(q, 5, probes=4).orderBy("rank").collect()] == exact and exact[0] == 3
    assert index.nearest(q, 5, probes=1).first()["relevance"] > 0


def test_providers(spark):
    df = spark.createDataFrame([("brake failure on the train",), ("",)], "document string")
    rows = providers.embed_column(df, providers.HashEmbedder(8)).collect()
    assert abs(sum(x * x for x in rows[0]["vector"]) - 1) < 1e-6 and set(rows[1]["vector"]) == {0.0}
    model = providers.ExtractiveModel()
    assert providers.answer("What failed?", [("r1", "the brake failed"), ("r2", "weather was fine")], model).startswith("[r1]")
    assert providers.answer("What?", [], model) == providers.NO_ANSWER
    assert model.query("", "x" * 600_000) is None


def test_stream(spark, tmp_path):
    source, sink, seen = (f"file://{tmp_path}/{x}" for x in ("in", "out", "seen"))
    for n in (3, 5):
        spark.range(n).write.mode("append").parquet(source)
        stream_new(spark, source, "id long", lambda df: df.filter("id > 0"), sink, seen)
    assert spark.read.parquet(sink).count() == 2 + 4
