"""Pairs of texts that are long to compare go to many tasks."""

from tidewater.operators import documents


def test_pairs_are_spread(spark):
    pairs = spark.range(0, 100, 1, 1)
    assert documents.spread(pairs).rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in documents.spread(pairs).collect()) == list(range(100))


def test_queries_spread_their_pairs(spark):
    d = "/root/testdata/sf0.001"
    for query in (documents.q_text_similarity, documents.q_sequence_similarity):
        assert "REPARTITION_BY_NUM" in query(spark, d)._jdf.queryExecution().executedPlan().toString()
