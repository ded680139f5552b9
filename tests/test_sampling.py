"""Exact samples and splits for any seed, projection and silhouettes against dense numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import analytics, documents, projection, sampling


def place(seed, key):
    return int(hashlib.md5(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:15], 16)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "a" if i % 3 else "b", "x") for i in range(500)] + [(1000 + i, None, "x") for i in range(7)] + [(2000, "one", "x")]
    data += [(3000, "same", str(k % 4)) for k in range(20)] + [(None, "nulls", str(k)) for k in range(5)]
    return data, spark.createDataFrame(data, "id long, s string, split string").repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_split_sizes_are_exact(rows, seed):
    data, df = rows
    shares = {"train": 0.6, "validation": 0.2, "test": 0.2}
    got = [(r["id"], r["s"], r["part"]) for r in sampling.split(df, "id", shares, seed, F.col("s"), "part").collect()]
    assert len(got) == len(data)
    for s in {s for _, s, _ in data}:
        own = sorted(place(seed, i) for i, x, _ in data if x == s)
        names = ["train"] * int(len(own) * 0.6 + 1e-9) + ["validation"] * (int(len(own) * 0.8 + 1e-9) - int(len(own) * 0.6 + 1e-9))
        names += ["test"] * (len(own) - len(names))
        want = sorted(zip(own, sorted(names, key=["train", "validation", "test"].index), strict=True))
        assert sorted((place(seed, i), p) for i, x, p in got if x == s) == want
    again = {(r["id"], r["s"], r["split"], r["part"]) for r in sampling.split(df.repartition(2), "id", shares, seed, F.col("s"), "part").collect()}
    assert again == {(r["id"], r["s"], r["split"], r["part"]) for r in sampling.split(df, "id", shares, seed, F.col("s"), "part").collect()}


def test_samples(spark, rows):
    data, df = rows
    got = [(r["id"], r["s"]) for r in sampling.sample(df, "id", 10, 3, F.col("s")).collect()]
    for s in {s for _, s, _ in data}:
        own = sorted(place(3, i) for i, x, _ in data if x == s)
        assert sorted(place(3, i) for i, x in got if x == s) == own[:10]
    assert sampling.sample(df, "id", 10, 4, F.col("s")).count() == len(got) and {(r["id"], r["s"]) for r in sampling.sample(df, "id", 10, 4, F.col("s")).collect()} != set(got)
    assert sampling.sample(df, "id", 0, 3).count() == 0 and sampling.sample(df, "id", 10**6, 3).count() == len(data)
    none = df.filter("1 = 0")
    assert sampling.sample(none, "id", 5, 1).count() == 0 and sampling.split(none, "id", {"a": 1.0}, 1).count() == 0
    assert {r["split"] for r in sampling.split(df, "id", {"all": 1.0}, 1).collect()} == {"all"}
    with pytest.raises(ValueError):
        sampling.split(df, "id", {"a": 0.5}, 1)


def vectors(spark, n=300, dims=6, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)) * np.arange(dims, 0, -1) + 3
    cells = rng.integers(0, 4, n)
    odd = [(900, None, 0), (901, [], 0), (902, [1.0], 0), (903, [None] * dims, 0), (904, [float("nan")] * dims, 0)]
    return x, cells, spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, cells, strict=True))] + odd, "vec_id long, embedding array<double>, cell int")


@pytest.mark.parametrize("partitions", [1, 40])
def test_projection(spark, partitions):
    x, _, df = vectors(spark)
    got = {r["vec_id"]: (r["x1"], r["x2"]) for r in projection.project(df.repartition(partitions)).collect()}
    centred = x - x.mean(0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :2].T
    axes = axes * np.sign(axes[[0, 1], np.abs(axes).argmax(1)])[:, None]
    assert set(got) == set(range(300)) and np.abs(np.array([got[i] for i in range(300)]) - centred @ axes.T).max() < 2e-6
    n, mean, covariance = projection.moments(df.filter("vec_id < 300").repartition(partitions), 6)
    assert n == 300 and mean == pytest.approx(x.mean(0)) and np.abs(covariance - np.cov(x.T, bias=True)).max() < 1e-9
    assert projection.project(df.filter("1 = 0")).count() == 0 and projection.project(df.filter("vec_id = 901")).columns[-2:] == ["x1", "x2"]


def test_silhouettes(spark):
    x, cells, df = vectors(spark)
    cells[0] = 9  # alone in its cell
    df = df.withColumn("cell", F.when(F.col("vec_id") == 0, 9).when(F.col("vec_id") == 1, None).otherwise(F.col("cell")))
    got = {r["vec_id"]: r["silhouette"] for r in projection.silhouettes(df, "cell").collect()}
    keep = [i for i in range(300) if i != 1]
    far = ((x[keep][:, None] - x[keep][None]) ** 2).sum(2)
    own = cells[keep]
    for k, i in enumerate(keep):
        same = own == own[k]
        if same.sum() == 1:
            assert got[i] == 0
            continue
        a = far[k][same].sum() / (same.sum() - 1)
        b = min(far[k][own == c].mean() for c in set(own.tolist()) - {own[k]})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=2e-6)
    assert len(got) == 299 and {r["silhouette"] for r in projection.silhouettes(df.withColumn("cell", F.lit(1)), "cell").collect()} == {0.0}
    assert projection.silhouettes(df.filter("1 = 0"), "cell").count() == 0


def test_numerals(spark):
    good = documents.ROMAN_LIST
    odd = ["", "iiii", "vx", "ic", "xlx", "vv", "cccc", "XI", "1", "lc", "ixi", "iix"]
    df = spark.createDataFrame([(x,) for x in good + odd], "x string").select("x", documents.numeral_value(F.col("x")).alias("n"))
    assert {r["x"]: r["n"] for r in df.collect()} == {r: k + 1 for k, r in enumerate(good)} | dict.fromkeys(odd, 0)


def test_first_ranks_of_a_large_key(spark):
    rng = np.random.default_rng(5)
    data = [(1 if k % 3 else int(rng.integers(2, 6)), f"m{rng.integers(0, 30)}", float(rng.integers(0, 200)), k) for k in range(3000)] + [(None, "m", 1.0, 9000)]
    df = spark.createDataFrame(data, "q int, m string, score double, id int").repartition(9)
    got = {(r["q"], r["m"]): r["first_rank"] for r in analytics.first_ranks(df, "q", "m", -F.col("score"), F.col("id")).collect()}
    want = {}
    for q in {d[0] for d in data}:
        for rank, (_, m, _, _) in enumerate(sorted((d for d in data if d[0] == q), key=lambda d: (-d[2], d[3])), 1):
            want.setdefault((q, m), rank)
    assert got == want
