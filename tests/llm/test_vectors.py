"""Whitening against dense numpy, codebooks against SQL and a plain version, and odd vectors."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from tidewater.llm import codebook, whitening
from tidewater.llm.whitening import Summary, Whitening

DIR = "/root/testdata/sf0.001"
SHAPE = "vec_id long, embedding array<double>, label int, code int, n int"
NAN, INF = float("nan"), float("inf")


def rows_of(spark, vectors, labels=None):
    labels = labels or [None] * len(vectors)
    return spark.createDataFrame([(i, v, x, 7, 7) for (i, v), x in zip(vectors, labels, strict=True)], SHAPE)


def odd(dims, n=40, seed=3):
    """Vectors with every oddity, and those of them that take part."""
    rng = np.random.default_rng(seed)
    plain = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, dims)))]
    fine = [*plain, plain[4], (None, plain[3][1]), (90, [0.0] * dims), (91, [-1e-9] * dims)]
    out = [(70, None), (71, []), (72, [1.0]), (73, [None, *plain[0][1][1:]]), (74, [NAN, *plain[0][1][1:]]), (75, [-INF, *plain[0][1][1:]]), (76, [1e30, *plain[0][1][1:]]), (77, plain[0][1] + [0.0])]
    return fine, out


def dense(x, most):
    """Covariance, eigenvalues and axes of integer rows by a dense eigendecomposition."""
    centred = x - x.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    return values[::-1][:most], axes[:, ::-1][:, :most].T, values.sum()


def check_whitening(got, kept, most=32):
    x = np.floor(64 * np.array([v for _, v in kept])).astype(np.int64) + whitening.OFFSET
    values, axes, trace = dense(x.astype(float) - whitening.OFFSET, most)
    n, sums = len(x), x.sum(0)
    want = {}
    for (key, _), row in zip(kept, x, strict=True):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True))
        want.setdefault((key, deviation), []).append((row - sums / n) @ axes.T / np.sqrt(values))
    assert len(got) == n * len(values) and {r["n"] for r in got} == {n}
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    assert by_row.keys() == want.keys()
    mine = np.array([[by_row[k][c + 1][0] for c in range(len(values))] for k in want])
    theirs = np.array([v[0] for v in want.values()])
    signs = np.sign((mine * theirs).sum(0))
    assert np.abs(mine * signs - theirs).max() < 1e-6
    explained = {r["component"]: r["explained"] for r in got}
    assert [explained[c + 1] for c in range(len(values))] == pytest.approx((values / trace).tolist(), rel=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-8


def test_whitening_of_the_table(spark):
    kept = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    check_whitening(whitening.query(spark, DIR).collect(), kept)


@pytest.mark.parametrize("partitions", [1, 3, 70])
def test_whitening_of_odd_rows(spark, partitions):
    fine, out = odd(6)
    got = whitening.components(rows_of(spark, fine + out).repartition(partitions)).collect()
    assert [f for f in got[0].asDict()] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(got, fine)


def test_whitening_without_variance(spark):
    for vectors in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        assert whitening.components(rows_of(spark, vectors)).collect() == []
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]  # one direction only
    got = whitening.components(rows_of(spark, flat)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)


def test_merging_summaries_loses_nothing():
    rng = np.random.default_rng(4)
    x = np.floor(rng.standard_normal((500, 20)) * np.geomspace(1, 2000, 20)).astype(np.int64)
    cuts = [0, 1, 2, 9, 30, 31, 250, 500]
    parts = [Summary.of(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    left = right = None
    for p in parts:
        left = p if left is None else left.merge(p)
    for p in reversed(parts):
        right = p if right is None else p.merge(right)
    want = np.cov(x.T, bias=True)
    for s in (left, right, Summary.read(left.row(3))):
        assert s.n == 500 and (s.sums == x.sum(0)).all() and np.abs(s.covariance() - want).max() < 1e-12 * np.abs(want).max() * 100
    assert left.singular == pytest.approx(np.linalg.svd(x - x.mean(0), compute_uv=False), rel=1e-9)


def test_deviation_beyond_64_bits():
    x = np.array([[1 << 30, 0], [0, 0]], np.int64)
    fitted = Whitening(1 << 20, x.sum(0), np.eye(2), np.ones(2), 1.0)
    small = (1 << 20) * 0 - (1 << 30)
    assert fitted.deviation(x) == [None, small * small]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """code, error and digest by loops over whole numbers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    x = [[math.floor(4096 * c) for c in v] for _, v in rows]
    cut = [a.tolist() for a in np.array_split(np.arange(len(x[0])), parts)]
    books = [[[x[e][i] for i in own] for e in range(min(entries, len(x)))] for own in cut]
    nearest = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, own in enumerate(cut):
            told = [[] for _ in books[p]]
            for v in x:
                part = [v[i] for i in own]
                told[nearest(part, books[p])[1]].append(part)
            books[p] = [[sum(c) // len(t) for c in zip(*t, strict=True)] if t else books[p][e] for e, t in enumerate(told)]
    out = []
    for (key, _), v in zip(rows, x, strict=True):
        best = [nearest([v[i] for i in own], books[p]) for p, own in enumerate(cut)]
        out.append((key, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def test_codes_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    want = c.execute(codebook.ORACLE).df()
    got = codebook.query(spark, DIR).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(got[columns].itertuples(index=False, name=None)) == sorted(want[columns].itertuples(index=False, name=None)) and len(got)


@pytest.mark.parametrize(("dims", "n"), [(8, 40), (16, 60), (11, 5), (3, 30)])
def test_codes_of_odd_rows(spark, dims, n):
    fine, out = odd(dims, n)
    labels = [i % 3 if i % 5 else None for i in range(len(fine) + len(out))]
    got = codebook.compressed(rows_of(spark, fine + out, labels).repartition(5)).collect()
    want, digest = plain_codes(fine)
    assert sorted((str(r["vec_id"]), r["code"], r["error"]) for r in got) == sorted((str(k), c, e) for k, c, e in want)
    assert {r["codebooks_sha256"] for r in got} == {digest}
    error_of = {k: e for k, _, e in want}
    totals = {}
    for (k, _), label in zip(fine, labels, strict=False):
        totals[label] = totals.get(label, 0) + error_of[k]
    told = {}
    for r in got:
        told.setdefault(r["vec_id"], set()).add(r["label_error"])
    expected = {}
    for (k, _), label in zip(fine, labels, strict=False):
        expected.setdefault(k, set()).add(totals[label])
    assert told == expected


def test_codes_of_empty_tables_and_back(spark):
    for vectors in ([], [(1, None)], [(1, [])]):
        got = codebook.compressed(rows_of(spark, vectors))
        assert got.collect() == [] and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    fine, _ = odd(16)
    rows = rows_of(spark, fine)
    kept = codebook.usable(rows, 16)
    books = codebook.fit(kept, 16)
    for r in codebook.decompress(codebook.compress(kept, books, 16), books).collect():
        off = sum((math.floor(4096 * a) - math.floor(4096 * b)) ** 2 for a, b in zip(r["embedding"], r["approximation"], strict=True))
        assert off == r["error"] and r["label"] is None and r["n"] == 7
