"""Embedding near-dedup against brute force, its recall by size, and odd vectors."""

import numpy as np
import pytest

from tests.llm.test_methods import components
from tidewater.llm import embdedup


def test_against_brute_force(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((150, 64))
    rows = np.concatenate([centres] + [centres[:40] + r.standard_normal((40, 64)) * s for s in (0.1, 0.2, 0.3, 0.35)] + [centres[:1] + r.standard_normal((700, 64)) * 0.15])
    rows = np.concatenate([rows, rows[:5]])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = {x["vec_id"]: x for x in embdedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")).collect()}
    found, exact = sum(x["n_links"] for x in got.values()), int(near.sum())
    assert found <= exact and found >= 0.98 * exact
    want = components(list(zip(*np.nonzero(near), strict=True)), range(len(rows)))
    assert np.mean([got[i]["component_id"] == want[i] for i in want]) > 0.95 and all(x["kept"] == (i == x["component_id"]) for i, x in got.items())


def test_exact_pass_finds_links_no_window_meets(spark):
    r = np.random.default_rng(9)
    shared = r.standard_normal(64)
    rows = shared / np.linalg.norm(shared) * 0.85 + 0.53 * r.standard_normal((1500, 64)) / 8
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    aside = r.standard_normal((60, 64))
    aside -= (aside * unit[:60]).sum(1, keepdims=True) * unit[:60]
    rows = np.concatenate([unit, 0.901 * unit[:60] + np.sqrt(1 - 0.901**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)])
    near = rows @ rows.T >= 0.9
    np.fill_diagonal(near, False)
    want = components(list(zip(*np.nonzero(near), strict=True)), range(len(rows)))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = embdedup.near_duplicates(vectors, passes=1, neighbours=1, exact=True).collect()
    assert near.sum() >= 120 and {x["vec_id"]: (x["n_links"], x["component_id"]) for x in got} == {i: (int(near[i].sum()), want[i]) for i in want}
    reps = vectors.withColumnRenamed("vec_id", "rid")
    links = embdedup.exact_links(reps, 0.9, chunk_values=64 * 400).collect()
    assert components([(x["a"], x["b"]) for x in links], range(len(rows))) == want


@pytest.mark.parametrize(("n", "shared"), [(50_000, 0.0), (50_000, 0.7), (1_000_000, 0.0)])
def test_recall_of_the_passes_by_size(n, shared):
    """Planted pairs just over the threshold among n random vectors, some sharing a direction: how
    many come within a window in one of the passes that the size asks for."""
    rng, pairs = np.random.default_rng(n), 1000
    rows = rng.standard_normal((n, 64), dtype=np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows *= np.float32(np.sqrt(1 - shared**2))
    rows[:, 0] += np.float32(shared)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    aside = rng.standard_normal((pairs, 64), dtype=np.float32)
    aside -= (aside * rows[:pairs]).sum(1, keepdims=True) * rows[:pairs]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    rows[-pairs:] = 0.9005 * rows[:pairs] + np.float32(np.sqrt(1 - 0.9005**2)) * aside
    mean = rows.mean(0, dtype=np.float64)
    spread = 1 - float(mean @ mean)
    passes, met = embdedup.passes_for(n, spread, 0.9, embdedup.NEIGHBOURS, embdedup.RECALL), np.zeros(pairs, bool)
    for p in range(passes):
        keys = np.concatenate([embdedup.sort_keys(rows[k : k + 100_000], p, 1, mean)[:, 0] for k in range(0, n, 100_000)])
        place = np.empty(n, np.int64)
        place[np.argsort(keys, kind="stable")] = np.arange(n)
        met |= np.abs(place[:pairs] - place[-pairs:]) <= embdedup.NEIGHBOURS
    assert met.mean() >= 0.95, (passes, met.mean())
    print(n, shared, passes, met.mean())


def test_borders_of_partitions(spark, monkeypatch):
    """Partitions of a few rows: the windows reach across their ends."""
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((600, 8))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    monkeypatch.setattr(embdedup, "PARTITION_ROWS", 40)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {x["vec_id"]: x["component_id"] for x in embdedup.near_duplicates(vectors, neighbours=30, passes=24).collect()}
    want = components(list(zip(*np.nonzero(near), strict=True)), range(len(rows)))
    assert np.mean([got[i] == want[i] for i in want]) > 0.97


def test_links_of_large_components_in_chunks(spark):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((2, 16))
    rows = np.concatenate(
        [centre[:1] + 0.25 * rng.standard_normal((900, 16)), centre[1:] + 0.25 * rng.standard_normal((700, 16)), rng.standard_normal((50, 16))],
    )
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    own = components(list(zip(*np.nonzero(near), strict=True)), range(len(rows)))
    members = spark.createDataFrame(
        [(int(own[i]), i, 1 + i % 3, v.tolist()) for i, v in enumerate(rows)],
        "component long, rid long, mult long, embedding array<double>",
    )
    want = {i: int(near[i] @ (1 + np.arange(len(rows)) % 3)) for i in range(len(rows))}
    for values in (4_000_000, 16 * 300):
        assert {r["rid"]: r["n"] for r in embdedup.count_links(members, 0.9, chunk_values=values).collect()} == want


def test_edges(spark):
    v = [1.0] + [0.0] * 3
    rows = [
        (1, v),
        (2, v),
        (2, v),
        (3, [0.99, 0.05, 0.0, 0.0]),
        (4, None),
        (5, [0.0] * 4),
        (6, [float("nan"), 1.0, 1.0, 1.0]),
        (7, [None, 1.0, 1.0, 1.0]),
        (8, [float("inf")] * 4),
        (9, []),
        (10, [1.0, 0.0]),
        (None, v),
        (11, [1e300, 0.0, 0.0, 0.0]),
        (12, [-1.0, 0.0, 0.0, 0.0]),
    ]
    vectors = spark.createDataFrame([(i, x, 0) for i, x in rows], "vec_id long, embedding array<double>, n_links int")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in embdedup.near_duplicates(vectors).collect())
    assert got[:6] == [(-1, 0, None, False), (1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 4, 1, False), (4, 0, 4, True)]
    assert (11, 4, 1, False) in got and all((i, 0, i, True) in got for i in (5, 6, 7, 8, 9, 10, 12))
    assert embdedup.near_duplicates(vectors.filter("1 = 0")).count() == 0


def planted(n, hot, background, pairs, seed):
    """Unit vectors of which the first `hot` share a direction, so that their cosine is `background`, and
    behind them a partner of cosine 0.9005 for each of some of these (or of any, without hot ones)."""
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((n, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    shared = rng.standard_normal(64)
    shared /= np.linalg.norm(shared)
    rows[:hot] -= np.outer(rows[:hot] @ shared, shared)
    rows[:hot] /= np.linalg.norm(rows[:hot], axis=1, keepdims=True)
    rows[:hot] = np.sqrt(background) * shared + np.sqrt(1 - background) * rows[:hot]
    one = rows[:pairs]
    aside = rng.standard_normal((pairs, 64))
    aside -= (aside * one).sum(1, keepdims=True) * one
    if hot:  # the partner lies in the source too
        aside = rows[pairs : 2 * pairs] - (rows[pairs : 2 * pairs] * one).sum(1, keepdims=True) * one
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    return np.concatenate([rows, 0.9005 * one + np.sqrt(1 - 0.9005**2) * aside])


@pytest.mark.parametrize(("hot", "background"), [(0, 0.0), (9000, 0.85), (4000, 0.75), (4000, 0.85)])
def test_recall_in_close_sources(spark, hot, background):
    """Lone pairs just over the threshold, in tables without a source, of one, and with one within."""
    n, pairs = 9000, 400
    rows = planted(n, hot, background, pairs, 3)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embdedup.near_duplicates(vectors).collect()}
    near = np.flatnonzero((rows[:pairs] * rows[n:]).sum(1) >= 0.9)
    met = np.mean([got[i]["component_id"] == got[n + i]["component_id"] and got[n + i]["n_links"] > 0 for i in near])
    assert len(near) == pairs and met >= 0.95


def test_regions(spark):
    rows = planted(9000, 4000, 0.8, 1, 5)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(10**6, [1.0, 0.0])], "rid long, embedding array<double>")
    found, placed = embdedup.regions(vectors)
    dense = max(found, key=lambda r: r.rows)
    assert 3800 <= dense.rows <= 4600 and abs(dense.spread - 0.2) < 0.08 and sum(r.rows for r in found) in (9001, 9002)
    assert placed.count() == 9002 and embdedup.passes_for(dense.rows, dense.spread, 0.9, 256, 0.995) > embdedup.passes_for(9001, 0.8, 0.9, 256, 0.995)
    few = vectors.limit(3)
    assert embdedup.links_of_regions(few, 0.9, 4, 256, 0.995) is None
