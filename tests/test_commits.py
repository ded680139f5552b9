"""Commits, concurrent writers, broken-off runs, segments."""

import threading

import pytest
from pyspark.sql import functions as F

from tidewater.plans import index as index_module
from tidewater.plans.catalog import Catalog, run_incremental
from tidewater.plans.commits import CommitLog, ConflictError
from tidewater.plans.index import SearchIndex


def at_once(*tasks):
    """Runs functions in threads that start together; gives what they raised."""
    start, errors = threading.Barrier(len(tasks)), []

    def run(task):
        start.wait()
        try:
            task()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(t,)) for t in tasks]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return errors


def test_one_writer_gets_a_number(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/t")
    assert log.last() == (0, {}) and log.versions() == []
    got = []
    assert at_once(*[lambda k=k: got.append(log.publish(1, {"by": k})) for k in range(8)]) == []
    assert sorted(got) == [False] * 7 + [True] and log.versions() == [1]
    assert not log.publish(1, {}) and log.publish(2, {"x": "ü"}) and log.last() == (2, {"x": "ü"})
    with pytest.raises(FileNotFoundError):
        log.read(3)


def test_by_renaming(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/t")
    log.local = None
    log.fs.mkdirs(log.path(log.folder))
    assert log.publish(1, {"a": 1}) and not log.publish(1, {"a": 2}) and log.last() == (1, {"a": 1})


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, v string")


def held(c, table="t", **k):
    return sorted((r["id"] is None, r["id"], r["v"]) for r in c.read(table, **k).collect())


def plain(c, table="t", **k):
    return [x[1:] for x in held(c, table, **k)]


def test_upserts_and_versions(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    assert c.upsert(rows(spark, (1, "a"), (2, "b"), (None, "n")), "t", "id") == 1
    assert c.upsert(rows(spark, (2, "B"), (3, "c"), (None, "N")), "t", "id") == 2
    assert plain(c) == [(1, "a"), (2, "B"), (3, "c"), (None, "N")]
    assert plain(c, version=1) == [(1, "a"), (2, "b"), (None, "n")]
    c.append(rows(spark, (3, "again")), "t")
    assert plain(c) == [(1, "a"), (2, "B"), (3, "again"), (3, "c"), (None, "N")]
    c.upsert(rows(spark, (3, "one")).withColumn("more", F.lit(1)), "t", "id")
    assert [(r["id"], r["v"], r["more"]) for r in c.read("t").filter("id = 3").collect()] == [(3, "one", 1)]
    c.compact("t", days=1)
    before = held(c)
    assert len(c.log("t").last()[1]["parts"]) == 1 and held(c) == before
    c.restore("t", 1)
    assert plain(c) == [(1, "a"), (2, "b"), (None, "n")]
    c.drop_versions("t", 1)
    assert plain(c) == [(1, "a"), (2, "b"), (None, "n")] and len(c.versions("t")) == 1


def test_two_writers_keep_both(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    c.write(rows(spark, (0, "old"), (1, "old")), "t")
    tasks = [lambda k=k: c.upsert(rows(spark, (k, "new"), (10 + k, "new")), "t", "id") for k in range(4)]
    tasks.append(lambda: c.append(rows(spark, (99, "plain")), "t"))
    assert at_once(*tasks) == []
    assert plain(c) == sorted([(k, "new") for k in (0, 1, 2, 3, 10, 11, 12, 13)] + [(99, "plain")])


def test_counters_lose_nothing(spark, tmp_path):
    """Each writer adds one to the same row: only starting over on a conflict makes them all count."""
    c = Catalog(spark, f"file://{tmp_path}")
    c.write(spark.createDataFrame([(1, 0), (2, 0)], "id long, n long"), "t")
    one_more = lambda now: now.filter("id = 1").withColumn("n", F.col("n") + 1)
    other = lambda now: now.filter("id = 2").withColumn("n", F.col("n") + 1)
    assert at_once(*[lambda f=f: c.upsert(f, "t", "id") for f in (one_more, one_more, one_more, other)]) == []
    assert sorted((r["id"], r["n"]) for r in c.read("t").collect()) == [(1, 3), (2, 1)]


def test_conflicts(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    based = c.write(rows(spark, (1, "a")), "t")
    c.append(rows(spark, (2, "b")), "t")
    with pytest.raises(ConflictError):
        c.write(rows(spark, (1, "A")), "t", based_on=based)
    assert plain(c) == [(1, "a"), (2, "b")]
    calls = []

    def slow(now):
        calls.append(now.count())
        if len(calls) == 1:
            c.write(rows(spark, (5, "replaced")), "t")
        return rows(spark, (1, f"seen {calls[-1]}"))

    c.upsert(slow, "t", "id")
    assert calls == [2, 1] and plain(c) == [(1, "seen 1"), (5, "replaced")]
    folders = {p.name for p in (tmp_path / "t" / "parts").iterdir()}
    named = {p["path"] for v in c.versions("t") for p in c.log("t").read(v)["parts"]}
    assert named <= folders and len(folders - named) == 0


def test_compaction_beside_a_writer(spark, tmp_path, monkeypatch):
    c = Catalog(spark, f"file://{tmp_path}")
    c.append(rows(spark, (1, "a")), "t")
    c.append(rows(spark, (2, "b")), "t")
    write, done = Catalog._write_part, []

    def between(self, df, table, key=None):
        part = write(self, df, table, key)
        if not done:
            done.append(1)
            c.upsert(rows(spark, (2, "later")), "t", "id")
        return part

    monkeypatch.setattr(Catalog, "_write_part", between)
    assert c.compact("t") and plain(c) == [(1, "a"), (2, "later")] and len(c.log("t").last()[1]["parts"]) == 2


def test_parts_cost_their_own_rows(spark, tmp_path):
    c, read = Catalog(spark, f"file://{tmp_path}"), []

    def step(df):
        read.append(df.count())
        return df

    got = run_incremental(c, "s", spark.range(400), step, "id", every=100)
    parts = c.log("s").last()[1]["parts"]
    assert got.count() == 400 and len(parts) == 4 and sum(read) == 400
    assert run_incremental(c, "s", spark.range(500), step, "id", every=1000).count() == 500 and read[-1] == 100
    assert not [p for p in (tmp_path / "s").iterdir() if p.name.startswith("waiting")]


def docs_of(spark, a, b):
    return spark.range(a, b).select(F.col("id").alias("vec_id"), F.concat(F.lit("word common w"), F.col("id").cast("string")).alias("document"))


def counts(index):
    return {r["vec_id"]: r["tf"] for r in index.postings(["common"]).collect()}


def test_a_broken_run_leaves_no_double_posting(spark, tmp_path, monkeypatch):
    index = SearchIndex(Catalog(spark, f"file://{tmp_path}"))
    index.build(docs_of(spark, 0, 20))
    want = index.bm25(["common", "w3"]).count()
    store, publish = SearchIndex._store, CommitLog.publish
    for stop in ("lengths", "postings", "commit"):
        if stop == "commit":
            monkeypatch.setattr(CommitLog, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("broken off")))
        else:

            def broken(self, part, rows, path, stop=stop):
                store(self, part, rows, path)
                if part == stop:
                    raise RuntimeError("broken off")

            monkeypatch.setattr(SearchIndex, "_store", broken)
        with pytest.raises(RuntimeError):
            index.add(docs_of(spark, 0, 25))
        monkeypatch.setattr(SearchIndex, "_store", store)
        monkeypatch.setattr(CommitLog, "publish", publish)
        assert index.bm25(["common", "w3"]).count() == want and set(counts(index)) == set(range(20))
    assert index.add(docs_of(spark, 0, 25)) == 5 and index.add(docs_of(spark, 0, 25)) == 0
    assert counts(index) == dict.fromkeys(range(25), 1)
    index.vacuum(keep=1, days=-1)
    named = {s["path"] for s in index.segments}
    assert {p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("segment")} == named and counts(index) == dict.fromkeys(range(25), 1)


def test_additions_write_themselves_and_merge_by_size(spark, tmp_path):
    index = SearchIndex(Catalog(spark, f"file://{tmp_path}"))
    index.build(docs_of(spark, 0, 64))
    sizes = []
    for k in range(64, 76):
        before = {s["path"] for s in index.segments}
        index.add(docs_of(spark, 0, k + 1))
        sizes.append(sorted(s["docs"] for s in index.segments if s["path"] not in before))
    assert sizes[0] == [1] and sizes[3] == [4] and max(s["docs"] for s in index.segments) == 64
    assert sorted(s["docs"] for s in index.segments) == [4, 4, 4, 64]
    assert counts(index) == dict.fromkeys(range(76), 1)
    totals = [sum(s[k] for s in index.segments) for k in ("docs", "filled", "words")]
    assert totals == [76, 76, 228]


def test_two_additions_at_once(spark, tmp_path):
    index = SearchIndex(Catalog(spark, f"file://{tmp_path}"))
    index.build(docs_of(spark, 0, 5))
    assert at_once(lambda: index.add(docs_of(spark, 3, 12)), lambda: index.add(docs_of(spark, 8, 15))) == []
    assert counts(index) == dict.fromkeys(range(15), 1)


def test_odd_documents(spark, tmp_path):
    index = SearchIndex(Catalog(spark, f"file://{tmp_path}"))
    with pytest.raises(FileNotFoundError):
        index.add(docs_of(spark, 0, 1))
    rows_ = [(1, None, None), (2, "", [0.0] * 4), (3, "a b", [1.0, 0.0, 0.0, 0.0]), (None, "a", [1.0] * 4), (4, "b", [1.0, None, 0.0, 0.0]), (5, "b", [1.0, 0.1, 0.0, 0.0])]
    index.build(spark.createDataFrame(rows_, "vec_id long, document string, embedding array<double>"), cells=2)
    assert sum(s["docs"] for s in index.segments) == 5 and {r["vec_id"] for r in index.bm25(["b"]).collect()} == {3, 4, 5}
    assert [r["vec_id"] for r in index.nearest([1.0, 0.0, 0.0, 0.0], 5, probes=2).collect()] == [3, 5]
    assert index.add(spark.createDataFrame([], "vec_id long, document string, embedding array<double>")) == 0
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame([(9, "x", None), (9, "y", None)], "vec_id long, document string, embedding array<double>"))
    assert sum(s["docs"] for s in index.segments) == 5 and index_module.TIER == 4
