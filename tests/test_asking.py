"""Model calls: each prompt once over failures and repeats, bounded calls and tokens."""

import os
import time

import pytest

from tidewater.plans import asking
from tidewater.plans.asking import Budget, ask_column, embed_texts
from tidewater.plans.catalog import Catalog
from tidewater.plans.providers import HashEmbedder


class Counting:
    """Writes a line for each call that it answers; breaks at a prompt until a file is there."""

    def __init__(self, folder, breaks_at=None):
        self.folder, self.breaks_at = str(folder), breaks_at

    def query(self, system, user, temperature=0.0, max_tokens=1024):
        if user == self.breaks_at and not os.path.exists(f"{self.folder}/mended"):
            time.sleep(0.3)
            raise RuntimeError("broken off")
        with open(f"{self.folder}/calls", "a") as f:
            f.write(user + "\n")
        return None if user == "refused" else f"re: {user}"

    def calls(self):
        with open(f"{self.folder}/calls") as f:
            return f.read().splitlines()


def test_each_prompt_is_asked_once(spark, tmp_path):
    model = Counting(tmp_path, "prompt 17")
    rows = [(i, f"prompt {i % 40}", "x") for i in range(200)] + [(500, None, "x"), (501, "refused", "x"), (502, "y" * 600_000, "x"), (503, "", "x")]
    df = spark.createDataFrame(rows, "id int, prompt string, answers string")
    catalog = Catalog(spark, f"file://{tmp_path}/store")
    with pytest.raises(Exception, match="broken off"):
        ask_column(df, model, "s", "prompt", catalog, "m", tasks=3, calls=2).collect()
    before = model.calls()
    assert 0 < len(before) == len(set(before)) and catalog.versions("answers") == []
    (tmp_path / "mended").touch()
    out = ask_column(df, model, "s", "prompt", catalog, "m", tasks=3, calls=2)
    got = {r["id"]: r["answers"] for r in out.collect()}
    assert out.columns == ["id", "prompt", "answers"] and len(got) == len(rows)
    assert all(got[i] == [f"re: prompt {i % 40}"] for i in range(200)) and got[500] is got[501] is got[502] is None and got[503] == ["re: "]
    assert sorted(model.calls()) == sorted({p for _, p, _ in rows if p is not None and len(p) < 9999})
    ask_column(df, model, "s", "prompt", catalog, "m").collect()
    assert len(model.calls()) == 42 and not [f for _, _, fs in os.walk(tmp_path / "store" / "answers-waiting") for f in fs]
    ask_column(df.filter("id < 3"), model, "another", "prompt", catalog, "m").collect()
    assert len(model.calls()) == 45
    assert ask_column(df.filter("1 = 0"), model, "s", "prompt", catalog, "m").count() == 0


def test_embeddings_in_lots(spark, tmp_path, monkeypatch):
    catalog = Catalog(spark, f"file://{tmp_path}")
    df = spark.createDataFrame([(i, f"word{i % 300} of text") for i in range(700)] + [(900, None)], "id int, document string")
    got = {r["id"]: r["vector"] for r in embed_texts(df, HashEmbedder(8), "document", catalog, "h").collect()}
    assert got[900] is None and got[3] == pytest.approx(HashEmbedder(8).embed(["word3 of text"])[0]) and got[3] == got[303]
    monkeypatch.setattr(HashEmbedder, "embed", lambda *a: pytest.fail("asked again"))
    assert embed_texts(df, HashEmbedder(8), "document", catalog, "h").filter("vector is null").count() == 1


def test_budget_of_a_minute():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    b = Budget(100, lambda: now[0], sleep)
    for tokens in (60, 40, 30):
        b.take(tokens)
    assert slept == [60.0]
    b.take(500)  # larger than the budget: goes alone
    assert now[0] == 120.0
    b.take(1)
    assert now[0] == 180.0
    Budget(None).take(10**9)


def test_calls_under_way_are_bounded(spark, tmp_path):
    folder = str(tmp_path)

    class Busy:
        def query(self, system, user, temperature=0.0, max_tokens=1024):
            start = time.time()
            time.sleep(0.05)
            with open(f"{folder}/seen", "a") as f:
                f.write(f"{start} {time.time()}\n")
            return "x"

    df = spark.createDataFrame([(f"p{i}",) for i in range(60)], "prompt string")
    ask_column(df, Busy(), "s", "prompt", Catalog(spark, f"file://{tmp_path}/c"), "m", tasks=1, calls=4).collect()
    with open(f"{folder}/seen") as f:
        seen = [tuple(map(float, x.split())) for x in f]
    most = max(sum(a <= start < b for a, b in seen) for start, _ in seen)
    assert len(seen) == 60 and 2 <= most <= 4 and asking.CALLS == 8
