"""Line dedup against its SQL and a plain count, on copies, short lines and odd texts."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tidewater.llm import linededup

SMALL = "/root/testdata/sf0.01"


def number(word):
    return sum(ord(c) * (i * i % linededup.PLACES * linededup.FACTOR % linededup.PLACES) for i, c in enumerate(word, 1)) % linededup.WORD


def recurring(texts):
    """The recurring template keys of texts, counted plainly."""
    lines, having = {}, defaultdict(set)
    for text in {t for t in texts if t}:
        lines[text] = {}
        for line in text.split("\n"):
            raw = re.findall(r"[^\t\n\v\f\r ]+", line)
            w = [number(x) for x in raw]
            if w:
                least = min(sum(a * b for a, b in zip(w[i : i + 5], linededup.COEFFICIENTS, strict=False)) % linededup.MODULUS for i in range(max(1, len(w) - 4)))
                marks = {("first", *raw[:5]), ("last", *raw[-5:]), ("least", least)} if len(w) >= linededup.GENERAL_TOKENS else set()
                lines[text][line] = (least, linededup.templates(line.encode())[1], marks)
                for key in (*lines[text][line][1], *marks):
                    having[key].add(text)
    common = {k for k, own in having.items() if len(own) >= linededup.MIN_DOCS}
    found = defaultdict(dict)
    for text, own in lines.items():
        new = [least for least, keys, marks in own.values() if marks and not common.intersection(keys) and not common & marks]
        for line, (_, keys, _) in own.items():
            rest = min(new) if new else min((v[0] for x, v in own.items() if x != line), default=-1)
            for k in common.intersection(keys):
                found[k][text] = min(rest, found[k].get(text, rest))
    return {k for k, own in found.items() if len(set(own.values())) >= linededup.MIN_DOCS and len(set(own.values())) >= linededup.MIN_SHARE * len(own)}


def cut(texts):
    known = recurring(texts)
    return [linededup.without(t, lambda ks: [k in known for k in ks.tolist()]) for t in texts]


def test_lines_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(linededup.ORACLE).fetchall()}
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.query(spark, SMALL).collect()}
    assert got == want and sum(n for *_, n in got.values()) > 0
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert dict(zip(texts, cut(list(texts.values())), strict=True)) == got


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = [f"w{chr(97 + k % 26)}{'x' * (k // 26)}y" for k in range(2000)]
    said = lambda n: " ".join(rng.choices(words, k=n))
    passage, block, rows = said(60), [said(9) for _ in range(3)], []
    for i in range(12):  # short documents around one long passage, and some that hold nothing else
        rows.append(("passage", f"{said(8)}\n{passage}\n{said(6)}"))
    rows += [("bare", passage)] * 2
    rows += [("block", "\n".join([*block, said(40), said(30)])) for _ in range(8)]
    rows += [("short", f"Share\n{said(20)}") for _ in range(6)]
    rows += [("field", f"{said(20)}\nposted by user{i} on page {i} of this site") for i in range(6)]
    copy = "\n".join(said(25) for _ in range(6))
    rows += [("copies", copy)] * 40
    near = [said(25) for _ in range(12)]
    for k in range(60):  # near copies: a word or two of their own
        own = list(near)
        own[k % 12] = f"{said(1)} {own[k % 12]}"
        rows.append(("near", "\n".join(own)))
    for kind, lines, words_, own in (("heavy", 4, 20, 12), ("many", 6, 15, 60)):  # more boilerplate than text of their own
        site = [said(words_) for _ in range(lines)]
        rows += [(kind, "\n".join([*site[:2], said(own), *site[2:]])) for _ in range(400)]
    edited = [said(30) for _ in range(10)]
    for k in range(60):  # near copies with words changed and left out in several lines
        own = [x.split() for x in edited]
        for line in rng.sample(range(10), 2):
            own[line][rng.randrange(30)] = said(1)
        del own[rng.randrange(10)][rng.randrange(29)]
        rows.append(("near", "\n".join(map(" ".join, own))))
    rows += [("clean", "\n".join(said(rng.randrange(4, 40)) for _ in range(5))) for _ in range(50)]
    seen = Counter(x for kind, t in rows if kind in ("heavy", "many") for x in t.split("\n"))
    rng.shuffle(rows)
    return rows, passage, block + [x for x, n in seen.items() if n > 1]


def test_recurring_lines_go_and_copies_stay(spark, corpus):
    rows, passage, block = corpus
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    want = dict(enumerate(cut([t for _, t in rows])))
    for most in (1000, 0):
        got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup(docs, most=most).collect()}
        assert got == want
    for i, (kind, text) in enumerate(rows):
        rest = [x for x in text.split("\n") if x != passage and x not in block and x != "Share" and not x.startswith("posted")]
        assert got[i][0] == ("\n".join(rest) if kind in ("passage", "bare", "block", "short", "field", "heavy", "many") else text), kind


def test_edges(spark):
    odd = "word another third " * 40_000
    rows = [(1, None), (2, ""), (3, "a"), (4, odd), (5, "same\nsame"), (5, "same\nsame"), (None, " \n\t\n "), (7, "\x00 odd � \U0001f600\n text")]
    docs = spark.createDataFrame([(i, t, "clash", 1, "k") for i, t in rows], "doc_id long, text string, n_lines string, k int, rest string")
    out = linededup.dedup(docs)
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()]
    assert out.columns == ["doc_id", "text", "n_lines", "k", "rest", "n_dropped"]
    assert got == [(i, t, len(t.split("\n")) if t else 0, 0) for i, t in rows]
    assert linededup.dedup(docs.filter("1 = 0")).count() == 0
    with_chars = docs.withColumn("n_chars", docs.k.cast("long"))
    kept = linededup.stage(spark, with_chars, "")
    assert kept.columns == with_chars.columns and {r["doc_id"]: r["n_chars"] for r in kept.collect()}[3] == 1
    assert linededup.stage(spark, with_chars.filter("1 = 0"), "").count() == 0
    clash = docs.select("doc_id", "text").selectExpr("*", "99L AS n_lines", "'x' AS n_dropped", "7 AS _cut2", "CAST(0 AS INT) AS n_chars")
    same = linededup.stage(spark, clash, "").collect()
    assert {(r["n_lines"], r["n_dropped"], r["_cut2"]) for r in same} == {(99, "x", 7)} and linededup.stage(spark, clash, "").dtypes == clash.dtypes
    ties = spark.createDataFrame([(i, f"{'t' * (i + 1)} own text\nagain\nagain") for i in range(6)], "doc_id long, text string")
    assert {(r["text"].count("again"), r["n_dropped"]) for r in linededup.dedup(ties).collect()} == {(0, 2)}
