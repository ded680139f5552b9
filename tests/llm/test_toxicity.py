"""The toxicity query against a plain version: all labelled rows, every word against every term."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import toxicity
from tidewater.llm.common import fold

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"\w+")


def distance(a, b):
    """Insertions, deletions, substitutions and swaps of neighbours, by the whole table."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def odds(t, c, nt, nc):
    up = math.log((t + 0.5) / (nt + 1)) - math.log((c + 0.5) / (nc + 1))
    share = nt / max(1, nt + nc)
    g = sum(2 * k * math.log(k / ((t + c) * p)) for k, p in ((t, share), (c, 1 - share)) if k and p)
    return up, g


def nearest(word, weights):
    """(distance, -weight, term) of the nearest term within one edit, the heavier of equals; None without."""
    if word in weights:
        return 0, -weights[word], word
    if len(word) < 4:
        return None
    near = [(d, -w, t) for t, w in weights.items() if abs(len(t) - len(word)) <= 1 and (d := distance(word, t)) <= 1]
    return min(near) if near and len(min(near)[2]) >= 4 else None


def quoted(text, spans, i):
    words = [text[a:b].lower() for a, b in spans]
    if any(w in toxicity.REPORTING for w in words[max(0, i - 3) : i]):
        return True
    before, after = text[spans[max(0, i - 6)][0] : spans[i][0]], text[spans[i][1] : spans[min(len(spans) - 1, i + 6)][1] + 1]
    at = max(before.rfind(q) for q in "\"“„«‹‘'")
    return at >= 0 and (at == 0 or not before[at - 1].isalnum()) and any(q in after for q in "\"”“»›’'")


def lexicon(rows):
    """Terms with their weights, and the shares of near words that clean texts use, of (text, toxic)."""
    toxic, clean, n = Counter(), Counter(), Counter(y for _, y in rows)
    for text, y in rows:
        (toxic if y else clean).update({w.lower() for w in WORD.findall(text or "")})
    every = toxic.keys() | clean.keys()
    told = {w: odds(toxic[w], clean[w], n[1], n[0]) for w in every if toxic[w] >= 2}
    weights = {w: up for w, (up, g) in told.items() if up >= toxicity.LEAST_LIFT and g >= 2 * math.log(max(2, len(every)))}
    near = {w: hit[2] for w in every if clean[w] and w not in weights and (hit := nearest(w, weights))}
    bare = Counter()
    for text, y in rows:
        if not y:
            spans = [m.span() for m in WORD.finditer(text or "")]
            bare.update({text[a:b].lower() for i, (a, b) in enumerate(spans) if text[a:b].lower() in near and not quoted(text, spans, i)})
    forms = {}
    for w, k in bare.items():
        up, g = odds(toxic[w], k, n[1], n[0])
        forms[w] = min(1.0, max(0.0, up / weights[near[w]])) if g >= toxicity.CHANCE else 0.0
    return weights, forms


def said(text, weights, forms, known):
    spans = [m.span() for m in WORD.finditer(text or "")]
    hits = []
    for i, (a, b) in enumerate(spans):
        word = text[a:b].lower()
        if word not in known:
            hit = nearest(word, weights)
            share = 1.0 if hit and hit[0] == 0 else forms.get(word, toxicity.MISSPELT if hit and min(len(word), len(hit[2])) > 4 else toxicity.MISSPELT_SHORT)
            known[word] = (-hit[1] * share, hit[2]) if hit and share > 0 else None
        if known[word]:
            hits.append((i, *known[word]))
    abuse = [(k, w, t) for k, (i, w, t) in enumerate(hits) if not quoted(text, spans, i)]
    total, rest = sum(w for _, w, _ in abuse), sum(w for _, w, _ in hits) - sum(w for _, w, _ in abuse)
    close = sum(k > 0 and hits[k][0] - hits[k - 1][0] <= 6 for k, _, _ in abuse)
    return [max((w for _, w, _ in abuse), default=0.0), math.log1p(total), math.log1p(len({t for *_, t in abuse})), math.log1p(100 * total / max(1, len(spans))), math.log1p(close), math.log1p(max(0.0, rest))]


@pytest.mark.parametrize("part", [0, 1])
def test_query_against_a_plain_version(spark, tmp_path, part):
    """The given table, and one with misspelled, swapped and quoted terms put into its texts."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    folder = SMALL
    if part:
        folder = f"file://{tmp_path}"
        weights = toxicity.learn(docs, labels).weights
        term = max((t for t in weights if len(t) > 5), key=lambda t: (weights[t], t))
        other = term[1] + term[0] + term[2:]
        put = F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit(f" and {term[:-1]} you"))).when(F.col("doc_id") % 17 == 1, F.concat("text", F.lit(f' he said "{term}" once')))
        put = put.when(F.col("doc_id") % 17 == 2, F.concat("text", F.lit(f" {other} {term} {term}x"))).when(F.col("doc_id") % 97 == 5, F.lit(None)).otherwise(F.col("text"))
        docs.withColumn("text", put).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = labels.filter("toxic IN (0, 1)").filter(fold("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    rows = [(r["text"], r["y"], r["half"]) for r in docs.join(known, "doc_id").select("text", "y", half.alias("half")).collect()]
    first, memory = lexicon([(t, y) for t, y, h in rows if h == 0]), {}
    x = np.array([said(t, *first, memory) for t, _, h in rows if h == 1])
    y = np.array([y for _, y, h in rows if h == 1])
    v, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(7)
    keep = np.diag([0.05] * 6 + [1e-6])
    for _ in range(200):
        p = 1 / (1 + np.exp(-v @ w))
        w -= np.linalg.solve((v.T * (p * (1 - p) + 1e-6)) @ v + keep, v.T @ (p - y) + keep @ w)
    assert np.abs(v.T @ (1 / (1 + np.exp(-v @ w)) - y) + keep @ w).max() < 1e-6
    both, memory = lexicon([(t, y) for t, y, _ in rows]), {}
    want = {r["doc_id"]: 1 / (1 + math.exp(-float(np.clip(np.dot(said(r["text"], *both, memory), w[:-1]) + w[-1], -30, 30)))) for r in docs.collect()}
    got = {r["doc_id"]: r for r in toxicity.query(spark, folder).collect()}
    assert got.keys() == want.keys() and len(both[0]) > 3
    assert all(abs(got[i]["score"] - s) < 1e-6 and got[i]["predicted"] == (s >= 0.7) for i, s in want.items())
