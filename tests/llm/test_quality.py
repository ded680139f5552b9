"""The quality query against plain statistics and a dense quadratic discriminant."""

import zlib

import numpy as np

from tidewater.llm import quality

TINY = "/root/testdata/sf0.001"


def plain_statistics(text):
    words, chars = (text or "").split(), len(text or "")
    if not words:
        return [0.0] * 21
    kind = lambda f: sum(map(f, text)) / chars
    marks, lines, n = ".,;:'\"-?()", [x for x in text.split("\n") if x], len(words)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    high = lambda c: ord(c) > 127
    return [
        np.log1p(chars), np.log1p(n), np.log(mean), np.log1p((sum((x - mean) ** 2 for x in lengths) / n) ** 0.5),
        kind(lambda c: not high(c) and c.isupper()) ** 0.5,
        kind(lambda c: not high(c) and c.isdigit()) ** 0.5,
        kind(lambda c: not high(c) and not c.isalnum() and not c.isspace() and c not in marks) ** 0.5,
        kind(lambda c: c in marks) ** 0.5,
        (sum(not any(c.isalpha() for c in w) for w in words) / n) ** 0.5,
        len(set(words)) / n**0.9,
        (max(words.count(w) for w in set(words)) / n) ** 0.5,
        (sum(a == b for a, b in zip(words, words[1:], strict=False)) / n) ** 0.5,
        np.log1p(len(lines)), np.log1p(n / max(1, len(lines))),
        (1 - len(set(lines)) / max(1, len(lines))) ** 0.5,
        len(zlib.compress(text.encode(), 1)) / (chars + 100),
        kind(lambda c: high(c) or c.islower()) ** 0.5,
        (sum(x <= 3 for x in lengths) / n) ** 0.5,
        (sum(w[0].isupper() for w in words) / n) ** 0.5,
        (sum(w[-1] in ".!?" for w in words) / n) ** 0.5,
        (sum(not w[-1].isalnum() and w[-1] not in ".,;:?'\")-" for w in words) / n) ** 0.5,
    ]


def dense(x, y):
    """A function of rows: the difference of log densities with inverted shrunk covariances."""
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    z, k = np.clip((x - centre) / spread, -12, 12), x.shape[1]
    pooled, parts = np.diag(np.maximum(z.var(0), 1e-3)), []
    for c in (0, 1):
        own = z[y == c]
        cov = np.cov(own.T)
        share = min(1, quality.SHRINKAGE + 0.5 * k / (k + len(own)))
        cov = (1 - share) * cov + share * pooled * max(0.01, np.trace(cov) / np.trace(pooled)) + 1e-6 * np.eye(k)
        parts.append((own.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]))

    def ratio(rows):
        w = np.clip((rows - centre) / spread, -12, 12)
        logs = [-0.5 * np.einsum("ij,jk,ik->i", w - m, inverse, w - m) - 0.5 * log for m, inverse, log in parts]
        v = logs[1] - logs[0] + np.log((sum(y == 1) + 1) / (sum(y == 0) + 1))
        return np.sign(v) * np.log1p(abs(v))

    return ratio


def test_query_against_dense_discriminant(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{TINY}/labels.parquet").collect()}
    x = {i: plain_statistics(t) for i, t in texts.items()}
    assert all(np.allclose(quality.statistics(t), x[i]) for i, t in texts.items())
    known = sorted((labels[i], quality.statistics(texts[i]).tolist()) for i in labels if i in texts and zlib.crc32(str(i).encode()) % 5)
    rows, y = np.array([v for _, v in known]), np.array([q for q, _ in known])
    half = np.arange(len(y)) % 2 == 0
    v, w = dense(rows[half], y[half])(rows[~half]), np.zeros(2)
    v = np.stack([v, np.ones(len(v))], 1)
    for _ in range(200):  # the logistic score's slope and offset
        p = 1 / (1 + np.exp(-np.clip(v @ w, -30, 30)))
        w -= np.linalg.solve((v.T * (p * (1 - p))) @ v + 1e-3 * np.eye(2), v.T @ (p - y[~half]) + 1e-3 * w)
    ids = list(texts)
    want = dict(zip(ids, 1 / (1 + np.exp(-np.clip(w[0] * dense(rows, y)(np.array([x[i] for i in ids])) + w[1], -30, 30))), strict=True))
    for r in quality.query(spark, TINY).collect():
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-6 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
