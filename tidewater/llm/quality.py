"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance of the transformed statistics, shrunk towards a pooled,
diagonal one. A document's score comes from the difference of the two log densities, whose
Mahalanobis distances use Cholesky factors made once at fitting.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_sample, fold, table

#: Labelled rows of each class that the fit reads, about.
SAMPLE_PER_CLASS = 6000
#: Share of the pooled diagonal in each class covariance.
SHRINKAGE = 0.1
THRESHOLD = 0.3

_WORD = re.compile(r"\S+")
_LETTER_RUN = re.compile(r"[^\W\d_]+")
_CLASSES = np.zeros(128, np.uint8)
for _c in range(128):
    _s = chr(_c)
    _CLASSES[_c] = 1 if _s.isupper() else 2 if _s.islower() else 3 if _s.isdigit() else 4 if _s.isspace() else 5 if _s in ".,;:'\"-?()" else 6
STATISTICS = (
    "chars", "words", "word_length", "word_length_spread", "upper", "digits", "symbols", "plain_marks", "wordless", "distinct_words",
    "commonest_word", "same_as_before", "lines", "words_a_line", "repeated_lines", "compression", "letters_in_words", "short_words", "capitals", "final_marks", "symbol_ends",
)


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text; a null text counts as empty."""
    text = text or ""
    words = _WORD.findall(text)
    n, chars = len(words), len(text)
    if not n:
        return np.zeros(len(STATISTICS))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(np.where(points < 128, _CLASSES[np.minimum(points, 127)], 2), minlength=7) / chars
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    bare = sum(1 for w in words if not _LETTER_RUN.search(w))
    repeats = sum(map(str.__eq__, words[1:], words[:-1]))
    packed = len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1))
    ends = Counter(w[-1] for w in words)
    return np.array([
        np.log1p(chars),
        np.log1p(n),
        np.log(lengths.mean()),
        np.log1p(lengths.std()),
        np.sqrt(kinds[1]),
        np.sqrt(kinds[3]),
        np.sqrt(kinds[6]),
        np.sqrt(kinds[5]),
        np.sqrt(bare / n),
        len(counts) / n**0.9,
        np.sqrt(counts.most_common(1)[0][1] / n),
        np.sqrt(repeats / n),
        np.log1p(len(lines)),
        np.log1p(n / max(1, len(lines))),
        np.sqrt(1 - len(set(lines)) / max(1, len(lines))),
        packed / (chars + 100.0),
        np.sqrt(kinds[2]),
        np.sqrt((lengths <= 3).mean()),
        np.sqrt(sum(1 for w in words if w[0].isupper()) / n),
        np.sqrt((ends["."] + ends["!"] + ends["?"]) / n),
        np.sqrt(sum(v for k, v in ends.items() if not k.isalnum() and k not in ".,;:?'\")-") / n),
    ])


@dataclass(frozen=True)
class Discriminant:
    """Fitted parameters; `factors` are lower Cholesky factors of the shrunk covariances."""

    centre: np.ndarray
    spread: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_prior: float
    slope: float = 1.0
    offset: float = 0.0

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with priors, for rows of statistics."""
        z = np.clip((x - self.centre) / self.spread, -12, 12)
        parts = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            y = forward(factor, (z - mean).T)
            parts.append(-0.5 * (y * y).sum(axis=0) - np.log(np.diag(factor)).sum())
        return parts[1] - parts[0] + self.log_prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * squash(self.log_ratio(x)) + self.offset, -30, 30)))


def forward(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The y with factor @ y = right, for a lower triangular factor, row by row."""
    y = np.empty_like(right)
    for k, row in enumerate(factor):
        y[k] = (right[k] - row[:k] @ y[:k]) / row[k]
    return y


def squash(v: np.ndarray) -> np.ndarray:
    """Far log ratios count by their logarithm."""
    return np.sign(v) * np.log1p(np.abs(v))


def fit(x: np.ndarray, y: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fits both classes. A class with under two rows takes the pooled mean and covariance."""
    k = x.shape[1]
    if not len(x):
        return Discriminant(np.zeros(k), np.ones(k), np.zeros((2, k)), np.stack([np.eye(k)] * 2), 0.0)
    centre, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - centre) / spread, -12, 12)
    pooled = np.diag(np.maximum(z.var(axis=0), 1e-3))
    means, factors = [], []
    for c in (0, 1):
        own = z[y == c]
        if len(own) < 2:
            own = z
        cov = np.cov(own, rowvar=False) if len(own) > 1 else pooled
        share = min(1.0, shrinkage + k / (k + len(own)) * 0.5)
        means.append(own.mean(axis=0))
        factors.append(np.linalg.cholesky((1 - share) * cov + share * pooled * max(1e-2, np.trace(cov) / np.trace(pooled)) + 1e-6 * np.eye(k)))
    prior = float(np.log((np.sum(y == 1) + 1) / (np.sum(y == 0) + 1)))
    return Discriminant(centre, spread, np.array(means), np.array(factors), prior)


def calibrate(model: Discriminant, x: np.ndarray, y: np.ndarray, steps: int = 60) -> Discriminant:
    """Fits the slope and offset of the logistic score to the labels by Newton steps."""
    if len(set(y.tolist())) < 2:
        return Discriminant(**(model.__dict__ | {"slope": 0.0, "offset": 3.0 if len(y) and y[0] == 1 else -3.0 if len(y) else 0.0}))
    v = np.stack([squash(model.log_ratio(x)), np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(v @ w, -30, 30)))
        h = (v * (p * (1 - p))[:, None]).T @ v + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, v.T @ (p - y) + 1e-3 * w)
    return Discriminant(**(model.__dict__ | {"slope": float(w[0]), "offset": float(w[1])}))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Discriminant:
    """Fits on about `per_class` labelled rows of each class, drawn over all labels by hash.

    The ids of that sample are few, so they are broadcast to the one scan of the texts. Labels
    other than 0 and 1 teach nothing; a document labelled twice takes its larger label. Null and
    empty texts count as texts without words; labels without a document teach nothing. With one
    class alone every score is about 0.95 or 0.05, as the class is; without any labels 0.5.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("_y"))
    sample = bounded_sample(known, "doc_id", ["_y"], per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "_y")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["_y"].astype("int32"), "x": [statistics(t).tolist() for t in b["text"]]})

    got = rows.mapInPandas(measure, "y int, x array<double>").collect()
    got.sort(key=lambda r: (r["y"], r["x"]))
    x = np.array([r["x"] for r in got]).reshape(-1, len(STATISTICS))
    y = np.array([r["y"] for r in got], dtype=int)
    half = np.arange(len(x)) % 2 == 0
    if len(set(y[half].tolist())) == 2 and len(set(y[~half].tolist())) == 2:
        trial = calibrate(fit(x[half], y[half]), x[~half], y[~half])
        final = fit(x, y)
        return Discriminant(**(final.__dict__ | {"slope": trial.slope, "offset": trial.offset}))
    return calibrate(fit(x, y), x, y)


def score(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted; columns of those names are replaced.

    Texts are read whole; null and empty texts are scored as texts without words. One row in, one
    row out, repeated rows alike."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    @F.pandas_udf("double")
    def own(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))))

    return docs.select(*kept, own(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.filter(fold("doc_id", 5) != 0))
    return score(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
