"""Embedding whitening by hierarchical merging of singular value decompositions.

A component c counts as floor(SCALE * c). Each task keeps of its rows so far their number, exact sums,
and all singular values and right vectors of the centred rows; a further block of rows, or another
task's summary, is stacked below together with a row that corrects for the two means, and decomposed
again. No dimension is dropped, so the merged summary holds the whole covariance. Summaries are merged
in a tree, FAN_IN of them in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import table
from tidewater.llm.vectors import common_length, finite, matrix

#: Integers of a unit, what is added to each, components returned at most.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Components of this size or more, as integers, have no exact place in 64-bit sums.
LARGEST = 1 << 40
#: Rows that are decomposed together, and summaries that one task merges.
BLOCK, FAN_IN = 4096, 8
#: Eigenvalues below this share of the largest are nothing but rounding.
LEAST_SHARE = 1e-12
_SHAPE = "node long, n long, sums array<long>, mean array<double>, singular array<double>, vectors array<double>"
_DOUBLES = pa.list_(pa.float64())
_SCHEMA = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("mean", _DOUBLES), ("singular", _DOUBLES), ("vectors", _DOUBLES)])


@dataclass(frozen=True)
class Summary:
    """Of n rows: their sums (integers, or None where rows are no integers), means, and the singular
    values and right vectors of the centred rows."""

    n: int
    sums: np.ndarray | None
    mean: np.ndarray
    singular: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Summary:
        """Of the rows of a matrix, with exact sums if they are integers."""
        whole = np.issubdtype(rows.dtype, np.integer)
        sums = rows.sum(0) if whole else None
        mean = (sums if whole else rows.sum(0)) / len(rows)
        _, singular, vectors = np.linalg.svd(rows - mean, full_matrices=False)
        return Summary(len(rows), sums, mean, singular, vectors)

    def merge(self, other: Summary) -> Summary:
        """Of both lots of rows together. The added row is what the two means lack from the common one."""
        n = self.n + other.n
        correction = np.sqrt(self.n / n * other.n) * (self.mean - other.mean)
        stacked = np.vstack([self.singular[:, None] * self.vectors, other.singular[:, None] * other.vectors, correction])
        _, singular, vectors = np.linalg.svd(stacked, full_matrices=False)
        if self.sums is None or other.sums is None:
            return Summary(n, None, (self.mean * self.n + other.mean * other.n) / n, singular, vectors)
        sums = self.sums + other.sums
        return Summary(n, sums, sums / n, singular, vectors)

    def row(self, node: int) -> dict:
        sums = None if self.sums is None else self.sums.tolist()
        return {"node": node, "n": self.n, "sums": sums, "mean": self.mean.tolist(), "singular": self.singular.tolist(), "vectors": self.vectors.ravel().tolist()}

    @staticmethod
    def read(row) -> Summary:
        mean = np.array(row["mean"], np.float64)
        sums = None if row["sums"] is None else np.array(row["sums"], np.int64)
        return Summary(row["n"], sums, mean, np.array(row["singular"], np.float64), np.array(row["vectors"], np.float64).reshape(-1, len(mean)))

    def covariance(self) -> np.ndarray:
        """With divisor n."""
        scaled = self.singular[:, None] * self.vectors
        return scaled.T @ scaled / self.n


def whole(x: np.ndarray) -> np.ndarray:
    """The integers of components, without OFFSET, which no covariance and no deviation depends on."""
    return np.floor(x * SCALE).astype(np.int64)


def usable(rows: DataFrame, dims: int) -> DataFrame:
    """The rows whose vector is finite and has `dims` components of less than LARGEST as integers."""
    return rows.filter(finite(F.col("embedding"), LARGEST / SCALE) & (F.size("embedding") == dims))


def summarise(rows: DataFrame, dims: int, transform=whole) -> Summary | None:
    """The summary of the `embedding`s of all rows after `transform`; None without rows. What leaves a
    task is one summary, of a size that only `dims` decides; the driver gets the last one."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, held = None, [], 0
        for b in batches:
            waiting.append(transform(matrix(b.column(0), dims)))
            held += len(waiting[-1])
            if held >= BLOCK:
                block = Summary.of(np.vstack(waiting))
                own, waiting, held = block if own is None else own.merge(block), [], 0
        if held:
            block = Summary.of(np.vstack(waiting))
            own = block if own is None else own.merge(block)
        if own is not None:
            yield pa.RecordBatch.from_pylist([own.row(TaskContext.get().partitionId())], schema=_SCHEMA)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("node").to_dict("records")
        return pd.DataFrame([reduce(Summary.merge, map(Summary.read, ordered)).row(int(ordered[0]["node"]) // FAN_IN)])

    vectors = rows.select("embedding")
    tree, left = vectors.mapInArrow(fold, _SHAPE), vectors.rdd.getNumPartitions()
    while left > 1:
        tree, left = tree.groupBy(F.floor(F.col("node") / FAN_IN).alias("_group")).applyInPandas(merge, _SHAPE), -(-left // FAN_IN)
    last = [Summary.read(r) for r in tree.orderBy("node").collect()]  # one row, or none
    return reduce(Summary.merge, last) if last else None


@dataclass(frozen=True)
class Whitening:
    """Means (without OFFSET), axes as rows by falling eigenvalue, eigenvalues, and their sum over all dimensions."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @staticmethod
    def of(summary: Summary, most: int = COMPONENTS) -> Whitening:
        """Up to `most` axes; such whose eigenvalue is nothing but rounding can't be scaled and are left
        out. Each axis points to where its largest entry (the first of equal ones) is positive."""
        e = summary.singular**2 / summary.n
        fine = e > LEAST_SHARE * max(e[0], 0.0) if len(e) else np.zeros(0, bool)
        axes = summary.vectors[fine][:most]
        signs = np.sign(np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1)) if len(axes) else 1.0
        return Whitening(summary.n, summary.sums, axes * signs, e[fine][:most], float(e.sum()))

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The whitened components of integer rows."""
        return (x - self.sums / self.n) @ self.axes.T / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - S)^2 of each row; None where a 64-bit integer can't hold it."""
        largest = float(self.n) * float(np.abs(x).max(initial=0)) + float(np.abs(self.sums).max(initial=0))
        if largest * largest * x.shape[1] < 2.0**62:
            off = self.n * x - self.sums
            return (off * off).sum(1).tolist()
        off = self.n * x.astype(object) - self.sums.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (off * off).sum(1)]


def fit(rows: DataFrame, dims: int, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of usable rows; None without any."""
    summary = summarise(rows, dims)
    return Whitening.of(summary, most) if summary else None


def identity_error(rows: DataFrame, dims: int, fitted: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, by a second pass."""
    if not len(fitted.axes):
        return 0.0
    held = rows.sparkSession.sparkContext.broadcast(fitted)
    found = summarise(rows, dims, lambda x: held.value.apply(whole(x)))
    held.destroy()
    return float(np.abs(found.covariance() - np.eye(len(fitted.axes))).max())


def whiten(rows: DataFrame, fitted: Whitening, dims: int, into: str = "whitened") -> DataFrame:
    """Adds `into` (array of components) and deviation to usable rows; columns of those names are replaced."""
    held = rows.sparkSession.sparkContext.broadcast(fitted)
    kept = [c for c in rows.columns if c not in (into, "deviation")]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(matrix(b.column(len(kept)), dims))
            out = held.value.apply(x)
            ends = np.arange(len(x) + 1, dtype=np.int32) * out.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(kept)], pa.ListArray.from_arrays(ends, out.ravel()), pa.array(held.value.deviation(x), pa.int64())],
                [*(f"c{i}" for i in range(len(kept))), "whitened", "deviation"],
            )

    named = rows.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col("embedding").alias("_vector"))
    shape = "".join(f"c{i} {dict(rows.dtypes)[c]}, " for i, c in enumerate(kept)) + "whitened array<double>, deviation long"
    return named.mapInArrow(project, shape).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), F.col("whitened").alias(into), "deviation")


def components(rows: DataFrame, key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each row that takes
    part and each component, numbered from 1.

    Left out are rows whose vector is null, holds null or non-finite components or such of LARGEST or
    more as integers, or has another length than most (of equally frequent lengths the largest counts);
    and components without variance, so one vector alone, or equal ones, give no rows, nor does an empty
    table. Repeated rows and rows with a null key count like others.
    """
    rows = rows.select(key, "embedding")
    dims = common_length(rows)
    kept = usable(rows, dims)
    fitted = fit(kept, dims, most) if dims else None
    if fitted is None or not len(fitted.axes):
        empty = f"{key} {dict(rows.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], empty)
    share = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.eigenvalues])
    out = whiten(kept, fitted, dims).select(key, "deviation", F.posexplode("whitened").alias("_place", "whitened"))
    return out.select(
        key,
        (F.col("_place") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("_place")).alias("explained"),
        F.lit(identity_error(kept, dims, fitted)).alias("identity_error"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "embeddings"))
