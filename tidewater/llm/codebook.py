"""Vector compression by codebooks of integers, one for each part of the vector.

A component x counts as floor(SCALE * x). Each round broadcasts the codebooks; Arrow batches compute
the distances of all parts to all entries as |x|^2 - 2 x.c + |c|^2 by matrix products of 64-bit
integers, take the first least, and keep sums by entry. A grouped shuffle merges the sums of the
tasks, one row for each component of an entry and task, and the entries become their floored means.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import table
from tidewater.llm.vectors import common_length, finite, matrix

#: Integers of a unit, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


class Codebooks:
    """The entries of each part: a list of integer arrays of (entries, components of the part)."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.ends = np.cumsum([e.shape[1] for e in entries]).tolist()
        self.starts = [0, *self.ends[:-1]]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] for a, b in zip(self.starts, self.ends, strict=True)]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first nearest entry of each row's parts, squared distances to them), both rows by parts."""
        codes, errors = np.zeros((len(x), len(self.entries)), np.int64), np.zeros((len(x), len(self.entries)), np.int64)
        for p, (own, entries) in enumerate(zip(self.parts(x), self.entries, strict=True)):
            far = (entries * entries).sum(1) - 2 * (own @ entries.T)
            codes[:, p] = far.argmin(1)
            errors[:, p] = (own * own).sum(1) + np.take_along_axis(far, codes[:, p : p + 1], 1)[:, 0]
        return codes, errors

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, in decimal with commas between."""
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(x * scale).astype(np.int64)


def usable(rows: DataFrame, dims: int, scale: int = SCALE) -> DataFrame:
    """The rows whose vector is finite and has `dims` components, each small enough for the exact sum
    of squared distances over a vector to stay within 64 bits."""
    return rows.filter(finite(F.col("embedding"), math.isqrt((1 << 62) // max(1, dims)) // (2 * scale)) & (F.size("embedding") == dims))


def fit(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, key: str = "vec_id") -> Codebooks | None:
    """Codebooks of usable rows; None without any. They start as the vectors of the smallest keys (nulls
    last, equal keys by their vectors); with fewer rows than entries there are as many as rows. A vector
    that parts don't divide evenly has longer first parts."""
    first = rows.select(key, "embedding").orderBy(F.asc_nulls_last(key), "embedding").limit(entries).collect()
    if not first:
        return None
    start = whole(np.array([r["embedding"] for r in first], np.float64).reshape(len(first), dims), scale)
    books = Codebooks(np.array_split(start, parts, axis=1))
    spark = rows.sparkSession
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = held.value
            totals, counts = [np.zeros_like(e) for e in own.entries], [np.zeros(len(e), np.int64) for e in own.entries]
            for b in batches:
                x = whole(matrix(b.column(0), dims), scale)
                codes, _ = own.assign(x)
                for p, part in enumerate(own.parts(x)):
                    np.add.at(totals[p], codes[:, p], part)
                    counts[p] += np.bincount(codes[:, p], minlength=len(counts[p]))
            at = [(p, e, i) for p, t in enumerate(totals) for e in range(t.shape[0]) if counts[p][e] for i in range(t.shape[1])]
            columns = [[p for p, _, _ in at], [e for _, e, _ in at], [i for _, _, i in at]]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int32()) for c in columns), pa.array([int(totals[p][e, i]) for p, e, i in at], pa.int64()), pa.array([int(counts[p][e]) for p, e, _ in at], pa.int64())],
                ["part", "entry", "place", "total", "n"],
            )

        merged = rows.select("embedding").mapInArrow(sums, "part int, entry int, place int, total long, n long").groupBy("part", "entry", "place")
        grown = [e.copy() for e in books.entries]
        for r in merged.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # a row for each component of an entry
            grown[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
        held.destroy()
        books = Codebooks(grown)
    return books


def compress(rows: DataFrame, books: Codebooks, dims: int, scale: int = SCALE) -> DataFrame:
    """Adds code (the entries' indexes in part order, two hex digits each) and error (the sum of the
    squared distances) to usable rows; columns of those names are replaced."""
    held = rows.sparkSession.sparkContext.broadcast(books)
    kept = [c for c in rows.columns if c not in ("code", "error")]
    width = 2 if all(len(e) <= 256 for e in books.entries) else 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = [f"{k:0{width}x}" for k in range(max(len(e) for e in held.value.entries))]
        for b in batches:
            codes, errors = held.value.assign(whole(matrix(b.column(len(kept)), dims), scale))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(["".join(map(digits.__getitem__, c)) for c in codes.tolist()], pa.string()), pa.array(errors.sum(1))], [*(f"c{i}" for i in range(len(kept))), "code", "error"])

    named = rows.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col("embedding").alias("_vector"))
    shape = "".join(f"c{i} {dict(rows.dtypes)[c]}, " for i, c in enumerate(kept)) + "code string, error long"
    return named.mapInArrow(cut, shape).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "code", "error")


def decompress(rows: DataFrame, books: Codebooks, scale: int = SCALE, into: str = "approximation") -> DataFrame:
    """Adds `into`: the vector that a code stands for (the middle of each integer's range); null for null."""
    width = 2 if all(len(e) <= 256 for e in books.entries) else 4
    value = F.array(*[F.array(*[F.array(*[F.lit((int(v) + 0.5) / scale) for v in entry]) for entry in e]) for e in books.entries])
    index = lambda p: F.conv(F.substring("code", p * width + 1, width), 16, 10).cast("int")
    parts = [F.get(F.get(value, F.lit(p)), index(p)) for p in range(len(books.entries))]
    return rows.withColumn(into, F.concat(*parts))


def compressed(rows: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every row that can take part.

    Left out are rows whose vector is null, holds null or non-finite components or such that 64 bits
    can't hold the squares of, or has another length than most (of equally frequent lengths the
    largest counts). Repeated rows count as often as they occur, null labels as one label, null keys as
    the largest; an empty table gives no rows.
    """
    rows = rows.select(key, label, "embedding")
    dims = common_length(rows)
    kept = usable(rows, dims)
    books = fit(kept, dims, key=key) if dims else None
    if books is None:
        return kept.filter(F.lit(False)).select(key, F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    coded = compress(kept, books, dims).drop("embedding")
    # A row for each label; whether it is small enough to be broadcast Spark sees when it is there.
    totals = coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(totals, F.col(label).eqNullSafe(F.col("_label")))
    return joined.select(key, "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Every round as a table of its own, for vectors of 64 components."""
    width = 64 // PARTS
    far = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, width + 1))
    mean = ", ".join(f"CAST(floor(sum(x[{i}]) / count(*)) AS BIGINT)" for i in range(1, width + 1))
    step = lambda k: f"""a{k} AS MATERIALIZED (
  SELECT r, part, x, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (SELECT r, p.part, x, entry, {far} AS d FROM p JOIN c{k} ON c{k}.part = p.part)
  GROUP BY r, part, x
)"""  # noqa: E731
    grow = lambda k: f"""c{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.c, c{k}.c) AS c FROM c{k} LEFT JOIN (SELECT part, entry, [{mean}] AS c FROM a{k} GROUP BY part, entry) m USING (part, entry)
)"""  # noqa: E731
    rounds = ", ".join(f"{step(k)}, {grow(k)}" for k in range(ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), p AS MATERIALIZED (
  SELECT r, part, v[part * {width} + 1:part * {width} + {width}] AS x FROM kept, (SELECT unnest(range({PARTS})) AS part)
), c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {ENTRIES}),
{rounds}, {step(ROUNDS)}, rows AS (
  SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r
), books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM rows JOIN kept USING (r), books
"""


ORACLE = _oracle()
