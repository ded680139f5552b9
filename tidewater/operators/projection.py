"""Projection to few dimensions and silhouettes, by moments that tasks sum up: no pairs, no rows on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.quantiser import has_direction
from tidewater.operators.retrieval import nearest_cells
from tidewater.sources.fixtures import table

#: Sums that a task of the tree adds up.
FAN_IN = 16


def finite(vector: Column, dims: int) -> Column:
    """True for vectors of `dims` finite components."""
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def common_length(rows: DataFrame, vector: str = "embedding") -> int:
    """The length that most finite vectors have; of equally frequent ones the largest; 0 without any."""
    sizes = rows.filter(finite(F.col(vector), F.size(vector))).groupBy(F.size(vector).alias("dims")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("dims")).first()
    return most["dims"] if most else 0


def _pooled(a: tuple, b: tuple) -> tuple:
    """(rows, mean, scatter around it) of two lots together."""
    n = a[0] + b[0]
    off = b[1] - a[1]
    return n, a[1] + off * (b[0] / n), a[2] + b[2] + np.outer(off, off) * (a[0] / n * b[0])


def moments(rows: DataFrame, dims: int, vector: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance with divisor n) of finite vectors. Each task gives its count, mean and
    centred second moments; tasks add up FAN_IN of them until one is left, which the driver gets."""
    shape = "node long, n long, mean array<double>, scatter array<double>"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = None
        for b in batches:
            x = np.asarray(b.column(0).flatten()).astype(np.float64).reshape(-1, dims)
            if len(x):
                mean = x.mean(0)
                part = (len(x), mean, (x - mean).T @ (x - mean))
                own = part if own is None else _pooled(own, part)
        if own is not None:
            yield pa.RecordBatch.from_pylist([{"node": TaskContext.get().partitionId(), "n": own[0], "mean": own[1].tolist(), "scatter": own[2].ravel().tolist()}])

    def read(r) -> tuple:
        return int(r["n"]), np.array(r["mean"], np.float64), np.array(r["scatter"], np.float64).reshape(dims, dims)

    def add(group):
        ordered = group.sort_values("node").to_dict("records")
        total = read(ordered[0])
        for r in ordered[1:]:
            total = _pooled(total, read(r))
        return type(group)([{"node": int(ordered[0]["node"]) // FAN_IN, "n": total[0], "mean": total[1].tolist(), "scatter": total[2].ravel().tolist()}])

    vectors = rows.select(vector)
    tree, left = vectors.mapInArrow(fold, shape), vectors.rdd.getNumPartitions()
    while left > 1:
        tree, left = tree.groupBy(F.floor(F.col("node") / FAN_IN).alias("_g")).applyInPandas(add, shape), -(-left // FAN_IN)
    last = [read(r) for r in tree.orderBy("node").collect()]
    if not last:
        return 0, np.zeros(dims), np.zeros((dims, dims))
    total = last[0]
    for r in last[1:]:
        total = _pooled(total, r)
    return total[0], total[1], total[2] / total[0]


def axes_of(covariance: np.ndarray, count: int) -> np.ndarray:
    """The `count` unit eigenvectors of the largest eigenvalues as rows; each points to where its largest
    entry, the first of equal ones, is positive."""
    _, vectors = np.linalg.eigh(covariance)
    axes = vectors.T[::-1][:count]
    return axes * np.sign(np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1))


def project(rows: DataFrame, count: int = 2, vector: str = "embedding", digits: int = 6) -> DataFrame:
    """Adds x1, x2, ...: the coordinates on the principal axes around the mean. Rows whose vector isn't
    finite or has another length than most are left out; columns of those names are replaced."""
    dims = common_length(rows, vector)
    kept = rows.filter(finite(F.col(vector), dims))
    names = [f"x{k + 1}" for k in range(min(count, dims) or count)]
    if not dims:
        return kept.filter(F.lit(False)).withColumns({n: F.lit(0.0) for n in names})
    _, mean, covariance = moments(kept, dims, vector)
    axes = axes_of(covariance, count)
    product = lambda axis: F.aggregate(F.zip_with(vector, F.array(*map(F.lit, axis.tolist())), lambda x, a: x.cast("double") * a), F.lit(0.0), lambda s, v: s + v)
    return kept.withColumns({n: F.round(product(a) - F.lit(float(a @ mean)), digits) for n, a in zip(names, axes, strict=True)})


def silhouettes(rows: DataFrame, cell: str, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, cell, silhouette) by squared distances. The mean squared distance of a row to a cell follows
    from the cell's count, sum and sum of squares, so rows meet one row a cell and no other rows. A row
    alone in its cell has 0, as have all rows of a single cell. Rows without a cell, or whose vector isn't
    finite or has another length than most, are left out."""
    dims = common_length(rows, vector)
    kept = rows.filter(finite(F.col(vector), dims) & F.col(cell).isNotNull()).select(F.col(key), F.col(cell).alias("cell"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    placed = kept.withColumn("sq", squares)
    # Sums by place: one row for each cell and component after each task's own sums.
    sums = placed.select("cell", F.posexplode("v").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x"))
    lists = sums.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum("sq").alias("squares")).join(lists, "cell")
    # As many rows as there are cells, which is checked, go with every row.
    gathered = cells.select(F.struct("cell", "n", "squares", "total").alias("c")).agg(F.collect_list("c").alias("cells"))
    if (most := cells.count()) > MOST_CELLS:
        raise ValueError(f"{most} cells; silhouettes are for up to {MOST_CELLS}")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    far = F.transform("cells", lambda c: F.struct((c["cell"] == F.col("cell")).alias("own"), c["n"].alias("n"), (c["n"] * F.col("sq") - 2 * dot(F.col("v"), c["total"]) + c["squares"]).alias("sum")))
    met = placed.join(F.broadcast(gathered), F.lit(True)).withColumn("_far", far)
    own = F.get(F.filter("_far", lambda f: f["own"]), F.lit(0))
    a = F.greatest(own["sum"], F.lit(0.0)) / (own["n"] - 1)
    b = F.array_min(F.transform(F.filter("_far", lambda f: ~f["own"]), lambda f: F.greatest(f["sum"], F.lit(0.0)) / f["n"]))
    larger = F.greatest(a, b)
    score = F.when((own["n"] == 1) | (F.size("_far") == 1), 0.0).otherwise(F.when(larger > 0, (b - a) / larger).otherwise(0.0))
    return met.select(key, "cell", F.round(score, 6).alias("silhouette"))


#: Cells whose sums are broadcast at most.
MOST_CELLS = 10_000


def q_projection(spark: SparkSession, d: str) -> DataFrame:
    return project(table(spark, d, "embeddings").select("vec_id", "embedding")).drop("embedding")


def q_silhouette_by_label(spark: SparkSession, d: str) -> DataFrame:
    rows = silhouettes(table(spark, d, "embeddings").select("vec_id", "embedding", "label"), "label")
    return rows.groupBy(F.col("cell").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 4).alias("silhouette"))


def q_kmeans_silhouette(spark: SparkSession, d: str) -> DataFrame:
    """Three cells fitted on a sample, with their sizes and mean silhouettes."""
    docs = table(spark, d, "embeddings").select("vec_id", "embedding")
    placed, _ = nearest_cells(docs.filter(has_direction(F.col("embedding"), common_length(docs))), 3)
    return silhouettes(placed, "cell").groupBy("cell").agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 4).alias("silhouette"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
ORACLES = {
    "silhouette_by_label": f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL),
r AS (SELECT *, list_sum(list_transform(v, lambda x: x * x)) AS sq FROM e),
u AS (SELECT label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM e), t AS (SELECT label, i, sum(x) AS x FROM u GROUP BY ALL),
c AS (SELECT label, n, squares, total FROM (SELECT label, count(*) AS n, sum(sq) AS squares FROM r GROUP BY label) JOIN (SELECT label, list(x ORDER BY i) AS total FROM t GROUP BY label) USING (label)),
f AS (SELECT r.vec_id, r.label, c.label AS other, c.n, greatest(c.n * sq - 2 * {_DOT.format(a="v", b="total")} + squares, 0) AS far FROM r, c),
s AS (SELECT vec_id, label, max(CASE WHEN other = label THEN n END) AS n, max(CASE WHEN other = label THEN far / nullif(n - 1, 0) END) AS a, min(CASE WHEN other <> label THEN far / n END) AS b FROM f GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(CASE WHEN n = 1 OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE round((b - a) / greatest(a, b), 6) END), 4) AS silhouette FROM s GROUP BY label""",
}
