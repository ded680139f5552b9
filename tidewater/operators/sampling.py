"""Seeded samples and splits of exact sizes, without sorting the rows.

A row's place in the draw is 60 bits of a hash of the seed and its key. To take exactly n rows of a
stratum one needs the hash of its n-th row: histograms by the leading bits narrow it down, BITS a
round, till it is known; of rows that share it (repeated keys) as many are taken as are missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.plans.shared import shared_path
from tidewater.sources.fixtures import table

#: Bits of the hash that a round resolves, so a histogram has at most 2 ** BITS rows a stratum and cut.
BITS, ROUNDS = 12, 5


def draw(seed: int, key: str) -> Column:
    """A row's place in the draw, from 0 to 2 ** 60 - 1; a null key counts as the empty text."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 15), 16, 10).cast("long")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def cut_points(rows: DataFrame, ranks: DataFrame, at: str = "_at") -> DataFrame:
    """(stratum, cut, upto, left): the place of the rank-th row of a stratum, and how many of the rows
    that share it come up to that rank. `rows` have (stratum, at), `ranks` (stratum, cut, rank) with ranks
    from 1 to the stratum's rows. Each round reads the rows' places once more, and shuffles histograms."""
    open_ = _stored(ranks.select("stratum", "cut", F.lit(0).cast("long").alias("upto"), F.col("rank").alias("left")), "ranks")
    for done in range(ROUNDS):
        shift = 60 - BITS * (done + 1)
        prefix = F.shiftright(F.col(at), shift + BITS) if done else F.lit(0).cast("long")
        within = rows.select(F.col("stratum").alias("_s"), F.shiftright(F.col(at), shift).alias("bucket"), prefix.alias("_prefix"))
        counted = within.groupBy("_s", "_prefix", "bucket").agg(F.count("*").alias("n"))
        known = counted.join(open_, F.col("_s").eqNullSafe(F.col("stratum")) & (F.col("_prefix") == F.col("upto")))
        w = Window.partitionBy("stratum", "cut").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        summed = known.withColumn("_sum", F.sum("n").over(w)).filter((F.col("_sum") >= F.col("left")) & (F.col("_sum") - F.col("n") < F.col("left")))
        open_ = _stored(summed.select("stratum", "cut", F.col("bucket").alias("upto"), (F.col("left") - F.col("_sum") + F.col("n")).alias("left")), "ranks")
    return open_


def split(rows: DataFrame, key: str, shares: dict[str, float], seed: int, stratum: Column | None = None, into: str = "split") -> DataFrame:
    """Adds `into`: one of the names in `shares`, whose shares add up to one. Of a stratum's n rows the
    first names get floor(n x the shares up to theirs) less what those before got, the last one the rest:
    the sizes are exact for every seed. The same seed, keys and rows give the same split, however the
    rows are dealt out; rows with one key may be told apart by their other columns alone, and copies of
    a row by nothing. A null stratum is a stratum."""
    names, ends, so_far = list(shares), [], 0.0
    for share in shares.values():
        so_far += share
        ends.append(min(1.0, so_far))
    if abs(so_far - 1) > 1e-9 or min(shares.values()) < 0:
        raise ValueError("shares must add up to one")
    if len(names) == 1:
        return rows.withColumn(into, F.lit(names[0]))
    drawn = rows.withColumn("_at", draw(seed, key)).withColumn("_stratum", F.lit(0) if stratum is None else stratum)
    places = drawn.select(F.col("_stratum").alias("stratum"), "_at")
    sizes = places.groupBy("stratum").agg(F.count("*").alias("n"))
    # Half a millionth more, so that 0.6 + 0.2 of 5 rows are 4 and not 3.9999.
    cuts = F.explode(F.array(*[F.struct(F.lit(i).alias("cut"), F.floor(F.col("n") * F.lit(e) + 5e-7).alias("rank")) for i, e in enumerate(ends[:-1])]))
    ranks = sizes.select("stratum", cuts.alias("c")).select("stratum", "c.cut", "c.rank")
    points = cut_points(places, ranks.filter("rank > 0"))
    told = ranks.join(points.withColumnRenamed("stratum", "_s").withColumnRenamed("cut", "_c"), F.col("stratum").eqNullSafe(F.col("_s")) & (F.col("cut") == F.col("_c")), "left")
    lists = told.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("cut", F.coalesce("upto", F.lit(-1)).alias("upto"), F.coalesce("left", F.lit(0)).alias("left")))).alias("_cuts"))
    # One row a stratum, its cuts with it.
    met = drawn.join(lists.withColumnRenamed("stratum", "_s"), F.col("_stratum").eqNullSafe(F.col("_s")), "left").drop("_s")
    shared = F.exists("_cuts", lambda c: c["upto"] == F.col("_at"))
    own = [F.col(f"`{c}`") for c in rows.columns]
    order = Window.partitionBy("_stratum", "_at").orderBy(*[F.col(f"`{c}`").cast("string") for c in rows.columns])

    def named(place: Column) -> Column:
        beyond = F.size(F.filter("_cuts", lambda c: (F.col("_at") > c["upto"]) | ((F.col("_at") == c["upto"]) & (place > c["left"]))))
        return F.get(F.array(*[F.lit(n) for n in names]), F.coalesce(beyond, F.lit(0)))

    plain = met.filter(~F.coalesce(shared, F.lit(False))).select(*own, named(F.lit(0)).alias(into))
    tied = met.filter(F.coalesce(shared, F.lit(False))).withColumn("_place", F.row_number().over(order)).select(*own, named(F.col("_place")).alias(into))
    return plain.unionByName(tied)


def sample(rows: DataFrame, key: str, n: int, seed: int, stratum: Column | None = None) -> DataFrame:
    """Exactly min(n, its rows) rows of each stratum, drawn as in `split`."""
    drawn = rows.withColumn("_at", draw(seed, key)).withColumn("_stratum", F.lit(0) if stratum is None else stratum)
    places = drawn.select(F.col("_stratum").alias("stratum"), "_at")
    ranks = places.groupBy("stratum").agg(F.least(F.count("*"), F.lit(n)).alias("rank")).withColumn("cut", F.lit(0))
    points = cut_points(places, ranks.filter("rank > 0")).withColumnRenamed("stratum", "_s").drop("cut")
    met = drawn.join(points, F.col("_stratum").eqNullSafe(F.col("_s")))
    own = [F.col(f"`{c}`") for c in rows.columns]
    order = Window.partitionBy("_stratum", "_at").orderBy(*[F.col(f"`{c}`").cast("string") for c in rows.columns])
    tied = met.filter(F.col("_at") == F.col("upto")).withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= F.col("left"))
    return reduce(DataFrame.unionByName, [met.filter(F.col("_at") < F.col("upto")).select(*own), tied.select(*own)])


SEED, SHARES, PER_STRATUM = 42, {"train": 0.6, "validation": 0.2, "test": 0.2}, 40


def q_split_exact(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return split(docs, "doc_id", SHARES, SEED, F.col("lang"))


def q_sample_exact(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return sample(docs, "doc_id", PER_STRATUM, SEED, F.col("source"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
_AT = f"CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)"
ORACLES = {
    "split_exact": f"""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY {_AT}, doc_id, source) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, source, CASE WHEN place <= floor(n * 0.6) THEN 'train' WHEN place <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM r""",
    "sample_exact": f"""SELECT doc_id, source, lang FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY {_AT}, doc_id, lang) AS place FROM documents) WHERE place <= {PER_STRATUM}""",
}
