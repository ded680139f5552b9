"""Connected components of a table of links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import drop_written, materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Alternates two steps until neither changes a link: every larger neighbour of a node is linked
    to the smallest node around it, then every smaller one. The links become stars around the
    smallest nodes in about log(diameter) rounds. Each round is summed by map-side minima, is
    written to the shared folder, and so cuts the lineage; nodes of many links are split by the
    join's skew handling. Null ends are ignored, as are loops and repeated links; no links give
    no rows.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        start = edges
        large = _large_star(edges)
        edges = _small_star(large)
        drop_written(large)
        changed = edges.join(start, ["u", "v"], "left_anti").limit(1).count() or edges.count() != start.count()
        drop_written(start)
        if not changed:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select("v", "u")).toDF("x", "y")
    low = materialise(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "minima")
    out = both.join(low, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v")
    written = materialise(out.distinct(), "links")
    drop_written(low)
    return written


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the smallest of them."""
    low = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "minima")
    out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    written = materialise(out.filter("u <> v").distinct(), "links")
    drop_written(low)
    return written
