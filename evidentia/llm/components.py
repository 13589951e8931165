"""Connected components of an edge table, as alternating star contractions in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex's larger neighbours point to the smallest of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours point to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(vertex, comp) for every vertex of ``links`` (a, b); comp is the smallest vertex reachable.

    Both stars shrink paths at least geometrically, so few rounds are needed.
    Each round is written to the shared folder, which bounds the plan and
    survives lost executors. Only one row of totals reaches the driver, from the
    write itself.
    """
    edges, before = links.where("a <> b").select("a", "b"), None
    while True:
        edges, now = written(_small_star(_large_star(edges)), "stars", total=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("vertex"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("comp")).unionByName(roots)
