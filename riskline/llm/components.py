"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskline.llm.common import materialize


def _lowest(edges: DataFrame, key: str, other: str) -> DataFrame:
    """key -> smallest of itself and its neighbours; combined before the shuffle."""
    return edges.groupBy(F.col(key).alias("u")).agg(F.least(F.min(other), F.min(key)).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lowest(both, "a", "b")
    return (both.where("b > a").join(low, both["a"] == low["u"])
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _lowest(down, "a", "b")
    moved = down.join(low, down["a"] == low["u"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (a, b)."""
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .where("a <> b").distinct(), "links")
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges).distinct()).distinct(), "stars")
        state = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
