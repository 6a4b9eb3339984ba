"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(links: DataFrame, name: str = "stars") -> DataFrame:
    """node, root for every node that has a link to another; root is the smallest node of its component.

    links: a, b (numbers, not null), in any order and number. Every round sends a node's larger neighbours to
    its smallest one and then its smaller ones; each round's links are written to the shared folder. A node
    with very many neighbours is combined before the shuffle and its rows are split by Spark's skew joins.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = keep(edges, name)
    before = _mark(edges)
    while before[0]:
        both = edges.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionByName(edges.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct()
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(first, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi != lo")
        edges = keep(small.unionByName(first.select("hi", F.col("m").alias("lo"))).distinct(), name)
        now = _mark(edges)
        if now == before:
            break
        before = now
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
