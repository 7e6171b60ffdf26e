"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, durable, joined


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) from edges (a, b); nodes are every a and b.

    Each round joins nodes with the least neighbour, which is combined map-side, so a node with very many edges
    is one minimum, and its edges meet that where they are (see common.joined). Rounds end when the edges no longer change; their
    number grows with the logarithm of the longest path."""
    tidy = lambda e: e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars, before = durable(tidy(edges), "edges"), None
    while True:
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if mark == before:
            break
        before = mark
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = durable(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")), "least")
        large = durable(joined(both, first, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        second = durable(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = joined(large, second, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, stars = stars, durable(tidy(small.unionByName(second.select("a", F.col("m").alias("b")))), "edges")
        dropped(old, first, large, second)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
