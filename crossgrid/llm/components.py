"""Connected components of a link table by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crossgrid.session import materialize


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long, any order, a row may repeat) to (node, comp): the smallest node each one reaches.

    Nodes without links don't occur. Each round writes the edges to the shared folder; rounds are logarithmic in
    the length of the longest chain."""
    edges = materialize(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _size(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        edges = materialize(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        now = _size(edges)
        if now == before:
            break
        before = now
    # now every node that is not the smallest of its component has one edge, to that one
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select("b", "b").distinct())
