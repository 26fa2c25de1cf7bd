"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few, join_by_key, materialise


def _large_star(edges: DataFrame, paths: list[str], edges_at_most: int) -> DataFrame:
    """Each node hands its larger neighbours to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg"))
    out = join_by_key(both, materialise(few(least, 2 * edges_at_most), "cc-least", paths), "u", "deg", "inner").filter("v > u")
    return few(out.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), edges_at_most)


def _small_star(edges: DataFrame, paths: list[str], edges_at_most: int) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg"))
    least = materialise(few(least, 2 * edges_at_most), "cc-least", paths)
    out = join_by_key(edges, least, "u", "deg", "inner").filter("v <> m")
    moved = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return few(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), 2 * edges_at_most)


def components(edges: DataFrame, paths: list[str], u: str = "u", v: str = "v") -> DataFrame:
    """node and label, the least node of its component, of every node that has an edge.

    Edges are pairs of longs in either order; loops are ignored.  Every round is written to the
    shared folder, in as few files as its counted edges need; rounds end when the edges, by count
    and hash, no longer change.  A node with many neighbours is no hot spot: its least neighbour is
    pre-aggregated and joined by broadcast.  The table that the result is read from is added to `paths`.
    """
    spark = edges.sparkSession
    kept: list[str] = []
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u > v").distinct()
    now, before = materialise(now, "cc-edges", kept), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            break
        before, round_ = state, kept
        large = materialise(_large_star(now, round_, state[0]), "cc-edges", round_)
        small = _small_star(large, round_, state[0])
        kept = []
        now = materialise(small, "cc-edges", kept)
        discard(spark, round_)
    paths += kept
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
