"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.session import pinned


def _least(rows: DataFrame) -> DataFrame:
    """(a, b) with the least of a and its b."""
    return rows.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the least node near it."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are joined to the least of them."""
    star = e.join(_least(e), "a")
    return star.select("a", F.col("m").alias("b")).union(star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def _is_forest_of_stars(e: DataFrame) -> bool:
    """No node has two smaller neighbours, or a smaller and a larger one."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
    bad = ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("n"), F.max("up").alias("up")).where("up = 1 AND n > 1")
    return bad.agg(F.count(F.lit(1))).head()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges (``a``, ``b``; longs) that is not the
    least of its component.  The loop ends when every component is a star around its
    least node; each round is written to the shared folder, so a lost executor costs that
    round at most."""
    e = pinned(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_forest_of_stars(e):
        e = pinned(_small_star(_large_star(e)))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
