"""Connected components of a graph of any size, with every step a join or an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge import session


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``; the root is the component's smallest node.

    Large-star and small-star steps in turn (Kiveris et al., "Connected components in MapReduce and
    beyond") until nothing moves: every node then points at its root. Each round is written below
    the shared checkpoint folder. NULL ends and loops are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    folder = session.scratch(spark, "components")
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = _written(links.filter("a <> b").distinct(), f"{folder}/0")
    before = None
    for turn in range(1, 10_000):
        links = _written(_small_star(_large_star(links)), f"{folder}/{turn}")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")),
                        F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _written(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    larger = links.select(F.col("a").alias("v"), F.col("b").alias("a"))
    moved = larger.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()
