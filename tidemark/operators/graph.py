"""Chains, trees and components over edge tables, by pointer jumping and alternating stars: rounds grow with the logarithm of the depth."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemark-graph-"))
    return df.checkpoint()


def roots(edges: DataFrame, child: str, parent: str, hops: int = 32) -> DataFrame:
    """Rows (node, root, depth) of all children: who is reached by following parents for at most `hops` steps.

    Each round doubles the steps. A node on a cycle, which has no root, gets the least node of what it has walked.
    """
    first = edges.where(f"{child} is not null and {parent} is not null and {child} <> {parent}")
    first = first.groupBy(F.col(child).alias("node")).agg(F.min(parent).alias("root"))
    now = _cut(first.withColumn("depth", F.lit(1)))
    steps = 1
    while steps < hops:
        up = now.select(F.col("node").alias("_n"), F.col("root").alias("_r"), F.col("depth").alias("_d"))
        now = _cut(now.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_r").isNotNull().alias("_moved")))
        if not now.where("_moved").take(1):
            break
        now = now.drop("_moved")
        steps *= 2
    return now.select("node", "root", "depth")


def chains(edges: DataFrame, successor: str, predecessor: str) -> DataFrame:
    """Rows (head, position, node): each chain from its head on, by predecessors' depth. A predecessor with several successors has them at one position."""
    up = roots(edges, successor, predecessor, 1 << 20)
    heads = up.select(F.col("root").alias("head"), F.lit(0).alias("position"), F.col("root").alias("node")).distinct()
    return heads.union(up.select(F.col("root"), F.col("depth"), F.col("node")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component), the component being its least node."""
    pairs = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct()
    now, mark = _cut(pairs), None
    while True:
        both = now.union(now.select("y", "x").toDF("x", "y"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = _cut(both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct())
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        ends = F.explode(F.array(F.struct(F.col("x"), F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")
        now = _cut(large.join(least, "x").select(ends).select("e.x", "e.y").where("x <> y").distinct())
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if seen == mark:
            return now.select(F.col("x").alias("node"), F.col("y").alias("component")).union(now.select("y", "y").distinct())
        mark = seen
