"""Joins, windows and set operations that come back in many queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key by `order`, by an aggregate that sums up before the shuffle. Orders must be total."""
    names = [c for c in df.columns if c not in keys]
    return top_per_group(df, keys, 1, *order).select(*keys, *names)


def top_per_group(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows per key; Spark limits each group before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def around(hits: DataFrame, rows: DataFrame, key: str, place: str, k: int) -> DataFrame:
    """Rows within k places of a hit, with the hit's place and the distance. An equi join on exploded places, no range join."""
    near = hits.select(F.col(key), F.col(place).alias("hit"), F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("distance"))
    near = near.withColumn(place, F.col("hit") + F.col("distance"))
    return rows.join(near, [key, place])


def interval_join(points: DataFrame, spans: DataFrame, on: list[str], at: str, lo: str, hi: str, width: int, how: str = "inner") -> DataFrame:
    """points with the spans of the same `on` for which lo <= at <= hi. Spans are dealt to cells of `width`, so this is an equi join."""
    p = points.withColumn("_cell", F.floor(F.col(at) / width))
    s = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    s = s.withColumnsRenamed({c: f"_s_{c}" for c in on})
    test = (p["_cell"] == s["_cell"]) & F.col(at).between(F.col(lo), F.col(hi))
    for c in on:
        test = test & (p[c] == s[f"_s_{c}"])
    return p.join(s, test, how).drop(s["_cell"]).drop("_cell", *[f"_s_{c}" for c in on])


def overlap_join(a: DataFrame, b: DataFrame, on: str, a_lo: str, a_hi: str, b_lo: str, b_hi: str, width: int) -> DataFrame:
    """Pairs of spans of the same `on` that overlap, each pair once: it counts in the cell where its later start is."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    x, y = a.withColumn("_cell", cells(a_lo, a_hi)), b.withColumn("_cell", cells(b_lo, b_hi)).withColumnRenamed(on, "_on")
    test = (x["_cell"] == y["_cell"]) & (F.col(on) == F.col("_on")) & (F.col(a_lo) <= F.col(b_hi)) & (F.col(a_hi) >= F.col(b_lo)) & (x["_cell"] == F.floor(F.greatest(a_lo, b_lo) / width))
    return x.join(y, test).drop(x["_cell"]).drop(y["_cell"]).drop("_on")


def asof(left: DataFrame, right: DataFrame, on: list[str], at: str, right_at: str, columns: list[str]) -> DataFrame:
    """left with `columns` of the latest row of right not after it (null without one), by one union and one window: no join.

    Rows of right with equal times are taken in the order of their columns. left's column names must not be those.
    """
    marks = right.select(*on, F.col(right_at).alias("_at"), F.struct(F.col(right_at).alias("_at"), *columns).alias("_r"), F.lit(0).alias("_side"))
    rows = left.select(*on, F.col(at).alias("_at"), F.lit(None).cast(marks.schema["_r"].dataType).alias("_r"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    marks = marks.withColumn("_l", F.lit(None).cast(rows.schema["_l"].dataType))
    order = Window.partitionBy(*on).orderBy("_at", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(rows).withColumn("_m", F.last("_r", ignorenulls=True).over(order)).where("_side = 1")
    return found.select("_l.*", *[F.col(f"_m.{c}").alias(c) for c in columns])


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of only one side, with the side: one full join, both directions."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, key, "full_outer").where("_a is null or _b is null")
    return both.select(key, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))


def cursor_state(files: DataFrame, cursors: DataFrame, key: str) -> DataFrame:
    """Each file against how far it was read: new, deleted, truncated, append_behind, rewritten or converged.

    files: key, size, mtime; cursors: key, read_to, seen_size, seen_mtime.
    """
    both = files.join(cursors, key, "full_outer")
    state = (
        F.when(F.col("read_to").isNull(), "new")
        .when(F.col("size").isNull(), "deleted")
        .when(F.col("size") < F.col("read_to"), "truncated")
        .when(F.col("size") > F.col("read_to"), "append_behind")
        .when(F.col("mtime") != F.col("seen_mtime"), "rewritten")
        .otherwise("converged")
    )
    return both.withColumn("state", state)
