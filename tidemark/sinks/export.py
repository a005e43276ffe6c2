"""Markdown notes that keep what people wrote below a fence, JSON rows, snapshots with retention, and table upserts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug
from ..sources.markdown import human_part

FENCE = "<!-- generated above, yours below -->"


def note(fields: dict[str, Column], title: Column, body: Column) -> Column:
    """A note: frontmatter, title, body, and the fence."""
    head = F.concat(F.lit("---\n"), *[x for k, v in fields.items() for x in (F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit("")), F.lit("\n"))], F.lit("---\n"))
    return F.concat(head, F.lit("# "), title, F.lit("\n\n"), F.coalesce(body, F.lit("")), F.lit(f"\n\n{FENCE}\n"))


def merged(new: DataFrame, old: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Notes to write: the generated part is new, what stands below the fence of the old note stays; unchanged notes are left out."""
    had = old.select(path, F.col(content).alias("_old"))
    both = new.join(had, path, "left")
    below = F.when(F.col("_old").contains(FENCE), human_part(F.col("_old"), re.escape(FENCE))).otherwise(F.lit(""))
    whole = F.concat(F.col(content), below)
    return both.withColumn(content, whole).where(F.col("_old").isNull() | (F.col("_old") != F.col(content))).drop("_old")


def note_path(kind: str, title: Column, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}/"), slug(title, 60), F.lit("-"), F.substring(F.sha1(key.cast("string")), 1, 8), F.lit(".md"))


def write_notes(notes: DataFrame, root: str, path: str = "path", content: str = "content") -> None:
    """One folder a note, named by its path, so that executors write in parallel and each note's write is atomic."""
    notes.select(F.col(path).alias("path"), F.col(content).alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("path").text(root)


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON strings, one column."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], root: str, stamp: str) -> dict[str, int]:
    """Writes tables under root/stamp and reads them back: rows per table, which must be what was written."""
    counts = {}
    for name, df in tables.items():
        df.write.mode("errorifexists").option("compression", "gzip").parquet(f"{root}/{stamp}/{name}")
        counts[name] = spark.read.parquet(f"{root}/{stamp}/{name}").count()
    return counts


def expired(stamps: list[str], keep: int) -> list[str]:
    """Snapshots that go when the newest `keep` stay."""
    return sorted(stamps)[: max(len(stamps) - keep, 0)]


def new_entries(seen: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch that aren't there yet, once each; rows without a key all count as new."""
    keyed = batch.where(" and ".join(f"{k} is not null" for k in keys)).dropDuplicates(keys).join(seen.select(*keys), keys, "left_anti")
    return keyed.unionByName(batch.where(" or ".join(f"{k} is null" for k in keys)))


def merge_meta(rows: DataFrame, key: str, order: str, newest: list[str], oldest: list[str], largest: list[str]) -> DataFrame:
    """One row per key: the newest and the oldest value that isn't empty, and the largest."""
    filled = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order))
    return rows.groupBy(key).agg(*[F.max_by(c, filled(c)).alias(c) for c in newest], *[F.min_by(c, filled(c)).alias(c) for c in oldest], *[F.max(c).alias(c) for c in largest])
