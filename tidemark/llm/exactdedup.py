"""Exact duplicates by progressive refinement: length, then the hash of a prefix, then the hash of the whole text.

Only texts that share both length and prefix hash with another one get a full hash; the decision which
those are travels as a filter of bounded size, so that no text is ever shuffled. Of a group of copies only
counts and the largest id meet in one place (partial aggregates), and the group's result goes back by a join of
two written tables, which Spark can split where a third of all rows are copies of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, bounded_filter, maybe

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 64


def normalised(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, _sha (null for texts that no other resembles), and the carried columns.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id stays; of repeated rows
    with that same id exactly one is kept. Null texts are empty texts, and equal to them; null ids lose to any
    other and, in a group of their own, leave keep_id null with one row kept. An empty table gives an empty one.
    carry: columns made from docs' own in the same scan, under new names.
    """
    stage = Stage(docs.sparkSession, "exact")
    carried = {f"_carry_{name}": made for name, made in (carry or {}).items()}
    raw = F.coalesce(F.col("_text"), F.lit(""))
    key = F.xxhash64("_len", "_head")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[made.alias(name) for name, made in carried.items()])
    rows = rows.withColumn("_len", F.octet_length(raw)).withColumn("_head", F.xxhash64(F.translate(F.substring(raw, 1, prefix), UPPER, LOWER)))
    # Refinement one and two: how many rows share a length, and among those a prefix.
    counts = stage.write(rows.groupBy("_len", "_head").agg(F.count("*").alias("_n")), "parts")
    lengths = counts.groupBy("_len").agg(F.sum("_n").alias("_rows")).where("_rows > 1")
    alike = counts.join(lengths, "_len", "left_semi").where("_n > 1").select(key.alias("_part"))
    bits = stage.write(bounded_filter(alike, "_part"), "bits")
    # Refinement three: the full hash, of the survivors only.
    full = maybe(rows, key, bits).select("_id", F.monotonically_increasing_id().alias("_row"), F.when(F.col("_maybe"), F.unhex(F.sha2(normalised(F.col("_text")), 256))).alias("_sha"), *carried)
    hashed = stage.write(full, "hashed")
    groups = stage.write(
        hashed.where("_sha is not null").groupBy("_sha").agg(F.count("*").alias("group_size"), F.max(F.struct("_id", "_row")).alias("_top")).where("group_size > 1"), "groups"
    )
    found = hashed.where("_sha is not null").join(groups, "_sha", "left").withColumn("_alone", F.col("group_size").isNull())
    names = [F.col(name).alias(name.removeprefix("_carry_")) for name in carried]
    found = found.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_alone"), F.col("_id")).otherwise(F.col("_top._id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_alone") | (F.col("_top._row") == F.col("_row"))).alias("kept"),
        "_sha",
        *names,
    )
    rest = hashed.where("_sha is null").select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_sha", *names)
    return found.unionByName(rest)
