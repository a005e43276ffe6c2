"""Gaps, blocks, boundaries and spans over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.project import opens_topic

IDLE = 30 * 60
BLOCK = 5 * 3600


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, of times with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    return micros(ts) / 1_000_000


def active_seconds(df: DataFrame, key: str, ts: str, tie: str, idle: int = IDLE) -> DataFrame:
    """Per key the sum of gaps between neighbours that are above 0 and at most `idle`."""
    gap = seconds(F.col(ts)) - F.lag(seconds(F.col(ts))).over(Window.partitionBy(key).orderBy(ts, tie))
    return df.withColumn("_gap", gap).groupBy(key).agg(F.sum(F.when((F.col("_gap") > 0) & (F.col("_gap") <= idle), F.col("_gap")).otherwise(0.0)).alias("active_seconds"))


def blocks(df: DataFrame, ts: str, keys: list[str], length: int = BLOCK) -> DataFrame:
    """df's times with the start of their block: a block begins at the full hour of its first row, and a new one where a row is
    more than `length` after that start or after the row before.

    A gap above `length` always begins a block, so islands between such gaps are independent. An island's rows are folded in
    order to its block starts, of which there are few; then each row takes the last start not after it.
    """
    rows = df.withColumn("_us", micros(F.col(ts)))
    times = rows.select(*keys, "_us").distinct()
    far = F.col("_us") - F.lag("_us").over(Window.partitionBy(*keys).orderBy("_us")) > length * 1_000_000
    island = F.sum(F.when(far, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy("_us"))
    times = times.withColumn("_island", island)
    hour = 3600 * 1_000_000
    folded = times.groupBy(*keys, "_island").agg(F.sort_array(F.collect_list("_us")).alias("_all"))

    def begin(x: Column) -> Column:
        return x - F.pmod(x, F.lit(hour))

    starts = F.aggregate(
        "_all",
        F.struct(F.lit(None).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all")),
        lambda acc, x: F.when(acc["at"].isNull() | (x - acc["at"] > length * 1_000_000), F.struct(begin(x).alias("at"), F.array_append(acc["all"], begin(x)).alias("all"))).otherwise(acc),
        lambda acc: acc["all"],
    )
    begun = folded.select(*keys, F.explode(starts).alias("_begin")).select(*keys, F.col("_begin").alias("_us"), F.lit(True).alias("_mark"))
    both = rows.withColumn("_mark", F.lit(False)).unionByName(begun, allowMissingColumns=True)
    at = F.last(F.when(F.col("_mark"), F.col("_us")), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_us", F.desc("_mark")).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("block_start", F.timestamp_micros(at)).where("not _mark").drop("_mark", "_us")


def boundary_scores(df: DataFrame, key: str, place: str, role: str, text: str, ts: str | None = None, idle: int = IDLE) -> DataFrame:
    """df with `score`, how likely a topic ends after the row, null after the last row of a key.

    A gap of `idle` counts 0.7 and of a third of it 0.35; a user after an assistant 0.25, and 0.2 more where a new topic
    is opened; 1 at most.
    """
    order = Window.partitionBy(key).orderBy(place)
    nxt = lambda c: F.lead(c).over(order)
    turn = (F.col(role) == "assistant") & (nxt(role) == "user")
    score = F.when(turn, 0.25).otherwise(0.0) + F.when(turn & opens_topic(nxt(text)), 0.2).otherwise(0.0)
    if ts:
        gap = seconds(nxt(ts)) - seconds(F.col(ts))
        score = score + F.when(gap >= idle, 0.7).when(gap >= idle / 3, 0.35).otherwise(0.0)
    return df.withColumn("score", F.when(nxt(place).isNotNull(), F.least(score, F.lit(1.0))))


def spans(scored: DataFrame, key: str, place: str, threshold: float, least: int = 2, lookahead: int = 3) -> DataFrame:
    """Spans (key, span_from, span_to, n, sealed) from cuts after rows with score >= threshold.

    A run shorter than `least` between cuts gives no span; a short last run is taken into the span before it, or stands alone
    without one. A span is sealed when at least `lookahead` rows follow it.
    """
    order = Window.partitionBy(key).orderBy(place)
    before = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(F.when(F.col("score") >= threshold, 1).otherwise(0)).over(before), F.lit(0))
    rows = scored.withColumn("_n", F.row_number().over(order)).withColumn("_run", run)
    runs = rows.groupBy(key, "_run").agg(F.min("_n").alias("lo"), F.max("_n").alias("hi"), F.count("*").alias("n"), F.min(place).alias("span_from"), F.max(place).alias("span_to"))
    last = Window.partitionBy(key)
    runs = runs.withColumn("_total", F.max("hi").over(last)).withColumn("_tail", F.col("hi") == F.col("_total"))
    kept = runs.withColumn("_long", F.col("n") >= least).withColumn("_any", F.max(F.when(F.col("_long"), F.col("_run"))).over(last))
    tail = F.max(F.when(F.col("_tail") & ~F.col("_long"), F.struct("hi", "span_to"))).over(last)
    kept = kept.withColumn("_absorb", tail).where(F.col("_long") | (F.col("_tail") & F.col("_any").isNull()))
    takes = (F.col("_run") == F.col("_any")) & F.col("_absorb").isNotNull()
    kept = kept.withColumn("_hi", F.when(takes, F.col("_absorb.hi")).otherwise(F.col("hi")))
    return kept.select(
        key,
        "span_from",
        F.when(takes, F.col("_absorb.span_to")).otherwise(F.col("span_to")).alias("span_to"),
        (F.col("_hi") - F.col("lo") + 1).cast("long").alias("n"),
        (F.col("_total") - F.col("_hi") >= lookahead).alias("sealed"),
    )


def segmentation_errors(cuts: DataFrame, key: str, place: str, gold: str, guess: str, window: int) -> DataFrame:
    """Pk and WindowDiff per key: rows hold 1 in `gold` and `guess` where a segment ends after them. Windows slide over pairs (i, i + window)."""
    order = Window.partitionBy(key).orderBy(place)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    for c in (gold, guess):
        cuts = cuts.withColumn(f"_{c}", F.coalesce(F.sum(c).over(upto), F.lit(0)))
    for c in (gold, guess):
        cuts = cuts.withColumn(f"_d{c}", F.lead(f"_{c}", window).over(order) - F.col(f"_{c}"))
    pairs = cuts.where(F.col(f"_d{gold}").isNotNull())
    a, b = F.col(f"_d{gold}"), F.col(f"_d{guess}")
    return pairs.groupBy(key).agg(F.avg(((a > 0) != (b > 0)).cast("double")).alias("pk"), F.avg((a != b).cast("double")).alias("window_diff"), F.count("*").alias("windows"))


def decisions(messages: DataFrame, key: str = "conv_id", place: str = "turn") -> DataFrame:
    """Pairs of an assistant's proposal and the user's confirmation that comes next among messages that aren't noise."""
    from ..functions.project import is_confirmation, is_noise, is_proposal

    order = Window.partitionBy(key).orderBy(place)
    real = messages.where(~is_noise(F.col("text")))
    pairs = real.select(key, F.col(place).alias("proposal_at"), "role", F.col("text").alias("proposal"), F.lead(place).over(order).alias("confirmed_at"), F.lead("role").over(order).alias("_role"), F.lead("text").over(order).alias("confirmation"))
    pairs = pairs.where("role = 'assistant' and _role = 'user'")
    return pairs.where(is_proposal(F.col("proposal")) & is_confirmation(F.col("confirmation"))).drop("role", "_role").dropDuplicates([key, "proposal_at", "confirmed_at"])
