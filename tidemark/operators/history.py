"""What sessions did before and what waits: targets worked on again, chains of summaries, owed work, notes, batches and quiet keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import latest

# Days after which a calibration is old, the growth it bears, the lengths of a hit's title and body, and of a drip.
STALE_DAYS, GROWTH, TITLE, BODY, DRIP, MARGIN = 7, 0.5, 200, 600, 12, 10

PAYLOAD = "struct<targets_active: array<string>, targets: array<string>, targets_progressed: map<string, string>, open_threads: array<string>>"


def rework(compactions: DataFrame, target: str, payload: str = "payload_json") -> DataFrame:
    """compactions that worked on a target, with progress and open_threads: it is active (without active ones: a target) or has progressed.

    The text is looked at before it is parsed; what isn't JSON, or holds the name in another place only, goes.
    """
    likely = compactions.where(F.col(payload).contains(f'"{target}"')).withColumn("_p", F.from_json(payload, PAYLOAD))
    p = F.col("_p")
    active = F.when(F.coalesce(F.size(p.targets_active), F.lit(0)) > 0, p.targets_active).otherwise(p.targets)
    progress = F.try_element_at(p.targets_progressed, F.lit(target))
    found = F.coalesce(F.array_contains(active, target), F.lit(False)) | F.coalesce(F.map_contains_key(p.targets_progressed, target), F.lit(False))
    return likely.where(found).withColumn("progress", F.coalesce(progress, F.lit(""))).withColumn("open_threads", F.coalesce(F.size(p.open_threads), F.lit(0))).drop("_p")


def chain_compactions(chain: DataFrame, compactions: DataFrame, session: str, *order: Column) -> DataFrame:
    """The latest compaction of each link of a chain; links without one are left out."""
    return chain.join(latest(compactions, [session], *order), session)


def owed_since(entries: DataFrame, key: str, entry: str, watermark: int, volume: Column, budget: float) -> DataFrame:
    """Keys with an entry past the watermark whose whole volume exceeds the budget: what a full scan finds among those, read by a semi join."""
    touched = entries.where(F.col(entry) > watermark).select(key).distinct()
    return entries.join(touched, key, "left_semi").groupBy(key).agg(F.sum(volume).alias("volume")).where(F.col("volume") > budget)


def stale(quantiles: Column, age_days: Column, docs: Column, now_docs: Column) -> Column:
    """Why a calibration isn't to be trusted, or null."""
    growth = F.abs(now_docs - docs) / docs
    return F.when(F.coalesce(quantiles, F.lit(0)) < 2, "no calibration").when(age_days > STALE_DAYS, "old").when((docs > 0) & (now_docs > 0) & (growth > GROWTH), "grew")


def level(priced: Column, cap: Column, spent: Column, projected: Column, warn: Column, before: Column) -> Column:
    """How much background work a budget leaves: full, reduced or minimal; unpriced spend leaves it as it was, and recovery takes a margin."""
    bar = F.when(warn > 0, warn).otherwise(100)
    return (
        F.when(~priced, before)
        .when(cap <= 0, "full")
        .when(spent >= 100, "minimal")
        .when(projected >= bar, "reduced")
        .when((before != "full") & (projected >= bar - MARGIN), before)
        .otherwise("full")
    )


def plan_phase(path: Column) -> Column:
    """The folders of a plan's path, without what says phase or milestone."""
    parts = F.split(path, "/")
    return F.array_join(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda d: F.regexp_replace(d, "^(?i:phase-|milestone-)", "")), "/")


def received(notes: DataFrame, now: Column, inbox: str = "inbox", read_at: str = "read_at") -> tuple[DataFrame, DataFrame]:
    """The unread notes, and all notes as they are once those have been read: a note read before keeps its time."""
    return notes.where(F.col(read_at).isNull()), notes.withColumn(read_at, F.coalesce(read_at, now))


def drips(messages: DataFrame, key: str, at: str, sealed: Column, size: int = DRIP) -> DataFrame:
    """Messages past what is sealed of their key, dealt to batches of `size` in order: column drip from 0."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(at)) - 1
    return messages.where(F.col(at) > sealed).withColumn("drip", F.floor(place / size).cast("long"))


def debounced(events: DataFrame, key: str, at: Column, tie: str, quiet: int) -> DataFrame:
    """A row for each burst of a key, events no more than `quiet` seconds apart: its last event's tie column and how many it held."""
    own = Window.partitionBy(key).orderBy("_at", tie)
    rows = events.withColumn("_at", at)
    rows = rows.withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(own) > quiet).cast("int"), F.lit(1)))
    rows = rows.withColumn("_burst", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(key, "_burst").agg(F.max(F.struct("_at", tie))[tie].alias("last"), F.count("*").alias("coalesced")).drop("_burst")


def rotation(rows: DataFrame, group: str, key: str, turn: int, size: int) -> DataFrame:
    """Of each group the next `size` rows in a ring of its keys, for the turn-th time."""
    own = Window.partitionBy(group)
    place, count = F.row_number().over(own.orderBy(key)) - 1, F.count("*").over(own)
    ring = rows.withColumn("_place", place).withColumn("_count", count)
    return ring.where(F.pmod(F.col("_place") - F.lit(turn * size), F.col("_count")) < size).drop("_place", "_count")


@dataclass(frozen=True)
class Corpus:
    """How one kind of entity is searched and shown: columns of its table."""

    kind: str
    key: str
    title: str
    body: str
    meta: str
    default: bool = True


def entities(tables: dict[str, DataFrame], corpora: list[Corpus], every: bool = False) -> DataFrame:
    """Rows (kind, id, title, body, meta) of all corpora asked for by default, or of all."""
    out = None
    for c in corpora:
        if not (every or c.default):
            continue
        rows = tables[c.kind].select(
            F.lit(c.kind).alias("kind"), F.expr(c.key).cast("long").alias("id"), F.expr(f"left({c.title}, {TITLE})").alias("title"), F.expr(f"left({c.body}, {BODY})").alias("body"), F.expr(c.meta).cast("string").alias("meta")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def hydrated(hits: DataFrame, tables: dict[str, DataFrame], corpora: list[Corpus]) -> DataFrame:
    """Hits (kind, id) with what is shown of them; a hit without its row keeps nulls."""
    return hits.join(entities(tables, corpora, every=True), ["kind", "id"], "left")
