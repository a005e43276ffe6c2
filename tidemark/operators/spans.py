"""Spans proposed by a model or taken from compactions: validated, trimmed, ranked, linked to what encloses them; and what sessions are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much a method's spans are trusted, best first.
METHOD_RANK = {"llm": 0, "compaction": 1, "stream": 2}


def method_rank(method: Column, superseded: Column) -> Column:
    out = F.when(superseded, 9)
    for name, rank in METHOD_RANK.items():
        out = out.when(method == name, rank)
    return out.otherwise(3)


def trimmed(spans: DataFrame, window: DataFrame, key: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Proposed spans made to fit their window (key, first, last): ends swapped back, cut to the window, and each cut to begin after those before it; what is empty then goes.

    A span's start only depends on the largest end before it, so this is a running maximum.
    """
    s = spans.join(window, key).withColumn("_a", F.greatest(F.least(lo, hi), "first")).withColumn("_b", F.least(F.greatest(lo, hi), "last")).where("_a <= _b")
    before = Window.partitionBy(key).orderBy("_a", F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn(lo, F.greatest("_a", F.coalesce(F.max("_b").over(before) + 1, F.col("_a")))).withColumn(hi, F.col("_b"))
    return s.where(F.col(lo) <= F.col(hi)).select(spans.columns)


def compaction_spans(compactions: DataFrame, sessions: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Windows of compactions that have no span yet, as spans clamped to their session (first, last)."""
    todo = compactions.join(spans.select("compaction_id").where("compaction_id is not null"), "compaction_id", "left_anti").join(sessions, key)
    return todo.select(key, "compaction_id", F.greatest("from_id", "first").alias("lo"), F.least("to_id", "last").alias("hi"), F.lit("compaction").alias("method")).where("lo <= hi")


def enclosing(fine: DataFrame, coarse: DataFrame, key: str) -> DataFrame:
    """fine with parent_lo and parent_hi of the first coarse span that holds it, null without one."""
    c = coarse.select(key, F.col("lo").alias("parent_lo"), F.col("hi").alias("parent_hi"))
    both = fine.join(c, key, "left").withColumn("_in", (F.col("lo") >= F.col("parent_lo")) & (F.col("hi") <= F.col("parent_hi")))
    best = both.groupBy(*fine.columns).agg(F.min(F.when(F.col("_in"), F.struct("parent_lo", "parent_hi"))).alias("p"))
    return best.select(*fine.columns, "p.parent_lo", "p.parent_hi")


def find_session(sessions: DataFrame, ref: str, least: int = 2) -> DataFrame:
    """The session that a reference names: '' or latest, latest:scope, an id or its prefix of six characters at least, or part of a repository's name.

    sessions: session_id, repo, last_msg, substantive. An exact id wins; a prefix that several share gives them all, two at most, newest first.
    """
    newest = [F.desc("last_msg"), F.col("session_id")]
    real = sessions.where(F.col("substantive") >= least)
    if ref in ("", "latest", "recent"):
        return real.orderBy(*newest).limit(1)
    if ref.startswith("latest:"):
        return real.where(F.col("repo").ilike(f"%{ref.removeprefix('latest:')}%")).orderBy(*newest).limit(1)
    rank = F.when(F.col("session_id") == ref, 0).when(F.lit(len(ref) >= 6) & F.col("session_id").startswith(ref), 1).when(F.col("repo").ilike(f"%{ref}%") & (F.col("substantive") >= least), 2)
    found = sessions.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", *newest).limit(2)
    first = Window.orderBy("_rank", *newest)
    several = found.withColumn("_n", F.row_number().over(first)).withColumn("_best", F.min("_rank").over(Window.partitionBy(F.lit(0))))
    return several.where("_rank = _best and (_best = 1 or _n = 1)").drop("_rank", "_n", "_best")


def frontier(targets: DataFrame, needs: DataFrame) -> DataFrame:
    """Active targets (id, status) all of whose needs (id, need) are achieved."""
    open_ = needs.join(targets.where("status = 'achieved'").select(F.col("id").alias("need")), "need", "left_anti").select("id")
    return targets.where("status = 'active'").join(open_, "id", "left_anti")


def retry_after(failures: Column, interval: int, most: int = 6 * 3600) -> Column:
    """Seconds to wait after so many failures in a row: doubled each time, up to `most`."""
    return F.when(failures <= 0, 0).otherwise(F.least(F.lit(float(most)), interval * F.pow(F.lit(2.0), failures - 1))).cast("long")
