"""Incremental derivations on streams: exact dedup, sealed spans, event-time windows, upserts per micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tail(spark: SparkSession, path: str, schema, files_per_batch: int = 16, file_format: str = "parquet") -> DataFrame:
    """New files of a folder as a stream; the checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(file_format).load(path)


def once(stream: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """Each key once, as long as repeats come within `late`."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windows(stream: DataFrame, at: str, by: list[str], length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts per event-time window, tumbling or sliding."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, late).groupBy(w, *by).agg(F.count("*").alias("n"))


def session_windows(stream: DataFrame, at: str, by: list[str], gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n"))


def sealed_runs(stream: DataFrame, key: str, at: str, idle: int = 1800, lookahead: int = 3) -> DataFrame:
    """Runs of a key without a gap of `idle` seconds, given out once at least `lookahead` later rows have come: (key, run_from, run_to, n).

    State per key is the open run and at most `lookahead` runs behind it, each three numbers. Rows that come before what is sealed are left out.
    """
    out = f"{key} long, run_from double, run_to double, n long"
    state = "runs array<struct<lo: double, hi: double, n: long>>"

    def step(k, frames: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        runs = [list(r) for r in kept.get[0]] if kept.exists else []
        times = sorted(x for f in frames for x in f["_s"])
        for t in times:
            if runs and t < runs[0][0]:
                continue
            if runs and t - runs[-1][1] < idle:
                runs[-1][1] = max(runs[-1][1], t)
                runs[-1][2] += 1
            else:
                runs.append([t, t, 1])
        done = []
        while len(runs) > 1 and sum(r[2] for r in runs[1:]) >= lookahead:
            done.append(runs.pop(0))
        kept.update(([tuple(r) for r in runs],))
        yield pd.DataFrame([(k[0], *r) for r in done], columns=[key, "run_from", "run_to", "n"])

    rows = stream.select(F.col(key).cast("long").alias(key), (F.unix_micros(at) / 1_000_000).alias("_s"))
    return rows.groupBy(key).applyInPandasWithState(step, out, state, "append", "NoTimeout")


def available_now(stream: DataFrame, checkpoint: str, to: str, mode: str = "append") -> None:
    """Runs a stream over what is there and stops; a restart from the checkpoint goes on after it."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(to).awaitTermination()


def upsert(old: DataFrame, new: DataFrame, keys: list[str], least: list[str] = (), most: list[str] = (), order: str | None = None) -> DataFrame:
    """old and new as one row per key: least and most widen, other columns come from the row with the greatest `order` where there is one."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in {*keys, *least, *most}]
    pick = [(F.max_by(c, order) if order else F.max(c)).alias(c) for c in rest]
    return both.groupBy(*keys).agg(*[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most], *pick).select(both.columns)


def recompute_touched(batch: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that a batch touches: what a derivation has to look at again."""
    return history.join(batch.select(key).distinct(), key, "left_semi")
