"""Streams over the given tables, run until nothing is left and read back: the same rows as a batch query gives."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..registry import Tables, query
from ..streaming import incremental


def _run(t: Tables, name: str, made, mode: str = "append"):
    """made as a finished stream's table, in the shared folder."""
    root = t.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemark-stream-")
    root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    incremental.available_now(made, f"{root}/checkpoint", f"{root}/out", mode)
    return t.spark.read.schema(made.schema).parquet(f"{root}/out")


def _events(t: Tables):
    s = incremental.tail(t.spark, f"{t.dir}/events.parquet*", t.events.schema)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_dedup_counts(t: Tables):
    twice = _events(t).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    out = _run(t, "dedup", incremental.once(twice, ["event_id"], "ts"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, CASE WHEN epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w < 43200 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, s, sum(new) OVER (PARTITION BY user_id ORDER BY s RANGE UNBOUNDED PRECEDING) AS run FROM g), k AS (SELECT user_id, run, min(s) AS run_from, max(s) AS run_to, count(*) AS n FROM r GROUP BY 1, 2),
f AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY run DESC) - n AS later FROM k)
SELECT user_id, CAST(round(run_from * 1000) AS BIGINT) AS run_from, CAST(round(run_to * 1000) AS BIGINT) AS run_to, n FROM f WHERE later >= 3""")
def stream_seal_spans(t: Tables):
    """Runs without a gap of twelve hours, sealed once three rows follow."""
    out = _run(t, "seal", incremental.sealed_runs(_events(t), "user_id", "ts", 43_200, 3))
    return out.select("user_id", F.round(F.col("run_from") * 1000).cast("long").alias("run_from"), F.round(F.col("run_to") * 1000).cast("long").alias("run_to"), "n")


@query("SELECT user_id, min(event_id) AS first_seen, max(event_id) AS last_seen, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def upsert_widening(t: Tables):
    """Two batches as one table: first and last widen, the rest comes from the later row."""
    rows = t.events.select("user_id", F.col("event_id").alias("first_seen"), F.col("event_id").alias("last_seen"), "event_type", F.col("event_id").alias("ord"))
    one = lambda df: incremental.upsert(df, df.limit(0), ["user_id"], ["first_seen"], ["last_seen", "ord"], "ord")
    both = incremental.upsert(one(rows.where("event_id % 2 = 0")), one(rows.where("event_id % 2 = 1")), ["user_id"], ["first_seen"], ["last_seen", "ord"], "ord")
    return both.select("user_id", "first_seen", "last_seen", "event_type")


@query("SELECT * FROM events WHERE user_id IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29')")
def incremental_touched(t: Tables):
    """What a derivation looks at again after a batch: all rows of the keys in it."""
    return incremental.recompute_touched(t.events.where("ts >= timestamp'2024-01-29'"), t.events, "user_id")
