"""Windows over ordered rows: gaps, blocks, spans, decisions, intervals and as-of joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import project
from ..operators import graph, temporal
from ..operators import relational as rel
from ..registry import Tables, query


@query("""SELECT user_id, round(sum(CASE WHEN gap > 0 AND gap <= 1800 THEN gap ELSE 0 END) / 3600, 6) AS hours FROM (
SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY 1""")
def active_hours_gap30(t: Tables):
    return temporal.active_seconds(t.events, "user_id", "ts", "event_id").select("user_id", F.round(F.col("active_seconds") / 3600, 6).alias("hours"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value FROM events),
b AS (SELECT user_id, n, us, us - us % 3600000000 AS start, value FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, e.us, CASE WHEN e.us - b.start > 18000000000 OR e.us - b.us > 18000000000 THEN e.us - e.us % 3600000000 ELSE b.start END, e.value
FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
SELECT user_id, strftime(make_timestamp(start), '%Y-%m-%d %H:%M:%S') AS block_start, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY 1, 2""")
def blocks_5h(t: Tables):
    b = temporal.blocks(t.events.select("user_id", "ts", "value"), "ts", ["user_id"])
    return b.groupBy("user_id", F.date_format("block_start", "yyyy-MM-dd HH:mm:ss").alias("block_start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_PROPOSED = " OR ".join(f"contains(lower(text), '{p.replace(chr(39), chr(39) * 2)}')" for p in project.PROPOSALS)
_CONFIRMED = " OR ".join(f"c = '{p}' OR starts_with(c, '{p} ') OR ends_with(c, ' {p}')" for p in (x.replace("'", "''") for x in project.CONFIRMATIONS))


@query(f"""WITH m AS (SELECT conv_id, turn, role, text, lead(turn) OVER w AS turn2, lead(role) OVER w AS role2, lead(text) OVER w AS text2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT *, regexp_replace(lower(trim(text2)), '[.!?,]+$', '') AS c FROM m WHERE role = 'assistant' AND role2 = 'user' AND strlen(text) >= 50 AND ({_PROPOSED}))
SELECT conv_id, turn AS proposal_at, turn2 AS confirmed_at FROM p WHERE strlen(c) <= 60 AND ({_CONFIRMED})""")
def decision_pairs(t: Tables):
    return temporal.decisions(t.conversations).select("conv_id", "proposal_at", "confirmed_at")


_OPENS = " OR ".join(f"starts_with(lower(trim(text2)), '{p.replace(chr(39), chr(39) * 2)}')" for p in project.NEW_TOPICS)
_SCORES = f"""SELECT conv_id, turn, CASE WHEN turn2 IS NULL THEN NULL ELSE (CASE WHEN role = 'assistant' AND role2 = 'user' THEN 0.25 + (CASE WHEN {_OPENS} THEN 0.2 ELSE 0 END) ELSE 0 END) + (CASE WHEN length(text2) >= 600 THEN 0.35 ELSE 0 END) END AS score
FROM (SELECT conv_id, turn, role, text, lead(turn) OVER w AS turn2, lead(role) OVER w AS role2, lead(text) OVER w AS text2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def _scored(t: Tables):
    """Conversations have no times; a long message stands for a pause before it."""
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = temporal.boundary_scores(t.conversations.withColumn("_long", F.when(F.length(nxt) >= 600, 0.35).otherwise(0.0)), "conv_id", "turn", "role", "text")
    return rows.withColumn("score", F.col("score") + F.col("_long"))


@query(f"SELECT conv_id, turn, round(CAST(score AS DOUBLE), 4) AS score FROM ({_SCORES})")
def segment_boundaries(t: Tables):
    return _scored(t).select("conv_id", "turn", F.round("score", 4).alias("score"))


@query(f"""WITH s AS ({_SCORES}), r AS (SELECT *, row_number() OVER w AS n, coalesce(sum(CASE WHEN score >= 0.25 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT conv_id, run, min(n) AS lo, max(n) AS hi, min(turn) AS a, max(turn) AS b FROM r GROUP BY 1, 2),
k AS (SELECT *, max(hi) OVER (PARTITION BY conv_id) AS total, max(b) OVER (PARTITION BY conv_id) AS last_turn, hi - lo + 1 >= 2 AS long FROM g),
f AS (SELECT *, max(CASE WHEN long THEN run END) OVER (PARTITION BY conv_id) AS last_long, bool_or(hi = total AND NOT long) OVER (PARTITION BY conv_id) AS short_tail FROM k)
SELECT conv_id, a AS span_from, CASE WHEN run = last_long AND short_tail THEN last_turn ELSE b END AS span_to, CASE WHEN run = last_long AND short_tail THEN total - lo + 1 ELSE hi - lo + 1 END AS n,
CASE WHEN run = last_long AND short_tail THEN 0 ELSE total - hi END >= 3 AS sealed FROM f WHERE long OR (hi = total AND last_long IS NULL)""")
def segment_spans(t: Tables):
    return temporal.spans(_scored(t), "conv_id", "turn", 0.25)


@query("""SELECT c_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS at FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_per_key(t: Tables):
    """The newest row per key as one aggregate."""
    top = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return top.select("c_custkey", "m.o_orderkey", F.date_format("m.o_orderdate", "yyyy-MM-dd").alias("at"))


@query("""SELECT source, string_agg(CAST(doc_id AS VARCHAR) || ':' || excerpt, '|' ORDER BY doc_id) AS newest FROM (SELECT source, doc_id, text[1:30] AS excerpt, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= 3 GROUP BY 1""")
def topn_nested_status(t: Tables):
    top = rel.top_per_group(t.documents.select("source", "doc_id", F.substring("text", 1, 30).alias("e")), ["source"], 3, F.desc("doc_id"))
    made = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "e"))), lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["e"]))
    return top.groupBy("source").agg(F.array_join(made, "|").alias("newest"))


@query("""SELECT corpus, id, round(p, 6) AS p FROM (SELECT 'd' AS corpus, doc_id AS id, percent_rank() OVER (ORDER BY n_chars DESC, doc_id) AS p FROM documents UNION ALL
SELECT 'b', item_id, percent_rank() OVER (ORDER BY length(text) DESC, item_id) FROM benchmark) ORDER BY p, corpus DESC, id LIMIT 40""")
def percentile_merge(t: Tables):
    """Ranks of several lists as shares of their own length, merged."""
    both = t.documents.select(F.lit("d").alias("corpus"), F.col("doc_id").alias("id"), F.col("n_chars").alias("x")).unionByName(t.benchmark.select(F.lit("b").alias("corpus"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("x")))
    p = F.percent_rank().over(Window.partitionBy("corpus").orderBy(F.desc("x"), "id"))
    return both.withColumn("p", p).orderBy("p", F.desc("corpus"), "id").limit(40).select("corpus", "id", F.round("p", 6).alias("p"))


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM conversations WHERE role <> 'system'""")
def ordinal_positions(t: Tables):
    return t.conversations.where("role <> 'system'").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("ordinal"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS section FROM events""")
def ffill_section(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("section"))


@query("""SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS first_done, first(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS first_priority FROM orders GROUP BY 1""")
def first_nonempty(t: Tables):
    at = F.struct("o_orderdate", "o_orderkey")
    done = F.col("o_orderstatus") == "F"
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.when(done, at)).alias("first_done"), F.min_by("o_orderpriority", at).alias("first_priority"))


@query("""SELECT e.event_id, c.event_id AS rate_id, round(c.value, 4) AS rate FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) c
ON e.user_id = c.user_id AND e.ts >= c.ts""")
def asof_rate(t: Tables):
    cards = t.events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by(F.struct(F.col("event_id").alias("rate_id"), F.col("value").alias("rate")), "event_id").alias("r")).select("user_id", F.col("ts").alias("at"), "r.*")
    return rel.asof(t.events.select("event_id", "user_id", "ts"), cards, ["user_id"], "ts", "at", ["rate_id", "rate"]).select("event_id", "rate_id", F.round("rate", 4).alias("rate"))


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1, 2)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, strftime(pred, '%Y-%m-%d') AS predecessor, CASE WHEN lo - pred_hi < INTERVAL 24 HOUR THEN 'high' WHEN pred IS NOT NULL THEN 'medium' END AS confidence
FROM (SELECT user_id, day, lo, lag(day) OVER w AS pred, lag(hi) OVER w AS pred_hi FROM s WINDOW w AS (PARTITION BY user_id ORDER BY lo))""")
def asof_predecessor(t: Tables):
    """Sessions of one place don't overlap here, so the latest that ended before is the one before."""
    s = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    ends = s.select("user_id", F.col("hi").alias("at"), F.col("day").alias("pred"), F.col("hi").alias("pred_hi"))
    got = rel.asof(s.withColumn("before", F.col("lo") - F.expr("INTERVAL 1 MICROSECOND")), ends, ["user_id"], "before", "at", ["pred", "pred_hi"])
    sure = F.when(temporal.micros(F.col("lo")) - temporal.micros(F.col("pred_hi")) < 86_400_000_000, "high").when(F.col("pred").isNotNull(), "medium")
    return got.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("pred", "yyyy-MM-dd").alias("predecessor"), sure.alias("confidence"))


_SPANS = "SELECT conv_id, turn AS lo, turn + 1 + conv_id % 4 AS hi, CASE WHEN turn % 4 = 0 THEN 0 WHEN turn % 2 = 0 THEN 2 ELSE 3 END AS method FROM conversations WHERE turn % 2 = 0"


def _spans(t: Tables):
    method = F.when(F.col("turn") % 4 == 0, 0).when(F.col("turn") % 2 == 0, 2).otherwise(3)
    return t.conversations.where("turn % 2 = 0").select("conv_id", F.col("turn").alias("lo"), (F.col("turn") + 1 + F.col("conv_id") % 4).alias("hi"), method.alias("method"))


@query(f"""SELECT conv_id, turn, lo, hi, method FROM (SELECT c.conv_id, c.turn, s.lo, s.hi, s.method, row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY s.method, s.hi - s.lo, s.lo) AS r
FROM conversations c JOIN ({_SPANS}) s ON s.conv_id = c.conv_id AND c.turn BETWEEN s.lo AND s.hi) WHERE r = 1""")
def range_contain_narrowest(t: Tables):
    j = rel.interval_join(t.conversations.select("conv_id", "turn"), _spans(t), ["conv_id"], "turn", "lo", "hi", 8)
    best = j.groupBy("conv_id", "turn").agg(F.min(F.struct("method", (F.col("hi") - F.col("lo")).alias("w"), "lo", "hi")).alias("b"))
    return best.select("conv_id", "turn", "b.lo", "b.hi", "b.method")


@query(f"""WITH s AS ({_SPANS}) SELECT DISTINCT a.conv_id, a.lo, a.hi FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.lo <= b.hi AND a.hi >= b.lo AND b.method < a.method""")
def range_overlap_supersede(t: Tables):
    a = _spans(t)
    b = a.select("conv_id", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("method").alias("method2"))
    return rel.overlap_join(a, b, "conv_id", "lo", "hi", "lo2", "hi2", 8).where("method2 < method").select("conv_id", "lo", "hi").distinct()


@query(f"""WITH s AS ({_SPANS}) SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = c.conv_id AND s.method = 0 AND s.lo < c.turn AND c.turn <= s.hi)""")
def covered_suppress_anti(t: Tables):
    """Rows that no span of the best method covers, its first row not counted: spans as runs of their places, an equi anti join."""
    inside = _spans(t).where("method = 0 and hi > lo").select("conv_id", F.explode(F.sequence(F.col("lo") + 1, "hi")).alias("turn"))
    return t.conversations.select("conv_id", "turn").join(inside, ["conv_id", "turn"], "left_anti")


@query("""WITH h AS (SELECT conv_id, turn AS hit FROM conversations WHERE text ILIKE '%ing the%') SELECT h.conv_id, h.hit, c.turn, c.turn - h.hit AS distance, c.role FROM h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn BETWEEN h.hit - 2 AND h.hit + 2""")
def context_window_msgs(t: Tables):
    hits = t.conversations.where(F.col("text").ilike("%ing the%")).select("conv_id", "turn")
    return rel.around(hits, t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", 2).select("conv_id", "hit", "turn", F.col("distance").cast("long").alias("distance"), "role")


_CUTS = "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END AS gold, CASE WHEN length(text) % 3 = 0 THEN 1 ELSE 0 END AS guess FROM conversations"


@query(f"""WITH c AS ({_CUTS}), p AS (SELECT conv_id, turn, row_number() OVER w AS n, coalesce(sum(gold) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g,
coalesce(sum(guess) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT a.conv_id, round(avg(CASE WHEN (b.g > a.g) <> (b.h > a.h) THEN 1.0 ELSE 0.0 END), 6) AS pk, round(avg(CASE WHEN b.g - a.g <> b.h - a.h THEN 1.0 ELSE 0.0 END), 6) AS window_diff, count(*) AS windows
FROM p a JOIN p b ON b.conv_id = a.conv_id AND b.n = a.n + 2 GROUP BY 1""")
def pk_windowdiff(t: Tables):
    cuts = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, 1).otherwise(0).alias("gold"), F.when(F.length("text") % 3 == 0, 1).otherwise(0).alias("guess"))
    e = temporal.segmentation_errors(cuts, "conv_id", "turn", "gold", "guess", 2)
    return e.select("conv_id", F.round("pk", 6).alias("pk"), F.round("window_diff", 6).alias("window_diff"), "windows")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def event_tumbling(t: Tables):
    return t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""SELECT strftime(make_timestamp(w), '%Y-%m-%d %H:%M') AS at, count(*) AS n FROM (SELECT unnest([epoch_us(ts) // 43200000000 * 43200000000, epoch_us(ts) // 43200000000 * 43200000000 - 43200000000]) AS w FROM events) GROUP BY 1""")
def event_sliding(t: Tables):
    return t.events.groupBy(F.window("ts", "1 day", "12 hours").alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("at"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR > ts THEN 0 ELSE 1 END AS s FROM events),
r AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS at, count(*) AS n FROM r GROUP BY user_id, run""")
def event_session_window(t: Tables):
    return t.events.groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("at"), "n")


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS node, s_suppkey // 3 AS parent FROM supplier WHERE s_suppkey // 3 >= 1),
w AS (SELECT node, parent AS root, 1 AS depth FROM e UNION ALL SELECT w.node, e.parent, w.depth + 1 FROM w JOIN e ON e.node = w.root)
SELECT node, root, CAST(depth AS BIGINT) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth DESC) AS r FROM w) WHERE r = 1""")
def spawn_tree_roots(t: Tables):
    edges = t.supplier.select(F.col("s_suppkey").alias("node"), F.floor(F.col("s_suppkey") / 3).cast("long").alias("parent")).where("parent >= 1")
    return graph.roots(edges, "node", "parent").select("node", "root", F.col("depth").cast("long").alias("depth"))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS node, s_suppkey // 3 AS parent FROM supplier WHERE s_suppkey // 3 >= 1),
w AS (SELECT node, parent AS root, 1 AS depth FROM e UNION ALL SELECT w.node, e.parent, w.depth + 1 FROM w JOIN e ON e.node = w.root),
r AS (SELECT s_suppkey AS node, s_suppkey AS root, s_acctbal FROM supplier WHERE s_suppkey // 3 < 1 UNION ALL SELECT node, root, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth DESC) AS n FROM w) x JOIN supplier ON s_suppkey = x.node WHERE n = 1)
SELECT root, count(*) AS agents, round(sum(s_acctbal), 2) AS cost FROM r GROUP BY 1 ORDER BY cost DESC, root LIMIT 10""")
def spawn_tree_rollup(t: Tables):
    """Costs of whole trees, the dearest first."""
    edges = t.supplier.select(F.col("s_suppkey").alias("node"), F.floor(F.col("s_suppkey") / 3).cast("long").alias("parent")).where("parent >= 1")
    up = graph.roots(edges, "node", "parent")
    rows = t.supplier.join(up, F.col("s_suppkey") == F.col("node"), "left").select(F.coalesce("root", "s_suppkey").alias("root"), "s_acctbal")
    return rows.groupBy("root").agg(F.count("*").alias("agents"), F.round(F.sum("s_acctbal"), 2).alias("cost")).orderBy(F.desc("cost"), "root").limit(10)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS node, n_nationkey - 5 AS pred FROM nation WHERE n_nationkey >= 5),
w AS (SELECT n_nationkey AS node, n_nationkey AS head, 0 AS position FROM nation WHERE n_nationkey < 5 UNION ALL SELECT e.node, w.head, w.position + 1 FROM w JOIN e ON e.pred = w.node)
SELECT head, position, node FROM w""")
def chain_walk(t: Tables):
    """Chains from their heads on; here every fifth nation follows another."""
    edges = t.nation.where("n_nationkey >= 5").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") - 5).alias("pred"))
    return graph.chains(edges, "node", "pred")
