"""Billable calls, prices, budgets, over lineitem, orders and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import usage
from ..registry import Tables, query

#: Calls: an order is a request, its lines are records of it; part's size tells the model.
_CALLS = """SELECT l_orderkey AS call, l_suppkey AS req, max(CAST(l_quantity * 1000 AS BIGINT)) AS input, max(CAST(l_extendedprice AS BIGINT)) AS cache_read, max(CAST(l_tax * 1000 AS BIGINT)) AS output,
min_by(l_returnflag, struct_pack(a := l_shipdate, b := l_linenumber)) AS model, min(l_shipdate) AS seen_at FROM lineitem GROUP BY 1, 2"""


def _calls(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("call"), F.col("l_suppkey").alias("req"), (F.col("l_quantity") * 1000).cast("long").alias("input"), F.round("l_extendedprice").cast("long").alias("cache_read"), F.round(F.col("l_tax") * 1000).cast("long").alias("output"), F.col("l_returnflag").alias("model"), F.col("l_shipdate").alias("at"), "l_linenumber")
    return usage.billable(rows, ["call", "req"], ["input", "cache_read", "output"], ["model", "at"], ["at", "l_linenumber"])


_ROUND = _CALLS.replace("CAST(l_extendedprice AS BIGINT)", "CAST(round(l_extendedprice) AS BIGINT)").replace("CAST(l_tax * 1000 AS BIGINT)", "CAST(round(l_tax * 1000) AS BIGINT)")


@query(f"SELECT strftime(seen_at, '%Y-%m') AS period, count(*) AS calls, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(output) AS BIGINT) AS output FROM ({_ROUND}) GROUP BY 1")
def usage_dedup_day(t: Tables):
    """Repeated records of a call count once, at their largest, before anything is summed."""
    return _calls(t).groupBy(F.date_format("at", "yyyy-MM").alias("period")).agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in ("input", "cache_read", "output")])


#: Fixed rates of this query's three models, per token: input, output, cache read, and above the long-context threshold.
_RATES = {"R": (3e-6, 1.5e-5, 3e-7, 6e-6), "A": (5e-6, 2.5e-5, 5e-7, 1e-5), "N": (1e-6, 5e-6, 1e-7, 0.0)}
_CASE = lambda i: "CASE model " + " ".join(f"WHEN '{m}' THEN {r[i]!r}" for m, r in _RATES.items()) + " END"


@query(f"""SELECT model, count(*) AS calls, round(sum(input * CASE WHEN input + cache_read > 60000 AND {_CASE(3)} > 0 THEN {_CASE(3)} ELSE {_CASE(0)} END + output * {_CASE(1)} + cache_read * {_CASE(2)}), 4) AS cost FROM ({_ROUND}) GROUP BY 1""")
def usage_by_model(t: Tables):
    """Each call is priced by its own context, then prices are summed."""
    rate = lambda i: F.element_at(F.create_map(*[x for m, r in _RATES.items() for x in (F.lit(m), F.lit(r[i]))]), F.col("model"))
    tokens = {"input": F.col("input"), "output": F.col("output"), "cache_read": F.col("cache_read"), "write_5m": F.lit(0), "write_1h": F.lit(0)}
    cost = usage.price(tokens, {"input": rate(0), "output": rate(1), "cache_read": rate(2), "write_5m": F.lit(0.0), "write_1h": F.lit(0.0)}, {"input": rate(3)}, F.lit(60_000))
    return _calls(t).withColumn("cost", cost).groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))


@query("""WITH c AS (SELECT user_id, ts, max(value) AS rate FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), w AS (SELECT user_id, row_number() OVER v AS n, ts, lead(ts) OVER v AS until, rate FROM c WINDOW v AS (PARTITION BY user_id ORDER BY ts))
SELECT e.event_id, round(e.value * coalesce(w.rate, 0), 4) AS cost, w.rate IS NOT NULL AS priced FROM events e LEFT JOIN w ON w.user_id = e.user_id AND (e.ts >= w.ts OR w.n = 1) AND (e.ts < w.until OR w.until IS NULL)""")
def usage_dated_rates(t: Tables):
    """The rate in force at a record's time, the first one for what is older: windows of validity joined on the model."""
    cards = t.events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("rate"))
    v = Window.partitionBy("user_id").orderBy("ts")
    w = cards.select(F.col("user_id").alias("u"), F.when(F.row_number().over(v) == 1, F.lit(None)).otherwise(F.col("ts")).alias("lo"), F.lead("ts").over(v).alias("hi"), "rate")
    j = t.events.join(w, (F.col("user_id") == F.col("u")) & (F.col("lo").isNull() | (F.col("ts") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("ts") < F.col("hi"))), "left")
    return j.select("event_id", F.round(F.col("value") * F.coalesce("rate", F.lit(0.0)), 4).alias("cost"), F.col("rate").isNotNull().alias("priced"))


@query("""SELECT source, reason, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT d.source, n_chars, CASE WHEN l.doc_id IS NULL THEN 'no key' WHEN n_chars = 0 THEN 'no tokens' END AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE reason IS NOT NULL GROUP BY 1, 2""")
def usage_quarantine(t: Tables):
    """Records without a key are left out of totals and told per source with the reason."""
    keyed = t.documents.join(t.labels.select("doc_id", F.lit(1).alias("k")), "doc_id", "left")
    reason = F.when(F.col("k").isNull(), "no key").when(F.col("n_chars") == 0, "no tokens")
    return keyed.groupBy("source", reason.alias("reason")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).where("reason is not null")


_DAYS = "SELECT CAST(ts AS DATE) AS day, sum(value) AS estimate FROM events GROUP BY 1"


@query(f"""WITH e AS ({_DAYS}), s AS (SELECT CAST(ts AS DATE) AS day, sum(value) * 1.1 AS settled FROM events WHERE day(ts) % 3 = 0 GROUP BY 1)
SELECT strftime(e.day, '%Y-%m-%d') AS day, round(coalesce(settled, estimate), 4) AS cost, CASE WHEN settled IS NULL THEN 'estimated' ELSE 'reconciled' END AS cost_source FROM e LEFT JOIN s ON s.day = e.day""")
def usage_reconciled_mixed(t: Tables):
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("estimate"))
    settled = days.where(F.dayofmonth("day") % 3 == 0).select("day", (F.col("estimate") * 1.1).alias("settled"))
    r = usage.reconcile(days, settled, "day", "estimate", "settled")
    return r.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("cost", 4).alias("cost"), "cost_source")


@query(f"""WITH d AS ({_DAYS}), s AS (SELECT sum(estimate) FILTER (WHERE day <= DATE '2024-01-20') AS spent, sum(estimate) FILTER (WHERE day >= DATE '2024-01-13' AND day <= DATE '2024-01-20') / 7.0 AS per_day FROM d)
SELECT round(spent, 4) AS spent, round(per_day, 4) AS per_day, round(spent + per_day * 12, 4) AS projected, CASE WHEN spent >= 1000000 THEN 'over' WHEN 100 * (spent + per_day * 12) / 1000000 >= 80 THEN 'warn' ELSE 'ok' END AS severity FROM s""")
def budget_projection(t: Tables):
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("cost"))
    b = usage.budget(days, "day", "cost", "2024-01-20 00:00:00", 1_000_000.0)
    return b.select(*[F.round(c, 4).alias(c) for c in ("spent", "per_day", "projected")], "severity")


@query("""SELECT user_id, event_type, round(value, 4) AS peak, CASE WHEN ends_with(event_type, 'e') THEN 1000000 ELSE 200000 END AS size FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def context_peak_maxby(t: Tables):
    """A session's largest value with the row that it comes from."""
    m = t.events.groupBy("user_id").agg(F.max(F.struct("value", "event_id", "event_type")).alias("m"))
    return m.select("user_id", "m.event_type", F.round("m.value", 4).alias("peak"), F.when(F.col("m.event_type").endswith("e"), 1_000_000).otherwise(200_000).alias("size"))


@query("""WITH c AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'system') AS mark FROM conversations GROUP BY 1)
SELECT m.conv_id, CASE WHEN sum(CASE WHEN role = 'assistant' THEN length(text) END) IS NULL THEN CAST(count(*) * 4000 AS BIGINT) ELSE CAST(sum(CASE WHEN role = 'assistant' THEN length(text) END) AS BIGINT) END AS owed, count(*) AS msgs
FROM conversations m JOIN c ON c.conv_id = m.conv_id WHERE mark IS NULL OR turn > mark GROUP BY 1""")
def addenda_fallback(t: Tables):
    """What came after a session's cursor; without recorded usage a message counts 4000."""
    cursor = t.conversations.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", F.col("turn"))).alias("at"))
    rows = t.conversations.join(cursor, "conv_id").where("at is null or turn > at")
    real = F.sum(F.when(F.col("role") == "assistant", F.length("text").cast("long")))
    return rows.groupBy("conv_id").agg(F.coalesce(real, F.count("*") * 4000).alias("owed"), F.count("*").alias("msgs"))


@query("""WITH c AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS mark FROM events GROUP BY 1),
v AS (SELECT e.user_id, sum(value) AS volume, sum(value) FILTER (WHERE event_type = 'view') AS part FROM events e JOIN c ON c.user_id = e.user_id WHERE mark IS NULL OR ts > mark GROUP BY 1),
o AS (SELECT * FROM v WHERE volume >= 50 AND coalesce(part, 0) / volume < 0.5 AND user_id % 11 <> 3)
SELECT user_id, round(volume, 4) AS volume, (SELECT count(*) FROM o) AS backlog FROM o ORDER BY o.volume DESC, user_id LIMIT 20""")
def owed_candidates(t: Tables):
    """Sessions with much past their cursor, little of it done, not excluded; with how many there are in all."""
    cursor = t.events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("at"))
    rows = t.events.join(cursor, "user_id").where("at is null or ts > at")
    v = rows.groupBy("user_id").agg(F.sum("value").alias("volume"), F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("part"))
    owed = v.where((F.col("volume") >= 50) & (F.coalesce("part", F.lit(0.0)) / F.col("volume") < 0.5) & (F.col("user_id") % 11 != 3))
    top = owed.orderBy(F.desc("volume"), "user_id").limit(20)
    return top.crossJoin(F.broadcast(owed.agg(F.count("*").alias("backlog")))).select("user_id", F.round("volume", 4).alias("volume"), "backlog")


@query("""SELECT conv_id, string_agg(text[1:40], ' / ' ORDER BY turn) AS view, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE role = 'system' OR turn >= 2 GROUP BY 1""")
def compacted_view(t: Tables):
    """Summaries first, then what came after them, in order."""
    rows = t.conversations.where("role = 'system' or turn >= 2")
    made = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.substring("text", 1, 40).alias("e")))), lambda x: x["e"]), " / ")
    return rows.groupBy("conv_id").agg(made.alias("view"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT c_nationkey, round(sum(o_totalprice), 2) AS spent, round(100 * sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 6) AS share FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def culprit_shares(t: Tables):
    g = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("x"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("x").alias("all")))).select("c_nationkey", F.round("x", 2).alias("spent"), F.round(100 * F.col("x") / F.col("all"), 6).alias("share"))


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def usage_by_group(t: Tables):
    return t.lineitem.where("l_shipdate <= timestamp'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
