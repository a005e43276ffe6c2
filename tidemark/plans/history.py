"""Registered queries of the history operators, on rows made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history
from ..operators.history import Corpus
from ..registry import Tables, query

_PAYLOAD = """'{"targets_active":[' || CASE WHEN turn % 3 = 0 THEN '' ELSE '"T' || turn % 12 || '"' END || '],"targets":["T' || conv_id % 12 || '"],"targets_progressed":{' || CASE WHEN turn % 4 = 1 THEN '"T' || conv_id % 5 || '":"step ' || turn || '"' ELSE '' END || '},"open_threads":["T1"]}'"""


def _compactions(t: Tables):
    quoted = lambda k: F.concat(F.lit('"T'), (k).cast("string"), F.lit('"'))
    active = F.when(F.col("turn") % 3 == 0, "").otherwise(quoted(F.col("turn") % 12))
    progress = F.when(F.col("turn") % 4 == 1, F.concat(quoted(F.col("conv_id") % 5), F.lit(':"step '), F.col("turn").cast("string"), F.lit('"'))).otherwise("")
    payload = F.concat(F.lit('{"targets_active":['), active, F.lit('],"targets":['), quoted(F.col("conv_id") % 12), F.lit('],"targets_progressed":{'), progress, F.lit('},"open_threads":["T1"]}'))
    return t.conversations.select("conv_id", "turn", payload.alias("payload_json"))


@query(f"""WITH c AS (SELECT conv_id, turn, {_PAYLOAD} AS p FROM conversations),
j AS (SELECT conv_id, turn, p, CASE WHEN json_array_length(p, '$.targets_active') > 0 THEN CAST(json_extract(p, '$.targets_active') AS VARCHAR[]) ELSE CAST(json_extract(p, '$.targets') AS VARCHAR[]) END AS active, json_extract_string(p, '$.targets_progressed.T1') AS note FROM c)
SELECT conv_id, turn, coalesce(note, '') AS progress, 1 AS open_threads FROM j WHERE list_contains(active, 'T1') OR note IS NOT NULL""")
def rework_history(t: Tables):
    """Spans that worked on T1: by exact membership, not by T10 or a thread of that name."""
    return history.rework(_compactions(t), "T1").select("conv_id", "turn", "progress", "open_threads")


@query("""WITH link AS (SELECT DISTINCT conv_id, conv_id % 7 AS chain FROM conversations), c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS n, length(text) AS size FROM conversations WHERE role = 'assistant')
SELECT chain, link.conv_id, turn, size FROM link JOIN c ON c.conv_id = link.conv_id AND n = 1""")
def chain_compactions(t: Tables):
    """The latest summary of each link of the chains."""
    link = t.conversations.select("conv_id", (F.col("conv_id") % 7).alias("chain")).distinct()
    made = t.conversations.where("role = 'assistant'").select("conv_id", "turn", "role", F.length("text").cast("long").alias("size"))
    return history.chain_compactions(link, made, "conv_id", F.desc("turn"), F.col("role")).select("chain", "conv_id", "turn", "size")


@query("""WITH w AS (SELECT max(event_id) * 9 // 10 AS mark FROM events)
SELECT user_id, sum(CAST(round(value * 100) AS BIGINT)) AS volume FROM events WHERE user_id IN (SELECT user_id FROM events, w WHERE event_id > mark) GROUP BY 1 HAVING volume > 1000""")
def owed_incremental(t: Tables):
    """Users over a volume among those with an event in the last tenth."""
    at = t.events.agg(F.floor(F.max("event_id") * 9 / 10)).first()[0] or 0
    return history.owed_since(t.events, "user_id", "event_id", int(at), F.round(F.col("value") * 100).cast("long"), 1000)


@query("""WITH n AS (SELECT source, count(*) AS docs, sum(n_chars) % 20 AS age, count(*) % 4 AS q FROM documents GROUP BY 1)
SELECT source, CASE WHEN q < 2 THEN 'no calibration' WHEN age > 7 THEN 'old' WHEN abs(docs * 8 // 5 - docs) / docs > 0.5 THEN 'grew' END AS why FROM n""")
def calibration_stale(t: Tables):
    n = t.documents.groupBy("source").agg(F.count("*").alias("docs"), (F.sum("n_chars") % 20).alias("age"), (F.count("*") % 4).alias("q"))
    return n.select("source", history.stale(F.col("q"), F.col("age"), F.col("docs"), F.floor(F.col("docs") * 8 / 5)).alias("why"))


@query("""WITH b AS (SELECT c_custkey, c_custkey % 9 <> 0 AS priced, c_custkey % 8 * 10 AS cap, c_custkey % 120 AS spent, c_custkey % 150 AS projected, c_custkey % 3 * 40 AS warn, CASE c_custkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'reduced' ELSE 'minimal' END AS before FROM customer),
x AS (SELECT *, CASE WHEN warn > 0 THEN warn ELSE 100 END AS bar FROM b)
SELECT c_custkey, CASE WHEN NOT priced THEN before WHEN cap <= 0 THEN 'full' WHEN spent >= 100 THEN 'minimal' WHEN projected >= bar THEN 'reduced' WHEN before <> 'full' AND projected >= bar - 10 THEN before ELSE 'full' END AS level FROM x""")
def throttle_levels(t: Tables):
    k = F.col("c_custkey")
    before = F.when(k % 3 == 0, "full").when(k % 3 == 1, "reduced").otherwise("minimal")
    return t.customer.select("c_custkey", history.level(k % 9 != 0, k % 8 * 10, k % 120, k % 150, k % 3 * 40, before).alias("level"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(doc_id % 7 AS VARCHAR) WHEN 2 THEN 'v' || doc_id % 3 || '/' || doc_id % 7 ELSE 'codebase' END AS phase FROM documents""")
def plan_phases(t: Tables):
    k = F.col("doc_id")
    n, v = (k % 7).cast("string"), (k % 3).cast("string")
    path = F.when(k % 4 == 0, "PLAN.md").when(k % 4 == 1, F.concat(F.lit("phase-"), n, F.lit("/PLAN.md"))).when(k % 4 == 2, F.concat(F.lit("Milestone-v"), v, F.lit("/phase-"), n, F.lit("/PLAN.md"))).otherwise("codebase/overview.md")
    return t.documents.select("doc_id", history.plan_phase(path).alias("phase"))


@query("""SELECT o_orderkey AS note_id, o_custkey AS inbox, o_orderstatus = 'O' AS unread, CASE WHEN o_orderstatus = 'O' THEN DATE '2026-01-01' ELSE CAST(o_orderdate AS DATE) END AS read_at FROM orders""")
def notes_read_once(t: Tables):
    """Notes after one reading of all inboxes: those unread before get its time, the others keep theirs."""
    notes = t.orders.select(F.col("o_orderkey").alias("note_id"), F.col("o_custkey").alias("inbox"), F.when(F.col("o_orderstatus") != "O", F.to_date("o_orderdate")).alias("read_at"))
    unread, after = history.received(notes, F.lit("2026-01-01").cast("date"))
    return after.join(unread.select("note_id", F.lit(True).alias("unread")), "note_id", "left").select("note_id", "inbox", F.coalesce("unread", F.lit(False)).alias("unread"), "read_at")


@query("""WITH s AS (SELECT *, conv_id % 3 AS sealed FROM conversations)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 12 AS drip FROM s WHERE turn > sealed""")
def drips_of_messages(t: Tables):
    return history.drips(t.conversations, "conv_id", "turn", F.col("conv_id") % 3).select("conv_id", "turn", "drip")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS moment FROM events),
n AS (SELECT *, coalesce(moment - lag(moment) OVER w > 3600, true) AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY moment, event_id)),
b AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY moment, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM n)
SELECT user_id, max_by(event_id, (moment, event_id)) AS last, count(*) AS coalesced FROM b GROUP BY user_id, burst""")
def debounced_events(t: Tables):
    """Bursts of a user's events, at most an hour apart, as their last event."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    return history.debounced(t.events.select("user_id", "event_id", "ts"), "user_id", at, "event_id", 3600).select("user_id", "last", "coalesced")


@query("""WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey FROM r WHERE ((place - 9) % n + n) % n < 3""")
def rotation_sample(t: Tables):
    """The fourth turn of three parts a brand."""
    return history.rotation(t.part.select("p_brand", "p_partkey"), "p_brand", "p_partkey", 3, 3)


CORPORA = [
    Corpus("documents", "doc_id", "source", "text", "lang"),
    Corpus("pages", "page_id", "url", "html", "length(html)"),
    Corpus("benchmark", "item_id", "text", "text", "'item'"),
    Corpus("conversations", "conv_id * 1000 + turn", "role", "text", "turn", default=False),
]


def _tables(t: Tables):
    return {c.kind: getattr(t, c.kind) for c in CORPORA}


_ENTITIES = """SELECT 'documents' AS kind, doc_id AS id, left(source, 200) AS title, left(text, 600) AS body, lang AS meta FROM documents
UNION ALL SELECT 'pages', page_id, left(url, 200), left(html, 600), CAST(length(html) AS VARCHAR) FROM pages
UNION ALL SELECT 'benchmark', item_id, left(text, 200), left(text, 600), 'item' FROM benchmark"""


@query(_ENTITIES)
def entity_union(t: Tables):
    """What is shown of the entities of all default corpora."""
    return history.entities(_tables(t), CORPORA)


@query(f"""WITH e AS ({_ENTITIES} UNION ALL SELECT 'conversations', conv_id * 1000 + turn, left(role, 200), left(text, 600), CAST(turn AS VARCHAR) FROM conversations),
h AS (SELECT 'documents' AS kind, doc_id AS id FROM labels UNION ALL SELECT 'pages', doc_id FROM labels UNION ALL SELECT 'conversations', conv_id * 1000 + turn FROM conversations WHERE role = 'user')
SELECT h.kind, h.id, title, body, meta FROM h LEFT JOIN e ON e.kind = h.kind AND e.id = h.id""")
def search_registry(t: Tables):
    """Hits of several corpora with their display fields; a hit without a row stays."""
    hits = t.labels.select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id")).union(t.labels.select(F.lit("pages"), "doc_id"))
    hits = hits.union(t.conversations.where("role = 'user'").select(F.lit("conversations"), F.col("conv_id") * 1000 + F.col("turn")))
    return history.hydrated(hits, _tables(t), CORPORA)


@query("""WITH m AS (SELECT max(ts) AS now FROM events)
SELECT event_type, count(*) AS n, epoch_us(now) // 1000000 - epoch_us(max(ts)) // 1000000 AS lag_seconds, count(*) FILTER (WHERE ts > now - INTERVAL 7 DAY) AS recent FROM events, m GROUP BY event_type, now""")
def ingest_freshness(t: Tables):
    """How far each source lags behind the newest entry, and what it gave in the last week."""
    sec = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1000000)
    now = t.events.agg(F.max("ts").alias("now"))
    rows = t.events.crossJoin(F.broadcast(now))  # one row
    return rows.groupBy("event_type", "now").agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.count_if(F.col("ts") > F.col("now") - F.expr("INTERVAL 7 DAYS")).alias("recent")).select(
        "event_type", "n", (sec(F.col("now")) - sec(F.col("last"))).alias("lag_seconds"), "recent"
    )


@query("""WITH m AS (SELECT max(ts) AS now FROM events)
SELECT user_id, count(*) AS messages, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE event_type = 'error') AS active, count(*) FILTER (WHERE event_type = 'error' AND ts < now - INTERVAL 3 DAY) AS overdue, max(event_id) AS newest FROM events, m GROUP BY user_id""")
def thread_activity(t: Tables):
    """Per thread its messages, open items and overdue ones."""
    rows = t.events.crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("now"))))  # one row
    open_ = F.col("event_type") == "error"
    return rows.groupBy("user_id").agg(
        F.count("*").alias("messages"), F.count_distinct("event_type").alias("kinds"), F.count_if(open_).alias("active"), F.count_if(open_ & (F.col("ts") < F.col("now") - F.expr("INTERVAL 3 DAYS"))).alias("overdue"), F.max("event_id").alias("newest")
    )
