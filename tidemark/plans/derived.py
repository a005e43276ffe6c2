"""Spans, references, targets, notes and task lists, made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import project, text
from ..operators import spans
from ..registry import Tables, query
from ..sinks import export
from ..sources import markdown

_PROPOSED = "SELECT conv_id, turn + length(text) % 3 AS lo, turn + length(text) % 5 AS hi, turn AS n FROM conversations"
_WINDOWS = "SELECT conv_id, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY 1"


def _proposed(t: Tables):
    n = F.length("text")
    return t.conversations.select("conv_id", (F.col("turn") + n % 3).alias("lo"), (F.col("turn") + n % 5).alias("hi"), F.col("turn").alias("n"))


@query(f"""WITH s AS (SELECT p.conv_id, greatest(least(lo, hi), first) AS a, least(greatest(lo, hi), last) AS b, n FROM ({_PROPOSED}) p JOIN ({_WINDOWS}) w ON w.conv_id = p.conv_id),
r AS (SELECT conv_id, n, b, greatest(a, coalesce(max(b) OVER (PARTITION BY conv_id ORDER BY a, b DESC, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, a)) AS lo FROM s WHERE a <= b)
SELECT conv_id, lo, max(b) AS hi FROM r WHERE lo <= b GROUP BY 1, 2""")
def span_trim_overlaps(t: Tables):
    """Proposed spans cut to their conversation and to begin after those before them."""
    w = t.conversations.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    return spans.trimmed(_proposed(t), w, "conv_id").groupBy("conv_id", "lo").agg(F.max("hi").alias("hi"))


@query("""WITH f AS (SELECT conv_id, turn AS lo, turn + 1 AS hi FROM conversations), c AS (SELECT conv_id, turn AS plo, turn + 4 AS phi FROM conversations WHERE turn % 3 = 0)
SELECT f.conv_id, f.lo, f.hi, min(c.plo) AS parent_lo FROM f LEFT JOIN c ON c.conv_id = f.conv_id AND f.lo >= c.plo AND f.hi <= c.phi GROUP BY 1, 2, 3""")
def span_parents(t: Tables):
    fine = t.conversations.select("conv_id", F.col("turn").alias("lo"), (F.col("turn") + 1).alias("hi"))
    coarse = t.conversations.where("turn % 3 = 0").select("conv_id", F.col("turn").alias("lo"), (F.col("turn") + 4).alias("hi"))
    return spans.enclosing(fine, coarse, "conv_id").select("conv_id", "lo", "hi", "parent_lo")


@query(f"""WITH w AS ({_WINDOWS}), c AS (SELECT doc_id AS compaction_id, doc_id % 20 AS conv_id, doc_id % 3 - 1 AS from_id, doc_id % 9 AS to_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT c.conv_id, compaction_id, greatest(from_id, first) AS lo, least(to_id, last) AS hi FROM c JOIN w ON w.conv_id = c.conv_id WHERE greatest(from_id, first) <= least(to_id, last)""")
def span_from_compactions(t: Tables):
    """Windows that have no span yet, as spans within their conversation."""
    w = t.conversations.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    c = t.documents.select(F.col("doc_id").alias("compaction_id"), (F.col("doc_id") % 20).alias("conv_id"), (F.col("doc_id") % 3 - 1).alias("from_id"), (F.col("doc_id") % 9).alias("to_id"))
    return spans.compaction_spans(c, w, t.labels.select(F.col("doc_id").alias("compaction_id")), "conv_id").drop("method")


@query("""SELECT l.conv_id, l.turn, CASE WHEN l.turn % 5 = 4 THEN 9 WHEN l.role = 'user' THEN 0 WHEN l.role = 'assistant' THEN 1 WHEN l.role = 'tool' THEN 2 ELSE 3 END AS rank FROM conversations l""")
def span_method_rank(t: Tables):
    method = F.when(F.col("role") == "user", "llm").when(F.col("role") == "assistant", "compaction").when(F.col("role") == "tool", "stream").otherwise("structural")
    return t.conversations.select("conv_id", "turn", spans.method_rank(method, F.col("turn") % 5 == 4).alias("rank"))


@query("""SELECT source, n FROM (SELECT source, count(*) AS n, max(doc_id) AS last FROM documents WHERE source ILIKE '%src1%' GROUP BY 1 HAVING count(*) >= 2) ORDER BY last DESC, source LIMIT 1""")
def session_ref_latest(t: Tables):
    """What latest:scope names."""
    s = t.documents.groupBy("source").agg(F.count("*").alias("substantive"), F.max("doc_id").alias("last_msg")).select(F.col("source").alias("session_id"), F.col("source").alias("repo"), "last_msg", "substantive")
    return spans.find_session(s, "latest:src1").select(F.col("session_id").alias("source"), F.col("substantive").alias("n"))


@query("""SELECT p_partkey FROM part p WHERE p_size % 3 = 1 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = p.p_partkey // 2 AND q.p_size % 3 <> 0)""")
def target_frontier(t: Tables):
    """Active targets all of whose needs are achieved."""
    p = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "achieved").when(F.col("p_size") % 3 == 1, "active").otherwise("blocked").alias("status"))
    needs = t.part.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 2).cast("long").alias("need")).join(t.part.select(F.col("p_partkey").alias("need")), "need", "left_semi")
    return spans.frontier(p, needs).select(F.col("id").alias("p_partkey"))


@query("""SELECT user_id, n, CAST(least(21600, 60 * pow(2, n - 1)) AS BIGINT) AS wait FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') + 1 AS n FROM events GROUP BY 1)""")
def retry_backoff(t: Tables):
    n = t.events.groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") + 1).alias("n"))
    return n.select("user_id", "n", spans.retry_after(F.col("n"), 60).alias("wait"))


@query("""SELECT item_id, '---' || chr(10) || 'id: ' || item_id || chr(10) || '---' || chr(10) || '# ' || text[1:30] || chr(10) || chr(10) || text || chr(10) || chr(10) || '<!-- generated above, yours below -->' || chr(10) AS content FROM benchmark""")
def note_export(t: Tables):
    return t.benchmark.select("item_id", export.note({"id": F.col("item_id")}, F.substring("text", 1, 30), F.col("text")).alias("content"))


@query("""SELECT r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")
def json_rows(t: Tables):
    return t.region.select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("json"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'todo' WHEN 1 THEN 'done' WHEN 2 THEN 'cancelled' ELSE 'in_progress' END AS status, CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'none' END AS priority,
'2024-03-01' AS due, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS tag, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS text, 'Parts' AS section FROM part""")
def todo_tasks(t: Tables):
    """Task lines with state, priority, date and tag, under a heading."""
    mark = F.element_at(F.array(F.lit(" "), F.lit("x"), F.lit("-"), F.lit("/")), (F.col("p_size") % 4 + 1))
    tag = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    line = F.concat(F.lit("## Parts\n- ["), mark, F.lit("] "), F.col("p_name"), F.lit(" #"), tag, F.when(F.col("p_size") % 2 == 0, " ⏫").otherwise(""), F.lit(" 📅 2024-03-01\n"))
    rows = markdown.todos(t.part.select("p_partkey", line.alias("content")))
    return rows.select("p_partkey", "status", "priority", F.date_format("due", "yyyy-MM-dd").alias("due"), F.get("tags", F.lit(0)).alias("tag"), "text", "section")


@query("""SELECT n_nationkey, 'T' || n_nationkey AS target_id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'active' ELSE 'achieved' END AS status, n_nationkey / 2.0 AS weight FROM nation""")
def target_blocks(t: Tables):
    """Targets parsed from their blocks."""
    block = F.concat(F.lit("### 🎯T"), F.col("n_nationkey").cast("string"), F.lit(" "), F.col("n_name"), F.lit("\n- **Status**: "), F.when(F.col("n_nationkey") % 2 == 0, "active").otherwise("achieved"), F.lit("\n- **Weight**: "), (F.col("n_nationkey") / 2).cast("string"), F.lit("\n\nText.\n"))
    return markdown.targets(t.nation.select("n_nationkey", block.alias("content"))).select("n_nationkey", "target_id", "name", "status", "weight")


@query("""SELECT s_suppkey, '2024-01-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') AS date, 'scan' AS skill, 'v1.' || s_suppkey AS version, s_name AS body FROM supplier""")
def audit_log(t: Tables):
    """Entries parsed from an audit log."""
    day = F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0")
    log = F.concat(F.lit("# Log\n\n## 2024-01-"), day, F.lit(" — /scan v1."), F.col("s_suppkey").cast("string"), F.lit("\n"), F.col("s_name"), F.lit("\n"))
    return markdown.audit_entries(t.supplier.select("s_suppkey", log.alias("content"))).select("s_suppkey", "date", "skill", "version", "body")


@query("""SELECT conv_id, turn, length(text) < 200 AND contains(text, 'is') OR text = 'Tool loaded' AS short_is, contains(text, '[Request interrupted') AS noise FROM conversations""")
def noise_flags(t: Tables):
    return t.conversations.select("conv_id", "turn", (((F.length("text") < 200) & F.col("text").contains("is")) | (F.col("text") == "Tool loaded")).alias("short_is"), project.is_noise(F.col("text")).alias("noise"))


@query("""SELECT conv_id, substr(min_by(text, turn), 1, 200) AS topic FROM conversations WHERE role = 'user' AND length(text) >= 10 AND NOT starts_with(text, '<system-reminder>') GROUP BY 1""")
def session_topics(t: Tables):
    """The first user text that may serve as a topic."""
    c = F.col("text")
    good = t.conversations.where((F.col("role") == "user") & (F.length("text") >= 10) & ~project.is_noise(c) & ~project.is_boilerplate(c))
    return good.groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 200).alias("topic"))


@query("""SELECT doc_id, CASE WHEN s = '' THEN '' ELSE regexp_replace(substr(s, 1, 48), '-+$', '') END AS slug FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(substr(text, 1, 90)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents)""")
def slugs(t: Tables):
    return t.documents.select("doc_id", text.slug(F.substring("text", 1, 90)).alias("slug"))
