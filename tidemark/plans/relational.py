"""Filters, joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import project, text
from ..operators import relational as rel
from ..registry import Tables, query


@query("""SELECT c.c_custkey, c.c_name, coalesce(o.n, 0) AS n_orders, coalesce(o.last, '') AS last_order
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, max(strftime(o_orderdate, '%Y-%m-%d')) AS last FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey""")
def sessions_view_left(t: Tables):
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"))
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("last", F.lit("")).alias("last_order"))


@query("""SELECT CASE WHEN source ILIKE '%1%' THEN 'worktree' WHEN source = 'src0' THEN 'subagent' ELSE 'interactive' END AS session_type, count(*) AS sessions,
CAST(sum(n_chars) AS BIGINT) AS total, CAST(sum(CASE WHEN n_chars >= 500 THEN n_chars ELSE 0 END) AS BIGINT) AS substantive,
CAST(sum(n_chars) - sum(CASE WHEN n_chars >= 500 THEN n_chars ELSE 0 END) AS BIGINT) AS noise FROM documents GROUP BY 1""")
def stats_by_type(t: Tables):
    kind = F.when(F.col("source").ilike("%1%"), "worktree").when(F.col("source") == "src0", "subagent").otherwise("interactive")
    real = F.coalesce(F.sum(F.when(F.col("n_chars") >= 500, F.col("n_chars")).otherwise(0)), F.lit(0))
    return t.documents.groupBy(kind.alias("session_type")).agg(F.count("*").alias("sessions"), F.sum("n_chars").alias("total"), real.alias("substantive"), (F.sum("n_chars") - real).alias("noise"))


@query("""SELECT event_type, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
string_agg(DISTINCT CAST(user_id % 5 AS VARCHAR), ',' ORDER BY CAST(user_id % 5 AS VARCHAR)) AS shards
FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1 HAVING event_type <> ''""")
def recent_activity(t: Tables):
    shard = (F.col("user_id") % 5).cast("string")
    return t.events.where("ts >= timestamp'2024-01-20' and event_type <> ''").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"), F.array_join(F.sort_array(F.collect_set(shard)), ",").alias("shards"))


@query("""SELECT d.source, count(*) AS docs, max(d.doc_id) AS last_doc, (SELECT text[1:60] FROM documents e WHERE e.source = d.source ORDER BY length(e.text), e.doc_id LIMIT 1) AS shortest,
(SELECT CAST(l.quality AS BIGINT) FROM labels l JOIN documents e ON e.doc_id = l.doc_id WHERE e.source = d.source ORDER BY l.doc_id DESC LIMIT 1) AS last_verdict
FROM documents d GROUP BY d.source""")
def list_repos_scalar_subq(t: Tables):
    docs = t.documents.groupBy("source").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last_doc"), F.substring(F.min_by("text", F.struct(F.length("text"), "doc_id")), 1, 60).alias("shortest"))
    verdicts = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.max_by("quality", "doc_id").cast("long").alias("last_verdict"))
    return docs.join(verdicts, "source", "left")


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%a%e%' AND p_brand ILIKE '%1%'""")
def ilike_glob_filter(t: Tables):
    return t.part.where(F.col("p_name").ilike(text.glob_pattern("*a*e*")) & F.col("p_brand").ilike(text.glob_pattern("1"))).select("p_partkey", "p_name", "p_brand")


@query("""SELECT s_name, n FROM (SELECT s_name, count(*) OVER () AS n, row_number() OVER (ORDER BY s_name <> 'Supplier#000000001', s_name) AS r
FROM supplier WHERE starts_with(s_name, 'Supplier#00000000')) WHERE r = 1""")
def prefix_resolve(t: Tables):
    """An exact name wins, else the first that begins so; n tells whether it is the only one."""
    exact = (F.col("s_name") != "Supplier#000000001").cast("int")
    found = t.supplier.where(F.col("s_name").startswith("Supplier#00000000"))
    return found.agg(F.min(F.struct(exact, "s_name")).alias("b"), F.count("*").alias("n")).where("n > 0").select("b.s_name", "n")


@query("""SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)""")
def semi_exists(t: Tables):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND n_chars < 400""")
def semi_in(t: Tables):
    return t.documents.where("n_chars < 400").join(t.labels.where("quality = 1"), "doc_id", "left_semi").select("doc_id", "text")


@query("""SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""")
def anti_notexists(t: Tables):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL""")
def anti_leftnull(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", "source")


@query("""SELECT r_name, n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def three_way_join(t: Tables):
    j = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("""SELECT DISTINCT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A'""")
def self_join_both(t: Tables):
    """Members of both groups: one aggregate in place of a self join."""
    two = t.lineitem.where("l_returnflag in ('R', 'A')").groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("n"))
    return two.where("n = 2").select("l_orderkey")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS first_there, event_type = 'purchase' AS is_purchase FROM events""")
def json_extract_generated(t: Tables):
    get = lambda p: F.get_json_object("props", p)
    return t.events.select("event_id", get("$.k").try_cast("bigint").alias("k"), F.coalesce(get("$.missing"), get("$.k")).alias("first_there"), (F.col("event_type") == "purchase").alias("is_purchase"))


@query("""SELECT event_id, e.key AS name, CAST(e.value AS VARCHAR) AS value FROM events, json_each(CAST(props AS JSON)) e""")
def json_unnest_lateral(t: Tables):
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))


@query("""SELECT kind, id, name FROM (
SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 37 = 5 UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE s_suppkey % 37 = 5
UNION ALL SELECT 'part', p_partkey, p_name FROM part WHERE p_partkey % 37 = 5) ORDER BY kind, id LIMIT 50""")
def union_all_locate(t: Tables):
    arms = [t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))]
    every = arms[0].unionByName(arms[1]).unionByName(arms[2]).where("id % 37 = 5").dropDuplicates(["kind", "id"])
    return every.orderBy("kind", "id").limit(50)


@query("""SELECT 'order' AS kind, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS at, o_orderstatus AS state FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000
UNION ALL SELECT 'line', l_orderkey, strftime(l_shipdate, '%Y-%m-%d'), NULL FROM lineitem WHERE l_extendedprice > 90000""")
def union_prs_issues(t: Tables):
    """Two kinds of items in one list; a state only one kind has is null in the other."""
    a = t.orders.where("o_orderstatus = 'F' and o_totalprice > 250000").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), F.col("o_orderstatus").alias("state"))
    b = t.lineitem.where("l_extendedprice > 90000").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)""")
def except_two_way(t: Tables):
    return rel.set_difference(t.documents.where("doc_id % 3 <> 0"), t.labels, "doc_id")


@query("""WITH a AS (SELECT doc_id FROM documents WHERE text ILIKE '%tion%'), b AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN a.doc_id IS NOT NULL THEN 'text' ELSE 'label' END AS match_source
FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def fullouter_match_source(t: Tables):
    a, b = t.documents.where(F.col("text").ilike("%tion%")).select("doc_id", F.lit(1).alias("a")), t.labels.where("quality = 1").select("doc_id", F.lit(1).alias("b"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "text").otherwise("label").alias("match_source"))


@query("""SELECT CASE WHEN event_type = 'click' THEN 'click ' || split_part(props, ' ', 1) ELSE event_type END AS tool, count(*) AS n FROM events GROUP BY 1""")
def permissions_prefix(t: Tables):
    tool = F.when(F.col("event_type") == "click", F.concat(F.lit("click "), F.substring_index("props", " ", 1))).otherwise(F.col("event_type"))
    return t.events.groupBy(tool.alias("tool")).agg(F.count("*").alias("n"))


@query("""SELECT 'role' AS histogram, role AS bucket, count(*) AS n FROM conversations GROUP BY 2 UNION ALL SELECT 'length', CAST(CAST(floor(length(text) / 100) AS BIGINT) AS VARCHAR), count(*) FROM conversations GROUP BY 2
UNION ALL SELECT 'turn', CAST(turn AS VARCHAR), count(*) FROM conversations GROUP BY 2""")
def session_structure(t: Tables):
    """Several histograms in one pass: each row is dealt to a bucket of each."""
    c = t.conversations
    both = c.select(F.explode(F.array(F.struct(F.lit("role").alias("h"), F.col("role").alias("b")), F.struct(F.lit("length").alias("h"), F.floor(F.length("text") / 100).cast("string").alias("b")), F.struct(F.lit("turn").alias("h"), F.col("turn").cast("string").alias("b")))).alias("e"))
    return both.groupBy(F.col("e.h").alias("histogram"), F.col("e.b").alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM conversations) AS messages, (SELECT count(*) FROM events) AS entries, (SELECT count(*) FROM lineitem) AS records,
(SELECT count(DISTINCT conv_id) FROM conversations) AS sessions""")
def dbstats_counts(t: Tables):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = t.conversations.agg(F.count("*").alias("messages"), F.countDistinct("conv_id").alias("sessions"))
    return one.crossJoin(n(t.documents, "documents")).crossJoin(n(t.events, "entries")).crossJoin(n(t.lineitem, "records"))  # one row each


@query("""SELECT DISTINCT source, lang FROM documents WHERE source IS NOT NULL""")
def distinct_repos(t: Tables):
    return t.documents.where("source is not null").select("source", "lang").distinct()


@query("""SELECT doc_id, CASE WHEN length(text) > 120 THEN text[1:117] || '...' ELSE text END AS excerpt FROM documents""")
def truncate_excerpt(t: Tables):
    return t.documents.select("doc_id", text.capped(F.col("text"), 120).alias("excerpt"))


@query("""SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'bugfix' WHEN '2-HIGH' THEN 'feature' WHEN '3-MEDIUM' THEN 'docs' WHEN '5-LOW' THEN 'development' ELSE 'branch-work' END AS work_type FROM orders""")
def work_type(t: Tables):
    branch = F.create_map(*[F.lit(x) for kv in {"1-URGENT": "fix/x", "2-HIGH": "feat/y", "3-MEDIUM": "docs/z", "5-LOW": "main"}.items() for x in kv])
    return t.orders.select("o_orderkey", "o_orderpriority", project.work_type(F.coalesce(F.try_element_at(branch, F.col("o_orderpriority")), F.lit("other"))).alias("work_type"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CASE WHEN url ILIKE '%utm%' THEN 'worktree' WHEN regexp_extract(url, '^https?://([^/?#]+)', 1) ILIKE 'm.%' THEN 'mobile' ELSE 'interactive' END AS kind FROM pages""")
def page_kinds(t: Tables):
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return t.pages.select("page_id", host.alias("host"), F.when(F.col("url").ilike("%utm%"), "worktree").when(host.ilike("m.%"), "mobile").otherwise("interactive").alias("kind"))


@query("""SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 12:00:00' AND value > 50""")
def range_filter(t: Tables):
    return t.events.where("ts between timestamp'2024-01-05' and timestamp'2024-01-09 12:00:00' and value > 50").select("event_id", "event_type")


@query("""SELECT doc_id, n_chars FROM documents WHERE doc_id > 20 ORDER BY doc_id LIMIT 25""")
def page_keyset(t: Tables):
    """The next page after a key: a filter and a limit, no offset."""
    return t.documents.where("doc_id > 20").select("doc_id", "n_chars").orderBy("doc_id").limit(25)


@query("""SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 10""")
def page_offset(t: Tables):
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(10).limit(10)


@query("""SELECT o_custkey, n, total, strftime(last_msg, '%Y-%m-%d') AS last_msg, qualifying FROM (
SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last_msg, count(*) OVER () AS qualifying FROM orders GROUP BY 1 HAVING count(*) >= 5) ORDER BY last_msg DESC, o_custkey LIMIT 20""")
def top_recent_total_over(t: Tables):
    """The newest groups with how many qualify in all: the total is an aggregate of its own, not a window over all rows."""
    g = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("at")).where("n >= 5")
    top = g.orderBy(F.desc("at"), "o_custkey").limit(20)
    return top.crossJoin(F.broadcast(g.agg(F.count("*").alias("qualifying")))).select("o_custkey", "n", "total", F.date_format("at", "yyyy-MM-dd").alias("last_msg"), "qualifying")


@query("""SELECT p_partkey, p_brand FROM part WHERE list_contains(string_split(lower(p_type), ' '), 'steel')""")
def json_array_member(t: Tables):
    return t.part.where(F.exists(F.split("p_type", " "), lambda x: x.ilike("steel"))).select("p_partkey", "p_brand")


@query("""SELECT doc_id, CASE WHEN seen IS NULL THEN 'new' WHEN size IS NULL THEN 'deleted' WHEN size < seen THEN 'truncated' WHEN size > seen THEN 'append_behind' ELSE 'converged' END AS state FROM (
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.n_chars AS size, l.seen FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 7 <> 0) d
FULL JOIN (SELECT doc_id, CAST(500 + 500 * quality AS BIGINT) AS seen FROM labels) l ON l.doc_id = d.doc_id)""")
def file_vs_cursor(t: Tables):
    files = t.documents.where("doc_id % 7 <> 0").select("doc_id", F.col("n_chars").alias("size"), F.lit(1).alias("mtime"))
    cursors = t.labels.select("doc_id", (500 + 500 * F.col("quality")).cast("long").alias("read_to"), F.lit(1).alias("seen_mtime"))
    return rel.cursor_state(files, cursors, "doc_id").select("doc_id", "state")


@query("""SELECT doc_id, kind, CAST(weight AS DOUBLE) AS weight FROM (SELECT doc_id, 'decision' AS kind, 1.0 AS weight FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'compaction', 0.8 FROM documents WHERE lang = 'fr'
UNION ALL SELECT doc_id, 'note', 1.5 FROM labels WHERE toxic = 0)""")
def union_corpora_weights(t: Tables):
    arm = lambda df, kind, w: df.select("doc_id", F.lit(kind).alias("kind"), F.lit(w).alias("weight"))
    return arm(t.documents.where("lang = 'en'"), "decision", 1.0).unionByName(arm(t.documents.where("lang = 'fr'"), "compaction", 0.8)).unionByName(arm(t.labels.where("toxic = 0"), "note", 1.5))


@query("""SELECT l.doc_id, CASE WHEN n >= 5 THEN 'due' WHEN n >= 2 AND quality = 0 THEN 'due' ELSE 'fresh' END AS review FROM labels l JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c ON c.conv_id = l.doc_id""")
def review_due(t: Tables):
    c = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    due = F.when(F.col("n") >= 5, "due").when((F.col("n") >= 2) & (F.col("quality") == 0), "due").otherwise("fresh")
    return t.labels.join(c, F.col("doc_id") == F.col("conv_id")).select("doc_id", due.alias("review"))


@query("""SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND text ILIKE '%the%' AND conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 4)""")
def who_ran(t: Tables):
    long = t.conversations.groupBy("conv_id").count().where("count >= 4")
    return t.conversations.where("role = 'assistant'").where(F.col("text").ilike("%the%")).join(long, "conv_id", "left_semi").select("conv_id", "turn", "text")


@query("""SELECT conv_id, turn, text[5:44] AS body, length(text) > 44 AS truncated FROM conversations WHERE conv_id = 3 AND turn = 1""")
def tool_result_window(t: Tables):
    return t.conversations.where("conv_id = 3 and turn = 1").select("conv_id", "turn", F.substring("text", 5, 40).alias("body"), (F.length("text") > 44).alias("truncated"))


@query("""SELECT p_brand, p_type, n, listagg_names FROM (SELECT p_brand, p_type, count(*) AS n, string_agg(p_name, ';' ORDER BY p_name, p_partkey) AS listagg_names FROM part GROUP BY 1, 2) WHERE n >= 2""")
def group_concat_having(t: Tables):
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_name", "p_partkey"))), lambda x: x["p_name"]), ";")
    return t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), names.alias("listagg_names")).where("n >= 2")


@query("""SELECT c_custkey, c_mktsegment, r FROM (SELECT c_custkey, c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3""")
def culprits_topk(t: Tables):
    order = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t.customer.withColumn("r", F.row_number().over(order)).where("r <= 3").select("c_custkey", "c_mktsegment", "r")


@query("""SELECT user_id, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY count(*) DESC, user_id) AS BIGINT) AS running FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def top_behind(t: Tables):
    top = t.events.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(15)
    return top.withColumn("running", F.sum("n").over(Window.orderBy(F.desc("n"), "user_id")))


@query("""SELECT source, round(avg(n_chars), 4) AS mean, CAST(count(*) FILTER (WHERE n_chars >= 2000) AS BIGINT) AS long_docs, CAST(count(*) - count(text) AS BIGINT) AS failures FROM documents GROUP BY 1""")
def sweep_means(t: Tables):
    return t.documents.groupBy("source").agg(F.round(F.avg("n_chars"), 4).alias("mean"), F.count_if(F.col("n_chars") >= 2000).alias("long_docs"), F.count_if(F.col("text").isNull()).alias("failures"))


@query("""SELECT coalesce(nullif(lang, 'en'), '(unrecorded)') AS derivation, count(*) AS n FROM documents GROUP BY 1""")
def span_derivation(t: Tables):
    return t.documents.groupBy(F.coalesce(F.nullif("lang", F.lit("en")), F.lit("(unrecorded)")).alias("derivation")).agg(F.count("*").alias("n"))


@query("""SELECT o_custkey AS stream, 'orders without lines' AS gap, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1
UNION ALL SELECT c_custkey, 'customers without orders', 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def divergence_report(t: Tables):
    a = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").groupBy(F.col("o_custkey").alias("stream")).agg(F.count("*").alias("n")).withColumn("gap", F.lit("orders without lines"))
    b = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("stream"), F.lit("customers without orders").alias("gap"), F.lit(1).cast("long").alias("n"))
    return a.unionByName(b)
