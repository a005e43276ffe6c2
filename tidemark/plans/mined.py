"""Terms, themes, labels, patterns, neighbours, and what is parsed from texts and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import project, text
from ..operators import mining, vector
from ..registry import Tables, query
from ..sources import markdown

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TERMS = f"""w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+')) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM w WHERE strlen(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, df, ln((n + 1.0) / (df + 1.0)) + 1 AS idf FROM df, n),
c AS (SELECT idf AS cap FROM (SELECT idf, row_number() OVER (ORDER BY idf, term) - 1 AS r, count(*) OVER () AS k FROM v) WHERE r = CAST(floor((k - 1) * 0.95) AS BIGINT)),
i AS (SELECT term, df, least(idf, cap) AS idf FROM v, c)"""


@query(f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM i WHERE df >= 15")
def idf_p95_clamp(t: Tables):
    counts = mining.term_counts(t.documents, "doc_id", "text")
    return mining.idf(counts, t.documents.count()).where("df >= 15").select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH {_TERMS}, x AS (SELECT id, tf.term, tf.tf * idf AS w FROM tf JOIN i ON i.term = tf.term), q AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM x)
SELECT id AS doc_id, term, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, term) AS r FROM q) WHERE r <= 3""")
def tfidf_top_terms(t: Tables):
    v = mining.tfidf(mining.term_counts(t.documents, "doc_id", "text"), t.documents.count())
    order = Window.partitionBy("id").orderBy(F.desc(F.round("w", 9)), "term")
    return v.withColumn("r", F.row_number().over(order)).where("r <= 3").select(F.col("id").alias("doc_id"), "term", F.round("w", 6).alias("w"))


_ITEMS = _TERMS.replace("SELECT doc_id AS id", "SELECT item_id AS id").replace("FROM documents", "FROM benchmark")
_PAIRS = f"""{_ITEMS}, x AS (SELECT id, tf.term, tf.tf * idf AS w FROM tf JOIN i ON i.term = tf.term), q AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM x),
p AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS cosine FROM q a JOIN q b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.08)"""


def _pairs(t: Tables):
    v = mining.tfidf(mining.term_counts(t.benchmark, "item_id", "text"), t.benchmark.count())
    return mining.similar_pairs(v, 0.08)


@query(f"WITH {_PAIRS} SELECT a, b, round(cosine, 6) AS cosine FROM p")
def similarity_pairs(t: Tables):
    return _pairs(t).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT x AS node, least(x, min(y)) AS theme FROM r GROUP BY 1""")
def themes_components(t: Tables):
    return mining.themes(_pairs(t)).select("node", F.col("component").alias("theme"))


_TOKENS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+'), lambda x: strlen(x) >= 2 AND x NOT IN ({_STOP}))"


@query(f"""WITH t AS (SELECT source, {_TOKENS} AS t FROM documents), b AS (SELECT source, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS pair FROM t WHERE len(t) > 1),
c AS (SELECT source, pair, count(*) AS n FROM b GROUP BY 1, 2) SELECT source, pair, 'bigram' AS path FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, pair) AS r FROM c) WHERE r = 1""")
def bigram_labels(t: Tables):
    return mining.bigrams(t.documents, "source", "text").select("source", F.lower("label").alias("pair"), "path")


@query("""WITH d AS (SELECT doc_id, lang, source FROM documents), s AS (SELECT lang, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, lang LIMIT 2), k AS (SELECT max(n) AS top, min(n) AS second, first(lang ORDER BY n DESC, lang) AS big FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM d, k), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, source) AS place FROM r)
SELECT doc_id, lang FROM p WHERE lang <> big OR top <= floor(1.5 * second) OR place <= greatest(floor(1.5 * second), 1)""")
def balance_cap(t: Tables):
    return mining.balanced(t.documents.select("doc_id", "lang", "source"), "lang", "source", "doc_id", 1.5).select("doc_id", "lang")


@query("""WITH f AS (SELECT role AS kind, regexp_replace(lower(regexp_extract(text, '^\\S+', 0)), '[^a-z]', '', 'g') AS signature, conv_id AS session, conv_id % 7 AS repo, text[1:50] AS excerpt, conv_id * 1000 + turn AS seen FROM conversations),
g AS (SELECT kind, signature, count(*) AS occurrences, count(DISTINCT session) AS sessions, count(DISTINCT repo) AS repos, min(seen) AS first_seen, max(seen) AS last_seen FROM f GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT session) >= 2),
e AS (SELECT kind, signature, excerpt, row_number() OVER (PARTITION BY kind, signature ORDER BY min(seen), excerpt) AS r FROM f GROUP BY 1, 2, 3)
SELECT g.*, (SELECT string_agg(excerpt, '|' ORDER BY r) FROM e WHERE e.kind = g.kind AND e.signature = g.signature AND r <= 3) AS excerpts, sha1(g.kind || chr(0) || g.signature) AS pattern_id FROM g""")
def pattern_mine_gate(t: Tables):
    c = t.conversations
    word = F.regexp_replace(F.lower(F.regexp_extract("text", r"^\S+", 0)), "[^a-z]", "")
    found = c.select(F.col("role").alias("kind"), word.alias("signature"), F.col("conv_id").alias("session"), (F.col("conv_id") % 7).alias("repo"), F.substring("text", 1, 50).alias("excerpt"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    return mining.patterns(found).withColumn("excerpts", F.array_join("excerpts", "|"))


@query("""SELECT shape, count(*) AS n FROM (SELECT trim(regexp_replace(lower(regexp_replace(regexp_replace(props || ' ' || '''a'' = 17', '''[^'']*''', '?', 'g'), '\\b[0-9]+(?:\\.[0-9]+)?\\b', '?', 'g')), '\\s+', ' ', 'g')) AS shape FROM events) GROUP BY 1""")
def sql_shape_normalise(t: Tables):
    shape = project.sql_shape(F.concat("props", F.lit(" 'a' = 17")))
    return t.events.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7) SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 5) AS similarity FROM embeddings, q WHERE vec_id <> 7
ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) DESC, vec_id LIMIT 10""")
def knn_cosine(t: Tables):
    q = t.embeddings.where("vec_id = 7").first()["embedding"]
    return vector.nearest(t.embeddings.where("vec_id <> 7"), q, 10).select("vec_id", "label", F.round("similarity", 5).alias("similarity"))


@query("""WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id < 5), s AS (SELECT query, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS c FROM embeddings, q WHERE vec_id <> query AND label = 1)
SELECT query, id, round(c, 5) AS similarity, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS r FROM s) WHERE r <= 5""")
def knn_filtered_many(t: Tables):
    """Neighbours of a few vectors among those that pass a filter; a filter that nothing passes gives nothing."""
    found = vector.nearest_to(t.embeddings.where("label = 1"), t.embeddings.where("vec_id < 5").select("vec_id", "embedding"), 5)
    return found.select("query", "id", F.round("similarity", 5).alias("similarity"), "rank")


@query("""SELECT label, i, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS w FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2)""")
def centroids(t: Tables):
    """Mean vectors per label, of length one."""
    m = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label")))
    return m.select("label", F.col("i").cast("long").alias("i"), F.round(F.col("m") / norm, 6).alias("w"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1) AS title, len(regexp_extract_all(html, '(?i)<a href="')) AS links, regexp_extract(html, '<a href="([^"]*)"', 1) AS first_link FROM pages""")
def page_titles_links(t: Tables):
    return t.pages.select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1).alias("title"), F.regexp_count("html", F.lit(r'(?i)<a href="')).cast("long").alias("links"), F.regexp_extract("html", r'<a href="([^"]*)"', 1).alias("first_link"))


@query(r"""SELECT page_id, regexp_extract(p, '^(?:.*/)?docs/((?:[^/]+/)*)[^/]*$', 1) AS area FROM (SELECT page_id, 'a/docs/' || regexp_replace(url, '^https?://', '') AS p FROM pages)""")
def taxonomy_from_path(t: Tables):
    return t.pages.select("page_id", markdown.taxonomy(F.concat(F.lit("a/docs/"), F.regexp_replace("url", "^https?://", ""))).alias("area"))


@query("""SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY regexp_replace(path, '\\.[A-Za-z0-9]+$', '') ORDER BY CASE regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) WHEN 'md' THEN 0 WHEN 'txt' THEN 1 ELSE 2 END) AS r
FROM (SELECT source || '/' || CAST(doc_id // 3 AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' ELSE '.md' END AS path FROM documents)) WHERE r = 1""")
def doc_stem_dedup(t: Tables):
    kind = F.element_at(F.array(F.lit(".pdf"), F.lit(".txt"), F.lit(".md")), (F.col("doc_id") % 3 + 1).cast("int"))
    paths = t.documents.select(F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 3).cast("string"), kind).alias("path"))
    return markdown.stems(paths)


@query("""SELECT min(doc_id) AS first_doc, sha256(text) AS content_hash, count(*) AS occurrences FROM documents WHERE text IS NOT NULL GROUP BY 2""")
def content_hash_dedup(t: Tables):
    return t.documents.where("text is not null").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("occurrences"))


@query("""SELECT doc_id, text[1:10] AS head FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents k WHERE k.doc_id = d.doc_id AND k.doc_id % 2 = 0 AND k.lang = 'en')""")
def changed_documents(t: Tables):
    """Documents whose hash isn't the known one."""
    docs = t.documents.select("doc_id", "text", "lang")
    known = docs.where("doc_id % 2 = 0 and lang = 'en'").withColumn("content_hash", F.sha2("text", 256))
    return markdown.changed(docs, known, "doc_id", "text").select("doc_id", F.substring("text", 1, 10).alias("head"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_extract(text, '(?m)^\s*(\S.*)$', 1), '^#+\s*', '')) AS title FROM documents""")
def document_titles(t: Tables):
    return t.documents.select("doc_id", markdown.title(F.col("text")).alias("title"))


@query("""SELECT doc_id, len(string_split(text, chr(10))) AS lines, array_to_string(string_split(text, chr(10))[-3:], chr(10)) AS tail FROM documents""")
def last_log_lines(t: Tables):
    lines = F.split("text", "\n")
    return t.documents.select("doc_id", F.size(lines).cast("long").alias("lines"), F.array_join(F.slice(lines, F.greatest(-F.size(lines), F.lit(-3)), 3), "\n").alias("tail"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000.5""")
def template_eval(t: Tables):
    """A stored query with bound parameters: values are never spliced into the text."""
    return t.spark.sql("SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_custkey = :cust AND o_totalprice > :least", args={"cust": 7, "least": 1000.5}, orders=t.orders)


@query("""SELECT r_name, to_json(list({'name': n_name, 'suppliers': k} ORDER BY n_name)) AS nations FROM (SELECT r_name, n_name, count(s_suppkey) AS k FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1""")
def nested_json(t: Tables):
    """Rows nested below rows, as JSON, in a stated order."""
    k = t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_regionkey", "n_name").agg(F.count("s_suppkey").alias("suppliers"))
    rows = t.region.join(k, F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct(F.col("n_name").alias("name"), "suppliers"))).alias("a"))
    return rows.select("r_name", F.to_json("a").alias("nations"))
