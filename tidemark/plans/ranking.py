"""Full-text search, calibration and fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import search
from ..operators import relational as rel
from ..registry import Tables, query

TERMS = ["the", "tion", "under"]


def _bm25_sql(source: str, id_col: str, text: str, terms: list[str]) -> str:
    wanted = ", ".join(f"'{t}'" for t in terms)
    return f"""w AS (SELECT {id_col} AS id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{Nd}}]+')) AS term FROM {source}),
l AS (SELECT {id_col} AS id, len(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{Nd}}]+')) AS len FROM {source}),
tf AS (SELECT id, term, count(*) AS f FROM w WHERE term IN ({wanted}) GROUP BY 1, 2),
st AS (SELECT count(*) AS n, avg(len) AS mean FROM l), df AS (SELECT term, count(*) AS k FROM tf GROUP BY 1),
ranked AS (SELECT tf.id, sum(greatest(CASE WHEN ln((n - k + 0.5) / (k + 0.5)) > 0 THEN ln((n - k + 0.5) / (k + 0.5)) ELSE 1e-6 END, 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))) AS score, count(*) AS n_terms
FROM tf JOIN df USING (term) JOIN l USING (id), st GROUP BY 1)"""


@query(f"WITH {_bm25_sql('documents', 'doc_id', 'text', TERMS)} SELECT id AS doc_id, round(score, 6) AS score, n_terms FROM ranked ORDER BY ranked.score DESC, id LIMIT 20")
def search_bm25_docs(t: Tables):
    """The documents that match some of the words best."""
    hits = search.search(t.documents, "doc_id", " ".join(TERMS), "text")
    return hits.orderBy(F.desc("score"), "id").limit(20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "n_terms")


@query(f"WITH {_bm25_sql('(SELECT * FROM documents WHERE source ILIKE ' + chr(39) + '%1%' + chr(39) + ')', 'doc_id', 'text', ['is', 'of'])} SELECT id AS doc_id, round(score, 6) AS score FROM ranked ORDER BY ranked.score DESC, id LIMIT 10")
def search_filtered_topk(t: Tables):
    """The filter comes before the ranking, so the best k are exact."""
    hits = search.search(t.documents.where(F.col("source").ilike("%1%")), "doc_id", "is of", "text")
    return hits.orderBy(F.desc("score"), "id").limit(10).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(r"""SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'), 'the') AND NOT list_contains(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'), 'of')
AND len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'), lambda x: starts_with(x, 'tion'))) > 0""")
def query_bool(t: Tables):
    node = search.parse_query("the AND tion* NOT of")
    return t.documents.where(search.holds(node, search.words(F.col("text")))).select("doc_id")


@query(r"""SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'), ' ') || ' ', ' in the ')""")
def query_phrase(t: Tables):
    return t.documents.where(search.holds(search.parse_query('"in the"'), search.words(F.col("text")))).select("doc_id")


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'), 1) AS at FROM documents)
SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.term = 'with' AND b.term = 'of' AND abs(a.at - b.at) <= 4""")
def phrase_near(t: Tables):
    return t.documents.where(search.holds(search.parse_query("NEAR(with of, 3)"), search.words(F.col("text")))).select("doc_id")


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) >= 20""")
def postings_df(t: Tables):
    return search.postings(t.documents, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).where("df >= 20")


_CAL = "SELECT source AS corpus, count(*) AS sample, " + ", ".join(f"quantile_cont(CAST(n_chars AS DOUBLE), {i / 100}) AS q{i}" for i in (0, 25, 50, 95, 100)) + " FROM documents GROUP BY 1"


@query(f"SELECT corpus, sample, {', '.join(f'round(q{i}, 4) AS q{i}' for i in (0, 25, 50, 95, 100))} FROM ({_CAL})")
def calibrate_quantiles(t: Tables):
    """A corpus's score distribution as boundaries at every percent, five of them shown."""
    q = search.quantiles(t.documents.select(F.col("source").alias("corpus"), F.col("n_chars").cast("double").alias("score")), "corpus", "score")
    return q.select("corpus", "sample", *[F.round(F.get("boundaries", F.lit(i)), 4).alias(f"q{i}") for i in (0, 25, 50, 95, 100)])


@query("""WITH b AS (SELECT lang, quantile_cont(CAST(n_chars AS DOUBLE), [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q, count(*) AS n FROM documents GROUP BY 1),
x AS (SELECT doc_id, n, q, len(list_filter(q, lambda y: y < n_chars * 0.9)) AS i, n_chars * 0.9 AS v FROM documents JOIN b USING (lang)),
p AS (SELECT doc_id, n, CASE WHEN i <= 0 THEN 0.0 WHEN i >= 11 THEN 1.0 ELSE (i - 1 + CASE WHEN q[i + 1] > q[i] THEN (v - q[i]) / (q[i + 1] - q[i]) ELSE 0 END) / 10.0 END AS pos FROM x)
SELECT doc_id, round(pos, 6) AS position, round(n / (n + 100.0) * pos + (1 - n / (n + 100.0)) * 0.5, 6) AS score FROM p""")
def calibrated_scores(t: Tables):
    """A magnitude's place in its corpus, shrunk to the middle by evidence."""
    q = search.quantiles(t.documents.select(F.col("lang").alias("corpus"), F.col("n_chars").cast("double").alias("score")), "corpus", "score", 10)
    rows = t.documents.join(F.broadcast(q), F.col("lang") == F.col("corpus"))  # a row a language
    v = F.col("n_chars") * 0.9
    return rows.select("doc_id", F.round(search.position(F.col("boundaries"), v), 6).alias("position"), F.round(search.calibrated(F.col("boundaries"), F.col("sample"), v, F.lit(0)), 6).alias("score"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) % 97, doc_id) - 1 AS r FROM documents)
SELECT doc_id, round(1.0 / (61 + a.r) + 1.0 / (61 + b.r), 8) AS score FROM a JOIN b USING (doc_id) ORDER BY 1.0 / (61 + a.r) + 1.0 / (61 + b.r) DESC, doc_id LIMIT 25""")
def rrf_fusion(t: Tables):
    """Two rankings fused by reciprocal ranks; only ranks among the best matter, yet both orders are total."""
    d = t.documents.select("doc_id", "n_chars", (F.length("text") % 97).alias("m"))
    a, b = (F.row_number().over(Window.orderBy(*o)) - 1 for o in ([F.desc("n_chars"), "doc_id"], ["m", "doc_id"]))
    score = search.rrf(F.col("a")) + search.rrf(F.col("b"))
    return d.withColumn("a", a).withColumn("b", b).select("doc_id", score.alias("s")).orderBy(F.desc("s"), "doc_id").limit(25).select("doc_id", F.round("s", 8).alias("score"))


_WORDS = ["of", "and"]
_UNI = []
for _name, _from, _id in (("documents", "documents", "doc_id"), ("benchmark", "benchmark", "item_id")):
    _UNI.append(_bm25_sql(_from, _id, "text", _WORDS).replace("w AS", f"{_name}_w AS", 1).replace("FROM w ", f"FROM {_name}_w ").replace("\nl AS", f"\n{_name}_l AS").replace("\ntf AS", f"\n{_name}_tf AS").replace("\nst AS", f"\n{_name}_st AS").replace(", df AS", f", {_name}_df AS").replace("FROM tf ", f"FROM {_name}_tf ").replace("SELECT tf.id", f"SELECT {_name}_tf.id").replace("JOIN df", f"JOIN {_name}_df").replace("JOIN l ", f"JOIN {_name}_l ").replace(", st ", f", {_name}_st ").replace("FROM l)", f"FROM {_name}_l)").replace("\nranked AS", f"\n{_name}_r AS"))


@query(f"""WITH {_UNI[0]}, {_UNI[1]},
h AS (SELECT 'documents' AS corpus, id, score FROM documents_r UNION ALL SELECT 'benchmark', id, score FROM benchmark_r),
r AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY score DESC, id) - 1 AS rank FROM h), q AS (SELECT * FROM r WHERE rank < 50)
SELECT corpus, id, rank, round(1.0 / (61 + rank), 8) AS score FROM q ORDER BY 1.0 / (61 + rank) DESC, CASE corpus WHEN 'documents' THEN 1 ELSE 2 END, rank LIMIT 20""")
def unified_search(t: Tables):
    """Two corpora in one list. The small one has thin evidence, so ranks are fused."""
    found = []
    for name, df, id_col in (("documents", t.documents, "doc_id"), ("benchmark", t.benchmark, "item_id")):
        hits = search.search(df, id_col, " ".join(_WORDS), "text").orderBy(F.desc("score"), "id").limit(50)
        found.append(hits.select(F.lit(name).alias("corpus"), "id", F.col("score").alias("magnitude")))
    hits = found[0].unionByName(found[1])
    calibration = t.benchmark.agg(F.percentile(F.length("text").cast("double"), [i / 100 for i in range(101)]).alias("boundaries"), F.least(F.count("*"), F.lit(40)).alias("sample")).select(F.explode(F.array(F.lit("documents"), F.lit("benchmark"))).alias("corpus"), "boundaries", "sample")
    fused = search.fuse(hits, calibration, 20, ["documents", "benchmark"])
    return fused.select("corpus", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 8).alias("score"))


@query("""SELECT conv_id, turn, role, text[1:80] AS text FROM conversations WHERE text ILIKE '%with%' AND role = 'user' ORDER BY conv_id DESC, turn LIMIT 30""")
def search_list_newest(t: Tables):
    """A corpus search without ranking lists the newest matches."""
    return t.conversations.where(F.col("text").ilike("%with%") & (F.col("role") == "user")).orderBy(F.desc("conv_id"), "turn").limit(30).select("conv_id", "turn", "role", F.substring("text", 1, 80).alias("text"))


@query(f"WITH {_bm25_sql('conversations', 'conv_id * 1000 + turn', 'text', ['that'])}, b AS (SELECT CAST(id // 1000 AS BIGINT) AS conv_id, id % 1000 AS turn, score FROM ranked ORDER BY ranked.score DESC, id LIMIT 10) SELECT b.conv_id, b.turn AS hit, c.turn, c.role, round(score, 6) AS score FROM b JOIN conversations c ON c.conv_id = b.conv_id AND c.turn BETWEEN b.turn - 1 AND b.turn + 1")
def search_messages_context(t: Tables):
    """The best messages with the ones beside them."""
    rows = t.conversations.withColumn("_id", F.col("conv_id") * 1000 + F.col("turn"))
    top = search.search(rows, "_id", "that", "text").orderBy(F.desc("score"), "id").limit(10)
    hits = top.select(F.floor(F.col("id") / 1000).cast("long").alias("conv_id"), (F.col("id") % 1000).alias("turn"), "score")
    near = rel.around(hits.select("conv_id", "turn"), t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", 1)
    return near.join(hits.withColumnRenamed("turn", "hit"), ["conv_id", "hit"]).select("conv_id", "hit", "turn", "role", F.round("score", 6).alias("score"))
