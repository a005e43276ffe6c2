"""Terms, similarity, themes, labels and recurring patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from . import graph


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, term, tf) without stop words."""
    return docs.select(F.col(id_col).alias("id"), F.explode(terms(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, n: int) -> DataFrame:
    """Rows (term, df, idf): ln((n + 1) / (df + 1)) + 1, no larger than the value at 95 % of the sorted ones."""
    df = counts.groupBy("term").agg(F.countDistinct("id").alias("df"))
    # Few distinct document frequencies carry all terms, so the value at 95 % is read off them.
    by_df = df.groupBy("df").agg(F.count("*").alias("_k"))
    total = Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, 0)
    at = by_df.withColumn("_upto", F.sum("_k").over(total)).crossJoin(by_df.agg(F.sum("_k").alias("_all")))
    cap = at.where(F.col("_upto") > F.floor((F.col("_all") - 1) * 0.95)).agg(F.max("df").alias("_df"))
    value = lambda k: F.ln((F.lit(n) + 1.0) / (k + 1.0)) + 1
    return df.crossJoin(F.broadcast(cap)).select("term", "df", F.least(value(F.col("df")), value(F.col("_df"))).alias("idf"))


def tfidf(counts: DataFrame, n: int) -> DataFrame:
    """Rows (id, term, w): tf times idf, each document's vector of length one."""
    w = counts.join(idf(counts, n), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return w.join(norm, "id").select("id", "term", (F.col("w") / F.col("_norm")).alias("w"), "df")


def similar_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, cosine) of at least `least`, exact, a < b.

    Prefix filter: with a document's terms in a fixed order, rare ones first, its weights from some place on have a
    norm below `least`, so a pair that reaches it shares a term before that place in one of the two. Only those prefixes are indexed, and each
    candidate pair is then summed over all its shared terms.
    """
    order = Window.partitionBy("id").orderBy("df", "term")
    rest = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    v = vectors.withColumn("_tail", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest))).withColumn("_n", F.row_number().over(order))
    head = v.where(F.col("_tail") >= least - 1e-9).select("id", "term")
    x = head.select(F.col("id").alias("a"), "term").join(head.select(F.col("id").alias("b"), "term"), "term").where("a < b").select("a", "b").distinct()
    whole = vectors.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "w")))).alias("m"))
    both = x.join(whole.select(F.col("id").alias("a"), F.col("m").alias("ma")), "a").join(whole.select(F.col("id").alias("b"), F.col("m").alias("mb")), "b")
    shared = F.array_sort(F.array_intersect(F.map_keys("ma"), F.map_keys("mb")))
    cosine = F.aggregate(shared, F.lit(0.0), lambda s, t: s + F.col("ma")[t] * F.col("mb")[t])
    return both.select("a", "b", cosine.alias("cosine")).where(F.col("cosine") >= least)


def themes(pairs: DataFrame) -> DataFrame:
    """Single-link clusters of similar pairs, which are the components of their graph: rows (node, component)."""
    return graph.components(pairs, "a", "b")


def bigrams(docs: DataFrame, group: str, text_col: str, weight: Column | None = None) -> DataFrame:
    """The heaviest pair of neighbouring terms per group as a label, ties by spelling; the heaviest term where there is no pair."""
    w = weight if weight is not None else F.lit(1.0)
    rows = docs.select(group, terms(F.col(text_col)).alias("_t"), w.alias("_w"))
    pair = F.when(F.size("_t") > 1, F.transform(F.sequence(F.lit(1), F.size("_t") - 1), lambda i: F.concat_ws(" ", F.element_at("_t", i), F.element_at("_t", i + 1)))).otherwise(F.array().cast("array<string>"))
    both = rows.select(group, "_w", F.explode(F.concat(F.transform(pair, lambda x: F.struct(F.lit(0).alias("k"), x.alias("t"))), F.transform("_t", lambda x: F.struct(F.lit(1).alias("k"), x.alias("t"))))).alias("e"))
    sums = both.groupBy(group, "e.k", "e.t").agg(F.sum("_w").alias("n"))
    best = sums.groupBy(group).agg(F.min(F.struct("k", (-F.col("n")).alias("m"), "t")).alias("b"))
    return best.select(group, F.initcap("b.t").alias("label"), F.when(F.col("b.k") == 0, "bigram").otherwise("token").alias("path"))


def balanced(docs: DataFrame, repo: str, kind: str, id_col: str, factor: float) -> DataFrame:
    """docs, the largest repository cut to factor times the second, its kinds taken in turn; ties by name and id."""
    sizes = docs.groupBy(F.coalesce(F.col(repo), F.lit("_none")).alias("_r")).agg(F.count("*").alias("_n"))
    two = sizes.orderBy(F.desc("_n"), "_r").limit(2).agg(F.max_by("_r", F.struct("_n", F.lit(1))).alias("_x"), F.max("_n").alias("_top"), F.min("_n").alias("_second"), F.count("*").alias("_repos"), F.min("_r").alias("_least"))
    two = two.withColumn("_top_repo", F.when(F.col("_top") == F.col("_second"), F.col("_least")).otherwise(F.col("_x")))
    rows = docs.withColumn("_r", F.coalesce(F.col(repo), F.lit("_none"))).crossJoin(F.broadcast(two))  # one row
    cut = (F.col("_repos") > 1) & (F.col("_r") == F.col("_top_repo")) & (F.col("_top") > F.floor(F.lit(factor) * F.col("_second")))
    turn = F.row_number().over(Window.partitionBy("_r", kind).orderBy(id_col))
    rows = rows.withColumn("_turn", F.when(cut, turn)).withColumn("_place", F.row_number().over(Window.partitionBy("_r").orderBy("_turn", kind)))
    most = F.greatest(F.floor(F.lit(factor) * F.col("_second")), F.lit(1))
    return rows.where(~cut | (F.col("_place") <= most)).select(docs.columns)


def patterns(found: DataFrame, least: int = 3, sessions: int = 2, excerpts: int = 3) -> DataFrame:
    """Recurring patterns from rows (kind, signature, session, repo, excerpt, at): how often, where, and the first distinct excerpts.

    Only what occurs at least `least` times in at least `sessions` sessions.
    """
    firsts = found.groupBy("kind", "signature", "excerpt").agg(F.min("at").alias("_at"))
    early = Window.partitionBy("kind", "signature").orderBy("_at", "excerpt")
    firsts = firsts.withColumn("_n", F.row_number().over(early)).where(F.col("_n") <= excerpts)
    shown = firsts.groupBy("kind", "signature").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "excerpt"))), lambda x: x["excerpt"]).alias("excerpts"))
    sums = found.groupBy("kind", "signature").agg(F.count("*").alias("occurrences"), F.countDistinct("session").alias("sessions"), F.countDistinct("repo").alias("repos"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    return sums.where((F.col("occurrences") >= least) & (F.col("sessions") >= sessions)).join(shown, ["kind", "signature"]).withColumn("pattern_id", F.sha1(F.concat(F.col("kind"), F.lit("\0"), F.col("signature"))))
