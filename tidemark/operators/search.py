"""Full-text search: postings, BM25, boolean queries, calibration and fusion of ranked corpora."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words

#: Fixed values of the ranking: BM25's two, the least idf, the rank constant of reciprocal rank fusion, how much evidence counts half.
K1, B, LEAST_IDF, RRF_K, SHRINK, NEUTRAL, RANK_STEP = 1.2, 0.75, 1e-6, 60, 100.0, 0.5, 1e-4


def postings(docs: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """Rows (id, term, tf, len): one per distinct word of a document, with the document's length over all columns."""
    every = docs.select(F.col(id_col).alias("id"), F.concat(*[words(F.col(c)) for c in text_cols]).alias("_w")).withColumn("len", F.size("_w").cast("long"))
    return every.select("id", "len", F.explode("_w").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def matches(docs: DataFrame, id_col: str, terms: list[str], *text_cols: str) -> DataFrame:
    """Rows (id, len, term, tf) of the wanted terms only, read off each document without exploding its other words."""
    every = docs.select(F.col(id_col).alias("id"), F.concat(*[words(F.col(c)) for c in text_cols]).alias("_w")).withColumn("len", F.size("_w").cast("long"))
    wanted = F.array(*[F.lit(t) for t in terms])
    hit = every.withColumn("_w", F.filter("_w", lambda w: F.array_contains(wanted, w)))
    return hit.select("id", "len", F.explode_outer("_w").alias("term")).groupBy("id", "len", "term").agg(F.count("term").alias("tf"))


def bm25(found: DataFrame) -> DataFrame:
    """Rows (id, score, n_terms) from matches(): score is the sum over terms of idf times the saturated frequency, more is better.

    Corpus size and mean length are taken from the rows without a hit as well, in the same pass.
    """
    docs = found.select("id", "len").distinct()
    size = docs.agg(F.count("*").alias("N"), F.avg("len").alias("mean"))
    df = found.where("tf > 0").groupBy("term").agg(F.countDistinct("id").alias("df"))
    n, k = F.col("N"), F.col("df")
    idf = F.greatest(F.ln((n - k + 0.5) / (k + 0.5)), F.lit(0.0))
    idf = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))
    rows = found.where("tf > 0").join(F.broadcast(df), "term").crossJoin(F.broadcast(size))  # one row a query term, one row
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return rows.groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("n_terms"))


def relax(query: str) -> str:
    """Several plain words become alternatives; a query with operators or quotes stays."""
    parts = query.split()
    if len(parts) <= 1 or '"' in query or any(p in ("AND", "OR", "NOT") or p.startswith("NEAR") for p in parts):
        return query
    return " OR ".join(parts)


@dataclass(frozen=True)
class Node:
    """A parsed query: kind is word, prefix, phrase, near, and, or, not."""

    kind: str
    parts: tuple = ()
    gap: int = 0


_PIECE = re.compile(r'"([^"]*)"|NEAR\(([^)]*)\)|(\()|(\))|(\S+?)(?=[\s()]|$)')


def parse_query(query: str) -> Node | None:
    """OR, AND, NOT (upper case), phrases, NEAR(a b, k), prefix*; side by side means AND. Other punctuation separates words; never raises."""
    pieces = []
    for m in _PIECE.finditer(query):
        phrase, near, opening, closing, word = m.groups()
        split = lambda s: tuple(re.findall(r"[^\W_]+", s.lower()))
        if phrase is not None:
            if split(phrase):
                pieces.append(Node("phrase", split(phrase)))
        elif near is not None:
            inside, _, gap = near.partition(",")
            if split(inside):
                pieces.append(Node("near", split(inside), int(gap) if gap.strip().isdigit() else 10))
        elif opening or closing:
            pieces.append(opening or closing)
        elif word in ("AND", "OR", "NOT"):
            pieces.append(word)
        else:
            prefix = word.endswith("*")
            for w in split(word):
                pieces.append(Node("prefix" if prefix else "word", (w,)))
    at = 0

    def peek():
        return pieces[at] if at < len(pieces) else None

    def either():
        nonlocal at
        left = both()
        while peek() == "OR":
            at += 1
            right = both()
            left = Node("or", (left, right)) if left and right else left or right
        return left

    def both():
        nonlocal at
        left = one()
        while peek() not in (None, "OR", ")"):
            negate = peek() == "NOT"
            if peek() in ("AND", "NOT"):
                at += 1
            right = one()
            if right:
                left = (Node("not", (left, right)) if negate else Node("and", (left, right))) if left else (None if negate else right)
        return left

    def one():
        nonlocal at
        p = peek()
        if p == "(":
            at += 1
            inner = either()
            if peek() == ")":
                at += 1
            return inner
        if isinstance(p, Node):
            at += 1
            return p
        if p in ("AND", "NOT", "OR"):
            return None
        at += p is not None
        return None

    return either()


def holds(node: Node, w: Column) -> Column:
    """Whether a query holds for a document's words, without leaving the JVM."""
    if node.kind == "word":
        return F.array_contains(w, node.parts[0])
    if node.kind == "prefix":
        return F.exists(w, lambda x: x.startswith(node.parts[0]))
    if node.kind == "phrase":
        joined = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
        return F.contains(joined, F.lit(" " + " ".join(node.parts) + " "))
    if node.kind == "near":
        at = F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
        of = lambda t: F.transform(F.filter(at, lambda s: s["w"] == t), lambda s: s["i"])
        places = [of(t) for t in node.parts]
        # Some place of the first word has all others within gap + 1.
        return F.exists(places[0], lambda i: _all([_within(p, i, node.gap + 1) for p in places[1:]] or [F.lit(True)]))
    a, b = (holds(p, w) for p in node.parts)
    return a & b if node.kind == "and" else a | b if node.kind == "or" else a & ~b


def _within(places: Column, i: Column, most: int) -> Column:
    return F.exists(places, lambda j: F.abs(i - j) <= most)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def query_words(node: Node | None) -> list[str]:
    if node is None:
        return []
    if node.kind in ("word", "prefix", "phrase", "near"):
        return list(dict.fromkeys(node.parts))
    found = query_words(node.parts[0]) + ([] if node.kind == "not" else query_words(node.parts[1]))
    return list(dict.fromkeys(found))


def search(docs: DataFrame, id_col: str, query: str, *text_cols: str) -> DataFrame:
    """Rows (id, score, n_terms) of the documents for which the relaxed query holds. Filters belong before, on docs."""
    node = parse_query(relax(query))
    if node is None:
        return bm25(matches(docs.limit(0), id_col, ["-"], *text_cols))
    ranked = bm25(matches(docs, id_col, query_words(node), *text_cols))
    if node.kind in ("word",) or _only_or(node):
        return ranked
    holding = docs.where(holds(node, F.concat(*[words(F.col(c)) for c in text_cols]))).select(F.col(id_col).alias("id"))
    return ranked.join(holding, "id", "left_semi")


def _only_or(node: Node) -> bool:
    return node.kind == "word" or node.kind == "or" and all(_only_or(p) for p in node.parts)


def quantiles(scores: DataFrame, corpus: str, score: str, steps: int = 100) -> DataFrame:
    """Per corpus the boundaries of its scores at 0, 1 % ... 100 % and how many there are."""
    share = [i / steps for i in range(steps + 1)]
    return scores.groupBy(corpus).agg(F.percentile(score, share).alias("boundaries"), F.count(score).alias("sample"))


def position(boundaries: Column, x: Column) -> Column:
    """Where x stands among ascending boundaries, 0 to 1, linear between two; 0.5 with fewer than two."""
    n = F.size(boundaries)
    below = F.size(F.filter(boundaries, lambda b: b < x))
    lo, hi = F.get(boundaries, below - 1), F.get(boundaries, below)
    part = F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0)
    return F.when(n < 2, F.lit(0.5)).when(below <= 0, F.lit(0.0)).when(below >= n, F.lit(1.0)).otherwise((below - 1 + part) / (n - 1))


def evidence(sample: Column) -> Column:
    return F.coalesce(sample / (sample + SHRINK), F.lit(0.0))


def calibrated(boundaries: Column, sample: Column, magnitude: Column, rank: Column) -> Column:
    """The score's place in its corpus, drawn to the middle as far as evidence is thin; rank (from 0) breaks ties."""
    w = evidence(sample)
    q = F.when(w > 0, position(boundaries, magnitude)).otherwise(NEUTRAL)
    return w * q + (1 - w) * NEUTRAL - rank * RANK_STEP


def rrf(rank: Column) -> Column:
    return 1 / (RRF_K + rank + 1)


def fuse(hits: DataFrame, calibration: DataFrame, limit: int, corpora: list[str]) -> DataFrame:
    """The best hits of several corpora (corpus, id, magnitude) on one scale: calibrated, or by ranks as soon as one corpus has thin evidence.

    Ties go by the order of corpora, then rank.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in corpora]), F.col("corpus"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("magnitude"), "id")) - 1)
    ranked = ranked.join(F.broadcast(calibration), "corpus", "left")  # one row a corpus
    thin = ranked.agg(F.max((evidence(F.col("sample")) < 0.5).cast("int")).alias("thin"))
    both = ranked.crossJoin(F.broadcast(thin))
    score = F.when(F.col("thin") == 1, rrf(F.col("rank"))).otherwise(calibrated(F.col("boundaries"), F.col("sample"), F.col("magnitude"), F.col("rank")))
    return both.withColumn("score", score).withColumn("_o", order).orderBy(F.desc("score"), "_o", "rank", "id").limit(limit).drop("_o", "boundaries")
