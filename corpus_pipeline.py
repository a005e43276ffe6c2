"""The corpus pipeline: language ID, exact and near duplicates, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents,
with the rows that stay as they came. A stage sees all that the one before it kept. The session's batches to Python workers are bounded
(common.small_batches), since whole texts go there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, exactdedup, jaccard, langid
from tidemark.llm.common import Stage, bounded_filter, filter_size, maybe, small_batches, table

#: A text goes when it has no letter or when no language is likelier than this.
LEAST_SCORE = 0.5


#: Near copies: runs of so many words, and so many of a hundred of them shared.
WIDTH, PERCENT = 5, 80


def packed(docs: DataFrame, **made) -> DataFrame:
    """docs as one column _doc beside columns made from it, so that no name of theirs clashes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *[x.alias(name) for name, x in made.items()])


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in gone, a written table (a null id matches a null id). Only rows that a filter of bounded size can't clear are shuffled."""
    size = filter_size(gone.count())
    marked = maybe(packed(docs, _id=F.col(id_col)), F.col("_id"), bounded_filter(gone, id_col, size), size)
    ids = gone.select(F.col(id_col).alias("_gone")).distinct()
    stay = marked.where("_maybe").join(ids, F.col("_id").eqNullSafe(F.col("_gone")), "left_anti")
    return marked.where("not _maybe").select("_doc.*").unionByName(stay.select("_doc.*"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and those that no learned language accounts for.

    Null and empty texts go; very long ones are scored whole. Rows with a null language or id, repeated rows and ties are scored like
    others. Without any language to learn all texts with a letter stay. An empty table gives an empty one.
    """
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    if not model[0]:  # nothing to learn from
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    small_batches(spark)
    found = langid.predict(docs, model, keep=tuple(docs.columns))
    return found.where(f"lang_pred <> 'und' and score >= {LEAST_SCORE}").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that with the largest doc_id.

    Null texts count as empty. Of repeated rows, and of equal texts with null ids only, one stays. Texts are compared whole, whatever their
    length; other columns don't matter. An empty table gives an empty one.
    """
    stage = Stage(spark, "copies")
    found = exactdedup.exact_dedup(docs).select("doc_id", "_sha", "kept")
    found = stage.write(found.where("_sha is not null").groupBy("doc_id", "_sha").agg(F.max("kept").alias("kept"), F.min("kept").alias("_all")), "verdicts")
    # An id has several rows only where documents repeat ids; so text hashes are compared as well.
    doubtful = stage.write(found.where("not _all"), "doubtful")
    size = filter_size(doubtful.count())
    marked = maybe(packed(docs, _id=F.col("doc_id"), _text=F.col("text")), F.col("_id"), bounded_filter(doubtful, "doc_id", size), size)
    doubt = marked.where("_maybe").select("_doc", "_id", F.unhex(F.sha2(exactdedup.normalised(F.col("_text")), 256)).alias("_sha"))
    gone = doubtful.where("not kept").select(F.col("doc_id").alias("_other"), F.col("_sha").alias("_gone"))
    stay = doubt.join(gone, F.col("_id").eqNullSafe(F.col("_other")) & (F.col("_sha") == F.col("_gone")), "left_anti").dropDuplicates(["_id", "_sha"])
    return marked.where("not _maybe").select("_doc.*").unionByName(stay.select("_doc.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, that with the least doc_id.

    Texts without a word, null ones among them, are copies of none. Of repeated ids the rows stay or go together; a null id goes
    where another one is in its component. Texts of any length are compared whole. An empty table gives an empty one.
    """
    found = jaccard.jaccard_classes(docs, width=WIDTH, percent=PERCENT).where("not (doc_id <=> component_id)")
    return without(docs, Stage(spark, "near").write(found.select("doc_id"), "gone"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts and items match nothing; very long texts are searched whole; rows that repeat an id go together, null ids too.
    An empty table, of documents or items, takes nothing away.
    """
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, Stage(spark, "leaks").write(found.select("doc_id").distinct(), "gone"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of each document, with hashes of the ids and of the bytes that they decode to.

    A null text has no ids; null ids, repeated rows and very long texts are rows like others; an empty table gives an empty one.
    """
    small_batches(spark)
    made = bpe.encode(docs, keep=("lang", "source"), decoded="decoded")
    return made.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: SQL expresses neither the language model, the edit distance nor the encoder; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage.write(step(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
