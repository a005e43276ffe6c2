"""Exact nearest neighbours by cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to a vector, ties by id. Filter vectors before; none left gives none."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("similarity", cosine(F.col(vector_col), q)).orderBy(F.desc("similarity"), id_col).limit(k)


def nearest_to(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query, id, similarity, rank) of the k nearest of each query row. queries must be few: they go to every task."""
    q = queries.select(F.col(id_col).alias("query"), F.col(vector_col).alias("_q"))
    scored = vectors.crossJoin(F.broadcast(q)).where(F.col(id_col) != F.col("query")).select("query", F.col(id_col).alias("id"), cosine(F.col(vector_col), F.col("_q")).alias("similarity"))
    from .relational import top_per_group

    from pyspark.sql import Window

    best = top_per_group(scored, ["query"], k, F.desc("similarity"), F.col("id"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id")))
