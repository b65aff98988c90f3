"""Cosine similarity with native functions, exact top-k, and top-k with an early stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where either norm is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def similarity(cos: Column) -> Column:
    """(cos + 1) / 2 kept in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1) / 2))


def nearest(df: DataFrame, vector: str, query: list[float], k: int, id_: str) -> DataFrame:
    """The k rows of greatest cosine to the query, ties by id; the query is one literal vector, so nothing is joined."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("cos", cosine(F.col(vector), q)).orderBy(F.col("cos").desc_nulls_last(), F.col(id_)).limit(k)


def early_stop_topk(df: DataFrame, title: str, text: str, id_: str, k: int, weights: tuple[float, float] = (0.7, 0.3), ceiling: float = 1.0) -> DataFrame:
    """Top k rows by w0*title + w1*text, ties by id, without ranking all texts.

    The k rows of best title have some combined score at worst: no row whose title leaves it below that even with a text
    of the `ceiling` can be among the top k. The bound is one row, found by a top-k and broadcast; one filtered top-k
    follows. Nothing goes through the driver.
    """
    score = weights[0] * F.col(title) + weights[1] * F.col(text)
    first = df.orderBy(F.desc(title), id_).limit(k).agg(F.min(score).alias("_bound"), F.count("*").alias("_held"))
    near = (F.col("_held") < k) | (weights[0] * F.col(title) + weights[1] * ceiling >= F.col("_bound"))
    kept = df.crossJoin(F.broadcast(first)).filter(near).drop("_bound", "_held")
    return kept.withColumn("score", score).orderBy(F.desc("score"), id_).limit(k)
