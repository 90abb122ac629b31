"""Exact vector search: inner product of unit vectors, ranked with an id tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision; stays in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Inner product of the unit vectors; null where either is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def scored(vectors: DataFrame, queries: DataFrame, vector: str = "embedding", query_vector: str = "query_vector") -> DataFrame:
    """Each row with its score against a one-row query frame (which Spark broadcasts)."""
    return vectors.crossJoin(F.broadcast(queries.select(query_vector).limit(1))).withColumn("score", cosine(F.col(vector), F.col(query_vector))).drop(query_vector)


def top_k(hits: DataFrame, k: int, id_col: str, score: str = "score", least: float | None = None) -> DataFrame:
    """The k best rows by score, then id; one TakeOrdered, no full sort."""
    kept = hits.filter(F.col(score).isNotNull())
    if least is not None:
        kept = kept.filter(F.col(score) >= least)
    return kept.orderBy(F.desc(score), id_col).limit(k)


def top_k_per(hits: DataFrame, k: int, partition: str, id_col: str, score: str = "score") -> DataFrame:
    """The k best rows of each partition (one per index, category or snapshot)."""
    order = Window.partitionBy(partition).orderBy(F.desc(score), id_col)
    return hits.filter(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def over_fetch(hits: DataFrame, k: int, factor: int, keep: Column, id_col: str, score: str = "score") -> DataFrame:
    """Rank first, filter the best k * factor, then cut to k: may return fewer than k."""
    return top_k(top_k(hits, k * factor, id_col, score).filter(keep), k, id_col, score)


def merge_indexes(parts: list[DataFrame], k: int, id_col: str, score: str = "score") -> DataFrame:
    """Union of per-index hits, one row per id (its best), cut to k."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = every.groupBy(id_col).agg(F.max(score).alias(score))
    return top_k(best, k, id_col, score)


def cap_per_group(hits: DataFrame, n: int, group: str, order: list) -> DataFrame:
    """First n rows of each group in the given order; n <= 0 keeps all."""
    if n <= 0:
        return hits
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def hashing_embedding(tokens: Column, id_col: str, frame: DataFrame, dims: int) -> DataFrame:
    """Sparse hashing embedding ``id, bucket, weight``: sha1 bucket and sign per token, L2-normalised per row."""
    digests = frame.select(F.col(id_col), F.explode(tokens).alias("token")).select(id_col, F.sha1(F.col("token").cast("binary")).alias("d"))
    bucket = F.conv(F.substring("d", 1, 8), 16, 10).cast("long") % dims
    sign = F.when(F.conv(F.substring("d", 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    # at most ``dims`` rows of a text leave a task
    sums = digests.select(id_col, bucket.alias("bucket"), sign.alias("w")).groupBy(id_col, "bucket").agg(F.sum("w").alias("w")).filter("w <> 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return sums.select(id_col, "bucket", (F.col("w") / norm).alias("weight"))
