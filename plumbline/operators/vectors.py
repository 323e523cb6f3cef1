"""Cosine retrieval and the hashing embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as X


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 for a vector without length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def cosine_top_k(index: DataFrame, query: list[float], *, key: str, vector: str, k: int = 5) -> DataFrame:
    """The ``k`` rows nearest to one query vector; a distributed top-k, ties by key."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return index.select(key, cosine(F.col(vector), q).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def hash_embedding(docs: DataFrame, *, key: str, text: str, buckets: int = 32) -> DataFrame:
    """(key, bucket, value): tokens fall into the bucket of their sha256's first byte with weight 1 + second byte / 255; texts without tokens have 1 in bucket 0."""
    tok = docs.select(key, F.explode_outer(X.tokens(text)).alias("tok"))
    h = F.sha2("tok", 256)
    byte = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    bucket = F.when(F.col("tok").isNull(), 0).otherwise(byte(1) % buckets)
    value = F.when(F.col("tok").isNull(), 1.0).otherwise(1 + byte(3) / 255)
    return tok.select(key, bucket.alias("bucket"), value.alias("v")).groupBy(key, "bucket").agg(F.sum("v").alias("value"))


def rank_of(rows: DataFrame, *, run: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(run).orderBy(*order)))
