"""Vector functions as column expressions, and an offline embedder. Arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null, empty or zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


#: metric -> (function, whether a higher value is better)
METRICS = {"COSINE": (cosine, True), "IP": (dot, True), "L2": (euclidean, False)}


def hash_embed(df: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """key and a unit vector of hashed words: md5 picks a word's place and sign. No model, the same everywhere."""
    words = df.select(F.col(key), F.explode_outer(T.word_parts(F.col(text))).alias("w"))
    digest = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("long")
    places = words.select(
        key, (F.pmod(digest, F.lit(dims))).cast("int").alias("at"),
        F.when(F.floor(digest / dims) % 2 == 0, 1.0).otherwise(-1.0).alias("sign")
    )
    sums = places.groupBy(key, "at").agg(F.sum("sign").alias("v")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "v")))).alias("m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return sums.select(key, raw.alias("raw")).select(
        key, F.transform("raw", lambda x: F.coalesce(x / F.nullif(norm(F.col("raw")), F.lit(0.0)), F.lit(0.0))).alias("embedding")
    )
