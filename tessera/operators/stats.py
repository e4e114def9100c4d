"""Statistics of files and collections, and estimates of an indexing run."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import fixed


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def detect_language(ext: Column, configured: dict[str, list[str]] | None = None) -> Column:
    """Language of a lower-cased extension: configured ones first, then the built-in table, else null."""
    table = dict(fixed.LANGUAGES)
    for language, extensions in reversed(list((configured or {}).items())):
        table |= dict.fromkeys(extensions, language)
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))[ext]


def file_stats(files: DataFrame) -> DataFrame:
    """Count and bytes by language, and in total (language null)."""
    return files.rollup("language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.grouping("language").alias("total"))


def extension_histogram(files: DataFrame, path: str = "path") -> DataFrame:
    return files.groupBy(extension(F.col(path)).alias("extension")).agg(F.count("*").alias("files"))


def primary_language(files: DataFrame, order: str = "path") -> DataFrame:
    """One row: the language of the most frequent extension, the first seen of equals; typescript for others."""
    counted = files.groupBy(extension(F.col("path")).alias("extension")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counted.orderBy(F.col("n").desc(), F.col("first")).limit(1)
    known = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".rb": "ruby"}
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in known.items()))
    return best.select(F.coalesce(table[F.col("extension")], F.lit("typescript")).alias("primary_language"))


def project_size(sampled: Column) -> Column:
    files = sampled * 10
    return F.when(files < 500, "small").when(files < 5000, "medium").when(files < 30000, "large").otherwise("massive")


def estimate_chunks(files: Column, language: Column) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in fixed.CHUNKS_PER_FILE.items()))
    return F.floor(files * F.coalesce(table[language], F.lit(fixed.OTHER_CHUNKS_PER_FILE)) + 0.5).cast("long")


def estimate_seconds(files: Column, chunks: Column, provider: str = "ollama", concurrency: int = 3) -> Column:
    rate = fixed.LOCAL_RATE if provider == "ollama" else next((r for c, r in fixed.RATES_BY_CONCURRENCY if concurrency >= c), fixed.SLOWEST_RATE)
    return chunks / F.lit(rate) + files / F.lit(fixed.FILES_PARSED_A_SECOND) + F.lit(fixed.FIXED_SECONDS)


def time_text(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60).cast("long")
    return F.when(
        minutes < 1, F.format_string("~%d seconds", F.floor(seconds % 60).cast("long"))
    ).when(minutes < 2, "~1-2 minutes").otherwise(F.format_string("~%d-%d minutes", minutes, minutes + 1))


def embedding_cost(tokens: Column, model: str | Column) -> Column:
    name = F.lit(model) if isinstance(model, str) else model
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in fixed.PRICES.items()))
    return tokens * F.coalesce(table[name], F.lit(fixed.PRICES["text-embedding-3-small"])) / 1e6


def cost_text(chunks: Column, model: str = "text-embedding-3-small", provider: str = "openai") -> Column:
    if provider == "ollama":
        return F.lit("FREE (local Ollama)")
    cost = embedding_cost(chunks * fixed.TOKENS_PER_CHUNK, model)
    return F.when(cost < 0.01, F.format_string("~$%.6f (<1 cent)", cost)).otherwise(F.format_string("~$%.4f", cost))


def success_rate(chunks: Column, embedded: Column) -> Column:
    """Whether four fifths of the chunks were embedded; no chunks fail."""
    return (chunks > 0) & (embedded >= F.lit(0.8) * chunks)


def collection_stats(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.agg(F.count("*").alias("count"), F.max(F.size(vector)).cast("long").alias("dimensions"))


def assign_batches(df: DataFrame, order: str, size: int = 32) -> DataFrame:
    """df with batch = 0, 1, ... of `size` rows in order."""
    from tessera.operators.changes import numbered

    return numbered(df, order).withColumn("batch", F.floor(F.col("i") / size)).drop("i")


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).where("__r = 1").drop("__r")
