"""Sharding by extendible hashing, in DataFrame functions only.

A document's key is the first 48 bits of md5(doc_id). The directory is indexed by prefixes of
these bits; a bucket that holds more than `limit` bytes splits on its next bit, any other
stays, until every shard fits. Sizes are summed once at the finest depth that the total can
need and rolled up to each shallower depth, so the work is one aggregation of documents and
one of directory entries; documents join the directory on the fine prefix.

Defined results: a null text has no bytes, a null doc_id is keyed as the empty text; rows that
repeat a doc_id have one key and stay together; a shard is over the limit only where it cannot
split, at full depth (`fits` is false there). An empty table has no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 48


def key_bits(doc_id: Column) -> Column:
    """The first 48 bits of md5(doc_id) as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 2), BITS, "0")


def directory(sizes: DataFrame, depth: int, limit: int) -> DataFrame:
    """prefix (of `depth` bits) -> shard (its prefix), for (prefix, bytes, docs) sums at that depth."""
    levels = sizes.select("prefix", "bytes", "docs", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    levels = levels.withColumn("shard", F.expr("substring(prefix, 1, d)"))
    by_shard = levels.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    fits = by_shard.where((F.col("shard_bytes") <= limit) | (F.length("shard") == depth))
    # a fine prefix belongs to its shallowest bucket that fits
    covers = levels.select("prefix", "shard").join(fits, "shard")
    best = covers.groupBy("prefix").agg(F.min_by(F.struct("shard", "shard_bytes", "shard_docs"), F.length("shard")).alias("b"))
    return best.select("prefix", "b.*")


def extendible_shards(docs: DataFrame, limit: int = 64 << 20, slack: int = 6) -> DataFrame:
    """doc_id, shard (bit prefix), depth, shard_docs, shard_bytes and fits of every row."""
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), key_bits(F.col("doc_id")).alias("bits"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    depth = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + slack))
    top = F.expr(f"substring(bits, 1, {depth})")
    sums = [F.sum("bytes").alias("bytes"), F.count("*").alias("docs")]
    sizes = rows.groupBy(top.alias("prefix")).agg(*sums)
    coarse = directory(sizes, depth, limit)
    # prefixes that are still too large at this depth are split further, key by key
    hot = sizes.where(F.col("bytes") > limit).select(F.col("prefix").alias("top"))
    keys = rows.withColumn("top", top).join(hot, "top", "left_semi").groupBy(F.col("bits").alias("prefix")).agg(*sums)
    fine = directory(keys, BITS, limit)
    placed = rows.withColumn("prefix", F.expr(f"substring(bits, 1, {depth})")).join(coarse, "prefix", "left")
    fine = fine.select(F.col("prefix").alias("bits"), *(F.col(c).alias(f"f_{c}") for c in ("shard", "shard_bytes", "shard_docs")))
    placed = placed.join(fine, "bits", "left")
    pick = lambda c: F.coalesce(F.col(f"f_{c}"), F.col(c))
    return placed.select("doc_id", pick("shard").alias("shard"), F.length(pick("shard")).alias("depth"), pick("shard_docs").alias("shard_docs"),
                         pick("shard_bytes").alias("shard_bytes"), (pick("shard_bytes") <= limit).alias("fits"))
