"""Content-hash snapshots: differences, root hashes and incremental merges."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import work_dir

EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def snapshot(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, hash) of each file; an unreadable one hashes to the empty text."""
    return files.select(F.col(path).alias("path"), F.coalesce(F.sha2(F.col(content).cast("binary"), 256), F.lit("")).alias("hash"))


def diff(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(path, change): added, modified or deleted. Without an old snapshot everything is added."""
    if old is None:
        return new.select("path", F.lit("added").alias("change"))
    a, b = old.select("path", F.col("hash").alias("old")), new.select("path", F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def same_root(old: DataFrame, new: DataFrame) -> bool:
    """Whether counts and order-free sums of (path, hash) agree: the cheap test before a diff."""
    sums = lambda s: s.agg(F.count("*"), F.sum(F.xxhash64("path", "hash").cast("decimal(38,0)"))).first()
    return sums(old) == sums(new)


def flat_root(snap: DataFrame, most: int = 1_000_000) -> DataFrame:
    """One row: sha256 of all hashes in order, joined.

    This hash is sequential by definition. Up to `most` files it is one aggregate (64 bytes a file);
    beyond, sorted hashes stream through the driver, which holds one partition at a time."""
    files = snap.count()
    if files <= most:
        return snap.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ""), 256).alias("root_hash"), F.count("*").alias("file_count"))
    digest = hashlib.sha256()
    for row in snap.select("hash").orderBy("hash").toLocalIterator(prefetchPartitions=True):
        digest.update(row.hash.encode())
    return snap.sparkSession.createDataFrame([(digest.hexdigest(), files)], "root_hash string, file_count long")


def pairwise_root(snap: DataFrame, order: str = "path") -> DataFrame:
    """One row: root of the binary tree over hashes in order; an odd last node moves up unchanged.

    Each level is a group of pairs, so the tree is built in parallel; only the numbering of the
    leaves needs their order, which a range partition gives without one task seeing all rows."""
    spark = snap.sparkSession
    level = numbered(snap.select(F.col(order).alias("o"), "hash"), "o").select("i", "hash")
    n = level.count()
    if n == 0:
        return spark.range(1).select(F.lit(EMPTY_ROOT).alias("root_hash"), F.lit(0).cast("long").alias("leaves"))
    leaves, depth = n, 0
    while n > 1:
        left, right = F.max(F.when(F.col("i") % 2 == 0, F.col("hash"))), F.max(F.when(F.col("i") % 2 == 1, F.col("hash")))
        pairs = level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(left.alias("l"), right.alias("r"))
        level = pairs.select("i", F.when(F.col("r").isNull(), F.col("l")).otherwise(F.sha2(F.concat("l", "r"), 256)).alias("hash"))
        n, depth = (n + 1) // 2, depth + 1
    return level.select(F.col("hash").alias("root_hash"), F.lit(leaves).cast("long").alias("leaves"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with i = 0, 1, 2, ... in order: rows are numbered within ranges and ranges are offset by counts.

    The ranges are written before they are counted: their bounds come from a sample, and two readings of a plan draw two."""
    from pyspark.sql import Window as W

    spark, path = df.sparkSession, f"{work_dir(df.sparkSession, 'ranges')}/rows"
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    staged = spark.read.schema(ranged.schema).parquet(path)
    place = F.col("__m").bitwiseAND((1 << 33) - 1)  # the id holds the number of the range above 33 bits
    rows = staged.withColumns({"__p": F.shiftright("__m", 33), "__r": place})
    counts = rows.groupBy("__p").agg(F.count("*").alias("__n"))  # one row a range
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(before.select("__p", "__before")), "__p").withColumn("i", F.col("__before") + F.col("__r")).drop("__p", "__r", "__m", "__before")


def incremental_merge(chunks: DataFrame, changes: DataFrame, fresh: DataFrame, path: str = "path") -> DataFrame:
    """Chunks of unchanged files and those of added and modified ones; chunks of deleted files go."""
    gone = changes.where(F.col("change") != "added").select(F.col("path").alias(path))
    kept = chunks.join(gone, path, "left_anti")
    new = fresh.join(changes.where(F.col("change") != "deleted").select(F.col("path").alias(path)), path, "left_semi")
    return kept.unionByName(new)


def change_counts(changes: DataFrame) -> DataFrame:
    count = lambda kind: F.count(F.when(F.col("change") == kind, 1)).alias(kind)
    return changes.agg(count("added"), count("modified"), count("deleted"), F.count(F.when(F.col("change") != "deleted", 1)).alias("processed"))


def chunk_counters(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Chunks of added and of modified files."""
    kinds = chunks.join(changes.where("change <> 'deleted'"), "path")
    return kinds.agg(
        F.count(F.when(F.col("change") == "added", 1)).alias("chunks_added"),
        F.count(F.when(F.col("change") == "modified", 1)).alias("chunks_updated")
    )


def delete_ids(chunks: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return chunks.join(ids.select(key), key, "left_anti")
