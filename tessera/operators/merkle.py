"""Hierarchical snapshots: a digest of every folder's files, and a difference that descends only where digests differ.

A folder's digest covers all files below it: four sums over hashes of (path, hash), 60 bits each, and the count. Sums
need no order and combine before the shuffle, so a folder with any share of the files is no single task; they also
follow a change by adding and subtracting. Equal digests mean equal files but for collisions of 240 bits.

A stored tree is two tables: folders (by depth, ordered by parent) and files (ordered by folder), so a descent reads
the rows of the folders it names, by the statistics of row groups.

Defined results: the root is the folder ""; a path without a slash is a file of the root, and
slashes at its start are passed over; an unreadable file has
the empty hash; a null path is no file; rows that repeat a path count each time in digests, and differences pair them as a join does; an empty
snapshot has a root without files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import changes

LANES = 4
EMPTY = "0" * 64


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^/*(.*)/[^/]*$", 1)


def _ancestors(path: Column) -> Column:
    """array<struct<depth, folder>>: the root and every folder above a path."""
    parts = F.split(F.regexp_replace(path, "^/+", ""), "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("folder"))
    )


def folders(snapshot: DataFrame) -> DataFrame:
    """depth, folder, parent, files and digest of every folder of a snapshot (path, hash): one aggregation."""
    name = F.sha2(F.concat_ws("\n", "path", "hash").cast("binary"), 256)
    lanes = [F.conv(F.substring(name, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)").alias(f"l{i}") for i in range(LANES)]
    rows = snapshot.select(F.explode(_ancestors(F.col("path"))).alias("a"), *lanes).select("a.depth", "a.folder", *(f"l{i}" for i in range(LANES)))
    sums = rows.groupBy("depth", "folder").agg(F.count("*").alias("files"), *(F.sum(f"l{i}").alias(f"l{i}") for i in range(LANES)))
    digest = F.sha2(F.concat_ws(":", "files", *(f"l{i}" for i in range(LANES))).cast("binary"), 256)
    parent = F.when(F.col("depth") > 0, folder_of(F.col("folder")))
    return sums.select("depth", "folder", parent.alias("parent"), "files", digest.alias("digest"))


class StoredTree:
    """A snapshot at a path: folders/depth=D and files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, snapshot: DataFrame) -> StoredTree:
        """Store a snapshot (path, hash); it is replaced as a whole."""
        tree = folders(snapshot)
        tree.repartitionByRange("depth", "parent", "folder").sortWithinPartitions("depth", "parent", "folder").write.mode("overwrite").partitionBy("depth").parquet(f"{self.path}/folders")
        files = snapshot.select("path", "hash", folder_of(F.col("path")).alias("folder"))
        files.repartitionByRange("folder", "path").sortWithinPartitions("folder", "path").write.mode("overwrite").parquet(f"{self.path}/files")
        return self

    @property
    def folders(self) -> DataFrame:
        return self.spark.read.schema("folder string, parent string, files bigint, digest string, depth int").parquet(f"{self.path}/folders")

    @property
    def files(self) -> DataFrame:
        return self.spark.read.schema("path string, hash string, folder string").parquet(f"{self.path}/files")

    def root(self) -> str:
        row = self.folders.where("depth = 0").first()
        return row.digest if row else EMPTY


def _of(rows: DataFrame, column: str, names: list[str] | DataFrame) -> DataFrame:
    """Rows whose column is among names: a filter that reaches the scan for a list, a join for a table."""
    if isinstance(names, list):
        return rows.where(F.col(column).isin(names))
    return rows.join(names.select(F.col("folder").alias(column)).distinct(), column, "left_semi")


def tree_diff(old: StoredTree, new: StoredTree, scratch: str, listed: int = 500) -> tuple[DataFrame, list[dict]]:
    """(path, change) as changes.diff gives, and what was read: folders compared at each depth, and files.

    Folders of a depth are compared only below folders that differ. Up to `listed` names go into filters that the
    Parquet scan uses; more are written below `scratch` and joined."""
    spark, read = old.spark, []
    names: list[str] | DataFrame = [""]
    found: list[list[str] | DataFrame] = []
    depth = 0
    while True:
        sides = [t.folders.where(F.col("depth") == depth) if depth == 0 else _of(t.folders.where(F.col("depth") == depth), "parent", names) for t in (old, new)]
        a, b = (s.select("folder", F.col("digest").alias(n)) for s, n in zip(sides, ("was", "is"), strict=True))
        both = a.join(b, "folder", "full_outer")
        path = f"{scratch.rstrip('/')}/depth-{depth}"
        both.withColumn("differs", ~F.col("was").eqNullSafe(F.col("is"))).write.mode("overwrite").parquet(path)
        level = spark.read.schema("folder string, was string, is string, differs boolean").parquet(path)
        counts = level.agg(F.count("*").alias("n"), F.count(F.when(F.col("differs"), 1)).alias("d")).first()
        read.append({"depth": depth, "folders": counts.n, "differ": counts.d})
        if not counts.d:
            break
        differ = level.where("differs").select("folder")
        names = [r.folder for r in differ.collect()] if counts.d <= listed else differ
        found.append(names)
        depth += 1
    files = [None, None]
    for i, tree in enumerate((old, new)):
        parts = [_of(tree.files, "folder", n) for n in found]
        files[i] = parts[0] if parts else tree.files.where(F.lit(False))
        for p in parts[1:]:
            files[i] = files[i].unionByName(p.select(files[i].columns))
    return changes.diff(files[0].select("path", "hash"), files[1].select("path", "hash")), read
