"""Collections of vectors: versioned Parquet folders with a header that names what is current.

Rows are dealt to parts by their path (their id, where they have none). The header names the
versions that make up each part, so a change writes the touched parts as a new version, writes the
next header, and leaves the others as they are. Readers see the old or the new state, and a job
that dies leaves only a folder that no header names.

Headers are numbered, and a number can be taken once: of two writers, the second reads what the
first has done and adds to it; where both have rewritten a part, it does its work again.

A collection of the type IVF_PQ has an index (operators.ann): each version has its rows once more by
cell, with codes, and whatever changes the collection adds its rows to it."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import CollectionExists, CollectionNotFound, DimensionMismatch
from tessera.operators import ann, search


class Folder:
    """Small operations on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def names(self, name: str = "") -> list[str]:
        p = self._path(f"{self.root}/{name}" if name else self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def write(self, name: str, text: str, new: bool = False) -> bool:
        """Write a small file; with new, only if there is none."""
        p = self._path(f"{self.root}/{name}")
        try:
            out = self._fs.create(p, not new)
        except Exception as e:
            if new and "exist" in str(e).lower():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


class ConcurrentChange(RuntimeError):
    """Another writer has changed the same rows: nothing has been made visible."""


class ModelChanged(RuntimeError):
    """The index has another model than the one its new rows were made with."""


class Collections:
    """Collections below one root; `parts` is the number of parts of those that are created."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 64):
        self.spark, self.folder, self.parts = spark, Folder(spark, root), parts

    def _latest(self, name: str, tries: int = 20) -> tuple[int, dict]:
        """Number and content of the newest header. One that stays unreadable was left by a writer that died, and is passed over."""
        numbers = sorted((int(n[7:-5]) for n in self.folder.names(name) if n.startswith("header-") and n.endswith(".json")), reverse=True)
        for n in numbers:
            for _ in range(tries):
                try:
                    return numbers[0], json.loads(self.folder.read(f"{name}/header-{n:010d}.json") or "")
                except json.JSONDecodeError:
                    time.sleep(0.1)
        raise CollectionNotFound(name)

    def header(self, name: str) -> dict:
        return self._latest(name)[1]

    def exists(self, name: str) -> bool:
        return any(n.startswith("header-") for n in self.folder.names(name))

    def create(self, name: str, dimensions: int, index_type: str = "FLAT", metric: str = "COSINE") -> None:
        head = {"dimensions": dimensions, "index_type": index_type, "metric": metric, "parts": [[] for _ in range(self.parts)], "index": None}
        if self.exists(name) or not self.folder.write(f"{name}/header-{0:010d}.json", json.dumps(head), new=True):
            raise CollectionExists(name)

    def ensure(self, name: str, dimensions: int) -> None:
        if not self.exists(name):
            self.create(name, dimensions)

    def drop(self, name: str) -> None:
        if not self.exists(name):
            raise CollectionNotFound(name)
        self.folder.delete(name)

    def clear(self, name: str) -> None:
        if self.exists(name):
            self.drop(name)

    def _paths(self, name: str, held: list[list[str]], parts: Iterable[int] | None = None) -> list[str]:
        return [f"{self.folder.root}/{name}/{v}/part={p}" for p, versions in enumerate(held) if parts is None or p in parts for v in versions]

    def scan(self, name: str) -> DataFrame | None:
        """The rows, or None for a collection without any."""
        paths = self._paths(name, self.header(name)["parts"])
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def _part(self, rows: DataFrame, parts: int) -> Column:
        return F.pmod(F.xxhash64(F.col("path" if "path" in rows.columns else "id")), F.lit(parts)).cast("int")

    def _write(self, name: str, rows: DataFrame) -> tuple[str, set[int]]:
        """A new version with rows, and the parts that it has."""
        version, many = f"v-{uuid.uuid4().hex}", len(self.header(name)["parts"])
        rows.withColumn("part", self._part(rows, many)).write.partitionBy("part").parquet(f"{self.folder.root}/{name}/{version}")
        new = {int(n.removeprefix("part=")) for n in self.folder.names(f"{name}/{version}") if n.startswith("part=")}
        if not new:  # no rows
            self.folder.delete(f"{name}/{version}")
        return version, new

    def _commit(self, name: str, change: Callable[[dict], dict], kept: int = 20) -> None:
        """Write the next header: change() of the newest one. Where another writer takes the number first, once more."""
        while True:
            n, head = self._latest(name)
            if self.folder.write(f"{name}/header-{n + 1:010d}.json", json.dumps(change(head)), new=True):
                break
        self.folder.delete(f"{name}/header-{n + 1 - kept:010d}.json")

    def _checked(self, name: str, rows: DataFrame) -> DataFrame:
        dims = self.header(name)["dimensions"]
        wrong = rows.where(F.size("embedding") != dims).select(F.size("embedding").alias("n")).first()
        if wrong is not None:
            raise DimensionMismatch(name, dims, wrong.n)
        return rows

    def _publish(
        self, name: str, version: str, rows: bool, parts: Callable[[dict], list[list[str]]], check: Callable[[], None] = lambda: None
    ) -> None:
        """Make a version part of the collection, with its index rows if there is an index: parts() of the newest header are its parts."""
        while True:
            model = (self.header(name).get("index") or {}).get("model")
            folders = self._index_write(name, self._version_rows(name, version), self._model(name, model)) if model and rows else []
            check()

            def change(head: dict, model=model, folders=folders) -> dict:
                index = head.get("index") or {}
                if index.get("model") != model:  # built or split meanwhile: these index rows are of no use
                    raise ModelChanged(name)
                return head | {"parts": parts(head), "index": index | {"folders": index["folders"] + folders} if model else None}

            try:
                self._commit(name, change)
            except ModelChanged:
                continue
            break
        if not model and rows and self.header(name)["index_type"] == "IVF_PQ":
            self.build_index(name)

    def insert(self, name: str, rows: DataFrame) -> None:
        """Append rows (id, embedding and metadata columns); ids may repeat."""
        version, new = self._write(name, self._checked(name, rows))
        self._publish(name, version, bool(new), lambda head: [[*v, version] if p in new else v for p, v in enumerate(head["parts"])])

    def replace(self, name: str, rows: DataFrame, check: Callable[[], None] = lambda: None) -> None:
        """Write rows as a new version and point the header to it; check() may stop that before anything is visible."""
        version, new = self._write(name, rows)
        self._publish(name, version, bool(new), lambda head: [[version] if p in new else [] for p in range(len(head["parts"]))], check)

    def merge(
        self, name: str, gone: DataFrame, fresh: DataFrame | None = None, key: str = "path", check: Callable[[], None] = lambda: None,
        tries: int = 3
    ) -> list[int]:
        """Drop the rows whose key is in `gone`, add `fresh`, and rewrite only the parts that either touches: their numbers are returned."""
        for i in range(tries):
            try:
                return self._merge(name, gone, fresh, key, check)
            except ConcurrentChange:
                if i == tries - 1:
                    raise

    def _merge(self, name: str, gone: DataFrame, fresh: DataFrame | None, key: str, check: Callable[[], None]) -> list[int]:
        held = self.header(name)["parts"]
        whole = self.scan(name)
        own = key == ("path" if whole is None or "path" in whole.columns else "id")
        if own:
            touched = gone.select(F.pmod(F.xxhash64(key), F.lit(len(held))).cast("int").alias("part"))
        else:  # where a key may lie is found by reading that column
            touched = whole.join(gone.select(key), key, "left_semi").select(self._part(whole, len(held)).alias("part"))
        if fresh is not None:
            touched = touched.unionByName(fresh.select(self._part(fresh, len(held)).alias("part")))
        parts = {r.part for r in touched.distinct().collect()}  # at most as many as the collection has
        paths = self._paths(name, held, parts)
        old = self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None
        rows = None if old is None else old.join(gone.select(key), key, "left_anti")
        rows = fresh if rows is None else rows if fresh is None else rows.unionByName(fresh, allowMissingColumns=True)
        if rows is not None and parts:
            version, new = self._write(name, rows)

            def merged(head: dict) -> list[list[str]]:
                if any(head["parts"][p] != held[p] for p in parts):
                    raise ConcurrentChange(f"{name}: another writer has changed what was merged")
                return [[version] if p in new else [] if p in parts else v for p, v in enumerate(head["parts"])]

            self._publish(name, version, bool(new), merged, check)
        return sorted(parts)

    def delete(self, name: str, ids: list[str] | DataFrame) -> None:
        """Drop the rows with these ids: a list, or a table (id) of any size."""
        gone = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        if self.scan(name) is not None:
            self.merge(name, gone, key="id")

    # ---- index ----

    def _index_write(self, name: str, rows: DataFrame, model: ann.Model) -> list[str]:
        """A new batch of index rows by cell: brought together by cell before, so files follow the cells, not cells times tasks; a large cell is cut."""
        batch = uuid.uuid4().hex
        ann.encode(rows, model).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{self.folder.root}/{name}/index/batch={batch}")
        made = any(n.startswith("cell=") for n in self.folder.names(f"{name}/index/batch={batch}"))
        if not made:
            self.folder.delete(f"{name}/index/batch={batch}")
        return [batch] if made else []

    def _version_rows(self, name: str, version: str) -> DataFrame:
        """Rows of a version as the index has them: contents stay out."""
        rows = self.spark.read.parquet(f"{self.folder.root}/{name}/{version}")
        return rows.drop("content", "keywords").withColumn("version", F.lit(version))

    def _model(self, name: str, folder: str) -> ann.Model:
        return ann.Model.load(self.spark, f"{self.folder.root}/{name}/{folder}")

    def _save_model(self, name: str, model: ann.Model) -> str:
        folder = f"m-{uuid.uuid4().hex}"
        model.save(self.spark, f"{self.folder.root}/{name}/{folder}")
        return folder

    def build_index(self, name: str, cells: int | None = None, sample: int = 20_000, recall: float = 0.95) -> dict:
        """Fit and write the index of all current rows, and find how many cells and exact comparisons reach a recall. Later changes keep it up."""
        head, rows = self.header(name), self.scan(name)
        if rows is None:
            raise LookupError(f"{name}: no rows to index")
        model = ann.fit(rows, head["metric"], cells, sample)
        versions = sorted({v for held in head["parts"] for v in held})
        folders = [f for v in versions for f in self._index_write(name, self._version_rows(name, v), model)]
        index = {"model": self._save_model(name, model), "folders": folders, "probe": 1, "refine": 1}
        live = self._index_table(name, head | {"index": index})
        if live is not None:
            index["probe"], index["refine"] = ann.calibrated(live, model, target=recall)

        def change(now: dict) -> dict:
            if now["parts"] != head["parts"]:
                raise ConcurrentChange(f"{name}: another writer has changed what was indexed")
            return now | {"index": index, "index_type": "IVF_PQ"}

        self._commit(name, change)
        return {"cells": len(model.cells), "probe": index["probe"], "refine": index["refine"]}

    def _index_table(self, name: str, head: dict) -> DataFrame | None:
        """Index rows of the versions and parts that the header names."""
        if not head["index"]["folders"]:
            return None
        base = f"{self.folder.root}/{name}/index"
        reader = self.spark.read.option("basePath", base).option("mergeSchema", "true")
        rows = reader.parquet(*(f"{base}/batch={b}" for b in head["index"]["folders"])).drop("batch")
        pairs = [(v, p) for p, held in enumerate(head["parts"]) for v in held]
        live = self.spark.createDataFrame(pairs, "version string, part int")  # one row a part and version
        return rows.join(F.broadcast(live), ["version", "part"], "left_semi")

    def search(
        self, name: str, queries: DataFrame, k: int = 10, filters: dict | None = None, probe: int | None = None, refine: int | None = None
    ) -> DataFrame:
        """query_id, id, score and rank of the k best rows for each query (query_id, query): by the index where there is one, else of all rows."""
        head = self.header(name)
        if not head.get("index"):
            rows = self.scan(name)
            if rows is None:
                raise LookupError(f"{name}: no rows to search")
            return search.batch_top_k(
                queries, rows.where(search.equality_filter(filters)), k, head["metric"]
            ).select("query_id", "id", "score", "rank")
        model, rows = self._model(name, head["index"]["model"]), self._index_table(name, head)
        if rows is None:
            raise LookupError(f"{name}: no rows to search")
        return ann.search(
            rows.where(search.equality_filter(filters)), model, queries, k, probe or head["index"]["probe"],
            refine or head["index"]["refine"]
        )

    def split_cells(self, name: str, most: int, sample: int = 20_000) -> list[int]:
        """Part the cells of more than `most` rows; only their rows are written anew. Returns their numbers."""
        head = self.header(name)
        model, rows = self._model(name, head["index"]["model"]), self._index_table(name, head)
        if rows is None:
            return []
        parted, over = ann.split_cells(rows.select("id", "embedding", "cell"), model, most, sample)
        if not over:
            return []
        moved = rows.where(F.col("cell").isin(over)).drop("cell", "code", "size")
        folders, saved = self._index_write(name, moved, parted), self._save_model(name, parted)

        def change(now: dict) -> dict:
            if now["index"] != head["index"]:
                raise ConcurrentChange(f"{name}: another writer has changed the index")
            return now | {"index": head["index"] | {"model": saved, "folders": head["index"]["folders"] + folders}}

        self._commit(name, change)
        return over

    def stats(self, name: str) -> dict:
        head, rows = self.header(name), self.scan(name)
        count = rows.count() if rows is not None else 0
        return {
            "count": count, "dimensions": head["dimensions"], "indexed": count > 0, "index_type": head["index_type"],
            "metric_type": head["metric"]
        }

    def vacuum(self, name: str) -> list[str]:
        """Remove parts that the header does not name, and return the versions of which nothing is left."""
        head = self.header(name)
        held, index = head["parts"], head.get("index") or {"folders": [], "model": None}
        for n in self.folder.names(name):
            if n.startswith("m-") and n != index["model"]:
                self.folder.delete(f"{name}/{n}")
        for n in self.folder.names(f"{name}/index"):
            if n.startswith("batch=") and n.removeprefix("batch=") not in index["folders"]:
                self.folder.delete(f"{name}/index/{n}")
        used = {(v, f"part={p}") for p, versions in enumerate(held) for v in versions}
        old = []
        for v in (v for v in self.folder.names(name) if v.startswith("v-")):
            if not any(v == x for x, _ in used):
                self.folder.delete(f"{name}/{v}")
                old.append(v)
                continue
            for part in self.folder.names(f"{name}/{v}"):
                if part.startswith("part=") and (v, part) not in used:
                    self.folder.delete(f"{name}/{v}/{part}")
        return old
