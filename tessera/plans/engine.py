"""The engine: index, search, status, reindex, onboard, reset and clear over one project."""

from __future__ import annotations

import json
import os
import socket
import threading
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import errors
from tessera.functions import text as T
from tessera.functions.vectors import hash_embed
from tessera.operators import changes, chunking, search, stats
from tessera.operators.embedding import content_key, embed_requests, hash_model, missing
from tessera.plans import config as configs
from tessera.plans import gitstate, logs, providers
from tessera.session import work_dir
from tessera.sources import files
from tessera.sources.collections import Collections, Folder

LOG = logs.logger("engine")
VECTORS = "hash string, embedding array<float>"


def embed_with(
    df: DataFrame, model: Callable[[Sequence[str]], Sequence], text: str = "content", batch: int = 32, tries: int = 3, wait: float = 1.0,
    text_tokens: int | None = None
) -> DataFrame:
    """df with embedding and error: a request that keeps failing has null vectors and its error, the others go on.

    Texts of any length are sent, unless `text_tokens` says what the model takes."""
    return embed_requests(df, model, text, batch, text_tokens=text_tokens, tries=tries, wait=wait).drop("request", "place", "together")


class Lock:
    """One writer at a time, on any host of a shared store.

    A lock names its host, process, job group and the end of its lease, which the holder moves on while it works. It
    is taken over if its lease has ended, or its process has ended on this very host; with force, from anyone."""

    def __init__(self, folder: Folder, name: str = "engine.lock", lease: float = 600.0):
        self.folder, self.name, self.lease = folder, name, lease
        self.token = uuid.uuid4().hex
        self._stop = threading.Event()

    def info(self) -> dict | None:
        text = self.folder.read(self.name)
        return json.loads(text) if text else None

    def held(self) -> bool:
        """Whether this lock is still ours."""
        return (self.info() or {}).get("token") == self.token

    def _stale(self, held: dict) -> bool:
        if time.time() > held.get("until", float("inf")):
            return True
        if held.get("host", socket.gethostname()) != socket.gethostname():
            return False
        try:
            os.kill(held["pid"], 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            pass
        return False

    def _text(self, operation: str, group: str, since: float) -> str:
        return json.dumps({
            "host": socket.gethostname(), "pid": os.getpid(), "token": self.token, "group": group, "operation": operation, "since": since,
            "until": time.time() + self.lease
        })

    def _renew(self, operation: str, group: str, since: float) -> None:
        while not self._stop.wait(self.lease / 3):
            if not self.held():
                return
            self.folder.write(self.name, self._text(operation, group, since))

    def acquire(self, operation: str = "index", force: bool = False, group: str = "") -> bool:
        since = time.time()
        mine = self._text(operation, group, since)
        if not self.folder.write(self.name, mine, new=True):
            held = self.info()
            if held is not None and not force and not self._stale(held):
                return False
            self.folder.delete(self.name)
            if not self.folder.write(self.name, mine, new=True):
                return False
        self._stop.clear()
        threading.Thread(target=self._renew, args=(operation, group, since), daemon=True).start()
        return True

    def release(self, force: bool = False) -> None:
        """Give up our lock; with force, anyone's."""
        self._stop.set()
        if force or self.held():
            self.folder.delete(self.name)


class Engine:
    """Operations of one project: sources below `root`, tables below `store`.

    Sources may be a table instead, `sources` (path, content, and size and last_modified if known): it is selected by the
    same globs, languages and sizes, and may be set anew before a reindex. Contents that have been embedded are not
    embedded again."""

    def __init__(
        self, spark: SparkSession, root: str, store: str, config: dict | None = None, dims: int = 64, model: Callable | None = None,
        collection: str | None = None, distinct_strategies: bool = False, sources: DataFrame | None = None
    ):
        self.spark, self.root, self.dims, self.model, self.distinct, self.sources = spark, root, dims, model, distinct_strategies, sources
        self.config = config or configs.load()
        self.collections, self.folder = Collections(spark, store), Folder(spark, store)
        self.name = collection or self.config["vectordb"]["collectionName"]
        self.lock = Lock(self.folder)

    def discover(self) -> DataFrame:
        c = self.config
        languages = {k: v["extensions"] for k, v in c["indexing"]["languageConfig"].items()}
        if self.sources is not None:
            known = {"size": F.octet_length("content").cast("long"), "last_modified": F.lit(None).cast("timestamp")}
            rows = self.sources.select("path", *(F.col(k) if k in self.sources.columns else v.alias(k) for k, v in known.items()), "content")
            return files.selected(
                files.described(rows, languages), c["indexing"]["include"], c["indexing"]["exclude"],
                max_bytes=files.parse_size(c["performance"]["maxFileSize"])
            )
        ignored = Folder(self.spark, self.root).read(".gitignore") or ""
        return files.discover(
            self.spark, self.root, c["indexing"]["include"], c["indexing"]["exclude"], c["performance"]["maxFileSize"], languages, ignored
        )

    def chunks(self, found: DataFrame) -> DataFrame:
        """Embedded chunks of files."""
        return self._embedded(self._cut(found))

    def _cut(self, found: DataFrame) -> DataFrame:
        """Chunks of files with the hash of their content and of their file, written, as they are read more than once: files are read
        once. A file without chunks has one row, whose seq is null."""
        c, path = self.config["indexing"], f"{work_dir(self.spark, 'chunks')}/chunks"
        strategy, found = c["chunkingStrategy"], found.select("path", "language", "last_modified", "content")
        if self.distinct and strategy == "sliding-window":
            out = chunking.chunks_by(strategy, found, found, c["maxChunkSize"], c["overlap"], True)
            rows = changes.snapshot(found).withColumnRenamed("hash", "file_hash").join(out, "path", "left")
        else:
            whole = self.distinct and strategy == "ast-extract"
            rows = chunking.source_chunks(found, 1 << 30 if whole else c["maxChunkSize"], not whole)
            rows = chunking.stored_chunks(rows, strategy, "file_hash")
        rows = rows.withColumn("hash", content_key(F.col("content")))
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _embedded(self, cut: DataFrame) -> DataFrame:
        """Chunks with the vectors of their contents: those that the store has, and new ones, which it keeps."""
        model, settings = self.model or hash_model(self.dims), self.config["embedding"]
        chunks = cut.where("seq is not null").drop("file_hash")
        cache = f"{self.folder.root}/vectors-{self.name}"
        known = self.spark.read.schema(VECTORS).parquet(cache) if self.folder.exists(f"vectors-{self.name}") else None
        asked = missing(chunks.select("hash", "content", "token_count"), known)
        # the offline embedder waits for no server: requests side by side would only contend for the interpreter
        pace = {"max_texts": settings["batchSize"]} if self.model else {"max_texts": max(settings["batchSize"], 512), "in_flight": 1}
        new = embed_requests(asked, model, tokens="token_count", **pace)
        new.where("embedding is not null").select("hash", "embedding").write.mode("append").parquet(cache)
        return chunks.join(self.spark.read.schema(VECTORS).parquet(cache), "hash").drop("hash")

    def _snapshot(self) -> DataFrame | None:
        name = self.folder.read("snapshot")
        return self.spark.read.parquet(f"{self.folder.root}/{name}") if name else None

    def _write_snapshot(self, snapshot: DataFrame) -> tuple[str, DataFrame]:
        """The (path, hash) of all files, written; it becomes the current one with _keep_snapshot."""
        name = f"snapshot-{uuid.uuid4().hex}"
        snapshot.write.parquet(f"{self.folder.root}/{name}")
        return name, self.spark.read.schema("path string, hash string").parquet(f"{self.folder.root}/{name}")

    def _keep_snapshot(self, name: str) -> None:
        self.folder.write("snapshot", name)
        state = gitstate.current(self._local_root()) if self._local_root() else None
        if state:
            gitstate.save(self.folder, state)

    def _local_root(self) -> str | None:
        """The project's folder, where the driver can see it."""
        path = self.root.removeprefix("file://")
        return path if path.startswith("/") and os.path.isdir(path) else None

    def _locked(self, operation: str, work: Callable, force: bool = False):
        """work() as the one writer. With force, a running one is cancelled: its jobs if they are this application's, its commit in any case."""
        group = f"{operation}-{uuid.uuid4().hex}"
        held = self.lock.info() if force else None
        if not self.lock.acquire(operation, force, group):
            raise RuntimeError(f"locked: {self.lock.info()}")
        if held and held.get("group"):
            LOG.warning("preempted", extra={"data": held})
            self.spark.sparkContext.cancelJobGroup(held["group"])
        self.spark.sparkContext.setJobGroup(group, operation)
        LOG.info(operation, extra={"data": {"root": self.root, "collection": self.name}})
        try:
            return work()
        finally:
            self.lock.release()

    def _still_ours(self) -> None:
        if not self.lock.held():
            raise errors.Preempted("another writer has taken over", operation="index")

    def index(self) -> dict:
        """Index all files anew."""

        def work() -> dict:
            found = self.discover()
            self.collections.ensure(self.name, self.dims)
            cut = self._cut(found)
            first = cut.where("coalesce(seq, 0) = 0")  # one row a file
            snapshot, rows = self._write_snapshot(first.select("path", F.col("file_hash").alias("hash")))
            self.collections.replace(self.name, self._embedded(cut), self._still_ours)
            self._keep_snapshot(snapshot)
            table = self.collections.scan(self.name)
            n = 0 if table is None else table.count()
            return {"files": rows.count(), "chunks": n, "success": n > 0}

        return self._locked("index", work)

    def reindex(self, paths: list[str] | None = None, force: bool = False) -> dict:
        """Index what has changed since the last snapshot, or the given paths: only parts of the collection that hold a changed file are written."""

        def work() -> dict:
            found = self.discover()
            snapshot, now = self._write_snapshot(changes.snapshot(found))
            change = changes.diff(self._snapshot(), now)
            if paths is not None:
                named = self.spark.createDataFrame([(p,) for p in paths], "path string")
                here = now.select("path", F.lit(True).alias("here"))
                change = named.join(here, "path", "left").select("path", F.when(F.col("here"), "modified").otherwise("deleted").alias("change"))
            staged = f"{work_dir(self.spark, 'changes')}/changes"
            change.write.parquet(staged)  # read for its counts, the files to read and the rows to drop: where few changed, they are broadcast
            change = self.spark.read.schema("path string, change string").parquet(staged)
            counts = changes.change_counts(change).first().asDict()
            if sum(counts[k] for k in ("added", "modified", "deleted")):
                self.collections.ensure(self.name, self.dims)
                fresh = self.chunks(found.join(change.where("change <> 'deleted'").select("path"), "path", "left_semi"))
                self.collections.merge(self.name, change.select("path"), fresh, check=self._still_ours)
                self._keep_snapshot(snapshot)
            return counts

        return self._locked("reindex", work, force)

    def git_changes(self) -> tuple[bool, list[str]]:
        """Whether the project's branch or commit differ from those of the last index, and the paths that do."""
        root = self._local_root()
        return gitstate.changed_since(root, gitstate.load(self.folder)) if root else (False, [])

    def health(self) -> dict[str, bool]:
        """Whether sources and collection can be read, and an embedder answers."""
        table = lambda: self.collections.scan(self.name)
        return {
            "sources": providers.healthy(lambda: Folder(self.spark, self.root).names()),
            "collection": providers.healthy(lambda: table() is None or table().schema["embedding"]),
            "embedder": providers.healthy(lambda: self._vector(["health"])[0])
        }

    def _vector(self, texts: list[str]) -> list[list[float]]:
        if self.model is not None:
            return self.model(texts)
        rows = hash_embed(self.spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t", self.dims).collect()
        return [list(r.embedding) for r in sorted(rows, key=lambda r: r.i)]

    def search(
        self, query: str, max_results: int | None = None, min_score: float | None = None, language: str | None = None,
        path_pattern: str | None = None, result_format: str | None = None
    ) -> DataFrame:
        """The ranked results of the first rung of the ladder that has any. 0 counts as not given."""
        s = self.config["search"]
        k, least, form = max_results or s["maxResults"], min_score or s["minScore"], result_format or s["resultFormat"]
        rungs = search.passes(T.preprocess_query(query), least)
        table = self.spark.createDataFrame(
            [(0, p, t, m, v) for (p, t, m), v in zip(rungs, self._vector([t for _, t, _ in rungs]), strict=True)],
            "query_id int, pass int, text string, min_score double, query array<double>"
        )
        rows = self.collections.scan(self.name)
        if rows is None:
            raise LookupError("the collection is empty")
        details = rows.drop("embedding")
        hits = search.search_ladder(
            rows.select("id", "language", "embedding"), table, k, {"language": language} if language else None, path_pattern,
            strategy=s["strategy"], details=details
        )
        return search.formatted(hits, form).orderBy("rank")

    def status(self) -> dict:
        return self.collections.stats(self.name) if self.collections.exists(self.name) else {"count": 0, "indexed": False}

    def onboard(self, name: str) -> dict:
        """A configuration made for the project's size and languages."""
        listing = files.described(self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root).select("path", F.col("length").alias("size")))
        sample = files.sample_files(listing).select("path", "language")
        row = sample.agg(
            F.count("*").alias("n"), F.collect_set("language").alias("languages")
        ).select("*", stats.project_size(F.col("n")).alias("size")).first()
        return configs.for_project({
            "name": name, "size": row["size"], "languages": sorted(row["languages"]),
            "primary_language": stats.primary_language(sample).first()[0]
        })

    def reset(self) -> list[str]:
        """Drop the lock and versions that nothing names."""
        self.lock.release(force=True)
        gone = self.collections.vacuum(self.name) if self.collections.exists(self.name) else []
        current = self.folder.read("snapshot")
        for n in self.folder.names():
            if n.startswith("snapshot-") and n != current:
                self.folder.delete(n)
                gone.append(n)
        return gone

    def clear(self, confirm: bool = False) -> None:
        if not confirm:
            raise ValueError("confirm is needed")
        self.collections.clear(self.name)
        self.folder.delete(f"vectors-{self.name}")
        self.folder.delete("snapshot")
