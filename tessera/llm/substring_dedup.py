"""Substring deduplication over a log-structured fingerprint index.

A window is `WINDOW` consecutive words. Its fingerprint is the least hash among its `GRAM`-word
grams (leftmost of equals), so equal windows have equal fingerprints and neighbouring windows
share one: the index holds about one hash for every 15 words, and loses no repeat.

The index is a set of immutable runs in a folder, each bucketed and sorted by hash, with a count
of 1 or 2 (twice or more) and the document of a hash that stands once. A new batch of documents is
merge-joined with the runs of all earlier batches: that nominates its own repeated fingerprints,
and the earlier documents that held them alone so far. Then it becomes a run, and runs of one
level are merge-joined into one of the next when there are `fanout` of them (compaction). A
manifest names the runs, so an index outlives the call. Fingerprints only nominate windows: these
are verified by 96 bits of hash over all their words, and only windows found elsewhere are removed.

A text that is a copy of another, word for word, needs no windows of its own: its copies with
the least key stand for all, and count twice.

Verification needs no list of places: windows are counted with a partial aggregate, and for
those that stay alone the sum carries their document, so hot passages stay cheap.

Defined results: doc_id is an integer; a null text has no words; a text of fewer words than a window loses nothing;
rows that repeat are documents of their own (so their windows repeat); a null doc_id is kept;
other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, discard, new_path, partitions, possible_rows, remove, staged, text_chunks
from tessera.llm.textnum import WORD_BASE, Sequence, Words, covered, mix

WINDOW, GRAM = 35, 6
#: Documents join their fingerprints by this key; a null doc_id shares one with no loss, as keys only nominate.
KEY = "coalesce(doc_id, -9223372036854775808L)"


def window_anchors(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[Sequence, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The word sequence; first word and document of each window; the place of its anchor gram, and the gram's hash at each place."""
    seq = Sequence(words.hashes(), WORD_BASE)
    at, doc = words.window_starts(window)
    n = len(words.starts)
    place = np.arange(max(n - gram + 1, 0))
    grams = seq.spans(place, place + gram)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)
    width, span = 1, window - gram + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    anchor = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    return seq, at, doc, anchor, grams


def whole_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Documents with a window, and a hash of all their words."""
    some = np.flatnonzero(words.n_words >= WINDOW)
    return some, Sequence(words.hashes(), WORD_BASE).spans(words.first[:-1][some], words.first[1:][some])


def fingerprints(docs: DataFrame, batches: int = 1) -> DataFrame:
    """h (fingerprint), k (document key), n (places, at most 2), whole and batch, one row for each document and hash.

    whole: h is the hash of all words of a text that has a window."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            keys, deal = np.asarray(b.column(0)), np.asarray(b.column(2))
            for lo, hi, data, offsets in text_chunks(b):
                words = Words(data, offsets)
                _, _, doc, anchor, grams = window_anchors(words)
                new = np.ones(len(anchor), bool)
                new[1:] = anchor[1:] != anchor[:-1]
                anchor, doc = anchor[new], doc[new]
                order = np.lexsort((grams[anchor], doc))
                h, d = grams[anchor][order], doc[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                n = np.diff(np.append(np.flatnonzero(first), len(h)))
                some, total = whole_hashes(words)
                h = np.concatenate([h[first], total])
                d = np.concatenate([d[first], some]) + lo
                n = np.concatenate([np.minimum(n, 2), np.ones(len(some), np.int64)])
                whole = np.arange(len(h)) >= len(h) - len(some)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[d]), pa.array(n.astype(np.int64)), pa.array(whole), pa.array(deal[d])], ["h", "k", "n", "whole", "batch"])

    docs = docs.select(F.expr(KEY).alias("k"), "text")
    return arrow_map(docs.withColumn("batch", F.pmod(F.xxhash64("k"), F.lit(batches)).cast("int")), rows, "h long, k long, n long, whole boolean, batch int")


class FingerprintLog:
    """An index of fingerprints: immutable runs of (h, n, k) in one folder, named by a manifest.

    A run is bucketed and sorted by h, one file a bucket, so joins with it and between runs are merge joins that
    neither shuffle nor sort it. n is 1 or 2 (twice or more); k is the document of a hash that stands once. The
    manifest is replaced after each step, so an index can be opened again, by another application too; a run
    that no manifest names is left over from a failed step and plays no part."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, fanout: int = 2):
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout
        self.asked: list[DataFrame] = []  # staged answers of append()
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        known = sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(self.root)) if f.getPath().getName().startswith("manifest-")) if self._fs.exists(self._path(self.root)) else []
        self.version = int(known[-1].split("-")[1]) if known else 0
        if known:
            found = json.loads(spark.read.text(f"{self.root}/{known[-1]}", wholetext=True).first()[0])
            self.buckets, self.levels = found["buckets"], found["levels"]
        else:
            self.buckets, self.levels = buckets or partitions(spark), []

    def _save(self) -> None:
        """The next manifest, whole or not at all."""
        self.version += 1
        name = f"manifest-{self.version:010d}"
        out = self._fs.create(self._path(f"{self.root}/.{name}"), True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "levels": self.levels}).encode()))
        out.close()
        self._fs.rename(self._path(f"{self.root}/.{name}"), self._path(f"{self.root}/{name}"))

    def _table(self, run: str) -> DataFrame:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {run} (h BIGINT, n INT, k BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{run}'")
        return self.spark.table(run).hint("merge")

    def _write(self, counts: DataFrame) -> str:
        """A run of rows that are in partitions by bucket."""
        run = f"run_{uuid.uuid4().hex}"
        counts.select("h", "n", "k").write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.root}/{run}").saveAsTable(run)
        return run

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def append(self, batch: DataFrame) -> DataFrame:
        """Add a batch of (h, k, n); return (h, k): its hashes that repeat, and for those that stood once in older runs their document.

        The batch's counts are merge-joined with every older run first, then become a run themselves; levels with `fanout` runs are compacted."""
        counts = batch.groupBy("h").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), F.min("k").alias("k"))
        run = self._write(counts.repartition(self.buckets, "h"))
        found = self._table(run).select("h", F.col("n").alias("all"), F.lit(0).alias("old"), F.lit(None).cast("long").alias("owner"))
        for older in self.runs():
            past = self._table(older).select("h", F.col("n").alias("m"), F.col("k").alias("of"))
            found = found.join(past, "h", "left").select("h", (F.col("all") + F.coalesce("m", F.lit(0))).alias("all"), (F.col("old") + F.coalesce("m", F.lit(0))).alias("old"), F.coalesce("owner", "of").alias("owner"))
        again = staged(found.where("all > 1").select("h", F.when(F.col("old") == 1, F.col("owner")).alias("owner")), "again")
        self.asked.append(again)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        self._save()
        self.compact()
        return batch.join(again.select("h"), "h").select("h", "k").unionByName(again.where("owner is not null").select("h", F.col("owner").alias("k")))

    def compact(self) -> None:
        """Runs of a full level become one run of the next, by merge joins of sorted runs."""
        level = 0
        while level < len(self.levels):
            old = self.levels[level]
            if len(old) >= self.fanout:
                merged = self._table(old[0]).select("h", "n", "k")
                for run in old[1:]:
                    other = self._table(run).select("h", F.col("n").alias("m"), F.col("k").alias("of"))
                    total = F.least(F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)), F.lit(2)).alias("n")
                    merged = merged.join(other, "h", "full").select("h", total, F.least("k", "of").alias("k"))
                new = self._write(merged)
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level] = []
                self.levels[level + 1].append(new)
                self._save()
                for run in old:
                    self.spark.sql(f"DROP TABLE IF EXISTS {run}")
                    remove(self.spark, f"{self.root}/{run}")
            level += 1

    def drop(self) -> None:
        """Remove the index."""
        for run in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        remove(self.spark, self.root)
        self.levels = []


def nominations(found: list[DataFrame]) -> DataFrame:
    """k and the array of its repeated hashes, from what the batches of a log returned."""
    return reduce(DataFrame.unionByName, found).groupBy("k").agg(F.collect_set("h").alias("dup"))


def _nominated(words: Words, dup: list, lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Sequence]:
    """Windows (first words, documents) whose anchors are in their document's list, and their hash w."""
    seq, at, doc, anchor, grams = window_anchors(words)
    size = np.array([0 if d is None else len(d) for d in dup], np.int64)
    known = np.concatenate([d for d in dup if d is not None and len(d)]).view(np.uint64) if size.any() else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(size)), size)
    have = np.sort(mix(known ^ mix(of.astype(np.uint64))))
    ask = mix(grams[anchor] ^ mix(doc.astype(np.uint64)))
    i = np.minimum(np.searchsorted(have, ask), max(len(have) - 1, 0))
    yes = (have[i] == ask) if len(have) else np.zeros(len(ask), bool)
    at, doc = at[yes], doc[yes]
    return at, doc, seq.spans(at, at + WINDOW), seq


def _lists(column: pa.Array) -> list:
    return [None if x is None else np.array(x, np.int64) for x in column.to_pylist()]


def lone_windows(docs: DataFrame) -> DataFrame:
    """k and w of nominated windows that stand nowhere else. docs: k, doc_id, text, dup, stands (the least key) of its copies."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            b = b.filter(b.column(2).is_valid())
            keys = np.asarray(b.column(0))
            for lo, hi, data, offsets in text_chunks(b):
                words = Words(data, offsets)
                at, doc, w, seq = _nominated(words, _lists(b.column(2).slice(lo, hi - lo)), lo)
                some, total = whole_hashes(words)
                role = np.ones(hi - lo, np.int64)  # times that a window counts: 0 for copies, 2 for the one that stands for them
                copies = b.column(3).slice(lo, hi - lo).to_pylist()
                for i, h in zip(some.tolist(), total.view(np.int64).tolist(), strict=True):
                    for c in copies[i] or ():
                        if c["h"] == h:
                            role[i] = 2 if c["stands"] else 0
                use = role[doc] > 0
                at, doc, w = at[use], doc[use], w[use]
                uniq, first, count = np.unique(w, return_index=True, return_counts=True)
                count = np.maximum(count, role[doc[first]])
                second = mix((seq.spans(at[first], at[first] + 17) << np.uint64(1)) ^ seq.spans(at[first] + 17, at[first] + WINDOW)) >> np.uint64(33)
                yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(second.astype(np.int32)), pa.array(np.minimum(count, 2).astype(np.int32)), pa.array(keys[doc[first] + lo])], ["w", "x", "n", "k"])

    found = arrow_map(docs.select("k", "text", "dup", "copies"), rows, "w long, x int, n int, k long")
    return found.groupBy("w", "x").agg(F.sum("n").alias("n"), F.min("k").alias("k")).where("n = 1").select("k", "w")


def removed_words(docs: DataFrame, batches: int = 2) -> DataFrame:
    """k, doc_id, text, dup and lone of every row: what mark() needs to remove repeated windows."""
    spark = docs.sparkSession
    prints = staged(fingerprints(docs, batches), "fingerprints")
    log = FingerprintLog(spark, new_path(spark, "log"))
    found = [log.append(prints.where((F.col("batch") == i) & ~F.col("whole")).select("h", "k", "n")) for i in range(batches)]
    whole = prints.where("whole")
    stands = staged(whole.groupBy("h").agg(F.min("k").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "copies")
    copies = whole.join(stands, "h").groupBy("k").agg(F.collect_set(F.struct("h", (F.col("k") == F.col("least")).alias("stands"))).alias("copies"))
    dup = staged(nominations(found).join(copies, "k", "left"), "repeated")
    log.drop()
    discard(prints, stands, *log.asked)
    keyed = docs.select(F.expr(KEY).alias("k"), "doc_id", "text")
    lone = lone_windows(possible_rows(keyed.select("k", "text"), dup, "k").join(dup, "k")).groupBy("k").agg(F.collect_list("w").alias("lone"))
    marks = staged(dup.join(lone, "k", "left").select("k", "dup", "lone"), "marks")
    discard(dup)
    return keyed.join(marks, "k", "left")


def mark(b: pa.RecordBatch, text: int, dup: int, lone: int) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """For each chunk of a batch: its rows, words, and which words a repeated window covers."""
    data_name = b.schema.names[text]
    for lo, hi, data, offsets in text_chunks(b, data_name):
        words = Words(data, offsets)
        at, doc, w, _ = _nominated(words, _lists(b.column(dup).slice(lo, hi - lo)), lo)
        alone = _lists(b.column(lone).slice(lo, hi - lo))
        size = np.array([0 if d is None else len(d) for d in alone], np.int64)
        if size.any():
            have = np.sort(mix(np.concatenate([d for d in alone if d is not None]).view(np.uint64) ^ mix(np.repeat(np.arange(len(size)), size).astype(np.uint64))))
            ask = mix(w ^ mix(doc.astype(np.uint64)))
            at = at[have[np.minimum(np.searchsorted(have, ask), len(have) - 1)] != ask]
        yield lo, hi, words, covered(len(words.starts), at, WINDOW)


def kept_text(words: Words, gone: np.ndarray, i: int) -> bytes:
    """The kept words of document i, joined by one space."""
    a, b = words.first[i], words.first[i + 1]
    raw = words.data
    keep = np.flatnonzero(~gone[a:b]) + a
    return b" ".join([raw[s:e].tobytes() for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)])


def dedup_digest(docs: DataFrame, batches: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every row."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for lo, hi, words, gone in mark(b, 1, 2, 3):
                sha = [hashlib.sha256(kept_text(words, gone, i)).hexdigest() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(words.n_words.astype(np.int64)), pa.array(words.per_doc_words(gone)), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return arrow_map(removed_words(docs, batches).select("doc_id", "text", "dup", "lone"), rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_text(docs: DataFrame, batches: int = 2) -> DataFrame:
    """doc_id and the text of kept words of every row."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for lo, hi, words, gone in mark(b, 1, 2, 3):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([kept_text(words, gone, i).decode() for i in range(hi - lo)], pa.string())], ["doc_id", "text"])

    return arrow_map(removed_words(docs, batches).select("doc_id", "text", "dup", "lone"), rows, "doc_id long, text string")
