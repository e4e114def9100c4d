"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `window` consecutive words of the benchmark items (an item of
fewer words is one pattern). Patterns of one length are searched together: the block of the
last two words of the search position looks up a shift table, which skips positions where no
pattern can end; shift 0 selects the patterns of a suffix bucket, and direct comparison of
the words confirms an occurrence. Words hold no state, so the search is one pass without shuffle.

The tables are sent to the executors only within `table_bytes` of benchmark text. A larger
benchmark is dealt into parts of that size, searched one after another, and the hits of each
document are joined.

Defined results: null and empty texts have no words and no hits; items without text or words have no window,
nor have items without an id unless `unnamed` is set, as the query and the pipeline do; repeated rows are each reported; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, discard, id_type, staged
from tessera.llm.textnum import ALNUM, LOWER

_KEEP = bytes(int(LOWER[i]) if ALNUM[LOWER[i]] else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def in_order(items: set[str | None]) -> list[str | None]:
    """Item ids in order; that of rows without an id comes last."""
    return sorted(items - {None}) + [None] * (None in items)


class WuManber:
    """Shift tables and suffix buckets for patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = self._key(words, end)
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.bucket.setdefault(self._key(words, length), []).append((list(words), items))

    def _key(self, words, end: int):
        return (words[end - 2], words[end - 1]) if self.block == 2 else words[end - 1]

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word, items) of every occurrence."""
        length, far, shift, bucket, n = self.length, self.far, self.shift.get, self.bucket, len(words)
        end = length
        if self.block == 1:
            for i, w in enumerate(words):
                for _, items in bucket.get(w, ()):
                    yield i, items
            return
        while end <= n:
            step = shift((words[end - 2], words[end - 1]), far)
            if step:
                end += step
                continue
            start = end - length
            for pattern, items in bucket[(words[end - 2], words[end - 1])]:
                if words[start] == pattern[0] and words[start:end] == pattern:
                    yield start, items
            end += 1


def tables(items: list[tuple[str | None, str | None]], window: int) -> list[WuManber]:
    """One search structure for each pattern length."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(item)
    return [WuManber({w: in_order(i) for w, i in p.items()}, size) for size, p in sorted(by_length.items())]


def find(words: list[bytes], searches: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of occurrences and the items they belong to."""
    spans, items = [], set()
    for s in searches:
        for start, of in s.search(words):
            spans.append((start, start + s.length))
            items.update(of)
    return spans, items


def union_length(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _scan(docs: DataFrame, send: Broadcast, window: int) -> DataFrame:
    """doc_id, copy, n_words, spans and items of each row of docs."""
    kept: list = []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(tables(send.value, window))
        for b in batches:
            texts, n, spans, found = b.column(1), [], [], []
            for i in range(len(texts)):
                words = words_of(texts[i].as_py())
                at, of = find(words, kept[0])
                n.append(len(words))
                spans.append([x for s in at for x in s])
                found.append(in_order(of))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], ["doc_id", "copy", "n_words", "spans", "items"])

    return arrow_map(docs.select("doc_id", "text", "copy"), rows, f"doc_id {id_type(docs)}, copy long, n_words long, spans array<long>, items array<string>")


def benchmark_items(benchmark: DataFrame, unnamed: bool) -> DataFrame:
    """item_id and text of rows with a text, those without an id only if `unnamed`."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    return items if unnamed else items.where("item_id is not null")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, table_bytes: int = 16 << 20, unnamed: bool = False) -> DataFrame:
    """doc_id, n_words, spans (starts and ends in turn) and items (ids) of every row of docs.

    With `unnamed`, benchmark rows without an id are searched like others and count as one item."""
    items = benchmark_items(benchmark, unnamed)
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    docs = docs.select("doc_id", "text", F.lit(0).cast("long").alias("copy"))
    context = docs.sparkSession.sparkContext
    parts = -(-size // table_bytes) or 1
    if parts == 1:
        return _scan(docs, context.broadcast([tuple(r) for r in items.collect()]), window).drop("copy")  # within table_bytes
    docs, found = docs.withColumn("copy", F.xxhash64("text")), []
    for k in range(parts):  # one part of the benchmark is held at a time
        send = context.broadcast([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()])
        found.append(staged(_scan(docs, send, window), "part"))
        send.destroy()
    all_parts = reduce(DataFrame.unionByName, (f.withColumn("part", F.lit(k)) for k, f in enumerate(found)))
    joined = all_parts.groupBy("doc_id", "copy").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.sum(F.when(F.col("part") == 0, 1).otherwise(0)).alias("rows"))
    return joined.withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select("doc_id", "n_words", "spans", "items")


def digest(found: DataFrame) -> DataFrame:
    """The counts and the digest of item ids for each row of contamination()."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, n, sha = [], [], []
            for spans, items in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                hit.append(union_length(list(zip(spans[::2], spans[1::2], strict=True))))
                n.append(len(items))
                sha.append(hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array([h > 0 for h in hit], pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return arrow_map(found, rows, f"doc_id {id_type(found)}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, table_bytes: int = 16 << 20, unnamed: bool = False) -> DataFrame:
    """The rows of docs without any benchmark window, with all their columns: one pass a part, no join."""
    items = benchmark_items(benchmark, unnamed)
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = -(-size // table_bytes) or 1
    at = docs.columns.index("text")
    for k in range(parts):
        before = docs
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        send = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def rows(batches: Iterator[pa.RecordBatch], send=send) -> Iterator[pa.RecordBatch]:
            searches = tables(send.value, window)
            for b in batches:
                texts = b.column(at)
                clean = [not any(True for s in searches for _ in s.search(words)) for words in (words_of(texts[i].as_py()) for i in range(len(texts)))]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = arrow_map(before, rows, docs.schema)
        if parts > 1:  # one part of the benchmark is held at a time
            docs = staged(docs, "part")
            send.destroy()
            if k:
                discard(before)
    return docs


__all__ = ["WuManber", "contamination", "digest", "drop_contaminated", "find", "tables", "union_length", "words_of"]
