"""Line deduplication by a deletion-neighbourhood join.

A line is its words; lines without words are left alone. A line goes if an earlier line (by
doc_id, then line number) has the same words, or, where both have at least `least` words (a
parameter, 8 unless given), is within an edit distance of one word. Shorter lines are compared
exactly: one word of seven is another statement more often than a variant. Removed lines count as
earlier lines too.

Equal lines are collapsed by hash. Each distinct line then emits the hashes of its variants
with one word deleted: two lines are within one edit exactly if they share a variant with the
same word deleted (replacement), or one is a variant of the other (insertion). The earliest
member of each variant's group is a minimum, so a group is never listed, whatever its size.
The pair of a line and its earliest neighbour is verified on the words themselves.

A line enters the neighbourhood join only if another distinct line shares its first or last half:
one edit lies in one half and leaves the other, so no pair is lost, and most lines emit
nothing. A line of n words has the halves of n // 2 and of (n - 1) // 2 words, the latter for a
partner that is one word shorter.

Defined results: null and empty texts have no lines with words; a null doc_id is before all
others; rows that repeat a doc_id are one document to the order, so equal lines at the same
place of such rows stay; other columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, bit_table, may_hold, staged, text_chunks
from tessera.llm.textnum import WORD_BASE, Sequence, Words, lines, mix

#: Words from which a line may be a near copy.
LEAST = 8
KEY = "coalesce(doc_id, -9223372036854775808L)"
SPAN = np.uint64(0x632BE59BD9B4E019)


class Lines:
    """Lines with words of a chunk: document, number, first word and one past the last, hash."""

    def __init__(self, words: Words):
        start, end, doc, count = lines(words)
        real = count > 0
        begin = np.searchsorted(doc, np.arange(len(words.n_words)))
        self.per_doc = np.bincount(doc, minlength=len(words.n_words))
        self.doc, self.number = doc[real], (np.arange(len(doc)) - begin[doc])[real]
        self.a = np.searchsorted(words.starts, start[real])
        self.b = self.a + count[real]
        self.bytes = (start[real], end[real])
        self.word = words.hashes()
        self.seq = Sequence(self.word, WORD_BASE)
        self.h = self.seq.spans(self.a, self.b)

    def halves(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Four keys for each line: its first and last n // 2 words, and (n - 1) // 2 words where that is less; and which count."""
        n = self.b - self.a
        keys, counts = np.empty((4, len(n)), np.uint64), np.empty((4, len(n)), bool)
        for g, size in enumerate((n // 2, n // 2, (n - 1) // 2, (n - 1) // 2)):
            last = g % 2 == 1
            keys[g] = self.seq.spans(self.b - size, self.b) ^ SPAN if last else self.seq.spans(self.a, self.a + size)
            counts[g] = (n >= least) & ((g < 2) | (n % 2 == 0))
        return keys, counts

    def variants(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each line in `of` and each of its words: the line, the word's place, the hash of the line without it."""
        n = self.b[of] - self.a[of]
        line = np.repeat(of, n)
        j = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        a, b, cut = self.a[line], self.b[line], self.a[line] + j
        s, down = self.seq.sums, self.seq.down
        left = (s[cut] - s[a]) * down[a]
        right = (s[b] - s[cut + 1]) * down[a + 1]
        return line, j, mix(left + right + (b - a - 1).astype(np.uint64))


def line_table(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """row, doc_id, i, h, n and keys s of halves (lines of `least` words or more); one row with i = -1 a document, whose n is its count of lines."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for lo, hi, data, offsets in text_chunks(b):
                x = Lines(Words(data, offsets))
                many = hi - lo
                at = pa.array(np.concatenate([np.arange(lo, hi), x.doc + lo]))
                s, counts = x.halves(least)
                null = np.concatenate([np.ones((4, many), bool), ~counts], axis=1)
                pad = lambda v: np.concatenate([np.zeros(many, v.dtype), v])
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate([np.full(many, -1), x.number]).astype(np.int32)), pa.array(pad(x.h.view(np.int64))),
                    pa.array(np.concatenate([x.per_doc, x.b - x.a]).astype(np.int32)), *(pa.array(pad(s[g].view(np.int64)), mask=null[g]) for g in range(4))],
                    ["row", "doc_id", "i", "h", "n", "s0", "s1", "s2", "s3"])

    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return arrow_map(docs, rows, "row long, doc_id long, i int, h long, n int, s0 long, s1 long, s2 long, s3 long")


def wanted_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (h, k, i, flags) with each line's text: documents send only lines whose hash may be wanted."""
    send = bit_table(wanted, F.col("h"), 26)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            keys = np.asarray(b.column(0))
            for lo, _, data, offsets in text_chunks(b):
                x = Lines(Words(data, offsets))
                of = np.flatnonzero(may_hold(send.value, x.h))
                text = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(x.bytes[0][of].tolist(), x.bytes[1][of].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x.h[of].view(np.int64)), pa.array(keys[x.doc[of] + lo]), pa.array(x.number[of].astype(np.int32)), pa.array(text, pa.string())], ["h", "k", "i", "text"])

    found = arrow_map(docs.select(F.expr(KEY).alias("k"), "text"), rows, "h long, k long, i int, text string")
    return found.join(wanted.hint("merge"), ["h", "k", "i"])


#: What the sharing of halves tells about a line: its edit may be in the last half, in the first, its partner may be longer or shorter.
LAST, FIRST, LENGTH = 1, 2, 4


def variant_table(found: DataFrame) -> DataFrame:
    """key, role, h, k, i and (once a line) its text, for lines (h, k, i, text, flags).

    role 0: a variant with its deleted place; 1: the whole line; 2: a variant without place."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            h, k, i, flags = (np.asarray(b.column(c)) for c in (0, 1, 2, 4))
            for lo, hi, data, offsets in text_chunks(b):
                x = Lines(Words(data, offsets))  # each text is one line
                line, j, v = x.variants(np.arange(hi - lo))
                n, flag = (x.b - x.a)[line], flags[lo:hi][line]
                half = (n - 1) // 2
                use = ((flag & LAST) > 0) & (j >= half) | ((flag & FIRST) > 0) & (j < n - half)
                line, j, v, n, flag = line[use], j[use], v[use], n[use].astype(np.uint64), flag[use]
                placed = mix(v ^ mix((j.astype(np.uint64) << np.uint64(32)) | n)) ^ SPAN
                free = (flag & LENGTH) > 0
                src = np.concatenate([line, np.arange(hi - lo), line[free]])
                roles = np.repeat(np.array([0, 1, 2], np.int32), [len(line), hi - lo, int(free.sum())])
                texts = pa.concat_arrays([pa.nulls(len(line), pa.string()), b.column(3).slice(lo, hi - lo), pa.nulls(int(free.sum()), pa.string())])
                src_row = src + lo
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([placed, x.h, v[free]]).view(np.int64)), pa.array(roles), pa.array(h[src_row]), pa.array(k[src_row]), pa.array(i[src_row]), texts], ["key", "role", "h", "k", "i", "text"])

    return arrow_map(found.select("h", "k", "i", "text", "flags"), rows, "key long, role int, h long, k long, i int, text string")


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether the edit distance of two word lists is at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def neighbours(docs: DataFrame, real: DataFrame, distinct: DataFrame) -> DataFrame:
    """h and its earliest neighbour's place (k, i) for distinct lines (h, k, i) that have an earlier one."""
    halves = real.where("s0 is not null").select("h", "n", F.posexplode(F.array("s0", "s1", "s2", "s3")).alias("g", "s")).where("s is not null")
    shared = halves.groupBy("s").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("n").alias("short"), F.max("n").alias("long")).where("a <> b")
    shared = staged(shared.select("s", F.when(F.col("short") < F.col("long"), LENGTH).otherwise(0).alias("flag")), "halves")
    flag = F.when(F.col("g") % 2 == 0, LAST).otherwise(FIRST).bitwiseOR(F.col("flag"))
    alike = staged(halves.join(shared.hint("merge"), "s").groupBy("h").agg(F.bit_or(flag).alias("flags")), "alike")
    wanted = staged(distinct.select("h", "k", "i").join(alike, "h"), "wanted")
    table = staged(variant_table(wanted_lines(docs, wanted)), "variants")
    place = F.struct("k", "i", "h")
    least = lambda role: F.min(F.when(F.col("role") == role, place))
    groups = table.groupBy("key").agg(least(0).alias("m0"), least(1).alias("m1"), least(2).alias("m2"), F.count("*").alias("members"))
    groups = staged(groups.where("members > 1 and (m0 is not null or (m1 is not null and m2 is not null))").drop("members"), "groups")
    best = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    found = table.drop("text").join(groups, "key").withColumn("best", best)
    found = found.where(F.col("best").isNotNull() & (F.struct(F.col("best.k"), F.col("best.i")) < F.struct("k", "i")))
    pairs = found.groupBy("h").agg(F.min("best").alias("best"))
    text = table.where("role = 1").select("h", "text")
    both = pairs.join(text, "h").select("h", F.col("best.k").alias("k"), F.col("best.i").alias("i"), F.col("best.h").alias("other"), F.col("text").alias("mine"))
    both = both.join(text.withColumnRenamed("h", "other").withColumnRenamed("text", "theirs"), "other")

    def verified(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            good = [within_one(x.encode().split(), y.encode().split()) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield b.select(["h", "k", "i"]).filter(pa.array(good, pa.bool_()))

    return arrow_map(both.select("h", "k", "i", "mine", "theirs"), verified, "h long, k long, i int")


def removed_lines(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The staged table of lines, and the lines to remove (row, k, i, h)."""
    table = staged(line_table(docs, least), "lines")
    real = table.where("i >= 0").withColumn("k", F.expr(KEY))
    distinct = real.groupBy("h").agg(F.min(F.struct("k", "i")).alias("first"), F.count("*").alias("places"))
    distinct = staged(distinct.select("h", "first.k", "first.i", (F.col("places") > 1).alias("again")), "distinct")
    near = neighbours(docs, real, distinct).select("h", F.struct("k", "i").alias("near"))
    rule = distinct.join(near, "h", "left").where("again or near is not null")
    rule = staged(rule.select("h", F.least(F.struct("k", "i"), F.coalesce("near", F.struct("k", "i"))).alias("from")), "rule")
    gone = real.select("row", "k", "i", "h").join(rule, "h").where(F.struct("k", "i") > F.col("from"))
    return table, gone.select("row", "k", "i", "h")


def dedup_digest(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_removed and the removed line numbers (from 0, comma-joined) of every row."""
    table, gone = removed_lines(docs, least)
    all_rows = table.where("i = -1").select("row", "doc_id", F.col("n").alias("n_lines"), F.lit(None).cast("int").alias("i"))
    both = all_rows.unionByName(gone.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("n_lines"), "i"))
    out = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_lines").cast("long").alias("n_lines"), F.array_sort(F.collect_list("i")).alias("gone"))
    return out.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.transform("gone", lambda x: x.cast("string")), ",").alias("removed_lines"))


def dedup_documents(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs with their lines removed from text (and n_chars counted anew); a row that loses all its words goes."""
    _, gone = removed_lines(docs, least)
    # a set for each document, not distinct rows first: those would hold the join to its partitioning, and a frequent line to one task
    lists = gone.groupBy("k").agg(F.collect_set(F.struct("i", "h")).alias("__gone"))
    joined = docs.withColumn("__k", F.expr(KEY)).join(lists.withColumnRenamed("k", "__k"), "__k", "left").drop("__k")
    names, at = docs.columns, docs.columns.index("text")

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            asked = b.column(len(names)).to_pylist()
            texts = b.column(at).to_pylist()
            keep = np.ones(len(texts), bool)
            todo = [d for d, r in enumerate(asked) if r and texts[d]]
            for d in todo:
                raw = np.frombuffer(texts[d].encode(), np.uint8)
                x = Lines(Words(raw, np.array([0, len(raw)])))
                want = {(r["i"], r["h"]) for r in asked[d]}
                out = {i for i, h in zip(x.number.tolist(), x.h.view(np.int64).tolist(), strict=True) if (i, h) in want}
                if out:
                    texts[d] = "\n".join([t for i, t in enumerate(texts[d].split("\n")) if i not in out])
                    keep[d] = len(out) < len(x.h)
            columns = [pa.array(texts, pa.string()) if n == "text" else b.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    out = arrow_map(joined.select(*names, "__gone"), rows, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
