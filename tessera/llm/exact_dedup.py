"""Exact deduplication with an extendible-hash index on shared files.

A text's key is the leading bits of the SHA-256 of its normalised bytes (A-Z lower-cased, nothing
else changed). The directory has 2**g slots, one for each prefix of g bits; it starts with one slot
and doubles while a bucket holds more bytes than `limit`, and only the overfull buckets split on the
new bit. A bucket is a range of keys with one owner task.

1. One pass over the texts writes slim fingerprints: id, row number, key, digest, bytes.
2. Fingerprints of one digest are counted, and their row of the largest doc_id found, by an
   aggregation that combines before its shuffle. The sizes of keys that occur twice or more, by
   prefixes of `DEPTH` bits (65,536 numbers at most), make the directory.
3. A second pass sends each owner the texts of such keys, equal texts once for each `HELD` bytes a task
   holds, so a group of any number of copies costs its owner one text for each task that read it.
4. Owners take their rows ordered by key: texts of one key that differ are chained, a text is compared
   byte by byte with its chain, and the counts of step 2 are put to the link of their digest. What
   they write, sorted by key, are the bucket files of the index.
5. Rows meet their link by key and digest. Groups of a thousandth of all rows or more (1,000 at
   most) are broadcast; the join of all others has no hot key.

Defined results: a null text is empty, and all empty texts are equal; a null doc_id is less than any
other; of rows that repeat the largest doc_id of a group exactly one stays; doc_id may have any type
that can be ordered; columns other than doc_id and text are kept by drop_duplicates, whatever they
are called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructType

from tessera.llm.common import arrow_map, bit_table, discard, may_hold, partitions, staged, text_chunks
from tessera.llm.textnum import LOWER

#: Bits of the prefixes whose sizes are summed: the directory has at most 2**DEPTH slots.
DEPTH = 16
#: Bytes of different texts that a task of the second pass holds to send equal ones once.
HELD = 16 << 20
#: Tasks that may send one text, for the sizes of buckets.
SENDERS = 256
#: Groups of at least 1 / HOT of all rows are broadcast.
HOT = 1000


def digests(data: np.ndarray, offsets: np.ndarray, bits: int = 64) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Normalised texts, their SHA-256, and keys: the first `bits` bits of it."""
    raw = LOWER[data].tobytes()
    texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    shas = [hashlib.sha256(t).digest() for t in texts]
    keys = np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64)
    return texts, shas, keys >> np.uint64(64 - bits) << np.uint64(64 - bits)


def fingerprints(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, row, key, sha and bytes of every row."""
    schema = StructType([docs.schema["doc_id"]]).add("row", "long").add("key", "long").add("sha", "binary").add("bytes", "long")

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for lo, hi, data, offsets in text_chunks(b):
                _, shas, keys = digests(data, offsets, bits)
                ids, row = (b.column(c).slice(lo, hi - lo) for c in (0, 1))
                columns = [ids, row, pa.array(keys.view(np.int64)), pa.array(shas, pa.binary()), pa.array(np.diff(offsets))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return arrow_map(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), rows, schema)


def directory(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every slot and depth of every bucket, for the bytes below each prefix of log2(len(sizes)) bits.

    The directory doubles while a bucket is over the limit; buckets within it keep one number for
    all slots they span. A bucket over the limit at the last bit stays whole: its keys are chained."""
    most = len(sizes).bit_length() - 1
    slots, depth = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for g in range(most):
        held = np.bincount(slots, sizes.reshape(1 << g, -1).sum(axis=1), minlength=len(depth))
        over = np.flatnonzero((held > limit) & (depth == g))
        if not len(over):
            break
        slots = np.repeat(slots, 2)  # the directory doubles
        upper = np.full(len(depth), -1)
        upper[over] = len(depth) + np.arange(len(over))
        right = (np.arange(len(slots)) % 2 == 1) & (upper[slots] >= 0)  # the new bit is 1, of a bucket that splits
        slots[right] = upper[slots[right]]
        depth[over] += 1
        depth = np.concatenate([depth, np.full(len(over), g + 1)])
    order = np.unique(slots, return_index=True)[1].argsort().argsort()  # number buckets in the order of their keys
    return order[slots], depth[np.argsort(order)]


def bucket_of(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
    g = len(slots).bit_length() - 1
    return slots[(keys >> np.uint64(64 - g)).astype(np.int64) if g else np.zeros(len(keys), np.int64)]


class ExactIndex:
    """The index of a table: `slots` and `depth` (the directory), `entries` (bucket files), `prints` (fingerprints).

    entries: bucket, key, link (place in the chain of its key), sha, keep_id, keep_row and n of every
    text that occurs more than once."""

    def __init__(self, docs: DataFrame, limit: int = 8 << 20, bits: int = 64):
        spark = docs.sparkSession
        self.prints = staged(fingerprints(docs, bits), "fingerprints")
        winner = F.max(F.struct("doc_id", F.negate("row").alias("back"))).alias("w")
        groups = self.prints.groupBy("key", "sha").agg(winner, F.count("*").alias("n"), F.max("bytes").alias("bytes"))
        groups = staged(groups.select("key", "sha", F.col("w.doc_id").alias("keep_id"), F.negate("w.back").alias("keep_row"), "n", "bytes"), "digests")
        keys = groups.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("bytes") * F.least("n", F.lit(SENDERS))).alias("bytes"))
        repeated = staged(keys.where("n > 1"), "repeated-keys")
        prefix = F.shiftrightunsigned("key", 64 - DEPTH)
        sizes = np.zeros(1 << DEPTH)
        for p, size in repeated.groupBy(prefix).agg(F.sum("bytes")).collect():  # at most 2**DEPTH rows
            sizes[p] = size
        self.slots, self.depth = directory(sizes, max(limit, int(sizes.sum()) >> (DEPTH - 2)))
        self.wanted = bit_table(repeated, F.col("key"), 26)
        nodes = self._texts(docs, bits).unionByName(self._counts(groups), allowMissingColumns=True)
        dealt = nodes.repartition(max(partitions(spark), len(self.depth)), "bucket").sortWithinPartitions("bucket", "key", "kind")
        self.entries = staged(self._owners(dealt).where("n > 1"), "buckets")
        self.rows = self.prints.count()
        discard(groups, repeated)

    def _texts(self, docs: DataFrame, bits: int) -> DataFrame:
        """Texts of keys that may be repeated, for their buckets; equal ones once while a task holds them."""
        slots, wanted = self.slots, self.wanted

        def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["bucket", "key", "kind", "sha", "text"]
            held: dict[int, list[tuple[bytes, bytes]]] = {}
            size = 0

            def out() -> pa.RecordBatch:
                keys = np.array([k for k, chain in held.items() for _ in chain], np.uint64)
                shas, texts = zip(*(x for chain in held.values() for x in chain), strict=True)
                columns = [pa.array(bucket_of(slots, keys).astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(np.zeros(len(keys), np.int32))]
                return pa.RecordBatch.from_arrays([*columns, pa.array(shas, pa.binary()), pa.array(texts, pa.binary())], names)

            for b in parts:
                for _, _, data, offsets in text_chunks(b):
                    texts, shas, keys = digests(data, offsets, bits)
                    for i in np.flatnonzero(may_hold(wanted.value, keys)).tolist():
                        chain = held.setdefault(int(keys[i]), [])
                        if all(t != texts[i] for _, t in chain):
                            chain.append((shas[i], texts[i]))
                            size += len(texts[i]) + 64
                    if size >= HELD:
                        yield out()
                        held, size = {}, 0
            if held:
                yield out()

        return arrow_map(docs.select("text"), rows, "bucket int, key long, kind int, sha binary, text binary")

    def _counts(self, groups: DataFrame) -> DataFrame:
        """The counts of digests, for the owners of their keys."""
        slots, wanted = self.slots, self.wanted
        schema = groups.select(F.lit(0).alias("bucket"), F.lit(1).alias("kind"), "key", "sha", "keep_id", "keep_row", "n").schema

        def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                b = b.filter(pa.array(may_hold(wanted.value, np.asarray(b.column(0)))))
                bucket = bucket_of(slots, np.asarray(b.column(0)).view(np.uint64))
                columns = [pa.array(bucket.astype(np.int32)), pa.array(np.ones(len(b), np.int32)), *b.columns]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        return arrow_map(groups.select("key", "sha", "keep_id", "keep_row", "n"), rows, schema)

    def _owners(self, nodes: DataFrame) -> DataFrame:
        """Chains of rows (ordered by key, texts before counts): a link for every count."""
        kept = ["bucket", "key", "sha", "keep_id", "keep_row", "n"]
        schema = nodes.select(*kept).schema.add("link", IntegerType())

        def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, chain = None, []
            for b in parts:
                keys, kinds, shas, texts = (b.column(i).to_pylist() for i in range(1, 5))
                take, links = [], []
                for i, (key, kind, sha, text) in enumerate(zip(keys, kinds, shas, texts, strict=True)):
                    if key != last:
                        last, chain = key, []
                    if kind == 0:
                        if all(t != text for _, t in chain):
                            if any(s == sha for s, _ in chain):
                                raise ValueError(f"different texts with one SHA-256: {sha.hex()}")
                            chain.append((sha, text))
                        continue
                    take.append(i)
                    links.append([s for s, _ in chain].index(sha))
                at = [b.schema.get_field_index(c) for c in kept]
                columns = [b.column(c).take(pa.array(take, pa.int64())) for c in at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(links, pa.int32())], schema.names)

        return arrow_map(nodes.select("bucket", "key", "kind", "sha", "text", "keep_id", "keep_row", "n"), rows, schema)

    def join(self, rows: DataFrame) -> DataFrame:
        """rows (with key and sha) and keep_id, keep_row and n of their group, null for texts that occur once."""
        found = self.entries.select("key", "sha", "keep_id", "keep_row", "n")
        least = max(2, self.rows // HOT)
        hot = found.where(F.col("n") >= least)  # HOT groups at most, or groups of all rows of a small table
        rest = found.where(F.col("n") < least)
        named = lambda df, p: df.select("key", "sha", *(F.col(c).alias(p + c) for c in ("keep_id", "keep_row", "n")))
        out = rows.join(F.broadcast(named(hot, "__h")), ["key", "sha"], "left")
        cold = F.when(F.col("__hn").isNull(), F.col("key"))  # rows of hot groups have no key to be dealt by
        out = out.withColumn("__cold", F.coalesce(cold, F.xxhash64(F.monotonically_increasing_id())))
        rest = named(rest, "__r").withColumnsRenamed({"key": "__cold", "sha": "__rsha"})
        out = out.join(rest, (out["__cold"] == rest["__cold"]) & (out["sha"] == rest["__rsha"]) & out["__hn"].isNull(), "left").drop(rest["__cold"])
        pick = {c: F.when(F.col("__hn").isNotNull(), F.col(f"__h{c}")).otherwise(F.col(f"__r{c}")) for c in ("keep_id", "keep_row", "n")}
        return out.select(*(F.col(c) for c in rows.columns), *(v.alias(f"__{c}") for c, v in pick.items()))


def mark(docs: DataFrame, limit: int = 8 << 20, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    index = ExactIndex(docs, limit, bits)
    found = index.join(index.prints)
    alone = F.col("__n").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("__keep_id")).alias("keep_id"),
        F.coalesce("__n", F.lit(1).cast(LongType())).alias("group_size"),
        F.coalesce(F.col("row") == F.col("__keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, limit: int = 8 << 20, bits: int = 64) -> DataFrame:
    """docs with one row of each group of equal texts: that of the largest doc_id.

    Rows that go are known before texts are shuffled where their group is hot; where rows repeat the
    id as well, any one of them stays."""
    index = ExactIndex(docs, limit, bits)
    names, inner = docs.columns, [f"__c{i}" for i in range(len(docs.columns))]
    schema = docs.toDF(*inner).schema.add("key", "long").add("sha", "binary")
    at, where = names.index("text"), f"__c{names.index('doc_id')}"

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(f.dataType) for f in schema.fields[-2:]]
        for b in parts:
            for lo, hi, data, offsets in text_chunks(b, inner[at]):
                _, shas, keys = digests(data, offsets, bits)
                more = [pa.array(keys.view(np.int64), types[0]), pa.array(shas, types[1])]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, *more], schema.names)

    found = index.join(arrow_map(docs.toDF(*inner), rows, schema))
    alone = F.col("__n").isNull()
    stay = found.where(alone | F.col(where).eqNullSafe(F.col("__keep_id")))
    many = stay.where(~alone).withColumn("__r", F.row_number().over(Window.partitionBy("key", "sha").orderBy(F.lit(1)))).where("__r = 1")
    return stay.where(alone).select(*inner).unionByName(many.select(*inner)).toDF(*names)
