"""N-gram Jaccard join with parity sketches.

A document is its set of distinct `SHINGLE`-word shingles. Its sketch has K lanes; each shingle
picks a lane by its hash and is XORed into it, so a lane holds the parity of its shingles and
the number of lanes that differ between two sketches is at most the symmetric difference of
the sets. Two sets within the threshold differ in at most (|A|+|B|)(1-J)/(1+J) shingles: of the
m filled lanes of a document at least t = m - that bound must agree (pigeonhole). K depends on
the size band (powers of two); a document near the lower end of its band has a sketch for the
band below as well, so any two sizes that can match share a band.

Lanes are joined on (band, lane, content), range of keys by range. A document of which fewer than
t lanes are shared with any other has no partner and goes. A run that is long in one batch of
documents is cut there: its documents meet in a run of their own, which a hub node joins to the
others, so no key is gathered whole.

Each document left is first compared with its leader, the document that is the least of most of
its runs, and with those of the same leader in its block. That connects families of near copies at
a cost that grows with their size, not its square. Classes found so take the place of their
documents: a run of at most `LONG_RUN` classes gives counted pairs of classes, and a pair stays only
if its count can reach t. Longer runs are counted for their classes instead; a class with fewer than
t of them must agree elsewhere with any partner, so only classes with t or more are linked on long
runs, each to the least class of its run.

Classes that are connected in this way are verified: parity bits rule pairs of sets out by Hamming
distance, the sets themselves decide, and sets of one class are not compared again. A group of more
than `WHOLE` sets is compared in parts. Components of the verified links are the classes of the
result. Equal sets are one node from the start.

Defined results: doc_id is an integer; null and empty texts have no shingles and link with
nothing; a text of fewer words than a shingle is one shingle; rows that repeat share a class
through their equal sets; a null doc_id never is the least id of a class, unless there is no
other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, by_group, discard, partitions, possible_rows, sorted_groups, staged, text_chunks
from tessera.llm.graph import connected_components, least_labels
from tessera.llm.textnum import WORD_BASE, Sequence, Words, mix

SHINGLE = 5
#: Documents of one batch, or classes, beyond which a run is long.
LONG_RUN = 16
#: Bands of fewer than 2**WIDE shingles have 2**16 lanes, others as many as their least size.
WIDE = 7
#: Lanes that one batch of documents gathers before it sends them on, and shingles for each range of keys.
FLUSH, RANGE = 400_000, 2_500_000
#: Pairs that one step counts.
PAIRS = 500_000
#: Signatures that a task remembers, so that it sends the lanes of equal sets once.
SEEN = 200_000
#: Sets compared in one task, of a whole group or of a part of it; and their shingles.
WHOLE, BLOCK, BLOCK_SHINGLES = 512, 256, 400_000
SKETCH_BYTES = 256
KEY = "coalesce(doc_id, -9223372036854775808L)"


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every distinct shingle, ordered by both."""
    seq = Sequence(words.hashes(), WORD_BASE)
    at, doc = words.window_starts(size)
    short = np.flatnonzero((words.n_words > 0) & (words.n_words < size))
    x = np.concatenate([seq.spans(at, at + size), seq.spans(words.first[:-1][short], words.first[1:][short])])
    doc = np.concatenate([doc, short])
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], x[new]


def by_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def signature(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set: equal sets have equal sums."""
    return mix(by_doc(mix(x), bounds)), mix(by_doc(mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds))


def most_different(n: np.ndarray, partner: np.ndarray) -> np.ndarray:
    """Largest symmetric difference of a set of n and one of at most `partner` that reach J = 0.75."""
    return (n + partner) // 7


def sketch_lanes(doc: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per filled lane: entity and key; per entity (a document in a band): document, band, t."""
    band = np.frexp(np.maximum(n, 1))[1] - 1
    own = np.flatnonzero(n > 0)
    down = own[(3 * n[own] < 4 * 2 ** band[own]) & (band[own] > 0)]
    of = np.concatenate([own, down])
    level = np.concatenate([band[own], band[down] - 1])
    partner = np.concatenate([4 * n[own] // 3, 2 ** band[down] - 1])
    bounds = np.searchsorted(doc, np.arange(len(n) + 1))
    size = n[of]
    entity = np.repeat(np.arange(len(of)), size)
    at = np.repeat(bounds[of] - (np.cumsum(size) - size), size) + np.arange(len(entity))
    token = x[at]
    lanes = np.where(level < WIDE, 1 << 16, 1 << level).astype(np.uint64)
    lane = (token >> np.uint64(32)) & (lanes[entity] - np.uint64(1))
    place = (entity.astype(np.uint64) << np.uint64(32)) | lane
    order = np.argsort(place)
    place = place[order]
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    content = np.bitwise_xor.reduceat(mix(token[order]), start) if len(start) else np.zeros(0, np.uint64)
    ent = (place[start] >> np.uint64(32)).astype(np.int64)
    key = mix(content ^ mix((level[ent].astype(np.uint64) << np.uint64(32)) + (place[start] & np.uint64(0xFFFFFFFF)) + np.uint64(1)))
    t = np.bincount(ent, minlength=len(of)) - most_different(size, partner)
    low = np.flatnonzero(t <= 0)  # too few filled lanes to be sure of one that agrees: these share a key
    key = np.concatenate([key, mix(level[low].astype(np.uint64) ^ np.uint64(0xC0FFEE0000000000))])
    return np.concatenate([ent, low]), key, of, level, t


def document_table(docs: DataFrame) -> DataFrame:
    """doc_id, n and signature (s1, s2) of every row."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for lo, hi, data, offsets in text_chunks(b):
                doc, x = shingle_sets(Words(data, offsets, lower=True))
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                s1, s2 = signature(x, bounds)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds).astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))], ["doc_id", "n", "s1", "s2"])

    return arrow_map(docs.select("doc_id", "text"), rows, "doc_id long, n long, s1 long, s2 long")


def _planes(values: np.ndarray) -> bytes:
    """Bytes of an array, plane by plane, so that the shuffle's codec finds the equal high bytes."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).ravel()


def lane_blobs(docs: DataFrame, ranges: int) -> DataFrame:
    """range of lane keys -> sorted keys and entities, packed by many documents at a time."""
    step = np.uint64((1 << 64) // ranges + 1)

    def pack(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key = np.concatenate([h[0] for h in held])
        base = np.cumsum([0, *(len(h[2]) for h in held)])
        ent = np.concatenate([h[1] + base[i] for i, h in enumerate(held)])
        sig, level, t = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
        order = np.lexsort((sig[ent], key))
        key, ent = key[order], ent[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(key)))
        long = size > LONG_RUN
        if long.any():  # a run of their own for these documents; a hub and the least of them stand for them in the common run
            whole = key[start[long]]
            own = mix(whole ^ np.add.reduce(sig.view(np.uint64)))
            key = np.repeat(key[start], size)
            key[np.repeat(long, size)] = np.repeat(own, size[long])
            hub = len(sig) + np.arange(len(own))
            key, ent = np.concatenate([key, own, whole, whole]), np.concatenate([ent, hub, hub, ent[start[long]]])
            sig, level, t = np.concatenate([sig, own.view(np.int64)]), np.concatenate([level, np.full(len(own), -1)]), np.concatenate([t, np.zeros(len(own), t.dtype)])
            order = np.argsort(key)
            key, ent = key[order], ent[order]
        cut = np.searchsorted(key, np.arange(ranges, dtype=np.uint64) * step)
        cut = np.append(cut, len(key))
        out: dict[str, list] = {c: [] for c in ("range", "key", "ent", "sig", "level", "t")}
        for r in range(ranges):
            k, e = key[cut[r] : cut[r + 1]], ent[cut[r] : cut[r + 1]]
            if not len(k):
                continue
            used, e = np.unique(e, return_inverse=True)
            out["range"].append(r)
            out["key"].append(_planes(np.diff(k, prepend=np.uint64(0))))
            out["ent"].append(_planes(e.astype(np.uint32)))
            out["sig"].append(sig[used].tobytes())
            out["level"].append(level[used].astype(np.int8).tobytes())
            out["t"].append(_planes(t[used].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(out["range"], pa.int32()), *(pa.array(out[c], pa.binary()) for c in ("key", "ent", "sig", "level", "t"))], list(out))

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen = [], 0, set()
        for b in parts:
            for lo, hi, data, offsets in text_chunks(b):
                doc, x = shingle_sets(Words(data, offsets, lower=True))
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                s1, _ = signature(x, bounds)
                n = np.diff(bounds)
                once = np.zeros(hi - lo, bool)
                for i, s in enumerate(s1.tolist()):
                    if s not in seen:
                        once[i] = True
                        if len(seen) >= SEEN:  # bounded: a set that comes again is sent again, and dropped where lanes meet
                            seen.clear()
                        seen.add(s)
                ent, key, of, level, t = sketch_lanes(doc, x, np.where(once, n, 0))
                held.append((key, ent, s1[of].view(np.int64), level, t))
                count += len(key)
                if count >= FLUSH:
                    yield from pack(held)
                    held, count = [], 0
        yield from pack(held)

    return arrow_map(docs.select("text"), rows, "range int, key binary, ent binary, sig binary, level binary, t binary")


def shared_lanes(blobs: DataFrame, buckets: int) -> DataFrame:
    """Of every document (in a band) the lanes that others share: their number n in a range, the runs they are in, the least documents of these.

    A range of lanes packs what it has for a bucket of documents into one row."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sorted_groups(parts, 1):
            keys, ents, of, base = [], [], [], 0
            for b in held:
                for r in range(len(b)):
                    keys.append(np.cumsum(_from_planes(b.column(1)[r].as_py(), np.uint64), dtype=np.uint64))
                    ents.append(_from_planes(b.column(2)[r].as_py(), np.uint32) + np.uint32(base))
                    of.append((np.frombuffer(b.column(3)[r].as_py(), np.int64), np.frombuffer(b.column(4)[r].as_py(), np.int8), _from_planes(b.column(5)[r].as_py(), np.int32)))
                    base += len(of[-1][0])
            key, ent = np.concatenate(keys), np.concatenate(ents)
            del keys, ents
            sig, level, t = (np.concatenate(v) for v in zip(*of, strict=True))
            order = np.argsort(key)
            twin = np.zeros(len(key) + 1, bool)
            twin[1:-1] = key[order[1:]] == key[order[:-1]]
            order = order[twin[1:] | twin[:-1]]  # most keys are alone
            key, ent = key[order], ent[order]
            order = np.lexsort((sig[ent], key))
            key, ent = key[order], ent[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (sig[ent[1:]] != sig[ent[:-1]])
            key, ent = key[new], ent[new]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            run = np.cumsum(first) - 1
            shared = np.bincount(run, minlength=1)[run] > 1 if len(run) else first
            run, ent = run[shared].astype(np.uint32), ent[shared]
            if not len(run):
                continue
            first = _starts(run)
            least = np.where(level[ent] < 0, np.iinfo(np.int64).max, sig[ent])  # hubs lead nobody
            least = np.repeat(np.minimum.reduceat(least, first), np.diff(np.append(first, len(run))))
            bucket = (mix(sig.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((least, level[ent], sig[ent], bucket[ent]))
            run, ent, least = run[order], ent[order], least[order]
            start, group = _starts(sig[ent], level[ent]), _starts(sig[ent], level[ent], least)
            n, votes = np.diff(np.append(start, len(run))), np.diff(np.append(group, len(run)))
            led = np.diff(np.searchsorted(group, np.append(start, len(run))))
            e = ent[start]
            first = _starts(bucket[e])
            cut = np.append(first, len(start))
            at, of = np.append(start, len(run))[cut], np.append(np.cumsum(led) - led, len(group))[cut]
            out = {"bucket": bucket[e[first]], "range": np.full(len(first), held[0].column(0)[0].as_py(), np.int32)}
            for name, x, ends in (("sig", sig[e], cut), ("level", level[e], cut), ("t", t[e], cut), ("n", n.astype(np.int32), cut), ("led", led.astype(np.int32), cut), ("runs", run, at), ("least", least[group], of), ("votes", votes.astype(np.int32), of)):
                out[name] = _lists(x, ends)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], list(out))

    columns = ", ".join(f"{c} binary" for c in SHARED)
    return arrow_map(by_group(blobs, ["range"]), rows, f"bucket int, range int, {columns}")


#: Columns of shared lanes: of documents (in a band), of their runs, of the least documents of these.
SHARED = {"sig": np.int64, "level": np.int8, "t": np.int32, "n": np.int32, "led": np.int32, "runs": np.uint32, "least": np.int64, "votes": np.int32}


def _lists(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary lists of x[ends[i] : ends[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def live_documents(shared: DataFrame) -> DataFrame:
    """sig, level, t, lanes of documents (and hubs) that share as many lanes as a partner must, and leader.

    A leader is the document that is the least of most of its runs, if of half as many as a partner must share."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sorted_groups(parts, 1):
            number = np.concatenate([np.asarray(b.column(1)) for b in held])
            sig, level, t, n, led, run, least, votes = (np.frombuffer(b"".join(x for b in held for x in b.column(i).to_pylist()), kind) for i, kind in enumerate(SHARED.values(), 2))
            number = np.repeat(number, [len(x) // 8 for b in held for x in b.column(2).to_pylist()])
            order = np.lexsort((number, level, sig))
            doc = np.empty(len(sig), np.int64)  # of every entry, in order of sig and level
            first = _starts(sig[order], level[order])
            doc[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
            sig, level, t = (x[order[first]] for x in (sig, level, t))
            live = np.bincount(doc, weights=n, minlength=len(sig)) >= t
            row = np.repeat(doc, led)
            by = np.lexsort((least, row))
            row, least, votes = row[by], least[by], votes[by]
            at = _starts(row, least)
            row, least, votes = row[at], least[at], np.add.reduceat(votes, at)
            by = np.lexsort((least, -votes, row))
            best = by[_starts(row[by])]
            leader = least[best]  # one a document, in their order
            leads = live & (2 * votes[best] >= t) & (leader != sig) & (leader != np.iinfo(np.int64).max) & (level >= 0)
            order = order[live[doc[order]]]
            size, start = n[order], (np.cumsum(n) - n)[order]
            place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            lanes = pa.StructArray.from_arrays([pa.array(number[order]), _lists(run[place], np.append(0, np.cumsum(size)))], ["range", "runs"])
            ends = np.append(0, np.cumsum(np.bincount(doc[order], minlength=len(sig))[live])).astype(np.int32)
            out = pa.RecordBatch.from_arrays([pa.array(sig[live]), pa.array(level[live]), pa.array(t[live]), pa.ListArray.from_arrays(pa.array(ends), lanes), pa.array(leader[live], mask=~leads[live])], ["sig", "level", "t", "lanes", "leader"])
            for lo in range(0, len(out), 2000):
                yield out.slice(lo, 2000)

    return arrow_map(by_group(shared, ["bucket"]), rows, "sig long, level byte, t int, lanes array<struct<range: int, runs: binary>>, leader long")


def by_range(named: DataFrame) -> DataFrame:
    """range, classes c, levels, t and runs of a batch of live documents, packed."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            c, level, t = (np.asarray(b.column(i)) for i in range(3))
            row = np.repeat(np.arange(len(b)), b.column(3).value_lengths().to_numpy())
            lanes = b.column(3).flatten()
            number, blobs = np.asarray(lanes.field(0)), lanes.field(1).to_pylist()
            order = np.argsort(number, kind="stable")
            out: dict[str, list] = {x: [] for x in ("range", "c", "level", "t", "n", "runs")}
            for some in np.split(order, _starts(number[order])[1:]) if len(order) else []:
                at = row[some]
                parts_of = [blobs[i] for i in some.tolist()]
                out["range"].append(int(number[some[0]]))
                out["c"].append(c[at].tobytes())
                out["level"].append(level[at].tobytes())
                out["t"].append(t[at].tobytes())
                out["n"].append(np.array([len(x) // 4 for x in parts_of], np.int32).tobytes())
                out["runs"].append(b"".join(parts_of))
            yield pa.RecordBatch.from_arrays([pa.array(out["range"], pa.int32()), *(pa.array(out[x], pa.binary()) for x in list(out)[1:])], list(out))

    return arrow_map(named.select("c", "level", "t", "lanes"), rows, "range int, c binary, level binary, t binary, n binary, runs binary")


def meetings(packed: DataFrame) -> DataFrame:
    """What the classes (c) of live documents share, by range.

    kind 0: classes a < b of one band, the number n of runs of at most LONG_RUN classes where they
    meet, and how many they need; kind 1: the n longer runs (and those with a hub) of class a."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sorted_groups(parts, 1):
            c, level, t, n, run = (np.frombuffer(b"".join(x for b in held for x in b.column(i).to_pylist()), kind) for i, kind in enumerate((np.int64, np.int8, np.int32, np.int32, np.uint32), 1))
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((t[row], c[row], run))
            row, run = row[order], run[order]
            once = _starts(run, c[row])
            row, run = row[once], run[once]
            first = _starts(run)
            size = np.diff(np.append(first, len(run)))
            long = (size > LONG_RUN) | (np.minimum.reduceat(level[row], first) < 0)
            number = held[0].column(0)[0].as_py()
            flat = lambda kind, n: [pa.array(np.full(n, kind, np.int8)), pa.array(np.full(n, number, np.int32))]  # noqa: B023, E731
            names = ["kind", "range", "a", "b", "level", "n", "ta", "tb", "runs"]
            short = np.flatnonzero((size > 1) & ~long)
            due = np.cumsum(size[short] * (size[short] - 1) // 2) // PAIRS
            for some in np.split(short, np.flatnonzero(due[1:] != due[:-1]) + 1):
                a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for many in range(2, LONG_RUN + 1):
                    at = first[some[size[some] == many]]
                    for i in range(many if len(at) else 0):
                        for j in range(i + 1, many):
                            a.append(at + i)
                            b.append(at + j)
                a, b = row[np.concatenate(a)], row[np.concatenate(b)]
                order = np.lexsort((level[a], c[b], c[a]))
                a, b = a[order], b[order]
                at = _starts(level[a], c[b], c[a])
                many = len(at)
                # of the members that meet, the least need
                ta, tb = (np.minimum.reduceat(t[x], at) if many else t[:0] for x in (a, b))
                yield pa.RecordBatch.from_arrays([*flat(0, many), pa.array(c[a[at]]), pa.array(c[b[at]]), pa.array(level[a[at]]), pa.array(np.diff(np.append(at, len(a))).astype(np.int32)), pa.array(ta), pa.array(tb), pa.nulls(many, pa.binary())], names)
            keep = np.repeat(long, size)
            row, run = row[keep], run[keep]
            order = np.lexsort((run, level[row], c[row]))
            row, run = row[order], run[order]
            at = _starts(level[row], c[row])
            many, ends = len(at), np.append(at, len(row)).astype(np.int32)
            tc = np.minimum.reduceat(t[row], at) if many else t[:0]
            blobs = _lists(run, ends)
            yield pa.RecordBatch.from_arrays([*flat(1, many), pa.array(c[row[at]]), pa.nulls(many, pa.int64()), pa.array(level[row[at]]), pa.array(np.diff(ends)), pa.array(tc), pa.nulls(many, pa.int32()), blobs], names)

    return arrow_map(by_group(packed, ["range"]), rows, "kind byte, range int, a long, b long, level byte, n int, ta int, tb int, runs binary")


def run_edges(lanes: DataFrame) -> DataFrame:
    """Edges (a, b) to the least of the classes that the runs of a range connect."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sorted_groups(parts, 1):
            blobs = [x for b in held for x in b.column(2).to_pylist()]
            row, run = np.repeat(np.arange(len(blobs)), [len(x) // 4 for x in blobs]), np.frombuffer(b"".join(blobs), np.uint32)
            nodes, at = np.unique(np.concatenate([np.asarray(b.column(1)) for b in held]), return_inverse=True)
            order = np.argsort(run, kind="stable")
            run, node = run[order], at[row[order]]
            first = _starts(run)
            root = least_labels(node, np.repeat(node[first], np.diff(np.append(first, len(run)))), len(nodes))
            linked = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["a", "b"])

    return arrow_map(by_group(lanes.select("range", "a", "runs"), ["range"]), rows, "a long, b long")


def class_edges(live: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) of classes and hubs; classes of documents within the threshold are connected by them."""
    named = live.join(classes.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("c", F.coalesce("root", "sig"))
    met = staged(meetings(by_range(named)), "meetings")
    long = met.where("kind = 1")
    counts = staged(long.groupBy("a", "level").agg(F.sum("n").alias("long")), "long-runs")
    pairs = met.where("kind = 0").groupBy("a", "b", "level").agg(F.sum("n").alias("n"), F.min("ta").alias("ta"), F.min("tb").alias("tb"))
    pairs = pairs.join(counts.withColumnRenamed("long", "la"), ["a", "level"], "left")
    pairs = pairs.join(counts.select(F.col("a").alias("b"), "level", F.col("long").alias("lb")), ["b", "level"], "left")
    enough = F.col("n") + F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0))) >= F.greatest("ta", "tb")
    own = Window.partitionBy("a", "level")
    dense = long.withColumn("all", F.sum("n").over(own)).withColumn("need", F.min("ta").over(own)).where("all >= need")
    return pairs.where(enough).select("a", "b").unionByName(run_edges(dense))


def verify_sets(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (places) that connect what can be connected and is not connected yet, as `root` says; with `side`, only between sides."""
    n = np.array([len(s) for s in sets])
    bits = np.zeros((len(sets), SKETCH_BYTES * 8), np.uint8)
    for i, s in enumerate(sets):
        bits[i] = np.bincount((s & np.uint64(SKETCH_BYTES * 8 - 1)).astype(np.int64), minlength=SKETCH_BYTES * 8) & 1
    sketch = np.packbits(bits, axis=1).view(np.uint64)
    del bits
    root = root.copy()
    links = []
    for i in range(len(sets)):
        rest = np.arange(i + 1, len(sets))
        rest = rest[root[rest] != root[i]]
        if side is not None:
            rest = rest[side[rest] != side[i]]
        if not len(rest):
            continue
        far = np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        for j in rest[7 * far <= n[rest] + n[i]]:
            if root[j] != root[i] and alike(sets[i], sets[j]):
                links.append((i, int(j)))
                root[root == root[j]] = root[i]
    return links


def difference(a: np.ndarray, b: np.ndarray) -> int:
    """Elements in one of two sets."""
    return len(a) + len(b) - 2 * len(np.intersect1d(a, b, assume_unique=True))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (k, s1 and others) with each document's set of shingle hashes."""
    others = [c for c in wanted.columns if c != "k"]
    few = possible_rows(docs.select(F.expr(KEY).alias("k"), "text"), wanted, "k")
    found = few.join(wanted.hint("merge"), "k").select("text", *others)
    at = others.index("s1") + 1

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            want = np.asarray(b.column(at))
            for lo, hi, data, offsets in text_chunks(b):
                doc, x = shingle_sets(Words(data, offsets, lower=True))
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                good = np.flatnonzero(signature(x, bounds)[0].view(np.int64) == want[lo:hi])  # ids may repeat
                take = pa.array(good + lo)
                blobs = pa.array([x[bounds[i] : bounds[i + 1]].tobytes() for i in good], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in others), blobs], [*others, "set"])

    schema = found.select(*others).schema.add("set", "binary")
    return arrow_map(found, sets, schema)


def _group_sets(held: list[pa.RecordBatch], names: list[str]) -> tuple[dict[str, list], list[np.ndarray]]:
    """Columns and sets of a group, each signature once."""
    columns = {n: [v for b in held for v in b.column(b.schema.get_field_index(n)).to_pylist()] for n in names}
    blobs = [v for b in held for v in b.column(b.schema.get_field_index("set")).to_pylist()]
    seen: dict[int, int] = {}
    for i, s in enumerate(columns["s1"]):
        seen.setdefault(s, i)
    keep = list(seen.values())
    return {n: [v[i] for i in keep] for n, v in columns.items()}, [np.frombuffer(blobs[i], np.uint64) for i in keep]


def group_links(found: DataFrame) -> DataFrame:
    """Links (a, b) of sets of one group (g, i, j) that are not of one class yet, with `mine` of i and j in cut groups."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sorted_groups(parts, 3):
            c, sets = _group_sets(held, ["s1", "c", "mine"])
            _, root = np.unique(np.array(c["c"], np.int64), return_inverse=True)
            side = np.array(c["mine"]) if len(set(c["mine"])) > 1 else None
            links = verify_sets(sets, root, side) if len(sets) > 1 else []
            a, b = [c["s1"][i] for i, _ in links], [c["s1"][j] for _, j in links]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return arrow_map(by_group(found.select("g", "i", "j", "s1", "c", "mine", "set"), ["g", "i", "j"]), rows, "a long, b long")


def leader_links(docs: DataFrame, one: DataFrame, led: DataFrame, block: int) -> DataFrame:
    """Links (a, b) among the documents of one leader, which is compared with all of them, block by block."""
    groups = led.select("s1", F.col("leader").alias("g")).unionByName(led.select(F.col("leader").alias("s1"), F.col("leader").alias("g")).distinct())
    members = staged(one.join(groups, "s1"), "led")
    size = members.groupBy("g").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = staged(members.join(size, "g").select("k", "s1", "g", "blocks"), "members")
    found = with_sets(docs, members)
    own = F.array(F.pmod(F.xxhash64("s1"), F.col("blocks")).cast("int"))
    found = found.withColumn("i", F.explode(F.when(F.col("s1") == F.col("g"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)))
    return staged(group_links(found.select("g", "i", F.lit(0).alias("j"), "s1", F.col("s1").alias("c"), F.lit(0).alias("mine"), "set")), "leader-links")


def class_links(docs: DataFrame, one: DataFrame, classes: DataFrame, groups: DataFrame, whole: int, block: int) -> DataFrame:
    """Links (a, b) between different classes of a candidate group (node: class, root).

    A group of up to `whole` sets is one task. In a larger one, the sets outside its largest class are dealt to parts 0 to
    outer - 1, which meet one another and the inner parts, those of the largest class; inner parts do not meet."""
    named = one.join(classes.select(F.col("node").alias("s1"), "root"), "s1", "left").withColumn("c", F.coalesce("root", "s1"))
    members = staged(named.join(groups.select(F.col("node").alias("c"), F.col("root").alias("g")), "c").select("k", "s1", "g", "c", "n"), "open")
    sizes = members.groupBy("g", "c").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    big = F.max(F.struct("docs", "shingles", "c"))
    size = sizes.groupBy("g").agg(big.alias("big"), F.count("*").alias("classes"), F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles")).where("classes > 1")
    parts = lambda docs, shingles: F.ceil(F.greatest(docs / block, shingles / BLOCK_SHINGLES)).cast("int")
    cut = (F.col("docs") > whole) | (F.col("shingles") > BLOCK_SHINGLES)
    size = size.select("g", F.col("big.c").alias("most"), F.when(cut, parts(F.col("docs") - F.col("big.docs"), F.col("shingles") - F.col("big.shingles"))).otherwise(1).alias("outer"),
                       F.when(cut, parts(F.col("big.docs"), F.col("big.shingles"))).otherwise(0).alias("inner"))
    members = members.join(staged(size, "group-sizes"), "g").withColumn("within", (F.col("c") == F.col("most")) & (F.col("inner") > 0))
    place = F.xxhash64("s1")
    members = members.withColumn("mine", F.when(F.col("within"), F.col("outer") + F.pmod(place, F.greatest("inner", F.lit(1)))).otherwise(F.pmod(place, F.col("outer"))).cast("int"))
    found = with_sets(docs, staged(members.select("k", "s1", "g", "c", "mine", "within", "outer", "inner"), "left"))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("within"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)))
    return staged(group_links(found.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))), "class-links")


def components(docs: DataFrame, whole: int = WHOLE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id of its class) of every row."""
    table = staged(document_table(docs), "sets")
    shingles = table.agg(F.sum("n")).first()[0] or 0
    one = staged(table.where("n > 0").groupBy("s1").agg(F.min(F.expr(KEY)).alias("k"), F.max("n").alias("n")), "distinct")
    ranges = max(partitions(docs.sparkSession), shingles // RANGE + 1)
    live = staged(live_documents(shared_lanes(lane_blobs(docs, ranges), ranges)), "live")
    led = live.where("leader is not null").groupBy(F.col("sig").alias("s1")).agg(F.max_by("leader", "level").alias("leader"))
    near = leader_links(docs, one, led, block)
    classes = connected_components(near)
    groups = connected_components(class_edges(live, classes))
    discard(live)
    links = near.unionByName(class_links(docs, one, classes, groups, whole, block))
    classes = connected_components(links).select(F.col("node").alias("s1"), "root")
    table = table.withColumn("n", F.col("n").cast("long"))
    rooted = table.where("n > 0").join(classes, "s1", "left").withColumn("c", F.coalesce("root", "s1"))
    rooted = staged(rooted.select("doc_id", "n", "c"), "rooted")
    least = staged(rooted.groupBy("c").agg(F.min("doc_id").alias("component_id")), "least-ids")
    linked = rooted.join(least, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = table.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, that of the least doc_id, with all its columns; documents without shingles stay.

    Ids tell documents apart: rows that repeat the least doc_id of a class all stay, as do rows without one."""
    classes = components(docs.select("doc_id", "text")).where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(staged(classes, "dropped"), "doc_id", "left_anti")
    return kept.select(*docs.columns)
