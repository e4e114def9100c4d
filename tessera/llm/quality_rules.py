"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are trained on a bounded sample of labelled documents (`sample` rows, least hash
first; documents whose crc32(doc_id) mod 5 is 0 are held out), flattened into numpy node
arrays and scored for whole batches at once. Monotonic constraints hold the score from
rising with symbol share, repeated words, repeated lines and upper-case share.

Defined results: a null or empty text has no words and fails the base rules; rows that
repeat are judged one by one; columns besides doc_id and text play no part; an empty table
gives an empty result; without usable labels the base rules alone decide; doc_id
may have any type.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, id_type, text_chunks
from tessera.llm.textnum import WORD_BASE, Sequence, Words, byte_set, covered, lines, mix

SYMBOLS = byte_set(b"#*$%&|<>")
UPPER = byte_set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = byte_set(b"0123456789")
PUNCT = byte_set(b".,;:!?")
SHOUT = byte_set(b"!?")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "punctuation", "shouts", "distinct", "lone_symbols", "words_a_line")
#: Direction in which a feature may move the score: -1 never up, 0 free.
MONOTONE = np.array([0, 0, -1, -1, -1, -1, 0, 0, -1, 0, -1, 0])


def statistics(words: Words) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of the contract and the features of every document in a chunk."""
    n_words = words.n_words.astype(np.int64)
    n_docs = len(n_words)
    code_points = (words.data & 0xC0) != 0x80
    symbols = SYMBOLS[words.data]
    hashes = words.hashes()
    out = {"n_words": n_words, "word_chars": words.per_doc(words.inside & code_points), "n_symbols": words.per_doc(symbols)}

    start, end, doc, in_line = lines(words)
    real = in_line > 0
    key = mix(words.byte_seq().spans(start[real], end[real]) ^ mix(doc[real].astype(np.uint64)))
    kinds, first = np.unique(key, return_index=True)
    n_lines = np.bincount(doc[real], minlength=n_docs)
    out["n_dup_lines"] = n_lines - np.bincount(doc[real][first], minlength=n_docs)

    at, of = words.window_starts(5)
    key = mix(Sequence(hashes, WORD_BASE).spans(at, at + 5) ^ mix(of.astype(np.uint64)))
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    out["n_repeat_words"] = words.per_doc_words(covered(len(hashes), at[order[same[1:] | same[:-1]]], 5))

    of = words.doc_of_word()
    order = np.argsort(mix(hashes ^ mix(of.astype(np.uint64))))
    key = hashes[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[order][1:] != of[order][:-1])
    n_distinct = np.bincount(of[order][new], minlength=n_docs)

    nw, nc = np.maximum(n_words, 1), np.maximum(out["word_chars"], 1)
    one = (words.ends - words.starts) == 1
    lone = words.per_doc_words(one & symbols[words.starts]) if len(words.starts) else np.zeros(n_docs, np.int64)
    x = np.stack([
        np.log1p(n_words), out["word_chars"] / nw, out["n_symbols"] / nc, out["n_dup_lines"] / np.maximum(n_lines, 1),
        out["n_repeat_words"] / nw, words.per_doc(UPPER[words.data]) / nc, words.per_doc(DIGIT[words.data]) / nc,
        words.per_doc(PUNCT[words.data]) / nw, words.per_doc(SHOUT[words.data]) / nw, n_distinct / nw,
        lone / nw, n_words / np.maximum(n_lines, 1),
    ], axis=1).astype(np.float64)
    return out, x


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])


@dataclass
class Trees:
    """Complete binary trees of one depth: node i has children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of all rows: one gather a level for all trees at once."""
        n_trees, inner = self.feature.shape
        tree = np.arange(n_trees)[None, :]
        at = np.zeros((len(x), n_trees), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
        return self.bias + self.leaf[tree, at - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray = MONOTONE, n_trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, l2: float = 1.0) -> Trees:
    """Second-order boosting on quantile bins. A split against a feature's direction is not taken, and the
    children of a split on a constrained feature are held to either side of the mean of their values."""
    p = float(np.clip(y.mean(), 0.01, 0.99))
    bias = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, leaves))
    margin = np.full(len(x), bias)
    for t in range(n_trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, np.maximum(q * (1 - q), 1e-6)
        at, low, high = np.zeros(len(x), np.int64), np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            low[2 * node + 1 : 2 * node + 3], high[2 * node + 1 : 2 * node + 3] = low[node], high[node]
            best = (1e-6, -1, 0, 0.0, 0.0)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j, e in enumerate(edges):
                if not len(e) or len(rows) < 10:
                    continue
                left_g = np.cumsum(np.bincount(code[rows, j], g[rows], len(e) + 1))[:-1]
                left_h = np.cumsum(np.bincount(code[rows, j], h[rows], len(e) + 1))[:-1]
                vl = np.clip(left_g / (left_h + l2), low[node], high[node])
                vr = np.clip((total_g - left_g) / (total_h - left_h + l2), low[node], high[node])
                gain = left_g * vl - 0.5 * (left_h + l2) * vl**2 + (total_g - left_g) * vr - 0.5 * (total_h - left_h + l2) * vr**2
                gain = np.where((left_h < 0.5) | (total_h - left_h < 0.5) | ((vr - vl) * monotone[j] < 0), -np.inf, gain)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], j, k, vl[k], vr[k])
            _, j, k, vl, vr = best
            if j >= 0:
                feature[t, node], cut[t, node] = j, edges[j][k]
                if monotone[j]:
                    mid = (vl + vr) / 2
                    side = (2 * node + 1, 2 * node + 2) if monotone[j] < 0 else (2 * node + 2, 2 * node + 1)
                    low[side[0]], high[side[1]] = max(low[side[0]], mid), min(high[side[1]], mid)
                at[rows] = 2 * node + 1 + (x[rows, j] > edges[j][k])
            else:
                at[rows] = 2 * node + 1
        for i in range(leaves):
            rows = at == inner + i
            v = g[rows].sum() / (h[rows].sum() + l2)
            leaf[t, i] = rate * float(np.clip(v, low[inner + i], high[inner + i]))
        margin = margin + leaf[t, at - inner]
    return Trees(feature, cut, leaf, bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, quality) of at most `sample` labelled documents outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    picked = (labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
              .where(fold % 5 != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # `sample` rows of two numbers


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Trees | None:
    """Trees from a bounded sample of labelled documents; None where it has not both classes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b):
                _, x = statistics(Words(data, offsets))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    found = arrow_map(labelled_sample(docs, labels, sample), rows, f"doc_id {id_type(docs)}, quality int, x array<double>")
    one = found.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).select("doc_id", "r.*").collect()  # at most `sample` rows
    one.sort(key=lambda r: r.doc_id)
    y = np.array([r.quality for r in one], float)
    if not 0 < y.sum() < len(y):
        return None
    return train(np.array([r.x for r in one]), y)


def quality_rules(docs: DataFrame, model: Trees | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b):
                counts, x = statistics(Words(data, offsets))
                bad = base_failed(counts)
                score = np.ones(hi - lo) if model is None else model.score(x)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(bad), pa.array(~bad & (score >= threshold)), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    schema = f"doc_id {id_type(docs)}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return arrow_map(docs.select("doc_id", "text"), rows, schema)


def keep_good(docs: DataFrame, model: Trees | None, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that pass, with all their columns: one pass, no join."""
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b):
                counts, x = statistics(Words(data, offsets))
                good = ~base_failed(counts)
                if model is not None:
                    good &= model.score(x) >= threshold
                yield b.slice(lo, hi - lo).filter(pa.array(good))

    return arrow_map(docs.select(*names), rows, docs.schema)

