"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages: equal runs of at most `passage` words, as many as its text has.
Every passage is encoded from its own statistics; gated attention weights, learned from
document labels alone, weigh the passages, and the weighted representation is scored: sums over steps of
passages, whatever their number.

Training reads a bounded sample (`sample` labelled documents, least hash first; those whose
crc32(doc_id) mod 5 is 0 are held out), and of a document of over `passages` passages as many at
equal distances; nothing is left out of a score. labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts are one passage of zeros and get a score like any other;
repeated rows are scored each; without labels of both classes every score is the share of
label 1 (0.5 without labels); doc_id may have any type.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, id_type, text_chunks
from tessera.llm.quality_rules import DIGIT, PUNCT, SHOUT, SYMBOLS, UPPER, labelled_sample
from tessera.llm.textnum import WORD_BASE, Sequence, Words, mix

N_HASHED = 16
N_INPUTS = 12 + N_HASHED


def bags(words: Words, passage: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of every passage of a chunk of documents, and the first passage of each document (and one past the last)."""
    n_words = words.n_words
    count = np.maximum(-(-n_words // passage), 1)
    first = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(doc)) - first[doc]
    lo = words.first[doc] + k * n_words[doc] // count[doc]
    hi = words.first[doc] + (k + 1) * n_words[doc] // count[doc]
    size = np.maximum(hi - lo, 1)

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1)
        np.cumsum(values, out=sums[1:])
        return sums[hi] - sums[lo]

    def of_bytes(flags: np.ndarray) -> np.ndarray:
        """Sum of a flag over the bytes of each word."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[words.ends] - sums[words.starts]

    hashes = words.hashes()
    n = len(hashes)
    passage_of = np.repeat(np.arange(len(doc)), hi - lo)
    length = of_bytes((words.data & 0xC0) != 0x80)
    chars = np.maximum(total(length), 1)
    symbol = of_bytes(SYMBOLS[words.data])
    same = np.zeros(n, bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (passage_of[1:] == passage_of[:-1])

    def repeated(width: int) -> np.ndarray:
        """Share of windows that stand elsewhere in the passage."""
        at = np.arange(max(n - width + 1, 0))
        at = at[passage_of[at] == passage_of[at + width - 1]]
        raw = mix((Sequence(hashes, WORD_BASE).spans(at, at + width) if width > 1 else hashes) ^ mix(passage_of[at].astype(np.uint64)))
        order = np.argsort(raw)
        key = raw[order]
        twin = np.zeros(len(key) + 1, bool)
        twin[1:-1] = key[1:] == key[:-1]
        again = np.zeros(n)
        again[at[order]] = twin[1:] | twin[:-1]
        return total(again) / size

    x = np.empty((len(doc), N_INPUTS), np.float32)
    x[:, 0] = np.log1p(hi - lo) / 4
    x[:, 1] = chars / size / 8
    x[:, 2] = total(symbol) / chars * 4
    x[:, 3] = total((symbol > 0) & (length == 1)) / size * 4
    x[:, 4] = total(of_bytes(UPPER[words.data])) / chars * 2
    x[:, 5] = total(of_bytes(DIGIT[words.data])) / chars * 4
    x[:, 6] = total(of_bytes(PUNCT[words.data])) / size * 2
    x[:, 7] = total(of_bytes(SHOUT[words.data])) / size * 2
    x[:, 8] = total(same) / size * 4
    x[:, 9] = repeated(1) * 1
    x[:, 10] = repeated(3) * 2
    x[:, 11] = np.log1p(n_words[doc]) / 8
    bucket = (hashes >> np.uint64(60)).astype(np.int64)
    x[:, 12:] = (np.bincount(passage_of * N_HASHED + bucket, minlength=len(doc) * N_HASHED).reshape(len(doc), N_HASHED) / size[:, None]) * 2
    return x, first


def bounded(x: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bags of at most `most` passages: those of a larger one at equal distances."""
    count = np.diff(first)
    few = np.minimum(count, most)
    new = np.concatenate([[0], np.cumsum(few)])
    doc = np.repeat(np.arange(len(count)), few)
    k = np.arange(len(doc)) - new[doc]
    return x[first[doc] + k * count[doc] // few[doc]], new


@dataclass
class Attention:
    """Encoder, gated attention and scorer; fit() is Adam on the log loss of bags."""

    width: int = 16
    seed: int = 0
    p: dict[str, np.ndarray] = field(default_factory=dict)
    rate: float = 0.5  # share of label 1, the score without a fit

    def _start(self) -> None:
        r = np.random.default_rng(self.seed)
        shapes = {"W": (N_INPUTS, self.width), "b": (self.width,), "V": (self.width, self.width), "U": (self.width, self.width), "w": (self.width,), "c": (self.width,), "d": ()}
        self.p = {k: r.normal(0, 0.5 / np.sqrt(s[0]) if s else 0.1, s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}

    def _encode(self, x: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return h, t, g, (t * g) @ p["w"]

    def _forward(self, x: np.ndarray, first: np.ndarray):
        p, starts = self.p, first[:-1]
        h, t, g, e = self._encode(x)
        n = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        a = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        q = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return h, t, g, a, z, q

    def score(self, x: np.ndarray, first: np.ndarray, step: int = 4096) -> np.ndarray:
        """Scores of bags of any size: softmax sums of each bag, carried on from step to step of the passages."""
        n = len(first) - 1
        if not self.p:
            return np.full(n, self.rate)
        top, total, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, self.width))
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            ids = np.arange(np.searchsorted(first, lo, side="right") - 1, np.searchsorted(first, lo + len(part)))
            starts = np.maximum(first[ids] - lo, 0)
            h, _, _, e = self._encode(part)
            new = np.maximum(top[ids], np.maximum.reduceat(e, starts))
            a = np.exp(e - np.repeat(new, np.diff(np.append(starts, len(part)))))
            keep = np.exp(top[ids] - new)
            total[ids] = total[ids] * keep + np.add.reduceat(a, starts)
            z[ids] = z[ids] * keep[:, None] + np.add.reduceat(a[:, None] * h, starts, axis=0)
            top[ids] = new
        return 1 / (1 + np.exp(-np.clip((z / total[:, None]) @ self.p["c"] + self.p["d"], -30, 30)))

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 25, batch: int = 64, step: float = 0.01) -> Attention:
        self._start()
        r = np.random.default_rng(self.seed + 1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        i = 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for lo in range(0, len(y), batch):
                ids = order[lo : lo + batch]
                size = first[ids + 1] - first[ids]
                f = np.concatenate([[0], np.cumsum(size)])
                rows = np.repeat(first[ids] - f[:-1], size) + np.arange(f[-1])
                grads = self._grads(x[rows], f, y[ids])
                i += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    lr = step * (1 - epoch / epochs)
                    self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.999**i)) + 1e-8)
        return self

    def _grads(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, np.diff(first)
        h, t, g, a, z, q = self._forward(x, first)
        dz = (q - y) / len(y)
        dh_bag = np.repeat(dz, n)[:, None] * p["c"]
        da = (dh_bag * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), n))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dh_bag + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh + 1e-5 * p["W"], "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dz + 1e-5 * p["c"], "d": dz.sum()}


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, passage: int = 64, passages: int = 64) -> Attention:
    """A model from a bounded sample: at most `sample` bags of at most `passages` passages reach the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b):
                x, first = bounded(*bags(Words(data, offsets), passage), passages)
                blobs = [x[first[i] : first[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(blobs, pa.binary())], ["doc_id", "quality", "x"])

    found = arrow_map(labelled_sample(docs, labels, sample), rows, f"doc_id {id_type(docs)}, quality int, x binary")
    one = found.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).select("doc_id", "r.*").collect()
    one.sort(key=lambda r: r.doc_id)
    y = np.array([float(r.quality == 1) for r in one])
    if not 0 < y.sum() < len(y):
        return Attention(rate=float(y.mean()) if len(y) else 0.5)
    each = [np.frombuffer(bytes(r.x), np.float32).reshape(-1, N_INPUTS) for r in one]
    return Attention(rate=float(y.mean())).fit(np.concatenate(each), np.concatenate([[0], np.cumsum([len(e) for e in each])]), y)


def score(docs: DataFrame, model: Attention, threshold: float = 0.3, passage: int = 64) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b):
                s = model.score(*bags(Words(data, offsets), passage))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(s.astype(np.float64)), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = arrow_map(docs.select("doc_id", "text"), rows, f"doc_id {id_type(docs)}, score double, predicted int")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
