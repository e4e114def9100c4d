"""BPE encoding and decoding with a contiguous rank array for each word.

A word is held as the boundaries of its parts and the rank of each adjacent pair of parts.
The least rank is searched, the boundary between its parts deleted, and the ranks left and
right of it refreshed, until no pair has a rank. Words are short, so plain scans of a small
list are cheap. A word of more than `LONG` symbols is merged in the same order with linked parts
and a heap of ranks, whose cost grows with its length. Results of words of at most `KEPT`
characters are held in a bounded table, cleared when full.

The vocabulary file is read on each worker from its path (a parameter); it must be at the
same path on all executors, as installed packages are.

Defined results: a null or empty text has no tokens and decodes to the empty text; symbols
that are not in the vocabulary are left out, as no unknown token is defined; repeated rows are
encoded each; other columns play no part; doc_id may have any type.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import arrow_map, id_type


#: Symbols beyond which a word is merged with a heap, and characters up to which its ids are kept.
LONG, KEPT = 200, 64
_SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class WordBPE:
    """Encoder and decoder of a vocabulary whose words end in `</w>`."""

    def __init__(self, path: str, keep: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(pair if isinstance(pair, list) else pair.split(" ")) for pair in model["merges"]]
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.far = len(pairs)
        self.rank: dict[int, int] = {}
        for i, (a, b) in enumerate(pairs):
            self.rank.setdefault((self.vocab[a] << 20) | self.vocab[b], i)
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.token = {i: t for t, i in {**self.vocab, **self.added}.items()}
        cut = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"][0]
        self.words = regex.compile(cut["pattern"]["Regex"])
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.byte = byte_symbols()
        self.keep = keep
        self.known: dict[str, str] = {}
        self.chunks: dict[str, str] = {}

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word: part boundaries, the parts' ids and the ranks of adjacent parts, merged in place."""
        symbols = [self.byte[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.end
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        if len(ids) > LONG:
            return self.long_word_ids(ids)
        starts = list(range(len(ids)))
        far, get, made = self.far, self.rank.get, self.made
        ranks = [get((ids[i] << 20) | ids[i + 1], far) for i in range(len(ids) - 1)]
        while ranks and (least := min(ranks)) != far:
            i = ranks.index(least)
            ids[i] = made[least]
            del starts[i + 1], ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i] << 20) | ids[i + 1], far)
            if i:
                ranks[i - 1] = get((ids[i - 1] << 20) | ids[i], far)
        return ids

    def long_word_ids(self, ids: list[int]) -> list[int]:
        """What word_ids makes of the ids of symbols: the least rank first, the leftmost of equals."""
        far, get, made = self.far, self.rank.get, self.made
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        ranks = [get((ids[i] << 20) | ids[i + 1], far) for i in range(n - 1)] + [far]  # of a part and the one after it
        heap = [(r, i) for i, r in enumerate(ranks) if r != far]
        heapq.heapify(heap)

        def refresh(i: int) -> None:
            j = after[i]
            ranks[i] = get((ids[i] << 20) | ids[j], far) if j >= 0 else far
            if ranks[i] != far:
                heapq.heappush(heap, (ranks[i], i))

        while heap:
            rank, i = heapq.heappop(heap)
            if ranks[i] != rank:
                continue  # merged or refreshed since
            j = after[i]
            ids[i], ranks[j] = made[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            refresh(i)
            if before[i] >= 0:
                refresh(before[i])
        return [ids[i] for i in range(n) if ranks[i] >= 0]

    def normal(self, text: str) -> str:
        """NFC, white space to one space, lower case (each character by itself)."""
        if text.isascii():
            return text.lower()
        return "".join([c.lower() for c in unicodedata.normalize("NFC", text)]) if "Σ" in text else unicodedata.normalize("NFC", text).lower()

    def _keep(self, known: dict[str, str], text: str, ids: str) -> str:
        """ids, kept for a short text; a table holds at most `keep` entries of KEPT characters."""
        if len(text) <= KEPT:
            if len(known) >= self.keep:
                known.clear()
            known[text] = ids
        return ids

    def _chunk(self, chunk: str) -> str:
        """Decimal ids of a chunk without white space."""
        known, out = self.known, []
        for w in self.words.findall(chunk):
            ids = known.get(w)
            if ids is None:
                ids = self._keep(known, w, " ".join(map(str, self.word_ids(w))))
            if ids:
                out.append(ids)
        return " ".join(out)

    def _line(self, text: str) -> list[str]:
        """Decimal ids of each chunk of a text without special tokens. Words never span white space."""
        text = self.normal(text)
        if _SEPARATORS.search(text):  # white space to str.split, but not to the vocabulary's pattern
            return [self._chunk(text)]
        known, out = self.chunks, []
        for c in text.split():
            ids = known.get(c)
            if ids is None:
                ids = self._keep(known, c, self._chunk(c))
            out.append(ids)
        return out

    def encode_line(self, text: str | None) -> str:
        """Decimal ids joined by one space."""
        if not text:
            return ""
        if self.special is None or "<|" not in text:
            return " ".join(filter(None, self._line(text)))
        out: list[str] = []
        at = 0
        for m in self.special.finditer(text):
            out += self._line(text[at : m.start()])
            out.append(str(self.added[m[0]]))
            at = m.end()
        return " ".join(filter(None, out + self._line(text[at:])))

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.encode_line(text).split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the vocabulary names no decoder."""
        return " ".join([self.token[i] for i in ids if i in self.token])


_ready: dict[str, WordBPE] = {}


def codec(path: str) -> WordBPE:
    """The codec of a file, once for each worker."""
    if path not in _ready:
        _ready[path] = WordBPE(path)
    return _ready[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array) and decoded text of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in batches:
            for lo in range(0, len(b), 256):
                texts = b.column(1).slice(lo, 256)
                ids = [bpe.encode(texts[i].as_py()) for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return arrow_map(docs.select("doc_id", "text"), rows, f"doc_id {id_type(docs)}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        name = {str(i): t for i, t in bpe.token.items()}.__getitem__
        for b in batches:
            texts, n, a, d = b.column(1), [], [], []
            for i in range(len(texts)):
                line = bpe.encode_line(texts[i].as_py())
                ids = line.split(" ") if line else []
                n.append(len(ids))
                a.append(hashlib.sha256(line.encode()).hexdigest())
                d.append(hashlib.sha256(" ".join(map(name, ids)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select("doc_id", "text"), rows, f"doc_id {id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
