"""Embedding of texts with a model server: packed requests, a window of them in flight, answers in
order, and a table of vectors by content so that no text is embedded twice.

A request holds at most `max_texts` texts and `max_tokens` tokens and never mixes groups. A task packs
its rows in their order and keeps `in_flight` requests under way; rows leave in the order they came,
whatever the order of the answers. A task holds the rows of its window and no more.

Defined results: a null text, and one over the model's own limit for a text, is not sent and has a null
vector, an error, and no request; a request that keeps failing has null vectors and its error, the
others go on; an answer with too few or too many vectors is an error; an empty table gives an empty
result. Columns of df are kept; those added are named embedding, error, request, place and together.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from tessera import errors
from tessera.functions import text as T
from tessera.session import give_back, ship

#: A model: texts to their vectors, in the order of the texts or as (place, vector) in any order.
Model = Callable[[Sequence[str]], Sequence]


def retry(call: Callable, tries: int = 3, wait: float = 1.0, most: float = 10.0, sleep: Callable = time.sleep):
    """Call until it succeeds: up to `tries` times, waiting twice as long each time. Errors that cannot pass end it at once."""
    for i in range(tries):
        try:
            return call()
        except Exception as e:
            if i == tries - 1 or (isinstance(e, errors.EngineError) and not e.retryable):
                raise
            sleep(min(wait * 2**i, most))


def in_order(answer: Sequence, n: int) -> list[list[float]]:
    """n vectors, put back by the places that an answer names, if it does."""
    pairs = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(answer)]
    if sorted(i for i, _ in pairs) != list(range(n)):
        raise ValueError(f"{len(pairs)} vectors for {n} texts")
    return [v for _, v in sorted(pairs, key=lambda x: x[0])]


class Pace:
    """At most so many calls a second, evenly apart."""

    def __init__(self, per_second: float | None):
        self.gap, self.next = (1 / per_second if per_second else 0.0), 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if self.next > now:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def packed(tokens: list[int | None], groups: list, max_texts: int, max_tokens: int, state: list) -> list[int | None]:
    """Number of each row's request, rows in order: the open one, or a new one where a limit or the group ends it.

    state: number, texts, tokens and group of the open request; it goes on over calls."""
    out: list[int | None] = []
    for n, group in zip(tokens, groups, strict=True):
        if n is None:
            out.append(None)
            continue
        if state[1] and (state[1] == max_texts or state[2] + n > max_tokens or state[3] != group):
            state[:3] = state[0] + 1, 0, 0
        state[1], state[2], state[3] = state[1] + 1, state[2] + n, group
        out.append(state[0])
    return out


def embed_requests(df: DataFrame, model: Model, text: str = "content", max_texts: int = 2048, max_tokens: int = 300_000, text_tokens: int | None = 8192,
                   in_flight: int = 4, per_second: float | None = None, group: str | None = None, tries: int = 3, wait: float = 1.0, tokens: str | None = None) -> DataFrame:
    """df with embedding, error, request (its number in its task), place in it, and the number of texts together in it.

    `per_second` is the limit of requests of the whole job: each task that can run at a time gets its share.
    `text_tokens` is the model's own limit for a text; None is for a model that has none. `tokens` names a column that
    has the tokens of each text; without it they are counted."""
    spark = df.sparkSession
    share = per_second / max(1, spark.sparkContext.defaultParallelism) if per_second else None
    limit_error = lambda n: str(errors.TokenLimitExceeded(n, text_tokens, "embedding"))
    own = df.columns
    rows_in = df.withColumns({
        "__tokens": F.when(F.col(text).isNotNull(), F.col(tokens) if tokens else T.count_tokens(F.col(text))), "__group": F.col(group) if group else F.lit(0)
    })
    added = {"embedding": ArrayType(FloatType()), "error": StringType(), "request": LongType(), "place": IntegerType(), "together": IntegerType()}
    schema = StructType([*df.schema.fields, *(StructField(n, t) for n, t in added.items())])
    at = own.index(text)

    def ask(texts: list[str]) -> list[list[float]]:
        return retry(lambda: in_order(model(texts), len(texts)), tries, wait)

    def finished(run: list[tuple[pa.RecordBatch, list]], answers: dict[int, tuple[Future, int]]) -> Iterator[pa.RecordBatch]:
        for b, marks in run:
            vectors, faults, places, many = [], [], [], []
            for number, place, fault in marks:
                if number is None:
                    vectors.append(None), faults.append(fault), places.append(None), many.append(None)
                    continue
                future, n = answers[number]
                e = future.exception()
                vectors.append(None if e else future.result()[place]), faults.append(str(e) if e else None), places.append(place), many.append(n)
            new = [
                pa.array(vectors, pa.list_(pa.float32())), pa.array(faults, pa.string()), pa.array([m[0] for m in marks], pa.int64()),
                pa.array(places, pa.int32()), pa.array(many, pa.int32())
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], *new], schema.names)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace, state = Pace(share), [0, 0, 0, None]
        waiting: deque[tuple[pa.RecordBatch, list]] = deque()  # rows that have not left, in order
        answers: dict[int, tuple[Future, int]] = {}
        open_texts: list[str] = []

        def send(number: int) -> None:
            pace.wait()
            answers[number] = pool.submit(ask, list(open_texts)), len(open_texts)
            open_texts.clear()

        def leave(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            while waiting:
                needed = {m[0] for m in waiting[0][1]} - {None}
                if not all_of_it and (len(answers) <= in_flight or not needed <= answers.keys()):
                    return
                for number in needed:
                    answers[number][0].exception()  # waits
                yield from finished([waiting.popleft()], answers)
                still = {m[0] for _, marks in waiting for m in marks}
                for number in needed - still - {state[0]}:
                    del answers[number]

        with ThreadPoolExecutor(in_flight) as pool:
            for b in parts:
                texts, tokens, groups = (b.column(i).to_pylist() for i in (at, len(own), len(own) + 1))
                sizes = [n if n is not None and (text_tokens is None or n <= text_tokens) else None for n in tokens]
                lo, marks = 0, []
                for i, size in enumerate(sizes):
                    before = state[0]
                    number = packed([size], [groups[i]], max_texts, max_tokens, state)[0]
                    if state[0] != before:  # the open request is full
                        waiting.append((b.slice(lo, i - lo), marks))
                        lo, marks = i, []
                        send(before)
                        yield from leave(False)
                    if number is None:
                        marks.append((None, None, "no text" if tokens[i] is None else limit_error(tokens[i])))
                    else:
                        marks.append((number, len(open_texts), None))
                        open_texts.append(texts[i])
                waiting.append((b.slice(lo), marks))
            if open_texts:
                send(state[0])
            yield from leave(True)
        give_back()

    ship(spark)
    return rows_in.mapInArrow(rows, schema)


class _Places(dict):
    """A word's dimension; from `dims` on, the one that it is taken from. The first `most` short words are kept: frequent ones come early."""

    def __init__(self, dims: int, most: int = 300_000):
        super().__init__()
        self.dims, self.most = dims, most

    def __missing__(self, word: str) -> int:
        number = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")
        place = number % self.dims + (number // self.dims % 2) * self.dims
        if len(word) <= 64 and len(self) < self.most:
            self[word] = place
        return place


@lru_cache
def _places(dims: int) -> _Places:
    """The places that a worker keeps."""
    return _Places(dims)


#: The letters beyond ASCII whose lower case has one of ASCII; lower-case letters and digits, and a space for all other bytes.
_LOWER = re.compile("[\u0130\u212a]")
_PLAIN = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in bytes(range(256)).lower())
_CAMEL = "([a-z])([A-Z])"


def _word_table(texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct lower-cased words and parts of identifiers of texts, and of each place in them its text and word; among the words
    are some of fewer than three letters."""
    spaced = pc.replace_substring_regex(pa.array(texts, pa.string()), _CAMEL, r"\1 \2").to_pylist()
    plain = [(t.lower() if _LOWER.search(t) else t).encode().translate(_PLAIN) for t in spaced]
    found = pc.ascii_split_whitespace(pa.array(plain, pa.binary()).cast(pa.string()))
    words = found.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(found).to_numpy())
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), text, words.indices.to_numpy()


def hash_model(dims: int = 64) -> Model:
    """The offline embedder of functions.vectors.hash_embed as a model: unit vectors of hashed words."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        known, (words, text, word) = _places(dims), _word_table(texts)
        place = np.array([known[w] if len(w) > 2 else -1 for w in words], np.int64)[word]
        at = (text * 2 * dims + place)[place >= 0]
        counts = np.bincount(at, minlength=len(texts) * 2 * dims).reshape(len(texts), 2 * dims)
        out = (counts[:, :dims] - counts[:, dims:]).astype(np.float64)
        size = np.sqrt((out**2).sum(axis=1))
        return (out / np.where(size == 0, 1, size)[:, None]).tolist()

    return embed


# ---- vectors by content ----------------------------------------------------------------------


def content_key(content) -> F.Column:
    return F.sha2(content.cast("binary"), 256)


def missing(contents: DataFrame, cache: DataFrame | None, key: str = "hash") -> DataFrame:
    """One row of each content (key and others) that the cache has no vector for.

    Keys of the cache are first cut to those asked for, so where these are few, Spark can broadcast them and
    the cache is only scanned (its key column alone), not shuffled."""
    once = contents.dropDuplicates([key])
    if cache is None:
        return once
    known = cache.select(key).join(contents.select(key).distinct(), key, "left_semi")
    return once.join(known, key, "left_anti")


def uses(rows: DataFrame, key: str = "hash") -> DataFrame:
    """key and the number of rows that hold that content."""
    return rows.groupBy(key).agg(F.count("*").alias("uses"))


def unused(cache: DataFrame, rows: DataFrame, key: str = "hash") -> DataFrame:
    """Rows of the cache that no row refers to: what a mark pass would remove."""
    return cache.join(rows.select(key).distinct(), key, "left_anti")
