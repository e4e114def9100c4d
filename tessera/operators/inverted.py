"""Keyword index: terms of each language with their document frequency, and postings with tf-idf scores.

Words are counted inside their row, in Arrow batches; a document's language is a corpus of its own, as idf needs.

Defined results: null and empty texts have no terms but count as documents; a null language is one
language; rows that repeat an id are documents of their own; stop words and words of fewer than three
letters are no terms; the score of a term that all documents hold is 0."""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from tessera.functions import fixed
from tessera.session import ship

#: Terms in more than 1 / FREQUENT of all postings are broadcast: fewer than FREQUENT.
FREQUENT = 10_000
#: Rows that a task makes before it sends them on.
ROWS = 50_000
#: Documents between two looks at how many postings a task holds.
STEP = 256
#: The words of functions.text.plain_words: runs of ASCII word characters, of three or more.
WORD = re.compile("[A-Za-z0-9_]{3,}")


def words_of(text: str) -> list[str]:
    """Lower-cased words of a text that may be terms, in order."""
    return [w for w in map(str.lower, WORD.findall(text)) if w not in _STOP]


_STOP = frozenset(fixed.SCORED_STOP_WORDS)


def counted(text: str) -> tuple[Counter, int]:
    """The places of each of words_of, and of all."""
    words = WORD.findall(text.lower() if text.isascii() else text)
    counts = Counter(words if text.isascii() else map(str.lower, words))
    return counts, len(words) - sum(counts.pop(w, 0) for w in _STOP)


def term_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, term, n (its places) and size (words that are terms) of docs (doc_id, lang, text)."""
    rows_in = docs.select("doc_id", "lang", "text")
    schema = StructType(rows_in.schema.fields[:2]).add("term", StringType()).add("n", LongType()).add("size", IntegerType())

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            at: list[int] = []
            terms: list[str] = []
            n: list[int] = []
            size: list[int] = []

            def out(b=b) -> pa.RecordBatch:
                own = [b.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)]
                made = [pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(size, pa.int32())]
                return pa.RecordBatch.from_arrays([*own, *made], schema.names)

            for i, text in enumerate(b.column(2)):
                words = words_of(text.as_py() or "")
                counts = Counter(words)
                at.extend([i] * len(counts))
                terms.extend(counts.keys())
                n.extend(counts.values())
                size.extend([len(words)] * len(counts))
                if len(at) >= ROWS:
                    yield out()
                    at, terms, n, size = [], [], [], []
            if at:
                yield out()

    ship(docs.sparkSession)
    return rows_in.mapInArrow(rows, schema)


def blocks(docs: DataFrame, most: int = 1_000_000, long: int = 64) -> DataFrame:
    """Postings of docs (doc_id, lang, text) brought together: lang, term, and the doc_ids, n and sizes (as term_counts has them) of
    at most `long` documents.

    A task brings together what it has of a term before it sends that on, `most` postings at a time: a term goes through the
    shuffle once for many documents, not once for each."""
    rows_in = docs.select("doc_id", "lang", "text")
    schema = StructType().add("lang", rows_in.schema["lang"].dataType).add("term", StringType()).add("doc_ids", ArrayType(rows_in.schema["doc_id"].dataType))
    schema = schema.add("n", ArrayType(IntegerType())).add("sizes", ArrayType(IntegerType()))

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []  # of the documents read since rows were last made
        read = 0
        known: dict = {}  # numbers of the terms of each language, from 0 in order of their first places
        number = count()
        code, n, sizes, many = array("i"), array("i"), array("i"), array("i")

        def out() -> Iterator[pa.RecordBatch]:
            codes = np.frombuffer(code, np.int32)
            order = np.argsort(codes, kind="stable")  # documents of a term stay in order
            at = np.repeat(np.arange(read), np.frombuffer(many, np.int32))[order]
            # a block starts with a term, and after each `long` of its documents
            sorted_ = codes[order]
            fresh = np.flatnonzero(np.diff(sorted_, prepend=-1))
            place = np.arange(len(order)) - np.repeat(fresh, np.diff(fresh, append=len(order)))
            starts = np.flatnonzero(place % long == 0)
            own = sorted_[starts]
            held = [(lang, term) for lang, of in known.items() for term in of]
            names = np.empty(len(held), np.int64)
            names[np.fromiter((c for of in known.values() for c in of.values()), np.int64, len(held))] = np.arange(len(held))
            lang, term = (pa.array([x[i] for x in held], pa.string()).take(pa.array(names[own])) for i in (0, 1))
            all_ids = pa.concat_arrays(ids).take(pa.array(at))
            values = (all_ids, *(pa.array(np.frombuffer(x, np.int32)[order]) for x in (n, sizes)))
            bounds = np.append(starts, len(order)).astype(np.int32)
            for lo in range(0, len(starts), ROWS):
                hi = min(lo + ROWS, len(starts))
                a, z = bounds[lo], bounds[hi]
                lists = [pa.ListArray.from_arrays(pa.array(bounds[lo : hi + 1] - a), v.slice(a, z - a)) for v in values]
                yield pa.RecordBatch.from_arrays([lang.slice(lo, hi - lo), term.slice(lo, hi - lo), *lists], schema.names)

        for b in parts:
            for lo in range(0, len(b), STEP):
                part = b.slice(lo, STEP)
                ids.append(part.column(0))
                read += len(part)
                for lang, text in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    counts, size = counted(text.as_py() or "")
                    if lang not in known:
                        known[lang] = defaultdict(number.__next__)
                    code.extend(map(known[lang].__getitem__, counts))
                    n.extend(counts.values())
                    sizes.extend(repeat(size, len(counts)))
                    many.append(len(counts))
                if len(code) >= most:
                    yield from out()
                    ids, read, known, number = [], 0, {}, count()
                    code, n, sizes, many = array("i"), array("i"), array("i"), array("i")
        if code:
            yield from out()

    ship(docs.sparkSession)
    return rows_in.mapInArrow(rows, schema)


def block_terms(docs: DataFrame, held: DataFrame) -> DataFrame:
    """terms() of the blocks of docs."""
    return _with_idf(held.groupBy("lang", "term").agg(F.sum(F.size("doc_ids")).alias("df")), docs)


def block_postings(held: DataFrame, known: DataFrame) -> DataFrame:
    """postings() of blocks, in ranges of languages and terms and in their order: blocks are shuffled once, and what a term's blocks
    add up to is its df.

    A term with many postings is broadcast with its df; its blocks may lie in several partitions, by their first document."""
    total = known.agg(F.sum("df")).first()[0] or 0
    lang = F.coalesce("lang", F.lit("\0"))  # no language is one, too
    often = known.where(F.col("df") > total / FREQUENT).select(lang.alias("__l"), F.col("term").alias("__t"), F.col("df").alias("__df"))
    documents = known.groupBy(lang.alias("__of")).agg(F.max("documents").alias("documents"))  # one row a language, as there are folders
    marked = held.join(F.broadcast(often), (lang == F.col("__l")) & (F.col("term") == F.col("__t")), "left")
    marked = marked.withColumn("__part", F.when(F.col("__df").isNotNull(), F.col("doc_ids")[0])).drop("__l", "__t")
    near = marked.repartitionByRange("lang", "term", "__part").sortWithinPartitions("lang", "term", "__part", F.col("doc_ids")[0])
    own = F.sum(F.size("doc_ids")).over(W.partitionBy("lang", "term", "__part"))
    found = near.withColumn("df", F.coalesce("__df", own)).join(F.broadcast(documents), lang == F.col("__of"))
    found = found.withColumn("__idf", F.log(F.col("documents") / F.col("df")))
    rows = found.select("lang", "term", "df", "__idf", "n", "sizes", F.posexplode("doc_ids").alias("__i", "doc_id"))
    n, size = F.get("n", F.col("__i")), F.get("sizes", F.col("__i"))
    return rows.select("lang", "term", "doc_id", n.cast("long").alias("n"), (n / size * F.col("__idf")).alias("score"), "df")


def terms(docs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """lang, term, df, documents (of the language) and idf; counts may be those of docs, if they are kept."""
    counted = (term_counts(docs) if counts is None else counts).groupBy("lang", "term").agg(F.count("*").alias("df"))
    return _with_idf(counted, docs)


def _with_idf(counted: DataFrame, docs: DataFrame) -> DataFrame:
    held = docs.groupBy("lang").agg(F.count("*").alias("documents")).select(F.col("lang").alias("of"), "documents")
    met = counted.join(held, F.col("lang").eqNullSafe(F.col("of")))
    return met.select("lang", "term", "df", "documents", F.log(F.col("documents") / F.col("df")).alias("idf"))


def postings(counts: DataFrame, known: DataFrame) -> DataFrame:
    """lang, term, doc_id, n, score and df of counted documents, for the terms of their languages.

    Terms with many postings are broadcast, and their rows, most of all, meet them where they are; only the others are
    shuffled to their terms."""
    total = known.agg(F.sum("df")).first()[0] or 0
    lang = F.coalesce("lang", F.lit("\0"))  # no language is one, too
    few = known.select(lang.alias("__l"), F.col("term").alias("__t"), "df", "idf")
    often, seldom = few.where(F.col("df") > total / FREQUENT), few.where(F.col("df") <= total / FREQUENT)
    met = (lang == F.col("__l")) & (F.col("term") == F.col("__t"))
    rare = counts.join(F.broadcast(often.select("__l", "__t")), met, "left_anti")
    rows = counts.join(F.broadcast(often), met).unionByName(rare.join(seldom, met))
    return rows.select("lang", "term", "doc_id", "n", (F.col("n") / F.col("size") * F.col("idf")).alias("score"), "df")
