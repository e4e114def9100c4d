"""Scored keywords of whole tables, counted inside their row in Arrow batches, for texts of any length.

The column forms in functions.text compare words within a row and suit queries and chunks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from tessera.functions import fixed
from tessera.functions import text as T
from tessera.session import ship

#: The words of functions.text.plain_words, and the breaks of raw_words.
WORD, SPACE = re.compile("[A-Za-z0-9_]{3,}"), re.compile(fixed.SPACE + "+")
_STOP = frozenset(fixed.SCORED_STOP_WORDS)


GRAM = 3


def grams(word: Column, n: int = GRAM) -> Column:
    """Distinct substrings of n characters."""
    places = F.when(F.length(word) >= n, F.sequence(F.lit(1), F.length(word) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(word, i, n)))


def containing(words: DataFrame, texts: DataFrame, word: str = "word", text: str = "run") -> DataFrame:
    """(word, text) for distinct words and the distinct texts that contain them: the rows of a `contains` join.

    Texts are posted by their trigrams, whose number grows with their lengths; a word looks up its rarest trigram
    alone, and what that names is verified. Words shorter than a trigram are looked up among the substrings of their
    length. An empty word is in every text and is left out."""
    asked, held = words.select(word).where(F.length(word) > 0).distinct(), texts.select(text).distinct()
    posted = held.select(text, F.explode(F.concat(*(grams(F.col(text), n) for n in range(1, GRAM + 1)))).alias("__g"))
    sizes = posted.groupBy("__g").agg(F.count("*").alias("__n"))
    keys = asked.select(word, F.explode(grams(F.col(word))).alias("__g")).where(F.length(word) >= GRAM)
    rarest = keys.join(sizes, "__g").groupBy(word).agg(
        F.min_by("__g", F.struct("__n", "__g")).alias("__g"), F.count("*").alias("__found"),
        F.max(F.size(grams(F.col(word)))).alias("__all")
    )
    rarest = rarest.where("__found = __all").select(word, "__g")  # a trigram that no text has rules a word out
    short = asked.where(F.length(word) < GRAM).select(word, F.col(word).alias("__g"))
    return posted.join(rarest.unionByName(short), "__g").where(F.col(text).contains(F.col(word))).select(word, text)


def document_frequency(words: DataFrame, corpus: DataFrame, key: str, text: str) -> DataFrame:
    """word and the number of corpus texts that contain it anywhere, case ignored, for distinct ASCII words.

    A word without breaks is in a text exactly if it is within one of the text's runs of word characters, so the
    distinct runs are searched (containing), not the texts."""
    runs = corpus.select(
        F.col(key).alias("__d"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\w+"), F.lit(0)))).alias("run")
    )
    within = containing(words, runs)
    return within.join(runs, "run").groupBy("word").agg(F.count_distinct("__d").alias("df"))


def _word_scores(text: str, most: int | None) -> list[tuple[str, int, float]]:
    """(word, first place among cleaned words, share of the raw words), best first."""
    raw = SPACE.split(text.lower())
    places: dict[str, int] = {}
    for i, w in enumerate(map(str.lower, WORD.findall(text))):
        if w not in _STOP:
            places.setdefault(w, i)
    n = Counter(raw)
    scored = sorted(((w, i, n[w] / len(raw)) for w, i in places.items()), key=lambda x: (-x[2], x[1]))
    return scored[:most]


def word_scores(df: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """key, word, pos, score and rank of each row's words that may be keywords (the best `most`), counted in Arrow batches.

    Nothing is shuffled; a null text has none. What functions.text.scored_words gives, for texts of any length."""
    rows_in = df.select(F.col(key), F.col(text).alias("__t"))
    schema = StructType(rows_in.schema.fields[:1]).add("word", StringType()).add("pos", IntegerType()).add("score", DoubleType()).add("rank", IntegerType())

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = b.column(1)
            for lo in range(0, len(b), 256):
                found = [(i, r, *x) for i in range(lo, min(lo + 256, len(b))) if texts[i].is_valid for r, x in enumerate(_word_scores(texts[i].as_py(), most), 1)]
                at, rank, word, pos, score = zip(*found, strict=True) if found else ([],) * 5
                own = b.column(0).take(pa.array(at, pa.int64()))
                made = [pa.array(word, pa.string()), pa.array(pos, pa.int32()), pa.array(score, pa.float64()), pa.array(rank, pa.int32())]
                yield pa.RecordBatch.from_arrays([own, *made], schema.names)

    ship(df.sparkSession)
    return rows_in.mapInArrow(rows, schema)


def scored_keywords(df: DataFrame, key: str, text: str, most: int = 10, corpus: DataFrame | None = None) -> DataFrame:
    """key, keyword, score and rank: term frequency, times ln(N / df) over a corpus with the same columns, if given.

    Words are counted inside their row; without a corpus nothing is shuffled."""
    if corpus is None:
        return word_scores(df, key, text, most).select(key, F.col("word").alias("keyword"), "score", "rank")
    words = word_scores(df, key, text).drop("rank")
    total = corpus.agg(F.count("*").alias("total"))
    df_of = document_frequency(words.select("word"), corpus, key, text)
    idf = df_of.join(F.broadcast(total), F.lit(True)).select("word", F.log(F.col("total") / F.col("df")).alias("idf"))
    scored = words.join(idf, "word", "left").withColumn("score", F.col("score") * F.coalesce("idf", F.lit(0.0)))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col("score").desc(), F.col("pos")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select(key, F.col("word").alias("keyword"), "score", "rank")


#: functions.text.identifier_words: what is left out, in this order; a comment ends where Java ends a line.
_LINE = "[^\n\r\x85  ]*"
_IGNORED = tuple(map(re.compile, ("//" + _LINE, r"/\*[\s\S]*?\*/", "#" + _LINE, '"[^"]*"', "'[^']*'", "`[^`]*`")))
_NAME, _CAMEL, _BREAK = re.compile("(?<![A-Za-z0-9_])[a-zA-Z_][a-zA-Z0-9_]*"), re.compile("([a-z])([A-Z])"), re.compile("[_ ]+")
_NO_IDENTIFIER = frozenset(fixed.IDENTIFIER_STOP_WORDS)


@lru_cache(maxsize=100_000)
def _parts(name: str) -> tuple[str, ...]:
    found = _BREAK.split(_CAMEL.sub(r"\1 \2", name).lower())
    return tuple(w for w in found if len(w) > 2 and w not in _NO_IDENTIFIER)


def _identifier_counts(text: str, most: int | None) -> list[tuple[str, int, int]]:
    """(word, first place, number) of the parts of a text's identifiers, the most frequent first."""
    for pattern in _IGNORED:
        text = pattern.sub("", text)
    words = [w for name in _NAME.findall(text) for w in (_parts(name) if len(name) <= 64 else _parts.__wrapped__(name))]
    places: dict[str, int] = {}
    for i, w in enumerate(words):
        places.setdefault(w, i)
    n = Counter(words)
    return sorted(((w, i, n[w]) for w, i in places.items()), key=lambda x: (-x[2], x[1]))[:most]


def identifier_counts(df: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """key, word, pos, n and rank of the parts of each row's identifiers (the `most` most frequent), counted in Arrow batches: nothing is shuffled."""
    rows_in = df.select(F.col(key), F.col(text).alias("__t"))
    schema = StructType(rows_in.schema.fields[:1]).add("word", StringType()).add("pos", IntegerType()).add("n", LongType()).add("rank", IntegerType())

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for lo in range(0, len(whole), 256):
                b = whole.slice(lo, 256)
                found = [(i, r, *x) for i, t in enumerate(b.column(1)) if t.is_valid for r, x in enumerate(_identifier_counts(t.as_py(), most), 1)]
                at, rank, word, pos, n = zip(*found, strict=True) if found else ([],) * 5
                made = [pa.array(word, pa.string()), pa.array(pos, pa.int32()), pa.array(n, pa.int64()), pa.array(rank, pa.int32())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *made], schema.names)

    ship(df.sparkSession)
    return rows_in.mapInArrow(rows, schema)


def identifier_keywords(df: DataFrame, key: str, text: str, most: int = 10, corpus: DataFrame | None = None) -> DataFrame:
    """key, keyword and rank of parts of identifiers, by frequency or, with a corpus, by positive tf-idf.

    Words are counted inside their row. Without a corpus nothing else is done, unless keys repeat: then the counts of rows
    with the same key are added up."""
    if corpus is None and df.groupBy(key).count().where(F.col("count") > 1).isEmpty():
        return identifier_counts(df, key, text, most).select(key, F.col("word").alias("keyword"), "rank")
    counted = identifier_counts(df, key, text).groupBy(key, "word").agg(F.sum("n").alias("n"), F.min("pos").alias("pos"))
    if corpus is None:
        scored = counted.withColumn("score", F.col("n").cast("double"))
    else:
        total = corpus.agg(F.count("*").alias("total"))
        idf = document_frequency(counted.select("word"), corpus, key, text).join(F.broadcast(total), F.lit(True)).select("word", F.log(F.col("total") / F.col("df")).alias("idf"))
        size = counted.groupBy(key).agg(F.sum("n").alias("size"))
        scored = counted.join(size, key).join(idf, "word", "left").withColumn(
            "score", F.col("n") / F.col("size") * F.coalesce("idf", F.lit(0.0))
        ).where("score > 0")
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col("score").desc(), F.col("pos")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select(key, F.col("word").alias("keyword"), "rank")
