"""License scans: fixed phrases, then an exact set-similarity join of text blocks with templates.

A block is a line of a text, or a stretch of words of the whole text, taken as its set of words;
a template holds in a line when the line has at least `threshold` of the template's words, and
in a stretch when one of its windows has: any run of words / threshold words (rounded up, those
of the template counted with repeats), wherever lines break. So a notice wrapped over lines, with as
many foreign words between as may be missing, is found like one on a line. Stretches
overlap by the longest window, so each window lies in one. Words are ordered by their frequency
over the blocks of all documents, rarest first. A template is indexed by its prefix, the
size - needed + 1 rarest words: a block without any of them cannot reach the threshold. Length
and positional filters drop further pairs, and the intersection decides. Other words than the
templates' cannot change an intersection, so blocks keep only those: bounded, small rows. By the
same prefix argument a whole text without any of a few telling words needs no blocks at all.

Defined results: a null text is empty; repeated rows are each reported; columns besides doc_id
and text play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

#: Base phrases, then the templates, each with its label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD + "++"), F.lit(0))


def phrase_pattern(phrase: str) -> str:
    """A phrase's words in a row, upper or lower case A-Z, with whole words at both ends."""
    return f"(?i)(?<!{WORD})" + (BREAK + "+").join(phrase.split()) + f"(?!{WORD})"


def phrase_starts(text: Column, phrase: str, possible: Column) -> Column:
    """Word positions at which a phrase starts, where that is possible at all: words of the gaps before it, and of the phrases before it."""
    size = len(phrase.split())
    counts = F.transform(F.split(text, phrase_pattern(phrase), -1), lambda g: F.size(words(g)))
    before = F.slice(counts, F.lit(1), F.size(counts) - 1)
    none = F.from_json(F.lit("[]"), "array<int>")
    starts = F.aggregate(before, F.struct(F.lit(0).alias("at"), none.alias("out")),
                         lambda a, n: F.struct((a["at"] + n + size).alias("at"), F.array_append(a["out"], a["at"] + n).alias("out")), lambda a: a["out"])
    return F.when(possible & text.rlike(phrase_pattern(phrase)), starts).otherwise(none)


def window_sizes(templates=TEMPLATES, threshold: float = 0.8) -> list[int]:
    """Words of the window in which each template is looked for."""
    return [math.ceil(len(text.split()) / threshold - 1e-9) for text, _ in templates]


def template_sets(templates=TEMPLATES, threshold: float = 0.8) -> list[tuple[int, str, frozenset[str], int]]:
    """(number, label, words, words needed) of each template."""
    sets = [(i, label, frozenset(text.split())) for i, (text, label) in enumerate(templates)]
    return [(i, label, w, math.ceil(threshold * len(w) - 1e-9)) for i, label, w in sets]


def telling_words(sets: list[tuple[int, str, frozenset[str], int]]) -> list[str]:
    """Words of which a text that holds any template has at least one, as a part of a word.

    Of each template any size - needed + 1 words do, as a prefix does: here the longest, which are seldom found by chance."""
    picked = {x for _, _, w, need in sets for x in sorted(w, key=lambda x: (-len(x), x))[: len(w) - need + 1]}
    return sorted(x for x in picked if not any(y != x and y in x for y in picked))


def blocks(docs: DataFrame, vocabulary: list[str], least: int, window: int, telling: list[str]) -> DataFrame:
    """row, doc_id, n_words, starts of each phrase, and blocks of at least `least` of the templates' words.

    A block has its words of the templates and, where it is a stretch of a text of several lines,
    its run: all its words in order, those of no template empty. A stretch starts at every
    `window` words and has 2 * window of them. A text without any of the `telling` words has no blocks, and its words are only counted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = docs.select("doc_id", text.alias("text"), F.lower(text).alias("low"))
    may_hold = reduce(lambda a, b: a | b, (F.col("low").contains(w) for w in telling))
    doc = doc.select("doc_id", "text", may_hold.alias("may"), *(reduce(lambda a, b: a & b, (F.col("low").contains(w) for w in p.split())).alias(f"q{i}") for i, (p, _) in enumerate(PHRASES)))
    no_lines = F.from_json(F.lit("[]"), "array<array<string>>")
    known = F.array(*(F.lit(w) for w in vocabulary))
    none = F.lit(None).cast("array<string>")
    doc = doc.select("doc_id", *(phrase_starts(F.col("text"), p, F.col(f"q{i}")).alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)),
                     F.when(F.col("may"), F.transform(F.split(F.translate("text", UPPER, LOWER), "\n", -1), lambda line: words(line))).otherwise(no_lines).alias("lines"),
                     F.when(~F.col("may"), F.size(words(F.col("text")))).alias("counted"))
    doc = doc.withColumn("row", F.monotonically_increasing_id()).withColumn("all", F.flatten("lines"))
    n = F.size("all")
    at = F.when(F.size(F.filter("lines", lambda w: F.size(w) > 0)) > 1, F.sequence(F.lit(0), F.floor((n - 1) / window).cast("int"))).otherwise(F.from_json(F.lit("[]"), "array<int>"))
    stretches = F.transform(at, lambda i: F.slice("all", i * window + 1, F.lit(2 * window)))
    of_lines = F.transform("lines", lambda w: F.struct(F.array_intersect(w, known).alias("words"), none.alias("run")))
    of_text = F.transform(stretches, lambda w: F.struct(F.array_intersect(w, known).alias("words"), w.alias("run")))
    enough = lambda b: F.size(b["words"]) >= least
    bare = lambda b: F.struct(b["words"].alias("words"), F.transform(b["run"], lambda w: F.when(F.array_contains(b["words"], w), w).otherwise("")).alias("run"))
    return doc.select(
        "row", "doc_id", *(f"p{i}" for i in range(len(PHRASES))), F.coalesce("counted", n).cast("long").alias("n_words"),
        F.concat(F.filter(of_lines, enough), F.transform(F.filter(of_text, enough), bare)).alias("blocks"))


def similarity_join(found: DataFrame, sets: list[tuple[int, str, frozenset[str], int]], windows: list[int]) -> DataFrame:
    """row, label and containment of every block and template that reach the threshold."""
    spark = found.sparkSession
    vocabulary = sorted(frozenset(chain.from_iterable(w for _, _, w, _ in sets)))
    block = found.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    counts = dict(block.select(F.explode("words").alias("w")).groupBy("w").count().collect())  # one row a template word
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    index = []
    for i, label, w, need in sets:
        order = sorted(w, key=rank.__getitem__)
        index += [(word, i, label, need, len(order), at, order, windows[i]) for at, word in enumerate(order[: len(order) - need + 1])]
    index = F.broadcast(spark.createDataFrame(index, "word string, template int, label string, need int, size int, at int, whole array<string>, window int"))
    ranks = F.create_map(*chain.from_iterable((F.lit(w), F.lit(i)) for w, i in rank.items()))
    prefix_words = F.array(*(F.lit(w) for w in sorted({w for _, _, s, need in sets for w in sorted(s, key=rank.__getitem__)[: len(s) - need + 1]})))
    block = block.where(F.arrays_overlap("words", prefix_words))
    block = block.withColumn("words", F.transform(F.array_sort(F.transform("words", lambda w: F.struct(ranks[w].alias("r"), w.alias("w")))), lambda x: x["w"]))
    pairs = block.select("row", "words", "run", F.posexplode("words").alias("in_block", "word")).join(index, "word")
    rest = F.least(F.col("size") - F.col("at"), F.size("words") - F.col("in_block"))
    pairs = pairs.where((F.size("words") >= F.col("need")) & (F.least("at", "in_block") + rest >= F.col("need")))  # length, position
    both = lambda w: F.size(F.array_intersect(w, F.col("whole")))
    pairs = pairs.where(both(F.col("words")) >= F.col("need"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("run") - F.col("window") + 1, F.lit(1)))
    best = F.array_max(F.transform(starts, lambda i: both(F.slice("run", i, F.col("window")))))
    pairs = pairs.withColumn("both", F.when(F.col("run").isNull(), both(F.col("words"))).otherwise(best))
    return pairs.where(F.col("both") >= F.col("need")).select("row", "label", (F.col("both") / F.col("size")).alias("containment"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    sets = template_sets(templates, threshold)
    windows = window_sizes(templates, threshold)
    vocabulary = sorted(frozenset(chain.from_iterable(w for _, _, w, _ in sets)))
    found = staged(blocks(docs, vocabulary, min(need for _, _, _, need in sets), max(windows), telling_words(sets)), "licenses")
    joined = similarity_join(found, sets, windows).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    starts = F.concat(*(F.col(f"p{i}") for i in range(len(PHRASES))))
    base = F.filter(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES))), lambda x: x.isNotNull())
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    out = found.drop("blocks").join(joined, "row", "left")
    more = F.coalesce("more", F.from_json(F.lit("[]"), "array<string>"))
    return out.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        text(base).alias("base_labels"), text(F.concat(base, more)).alias("labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
