"""Text functions as column expressions: tokens, keywords, scores of terms, queries, hashes."""

from __future__ import annotations

import re
from itertools import chain
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed

SPACES = fixed.SPACE + "+"


def _literals(words: Iterable[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def without(words: Column, stop: Iterable[str]) -> Column:
    """Words that are in no stop list, in order, repeats kept."""
    stops = _literals(stop)
    return F.filter(words, lambda w: ~F.array_contains(stops, w))


def count_tokens(text: Column) -> Column:
    """Words by white space, one for each punctuation mark, one for each two operator signs. `<` and `>` are both."""
    words = F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))
    return F.coalesce(
        words + F.regexp_count(text, F.lit(fixed.PUNCTUATION)) + F.floor(F.regexp_count(text, F.lit(fixed.OPERATORS)) / 2).cast("int"),
        F.lit(0)
    )


def exceeds_limit(text: Column, limit: int) -> Column:
    return count_tokens(text) > limit


def truncate_to_limit(text: Column, limit: int) -> Column:
    """The text, or as many of its characters as the share of tokens within the limit."""
    tokens = count_tokens(text)
    return F.when(tokens <= limit, text).otherwise(F.substring(text, F.lit(1), F.floor(F.length(text) * (F.lit(float(limit)) / tokens)).cast("int")))


def tokens_from_chars(chars: Column) -> Column:
    return F.ceil(chars / 4)


def chars_from_tokens(tokens: Column) -> Column:
    return tokens * 4


def plain_words(text: Column) -> Column:
    """Lower-cased ASCII words of three letters or more, in order."""
    cleaned = F.lower(F.regexp_replace(text, r"[^\w\s]", " "))
    return F.filter(F.split(cleaned, r"\s+"), lambda w: F.length(w) > 2)


def word_parts(text: Column) -> Column:
    """Lower-cased words and parts of identifiers of three letters or more, in order, repeats kept."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda w: F.length(w) > 2)


def chunk_keywords(text: Column, most: int = 10) -> Column:
    """The first distinct words of a chunk that are no stop words."""
    return F.slice(without(F.array_distinct(plain_words(text)), fixed.CHUNK_STOP_WORDS), 1, most)


def candidate_keywords(text: Column) -> Column:
    """Distinct words that may be scored keywords, in order."""
    return without(F.array_distinct(plain_words(text)), fixed.SCORED_STOP_WORDS)


def raw_words(text: Column) -> Column:
    """Lower-cased text split at white space: empty ends count, punctuation stays on words."""
    return F.split(F.lower(text), SPACES)


def term_frequency(term: Column, raw: Column) -> Column:
    """Share of raw words that equal the term."""
    return F.size(F.filter(raw, lambda w: w == term)) / F.size(raw)


def once(value: Column, use) -> Column:
    """use(value) with value computed once: a name in a lambda, where a column used twice would be computed twice."""
    return F.transform(F.array(value), use)[0]


def runs(ordered: Column, same) -> Column:
    """array<struct<first, n>> of the runs of an ordered array whose elements agree in same(element). Linear in the array."""
    place = lambda a: F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))
    new = lambda a: F.filter(place(a), lambda i: (i == 1) | (same(F.get(a, i - 1)) != same(F.get(a, i - 2))))
    after = lambda a, starts: F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(a) + 1))
    made = lambda a: once(
        new(a),
        lambda starts: F.zip_with(
            starts, F.slice(after(a, starts), F.lit(1), F.size(starts)),
            lambda s, e: F.struct(F.get(a, s - 1).alias("first"), (e - s).alias("n"))
        )
    )
    return once(ordered, made)


def word_counts(words: Column) -> Column:
    """array<struct<first, n>> of distinct words, in order of the words: sorted once, so linear but for that; of null none."""
    return runs(F.array_sort(words), lambda w: w)


def scored_words(raw: Column, plain: Column) -> Column:
    """array<struct<word, pos, score>>: each distinct cleaned word that may be a keyword, its first place, and its share of the raw words.

    Raw and cleaned words are sorted together, a raw word before its equal, so a row's words are counted where the
    row is: no explosion, no shuffle, and no comparison of all words with all others."""
    wanted = lambda w: (F.length(w) > 2) & ~w.isin(*fixed.SCORED_STOP_WORDS)
    counted = F.transform(F.filter(raw, wanted), lambda w: F.struct(w.alias("word"), F.lit(-1).alias("pos")))
    places = F.transform(plain, lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    both = F.array_sort(F.concat(counted, F.filter(places, lambda x: wanted(x["word"]))))
    kinds = runs(both, lambda x: F.struct(x["word"], x["pos"] >= 0))

    def scored(found: Column) -> Column:
        before = lambda x, i: F.get(found, i - 1)
        n = lambda x, i: F.when((i > 0) & (before(x, i)["first"]["word"] == x["first"]["word"]), before(x, i)["n"]).otherwise(0)
        out = F.transform(
            found,
            lambda x, i: F.struct(x["first"]["word"].alias("word"), x["first"]["pos"].alias("pos"), (n(x, i) / F.size(raw)).alias("score"))
        )
        return F.filter(out, lambda x: x["pos"] >= 0)

    return once(kinds, scored)


def scored_keywords(text: Column, most: int = 10) -> Column:
    """array<struct<keyword, score>> by term frequency; words that tie keep their order."""
    raw = raw_words(text)
    scored = F.transform(candidate_keywords(text), lambda w, i: F.struct((-term_frequency(w, raw)).alias("s"), i.alias("i"), w.alias("w")))
    return F.slice(F.transform(F.array_sort(scored), lambda x: F.struct(x["w"].alias("keyword"), (-x["s"]).alias("score"))), 1, most)


#: What identifier keywords leave out, in the order of removal.
_IGNORED = (r"(?m)//.*$", r"/\*[\s\S]*?\*/", r"(?m)#.*$", r'"[^"]*"', r"'[^']*'", r"`[^`]*`")


def identifier_words(text: Column) -> Column:
    """Parts of identifiers (camelCase and snake_case split), lower case, without comments, strings and stop words; repeats kept."""
    for pattern in _IGNORED:
        text = F.regexp_replace(text, pattern, "")
    names = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0))
    parts = F.flatten(F.transform(names, lambda n: F.split(F.regexp_replace(n, "([a-z])([A-Z])", "$1 $2"), r"[_\s]+")))
    return F.filter(without(F.transform(parts, lambda p: F.lower(p)), fixed.IDENTIFIER_STOP_WORDS), lambda w: F.length(w) > 2)


def frequent_words(words: Column, most: int = 10) -> Column:
    """The most frequent words; those that tie keep the order of their first places."""
    counted = F.transform(
        F.array_distinct(words), lambda w, i: F.struct((-F.size(F.filter(words, lambda x: x == w))).alias("n"), i.alias("i"), w.alias("w"))
    )
    return F.slice(F.transform(F.array_sort(counted), lambda x: x["w"]), 1, most)


def identifier_keywords(text: Column, most: int = 10) -> Column:
    return frequent_words(identifier_words(text), most)


def keyword_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two keyword lists, case ignored; 0 for two empty lists."""
    a, b = (F.array_distinct(F.transform(x, lambda w: F.lower(w))) for x in (a, b))
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def keyword_score(query: Column, chunk: Column) -> Column:
    """Share of query keywords that some chunk keyword contains; 0 without query keywords."""
    lower = F.transform(chunk, lambda c: F.lower(c))
    hits = F.size(F.filter(query, lambda q: F.exists(lower, lambda c: c.contains(F.lower(q)))))
    return F.coalesce(hits / F.nullif(F.size(query), F.lit(0)), F.lit(0.0))


def vector_weight(query: Column) -> Column:
    """Weight of the vector score: code-like queries 0.8, longer questions 0.6, others 0.7."""
    code = query.rlike(fixed.CODE_SYNTAX) | query.rlike(fixed.QUERY_OPERATORS) | query.rlike("[a-z][A-Z]") | query.contains("_")
    return F.when(code, 0.8).when(F.size(F.split(query, SPACES)) > 3, 0.6).otherwise(0.7)


def keyword_weight(query: Column) -> Column:
    code = query.rlike(fixed.CODE_SYNTAX) | query.rlike(fixed.QUERY_OPERATORS) | query.rlike("[a-z][A-Z]") | query.contains("_")
    return F.when(code, 0.2).when(F.size(F.split(query, SPACES)) > 3, 0.4).otherwise(0.3)


def preprocess_column(query: Column) -> Column:
    """preprocess_query() for a column of queries."""
    out = F.regexp_replace(F.regexp_replace(query, SPACES, " "), "^ | $", "")
    for short, long in fixed.ABBREVIATIONS:
        out = F.regexp_replace(out, rf"(?i)(?<![A-Za-z0-9_]){short}(?![A-Za-z0-9_])", long)
    return out


def preprocess_query(query: str) -> str:
    """One space between words, and abbreviations in full."""
    out = re.sub(fixed.SPACE + "+", " ", query).strip()
    for short, long in fixed.ABBREVIATIONS:
        out = re.sub(rf"\b{short}\b", long, out, flags=re.IGNORECASE | re.ASCII)
    return out


def expand_query(query: str) -> list[str]:
    """The query, then each word with its synonyms, alone and among the other words; without repeats."""
    words = re.split(fixed.SPACE + "+", query.lower())
    out = [query]
    for word in words:
        out.append(word)
        others = [w for w in words if w != word]
        for synonym in fixed.SYNONYMS.get(word, ()):
            out += [synonym, " ".join([synonym, *others])] if others else [synonym]
    return list(dict.fromkeys(out))


def expand_column(query: Column) -> Column:
    """expand_query() for a column of queries: an array of texts."""
    known = F.create_map(*chain.from_iterable((F.lit(k), F.array(*map(F.lit, v))) for k, v in fixed.SYNONYMS.items()))

    def forms(words: Column) -> Column:
        def one(word: Column) -> Column:
            others = F.filter(words, lambda w: w != word)
            with_synonym = lambda s: F.when(F.size(others) > 0, F.array(s, F.concat_ws(" ", s, others))).otherwise(F.array(s))
            return F.concat(F.array(word), F.coalesce(F.flatten(F.transform(known[word], with_synonym)), F.array().cast("array<string>")))

        return F.flatten(F.transform(words, one))

    return F.array_distinct(F.concat(F.array(query), F.transform(F.array(F.split(F.lower(query), SPACES)), forms)[0]))


def search_variations(query: str) -> list[str]:
    processed = preprocess_query(query)
    return list(dict.fromkeys([query, processed, *expand_query(processed)]))


def variations_column(query: Column) -> Column:
    """search_variations() for a column of queries: an array of texts."""
    return once(preprocess_column(query), lambda q: F.array_distinct(F.concat(F.array(query, q), expand_column(q))))


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def string_hash(text: Column, algorithm: str = "sha256") -> Column:
    raw = text.cast("binary")
    if algorithm in ("md5", "sha1"):
        return {"md5": F.md5, "sha1": F.sha1}[algorithm](raw)
    return F.sha2(raw, int(algorithm.removeprefix("sha")))


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    """`chunk-` and the 32-bit string hash of `path:start:end` in base 36."""
    key = F.concat_ws(":", path, start.cast("string"), end.cast("string"))
    wrap = lambda h: F.pmod(h + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    chars = F.filter(F.split(key, ""), lambda c: c != "")
    code = F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + F.ascii(c)))
    return F.concat(F.lit("chunk-"), F.lower(F.conv(F.abs(code).cast("string"), 10, 36)))


def tenths(x: Column) -> Column:
    """A double of 0 or more, moved to the nearest tenth where it is next to the middle of two: as C's printf rounds, by its
    exact binary value, a tie to the even digit. (Java rounds its shortest decimal form, and ties up; elsewhere both agree.)

    20 times the fraction is summed from two parts of 26 bits, of which no product or sum is rounded; an odd whole is a tie."""
    whole = F.floor(x).cast("double")
    fraction = x - whole
    high = F.floor(fraction * (1 << 26)).cast("double") / (1 << 26)
    rest = 20 * high - F.floor(20 * high) + 20 * (fraction - high)
    twice, over = F.floor(20 * high) + F.floor(rest), rest > F.floor(rest)
    half = F.floor(twice / 2)
    up = (twice % 2 == 1) & (over | (half % 2 == 1))
    near = (F.abs(x * 20 - F.rint(x * 20)) <= x * 20 / float(1 << 50)) & (x < float(1 << 52))
    return F.when(near, (whole * 10 + half + up.cast("int")) / 10).otherwise(x)


def format_duration(ms: Column) -> Column:
    ms = ms.cast("double")
    return (F.when(ms < 1000, F.format_string("%.0fms", F.rint(ms))).when(ms < 60_000, F.format_string("%.1fs", tenths(ms / 1000)))
            .when(ms < 3_600_000, F.format_string("%.1fm", tenths(ms / 60_000))).otherwise(F.format_string("%.1fh", tenths(ms / 3_600_000))))


def snippet(text: Column, form: str = "hybrid") -> Column:
    """What a result shows of its content."""
    lines = F.split(text, "\n")
    if form == "snippet":
        return F.array_join(F.slice(lines, 1, 10), "\n")
    if form == "hybrid":
        return F.when(F.size(lines) <= 20, text).otherwise(F.concat(F.array_join(F.slice(lines, 1, 15), "\n"), F.lit("\n... (truncated)")))
    return text


def context(text: Column, form: str = "hybrid") -> Column:
    return text if form == "context" else F.lit(None).cast("string")


def dependencies(text: Column, language: Column) -> Column:
    """Distinct modules that a source file names, in order of pattern and place."""
    found = lambda pattern, group=1: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    script = F.concat(found(r"""import\s+.*\s+from\s+['"]([^'"]+)['"]"""), found(r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""))
    ruby = F.concat(found(r"""require\s+['"]([^'"]+)['"]"""), found(r"""require_relative\s+['"]([^'"]+)['"]"""))
    pattern = r"(?:from\s+(\S+)\s+)?import\s+(\S+)"
    python = F.filter(
        F.flatten(F.transform(F.arrays_zip(found(pattern, 1).alias("a"), found(pattern, 2).alias("b")), lambda x: F.array(x["a"], x["b"]))),
        lambda x: x != ""
    )
    kind = F.lower(language)
    none = F.array().cast("array<string>")
    return F.array_distinct(F.when(kind.isin("typescript", "javascript"), script).when(kind == "ruby", ruby).when(kind == "python", python).otherwise(none))


def total_tokens(texts: Column) -> Column:
    """Tokens of an array of texts."""
    return F.aggregate(F.transform(texts, count_tokens), F.lit(0), lambda a, n: a + n)


def lines_between(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1, both included)."""
    return F.array_join(F.slice(F.split(text, "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def line_and_column(text: Column, offset: Column) -> Column:
    """struct<line, column> of a character offset: lines from 1, columns from 0."""
    before = F.substring(text, F.lit(1), offset)
    return F.struct((F.size(F.split(before, "\n"))).alias("line"), F.length(F.element_at(F.split(before, "\n"), -1)).alias("column"))


def metadata_json(metadata: Column) -> Column:
    """A metadata struct as JSON with times in ISO 8601 (UTC)."""
    return F.to_json(metadata, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "timeZone": "UTC"})


def metadata_from_json(json: Column, schema: str) -> Column:
    return F.from_json(json, schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "timeZone": "UTC"})


def display_score(score: Column) -> Column:
    return F.format_string("%.3f", score)
