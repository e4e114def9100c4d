"""Token-budgeted chunking of one text or of ordered nodes, as folds inside a row: no shuffle.

Where a chunk starts depends on all before it, so the fold runs over small numbers only: token
counts of lines give the first line of each piece, and contents are sliced out afterwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from tessera.functions import fixed
from tessera.functions import text as T
from tessera.operators import extract
from tessera.session import ship


once = T.once


def _ints() -> Column:
    return F.array().cast("array<int>")


def tokens_of(lines: Column) -> Column:
    return F.transform(lines, lambda line: T.count_tokens(line))


def line_tokens(text: Column) -> Column:
    return tokens_of(F.split(text, "\n"))


def piece_starts(tokens: Column, most: int) -> Column:
    """First line (from 0) of each piece: a line that would go over the budget starts one, unless its piece is empty."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("at"), _ints().alias("starts"))

    def step(a: Column, t: Column) -> Column:
        over = (a["at"] == 0) | (a["sum"] + t > most)
        return F.struct(
            F.when(over, t).otherwise(a["sum"] + t).alias("sum"), (a["at"] + 1).alias("at"),
            F.when(over, F.array_append(a["starts"], a["at"])).otherwise(a["starts"]).alias("starts")
        )

    return F.aggregate(tokens, start, step, lambda a: a["starts"])


def split_lines(text: Column, first_line: Column, most: int = 250) -> Column:
    """array<struct<content, start_line, end_line>>: a text over the budget cut at line ends; a longer line stays whole."""
    piece = lambda lines, a, n: F.struct(
        F.array_join(F.slice(lines, a + 1, n), "\n").alias("content"), (first_line + a).alias("start_line"),
        (first_line + a + n - 1).alias("end_line")
    )

    def pieces(lines: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(lines)))
        return F.zip_with(starts, ends, lambda a, b: piece(lines, a, b - a))

    return once(F.split(text, "\n"), lambda lines: once(piece_starts(tokens_of(lines), most), lambda starts: pieces(lines, starts)))


WORD, NOT_SPACE = re.compile("[A-Za-z0-9_]{3,}"), re.compile(f"[^{fixed.SPACE[1:]}+")
#: White space beyond ASCII; of ASCII, bytes.split knows the same.
WIDE_SPACE = re.compile("".join(["[", *(c for c in map(chr, range(128, 1 << 16)) if re.match(fixed.SPACE, c)), "]"]))
PUNCTUATION, OPERATORS = (bytes(i for i in range(128) if re.match(signs, chr(i))) for signs in (fixed.PUNCTUATION, fixed.OPERATORS))
_STOP = frozenset(fixed.CHUNK_STOP_WORDS)


def _sizes(text: str) -> tuple[int, int]:
    """Words with punctuation marks, and operator signs of a text: its tokens are the first and half of the second."""
    raw = text.encode()
    words = len(NOT_SPACE.findall(text)) if not text.isascii() and WIDE_SPACE.search(text) else len(raw.split())
    return words + len(raw) - len(raw.translate(None, PUNCTUATION)), len(raw) - len(raw.translate(None, OPERATORS))


def _pieces(text: str, most: int) -> Iterator[tuple[int, int, int, int, str]]:
    """First and last line, words, signs and content of each piece of split_lines. A line end is white space, so words and signs of lines add up."""
    lines = text.split("\n")
    first, used, words, signs = 0, 0, 0, 0
    for i, line in enumerate(lines):
        w, s = _sizes(line)
        if i > first and used + w + s // 2 > most:
            yield first, i - 1, words, signs, "\n".join(lines[first:i])
            first, used, words, signs = i, 0, 0, 0
        used, words, signs = used + w + s // 2, words + w, signs + s
    yield first, len(lines) - 1, words, signs, "\n".join(lines[first:])


def _chunk_words(text: str, most: int = 10) -> list[str]:
    """functions.text.chunk_keywords: a text is read until it has so many."""
    found: dict[str, None] = {}
    for m in WORD.finditer(text):
        w = m.group().lower()
        if w not in _STOP:
            found[w] = None
            if len(found) == most:
                break
    return list(found)


def text_pieces(df: DataFrame, text: str = "text", most: int = 250, step: int = 256) -> DataFrame:
    """df without its texts, with a row a piece of split_lines: seq, start_line, end_line (from 1), tokens, keywords, hash
    (SHA-256) and content. A null text has one row, whose seq is null. Texts are read once, in Arrow batches, without a shuffle."""
    own = [c for c in df.columns if c != text]
    rows_in = df.select(*own, text)
    schema = StructType(rows_in.schema.fields[:-1])
    for name in ("seq", "start_line", "end_line", "tokens"):
        schema = schema.add(name, IntegerType())
    schema = schema.add("keywords", ArrayType(StringType())).add("hash", StringType()).add("content", StringType())
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string())

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for lo in range(0, len(whole), step):
                b, at, made = whole.slice(lo, step), [], []
                for i, value in enumerate(b.column(len(own))):
                    x = value.as_py()
                    if x is None:
                        at.append(i), made.append((None, None, None, 0, None, None, None))
                        continue
                    for seq, (a, z, w, s, content) in enumerate(_pieces(x, most)):
                        at.append(i), made.append((seq, a + 1, z + 1, w + s // 2, _chunk_words(content), hashlib.sha256(content.encode()).hexdigest(), content))
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.select(range(len(own))).take(pa.array(at, pa.int64())).columns, *columns], schema.names)

    ship(df.sparkSession)
    return rows_in.mapInArrow(rows, schema)


def split_overlapping(text: Column, most: int = 250, overlap: int = 50) -> Column:
    """array<string>: as split_lines, but each piece begins with the last ceil(overlap / 10) lines of the one before."""
    return F.transform(overlapping_pieces(text, most, overlap), lambda x: x["content"])


def overlapping_pieces(text: Column, most: int = 250, overlap: int = 50) -> Column:
    """array<struct<content, start_line, end_line>> of split_overlapping, lines from 1."""
    back = -(-overlap // 10)
    none = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("a"), F.lit(0).alias("at"), none.alias("out"))

    def spans(tokens: Column) -> Column:
        def step(x: Column, t: Column) -> Column:
            over = (x["at"] > x["a"]) & (x["sum"] + t > most)
            from_ = F.greatest(x["a"], x["at"] - back)
            kept = F.aggregate(F.slice(tokens, from_ + 1, x["at"] - from_), F.lit(0), lambda s, v: s + v)
            return F.struct(
                F.when(over, kept + t).otherwise(x["sum"] + t).alias("sum"), F.when(over, from_).otherwise(x["a"]).alias("a"), (x["at"] + 1).alias("at"),
                F.when(over, F.array_append(x["out"], F.struct(x["a"].alias("a"), x["at"].alias("b")))).otherwise(x["out"]).alias("out"))

        return F.aggregate(tokens, start, step, lambda x: F.array_append(x["out"], F.struct(x["a"].alias("a"), x["at"].alias("b"))))

    cut = lambda lines: F.transform(
        once(tokens_of(lines), spans),
        lambda s: F.struct(
            F.array_join(F.slice(lines, s["a"] + 1, s["b"] - s["a"]), "\n").alias("content"), (s["a"] + 1).alias("start_line"),
            s["b"].alias("end_line")
        )
    )
    return once(F.split(text, "\n"), cut)


#: Fields of a node or chunk in an array.
NODE = "struct<type:string,name:string,content:string,start_line:int,end_line:int,start_char:int,end_char:int>"


def split_nodes(nodes: Column, most: int = 250) -> Column:
    """Nodes (array of NODE) with those over the budget cut at line ends; type, name and characters stay the node's."""

    def one(n: Column) -> Column:
        pieces = F.transform(split_lines(n["content"], n["start_line"], most), lambda p: F.struct(
            n["type"].alias("type"), n["name"].alias("name"), p["content"].alias("content"), p["start_line"].cast("int").alias("start_line"),
            p["end_line"].cast("int").alias("end_line"), n["start_char"].alias("start_char"), n["end_char"].alias("end_char")))
        return F.when(T.count_tokens(n["content"]) <= most, F.array(n).cast(f"array<{NODE}>")).otherwise(pieces.cast(f"array<{NODE}>"))

    return F.flatten(F.transform(nodes, one))


def merge_starts(nodes: Column, most: int = 250, gap: int = 3) -> Column:
    """Index (from 0) of the first node of each group: neighbours merge within the budget and a gap of lines."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("at"), F.lit(0).alias("end"), _ints().alias("starts"))

    sizes = F.transform(nodes, lambda n: F.struct(T.count_tokens(n["content"]).alias("t"), n["start_line"].alias("start_line"), n["end_line"].alias("end_line")))

    def step(a: Column, n: Column) -> Column:
        t = n["t"]  # counted once a node: the fold names it four times
        new = (a["at"] == 0) | (a["sum"] + t > most) | (n["start_line"] - a["end"] > gap)
        return F.struct(F.when(new, t).otherwise(a["sum"] + t).alias("sum"), (a["at"] + 1).alias("at"), n["end_line"].alias("end"),
                        F.when(new, F.array_append(a["starts"], a["at"])).otherwise(a["starts"]).alias("starts"))

    return F.aggregate(sizes, start, step, lambda a: a["starts"])


def merge_nodes(nodes: Column, most: int = 250, gap: int = 3) -> Column:
    """Nodes with small neighbours merged: contents joined by a blank line, names by a comma, ends of the last node."""

    def group(x: Column) -> Column:
        part = F.slice(nodes, x["a"] + 1, x["b"] - x["a"])
        first, last = F.element_at(part, 1), F.element_at(part, -1)
        names = F.filter(F.transform(part, lambda n: n["name"]), lambda n: n.isNotNull() & (n != ""))
        return F.struct(first["type"].alias("type"), F.array_join(names, ", ").alias("name"), F.array_join(F.transform(part, lambda n: n["content"]), "\n\n").alias("content"),
                        first["start_line"].alias("start_line"), last["end_line"].alias("end_line"), first["start_char"].alias("start_char"), last["end_char"].alias("end_char"))

    def groups(starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(nodes)))
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), group)

    return F.when(F.size(nodes) > 0, once(merge_starts(nodes, most, gap), groups)).otherwise(F.array().cast(f"array<{NODE}>"))


def chunks(files: DataFrame, most: int = 250, merge: bool = True, strategy: str = "ast-split-merge") -> DataFrame:
    """One row a chunk, for files with path, language and nodes (array of NODE in order)."""
    found = files.withColumn("__c", split_nodes(F.col("nodes"), most))
    if merge:
        found = found.withColumn("__c", merge_nodes(F.col("__c"), most))
    kept = [c for c in ("path", "language", "last_modified") if c in files.columns]
    # outer: for an inner one Spark tests the array's size below the join, with all that makes it written into every use of it
    found = found.select(*kept, F.posexplode_outer("__c").alias("seq", "c")).where("seq is not null")
    return found.select(
        T.chunk_id(F.col("path"), F.col("c.start_line"), F.col("c.end_line")).alias("id"), *kept, "seq", F.col("c.content").alias("content"),
        F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"), F.col("c.start_char").alias("start_char"), F.col("c.end_char").alias("end_char"),
        F.col("c.type").alias("chunk_type"), F.lit(strategy).alias("granularity"), F.col("c.name").alias("symbol_name"), F.col("c.type").alias("symbol_type"),
        T.chunk_keywords(F.col("c.content")).alias("keywords"), T.count_tokens(F.col("c.content")).alias("token_count"))


def _source_chunks(nodes: list[dict], most: int, merge: bool, gap: int = 3) -> list[tuple]:
    """SOURCE_CHUNK of the nodes of one file: what split_nodes and merge_nodes make of them, each text counted once."""
    pieces = []
    for n in nodes:
        words, signs = _sizes(n["content"])
        if words + signs // 2 <= most:
            pieces.append((n, n["start_line"], n["end_line"], words, signs, n["content"]))
        else:
            pieces += ((n, n["start_line"] + a, n["start_line"] + z, *x) for a, z, *x in _pieces(n["content"], most))
    groups, used = [], 0
    for p in pieces:
        t = p[3] + p[4] // 2
        if merge and groups and used + t <= most and p[1] - groups[-1][-1][2] <= gap:
            groups[-1].append(p)
            used += t
        else:
            groups.append([p])
            used = t
    out = []
    for seq, g in enumerate(groups):
        first, last, content = g[0], g[-1], "\n\n".join(p[5] for p in g)
        name = ", ".join(p[0]["name"] for p in g if p[0]["name"])
        out.append((
            seq, content, first[1], last[2], first[0]["start_char"], last[0]["end_char"], first[0]["type"], name, _chunk_words(content),
            sum(p[3] for p in g) + sum(p[4] for p in g) // 2
        ))
    return out


#: Columns of a chunk that source_chunks makes.
SOURCE_CHUNK = {
    "seq": (IntegerType(), pa.int32()), "content": (StringType(), pa.string()), "start_line": (IntegerType(), pa.int32()),
    "end_line": (IntegerType(), pa.int32()), "start_char": (IntegerType(), pa.int32()), "end_char": (IntegerType(), pa.int32()),
    "chunk_type": (StringType(), pa.string()), "symbol_name": (StringType(), pa.string()),
    "keywords": (ArrayType(StringType()), pa.list_(pa.string())), "token_count": (IntegerType(), pa.int32())
}


def source_chunks(files: DataFrame, most: int = 250, merge: bool = True, size: int = 4 << 20) -> DataFrame:
    """files (path, language, content and others) without their contents, with file_hash (as changes.snapshot has it) and a row
    a chunk of extract_nodes, split_nodes and merge_nodes; a file without chunks, or one that fails, has one row whose seq is null.

    A file is read once, in Arrow batches; nothing is shuffled. A task holds a batch of files and about `size` characters of chunks."""
    own = [c for c in files.columns if c != "content"]
    rows_in, language = files.select(*own, "content"), own.index("language")
    schema = StructType(rows_in.schema.fields[:-1]).add("file_hash", StringType())
    for name, (kind, _) in SOURCE_CHUNK.items():
        schema = schema.add(name, kind)
    kinds = (pa.string(), *(kind for _, kind in SOURCE_CHUNK.values()))
    none = (None,) * len(SOURCE_CHUNK)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            at, made, held = [], [], 0

            def out(b=b) -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)]
                return pa.RecordBatch.from_arrays([*b.select(range(len(own))).take(pa.array(at, pa.int64())).columns, *columns], schema.names)

            for i, (value, kind) in enumerate(zip(b.column(len(own)), b.column(language), strict=True)):
                content = value.as_py()
                try:
                    found = _source_chunks(extract.parse(content or "", kind.as_py()), most, merge)
                except Exception:  # as in extract_nodes: a file that fails must not end the job
                    found = []
                key = "" if content is None else hashlib.sha256(content.encode()).hexdigest()
                for c in found or [none]:
                    at.append(i), made.append((key, *c))
                held += len(content or "")
                if held >= size:
                    yield out()
                    at, made, held = [], [], 0
            if at:
                yield out()

    ship(files.sparkSession)
    return rows_in.mapInArrow(rows, schema)


def stored_chunks(rows: DataFrame, strategy: str = "ast-split-merge", *others: str) -> DataFrame:
    """Rows of source_chunks with the columns that chunks() gives them, and others that they have."""
    kept = [c for c in ("path", "language", "last_modified", *others) if c in rows.columns]
    return rows.select(
        T.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line")).alias("id"), *kept, "seq", "content", "start_line", "end_line",
        "start_char", "end_char", "chunk_type", F.lit(strategy).alias("granularity"), "symbol_name", F.col("chunk_type").alias("symbol_type"),
        "keywords", "token_count"
    )


def window_nodes(files: DataFrame, most: int = 250, overlap: int = 50) -> DataFrame:
    """path, language and nodes: overlapping windows of lines over whole files, which no declaration bounds."""
    node = lambda x: F.struct(
        F.lit("window").alias("type"), F.lit("").alias("name"), x["content"].alias("content"),
        x["start_line"].cast("int").alias("start_line"), x["end_line"].cast("int").alias("end_line"), F.lit(0).alias("start_char"),
        F.lit(0).alias("end_char")
    )
    return files.withColumn("nodes", F.transform(overlapping_pieces(F.col("content"), most, overlap), node).cast(f"array<{NODE}>"))


def chunks_by(strategy: str, files: DataFrame, nodes: DataFrame, most: int = 250, overlap: int = 50, distinct: bool = False) -> DataFrame:
    """Chunks of files (path, language, content) with their nodes (path, language, nodes) by a named strategy.

    All three names split and merge nodes, as the configuration promises no more; with `distinct`, "ast-extract" keeps
    each node as it is and "sliding-window" cuts windows of lines instead."""
    if distinct and strategy == "sliding-window":
        windows = window_nodes(files, most, overlap)
        return chunks(windows.where("content <> ''"), 1 << 30, merge=False, strategy=strategy)
    if distinct and strategy == "ast-extract":
        return chunks(nodes, 1 << 30, merge=False, strategy=strategy)
    return chunks(nodes, most, strategy=strategy)
