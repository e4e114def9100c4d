"""Sources and texts are read and cut once: as many readings as there are passes, with the rows of the column functions."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.errors import UnsupportedLanguage
from tessera.operators import changes, chunking, embedding, extract
from tessera.plans.engine import Engine

#: Declarations of all sizes, white space and signs beyond ASCII, blank lines between and within, and files without any.
BODY = "\n".join(f"  const a{i} = b + c ** {i}; // word word \x1c <=> ﻿ x" for i in range(40))
FILES = [
    ("a.ts", "typescript", "export function one() {\n  return 1;\n}\nfunction two() {}\n\n\n\n\n\nfunction three() { return `${one()}`; }"),
    ("b.ts", "typescript", f"class Große {{\n  method() {{\n{BODY}\n  }}\n}}\n" + "function f() {\r\n}\n" * 30),
    ("c.rb", "ruby", "module M\n  def é\n  end\n  def ok?\n    1 <=> 2\n  end\nend\n"), ("d.js", "javascript", "a.b = function () {}; const x = (y) => y // 😀 tail"),
    ("e.ts", "typescript", "  \n\t"), ("f.ts", "typescript", ""), ("g.ts", "typescript", None), ("h.py", "python", "def a(): pass")
]
SHAPE = "path string, language string, content string"


@pytest.mark.parametrize(("most", "merge"), [(250, True), (20, True), (20, False), (1 << 30, False)])
def test_source_chunks_are_those_of_column_functions(spark, most, merge):
    """one pass of a file gives its hash and the chunks that its nodes split and merged in columns have."""
    files = spark.createDataFrame(FILES, SHAPE)
    made = chunking.source_chunks(files, most, merge, size=50)
    got = chunking.stored_chunks(made.where("seq is not null"))
    want = chunking.chunks(extract.nodes_by_file(extract.extract_nodes(files)), most, merge)
    assert got.dtypes == want.dtypes
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() > 8
    first = made.where("coalesce(seq, 0) = 0").select("path", F.col("file_hash").alias("hash"))
    assert sorted(first.collect()) == sorted(changes.snapshot(files).collect())
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(UnsupportedLanguage):
        extract.parse("def a(): pass", "python")


def counted(df, seen):
    """df, whose rows are counted as they are read."""

    def rows(parts):
        for b in parts:
            seen.add(len(b))
            yield pa.RecordBatch.from_arrays(b.columns, b.schema.names)

    return df.mapInArrow(rows, df.schema)


def test_a_source_is_read_once_by_index_and_twice_by_reindex(spark, tmp_path):
    """an index reads sources once; a reindex reads them for their hashes, and again where some changed."""
    rows = [(f"src/{i}.ts", f"function f{i}() {{ return {i}; }}") for i in range(20)]
    frame = lambda x, seen: counted(spark.createDataFrame(x, "path string, content string").coalesce(1), seen)
    seen = [spark.sparkContext.accumulator(0) for _ in range(3)]
    e = Engine(spark, f"file://{tmp_path}", f"file://{tmp_path}/store", sources=frame(rows, seen[0]))
    assert e.index() == {"files": 20, "chunks": 20, "success": True} and seen[0].value == 20
    e.sources = frame(rows, seen[1])
    assert e.reindex()["processed"] == 0 and seen[1].value == 20
    changed = [(p, c + " // more" if p == "src/3.ts" else c) for p, c in rows[1:]] + [("src/new.ts", "function g() {}"), ("src/none.ts", "")]
    e.sources = frame(changed, seen[2])
    assert e.reindex() == {"added": 2, "modified": 1, "deleted": 1, "processed": 3} and seen[2].value == 42
    names = {r.path: r.symbol_name for r in e.collections.scan(e.name).collect()}
    assert names == {"src/new.ts": "g"} | {f"src/{i}.ts": f"f{i}" for i in range(1, 20)}
    assert e.reindex()["processed"] == 0  # a file without chunks is in the snapshot


def test_places_of_words_beyond_the_kept_ones(spark):
    """The offline embedder gives a word the same place whether it is kept or not."""
    kept, few = embedding._Places(16), embedding._Places(16, most=1)
    words = ["alpha", "beta", "x" * 100, "beta", "x" * 100]
    assert [kept[w] for w in words] == [few[w] for w in words] and len(few) == 1 and len(kept) == 2


def test_changes_are_found_once(spark, tmp_path, monkeypatch):
    """what a reindex finds changed is written: the snapshots are compared once, not for each use."""
    seen, diff = spark.sparkContext.accumulator(0), changes.diff
    monkeypatch.setattr(changes, "diff", lambda old, new: counted(diff(old, new), seen))
    rows = [(f"src/{i}.ts", f"function f{i}() {{ return {i}; }}") for i in range(20)]
    frame = lambda x: spark.createDataFrame(x, "path string, content string")
    e = Engine(spark, f"file://{tmp_path}", f"file://{tmp_path}/store", sources=frame(rows))
    e.index()
    e.sources = frame([(p, c + ";") for p, c in rows[:5]] + rows[5:18])
    assert e.reindex() == {"added": 0, "modified": 5, "deleted": 2, "processed": 5} and seen.value == 7
    assert e.collections.scan(e.name).count() == 18


def test_words_of_the_offline_embedder(spark):
    """words come from byte tables and Arrow kernels: those of lower-cased texts split at what is no ASCII letter or digit."""
    odd = ["\u0130\u0130ab", "\u212ak9", "fooBarBaz aBcD", "x_y-zab", "", " \x1c\x00abc\u00a0def", "stra\u00dfe", "\U0001f600ABC", "ABCdEf"]
    assert {chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and any(ord(x) < 128 for x in chr(c).lower())} == set("\u0130\u212a")
    words, text, word = embedding._word_table(odd)
    got = [[words[w] for t, w in zip(text, word, strict=True) if t == i and len(words[w]) > 2] for i in range(len(odd))]
    assert got == [re.findall("[a-z0-9]{3,}", re.sub("([a-z])([A-Z])", r"\1 \2", t).lower()) for t in odd]
    assert embedding.hash_model(8)([]) == [] and embedding.hash_model(8)([""]) == [[0.0] * 8]
