"""Chunks, changes, extraction, collections, the engine and streams."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import changes, chunking, extract, search, stats
from tessera.plans import config
from tessera.operators.embedding import retry
from tessera.plans.engine import Engine, Lock, embed_with
from tessera.sources import files
from tessera.sources.collections import CollectionExists, CollectionNotFound, Collections, DimensionMismatch, Folder
from tessera.streaming import feed

NODES = f"path string, language string, nodes array<{chunking.NODE}>"


def node(name, content, a, b):
    return ("function", name, content, a, b, 0, len(content))


def test_line_pieces_rebuild_the_text_within_the_budget(spark):
    r = random.Random(1)
    texts = ["\n".join(" ".join("w" * r.randint(0, 4) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 40))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = df.select("t", chunking.split_lines(F.col("t"), F.lit(1), 20).alias("p"), chunking.line_tokens(F.col("t")).alias("n")).collect()
    for row in out:
        assert "\n".join(p.content for p in row.p) == row.t
        for p in row.p:
            assert p.end_line == p.start_line or sum(row.n[p.start_line - 1 : p.end_line]) <= 20


def test_merge_respects_budget_and_gaps(spark):
    nodes = [node("a", "x y", 1, 2), node("", "z", 5, 5), node("b", "q", 9, 9), node("c", "w " * 300, 10, 12)]
    out = spark.createDataFrame([("p", "typescript", nodes), ("e", "ruby", [])], NODES).select("path", chunking.merge_nodes(F.col("nodes")).alias("m")).collect()
    got = {r.path: r.m for r in out}
    assert [(m.name, m.start_line, m.end_line) for m in got["p"]] == [("a", 1, 5), ("b", 9, 9), ("c", 10, 12)]
    assert got["p"][0].content == "x y\n\nz" and got["e"] == []


def test_chunks_split_large_nodes(spark):
    body = "\n".join(f"let v{i} = {i};" for i in range(200))
    rows = chunking.chunks(spark.createDataFrame([("a.ts", "typescript", [node("big", body, 3, 202)])], NODES)).orderBy("seq").collect()
    assert len(rows) > 1 and rows[0].start_line == 3 and rows[-1].end_line == 202
    # the budget is on sums of lines: signs are halved line by line
    assert all(r.end_line - r.start_line + 1 <= 250 // 5 for r in rows) and all(a.end_line + 1 == b.start_line for a, b in zip(rows, rows[1:], strict=False))


SCRIPT = '''
// function no() {}
const s = "function fake() {}", t = `class ${ (() => { return "}" })() } X {}`;
export function add<T>(a: T, b: T): { x: T } { return { x: a }; }
export const mul = async (a: number, b: number): Promise<number> => a * b;
const one = x => x + 1;
export default class Store<T> extends Base {
  private items: T[] = [];
  constructor(private readonly n: number) { super(); }
  get size(): number { return this.items.length; }
  static async load(path: string): Promise<void> {
    if (path) { for (const p of [1]) { run(p); } }
    const r = /[}/]{2}/g.test(path);
  }
}
abstract class Hidden { f() { return 1; } }
interface Shape { area(): number; }
type Pair = { a: string; b: [number] } | null;
enum Color { Red }
items.map((x) => x * 2);
'''


def test_typescript_declarations():
    got = [(n["type"], n["name"]) for n in extract.parse(SCRIPT, "typescript")]
    assert got == [
        ("function", "add"), ("function", "mul"), ("function", "one"), ("class", "Store"), ("method", "constructor"), ("method", "size"),
        ("method", "load"), ("method", "f"), ("interface", "Shape"), ("type", "Pair")
    ]
    add = extract.parse(SCRIPT, "typescript")[0]
    assert add["content"].startswith("function add") and add["content"].endswith("}") and add["start_line"] == add["end_line"] == 4 and add["start_char"] == 7


def test_javascript_declarations():
    src = "function* gen() { yield 1; }\nobj.foo = function () { return 2; };\nvar f = function named() {};\nexports.bar = () => { return 1; };\nclass A { m() {} }\nlet o = { run() { return 1; } };\n(function () {})();\n"
    got = [(n["type"], n["name"]) for n in extract.parse(src, "javascript")]
    assert got == [
        ("function", "gen"), ("function", "obj.foo"), ("function", "named"), ("function", "exports.bar"), ("class", "A"), ("method", "m"),
        ("method", "run")
    ]


def test_ruby_declarations():
    src = 'module Top\n  class Inner < Base\n    def self.build(x) = x + 1\n    def go(a)\n      return 1 if a\n      items.each do |i|\n        puts "end #{i}"\n      end\n      while a do\n        a = nil\n      end\n    end\n    def name=(v)\n      @v = v\n    end\n  end\nend\nclass A::B\n  def x?; true; end\nend\n'
    got = [(n["type"], n["name"], n["start_line"], n["end_line"]) for n in extract.parse(src, "ruby")]
    assert got == [("module", "Top", 1, 17), ("class", "Inner", 2, 16), ("method", "build", 3, 3), ("method", "go", 4, 12), ("method", "x?", 19, 19)]


def test_nodes_are_split_once_a_file_beside_a_join(spark):
    """Spark infers a filter from an inner explode and writes the whole fold into it, once for each use of the nodes."""
    nodes = [node(f"f{i}", f"function f{i}() {{ return {i}; }}", 4 * i + 1, 4 * i + 3) for i in range(40)]
    files_ = spark.createDataFrame([("a.ts", "typescript", nodes), ("b.ts", "typescript", [])], NODES)
    joined = files_.join(spark.createDataFrame([("a.ts", 1), ("b.ts", 2)], "path string, n int"), "path")
    out = chunking.chunks(joined, 30)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 4 and "size(CASE" not in plan
    rows = out.orderBy("seq").collect()
    assert {r.path for r in rows} == {"a.ts"} and ", ".join(r.symbol_name for r in rows) == ", ".join(f"f{i}" for i in range(40))


def test_unsupported_languages_give_error_rows(spark):
    rows = extract.extract_nodes(spark.createDataFrame(
        [("a.py", "python", "def f(): pass"), ("a.rb", "ruby", None)], "path string, language string, content string"
    )).collect()
    assert [(r.path, "unsupported" in r.error) for r in rows] == [("a.py", True)]


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, hash string")
    assert {tuple(r) for r in changes.diff(old, new).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "added")}
    assert changes.diff(old, old).count() == 0 and changes.diff(None, new).count() == 3
    assert changes.same_root(old, old) and not changes.same_root(old, new)


def test_roots(spark):
    files_ = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c")], "path string, content string")
    snap = changes.snapshot(files_)
    assert changes.flat_root(snap).first().root_hash == "f71b5a2b8d2b4ed795489a9044d19848db2a60b76691961c6e16d89d4867c0d3"
    assert changes.flat_root(snap, most=1).first() == changes.flat_root(snap).first()
    assert changes.pairwise_root(snap).first().root_hash == "d71dc32fa2cd95be60b32dbb3e63009fa8064407ee19f457c92a09a5ff841a8a"
    assert changes.pairwise_root(snap.limit(0)).first().root_hash == changes.EMPTY_ROOT


def test_rows_are_numbered_alike_by_every_reading(spark):
    """More rows than the sample of a range partition holds, so two samples give two partitions."""
    rows = spark.range(50_000, numPartitions=5).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("o"), "id")
    got = changes.numbered(rows, "o").orderBy("i").collect()
    assert [r.i for r in got] == list(range(50_000)) and all(a.o < b.o for a, b in zip(got, got[1:], strict=False))


def test_globs_and_ignore_rules(spark):
    paths = ["src/a.ts", "src/x/b.test.ts", "lib/c.rb", "node_modules/q/d.js", "src/gen/e.ts", "src/gen/keep.ts", "f.ts"]
    df = files.described(spark.createDataFrame([(p, 10) for p in paths], "path string, size long"))
    rules = files.ignore_rules("# comment\nsrc/gen/*\n!keep.ts\n")
    got = {r.path for r in files.selected(df, ["src/**/*", "lib/**/*"], ["**/*.test.{ts,rb}", "node_modules/**"], rules).collect()}
    assert got == {"src/a.ts", "lib/c.rb", "src/gen/keep.ts"}
    assert files.parse_size("1.5KB") == 1536
    with pytest.raises(ValueError):
        files.parse_size("12")


def test_statistics(spark):
    n = spark.createDataFrame([(40,), (400,), (2000,), (4000,)], "n int")
    assert [r.s for r in n.select(stats.project_size(F.col("n")).alias("s")).collect()] == ["small", "medium", "large", "massive"]
    assert n.select(stats.cost_text(F.lit(10), provider="ollama").alias("c")).first().c.startswith("FREE")
    cost = spark.range(1).select(*(stats.embedding_cost(F.lit(1_000_000), m).alias(str(i)) for i, m in enumerate((
        "text-embedding-3-small", "text-embedding-3-large", "text-embedding-ada-002"
    )))).first()
    assert tuple(cost) == pytest.approx((0.02, 0.13, 0.1))
    batches = stats.assign_batches(spark.range(100), "id", 32).collect()
    assert all(r.batch == r.id // 32 for r in batches)


def test_config():
    c = config.load('{"search": {"minScore": 0.5}, "project": {"name": "${NAME}"}}', "fast", {"NAME": "x"})
    assert c["search"]["minScore"] == 0.5 and c["search"]["maxResults"] == 5 and c["project"]["name"] == "x"
    with pytest.raises(config.ConfigError):
        config.load('{"a": "${MISSING_NAME}"}', env={})
    bad = config.merge(
        c,
        {"performance": {"maxFileSize": "x"}, "embedding": {"dimensions": 3}, "search": {"hybrid": {"vectorWeight": 1.0, "keywordWeight": 1.0}}}
    )
    errors, warnings = config.problems(bad)
    assert len(errors) == 1 and len(warnings) == 2


def test_collections(spark, tmp_path):
    c = Collections(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame(
        [(str(i), [1.0, float(i)], "ts" if i % 2 else "rb") for i in range(6)], "id string, embedding array<float>, language string"
    )
    with pytest.raises(CollectionNotFound):
        c.scan("v")
    c.create("v", 2)
    with pytest.raises(CollectionExists):
        c.create("v", 2)
    assert c.scan("v") is None and c.stats("v")["count"] == 0
    c.insert("v", rows)
    c.insert("v", rows.limit(1))
    assert c.stats("v") == {"count": 7, "dimensions": 2, "indexed": True, "index_type": "FLAT", "metric_type": "COSINE"}
    hits = search.top_k(c.scan("v"), [1.0, 0.0], 10, filters={"language": "ts"}, min_score=0.3).collect()
    assert hits and all(h.language == "ts" and h.score >= 0.3 for h in hits)
    assert search.top_k(c.scan("v"), [1.0, 0.0], 2).count() == 2
    with pytest.raises(DimensionMismatch):
        c.insert("v", spark.createDataFrame([("9", [1.0], "ts")], rows.schema))
    c.delete("v", ["0", "1"])
    assert c.stats("v")["count"] == 4 and len(c.vacuum("v")) == 1
    c.drop("v")
    with pytest.raises(CollectionNotFound):
        c.drop("v")


def test_retry_waits_and_gives_up():
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        retry(fails, sleep=waits.append)
    assert len(calls) == 3 and waits == [1.0, 2.0]


def test_batches_that_fail_do_not_stop_others(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 5 else "ok") for i in range(10)], "i int, content string").coalesce(1)
    out = embed_with(df, model, batch=2, tries=1).collect()
    assert {r.i for r in out if r.embedding is None} == {4, 5} and {r.error for r in out} == {None, "no"}


def test_texts_of_any_length_are_embedded_unless_the_model_has_a_limit(spark):
    df = spark.createDataFrame([(0, "a b"), (1, "a " * 9000)], "i int, content string")
    model = lambda texts: [[float(len(t))] for t in texts]
    assert {r.i: (r.embedding, r.error) for r in embed_with(df, model).collect()} == {0: ([3.0], None), 1: ([18000.0], None)}
    assert [r.error is None for r in embed_with(df, model, text_tokens=8192).orderBy("i").collect()] == [True, False]


def write_sources(root):
    (root / "src").mkdir(parents=True)
    (root / "src" / "auth.ts").write_text("export function authenticateUser(token: string) {\n  return validateLogin(token);\n}\n")
    (root / "src" / "db.ts").write_text("export class DatabaseConnection {\n  connect() { return openSocket(); }\n}\n")
    (root / "src" / "util.rb").write_text("def format_money(amount)\n  amount.round(2)\nend\n")
    (root / "src" / "skip.test.ts").write_text("function skipped() {}\n")


def test_engine(spark, tmp_path):
    write_sources(tmp_path / "p")
    e = Engine(spark, f"file://{tmp_path}/p", f"file://{tmp_path}/store")
    assert e.index() == {"files": 3, "chunks": 3, "success": True}
    hits = e.search("authenticate user login", min_score=0.01).collect()
    assert hits[0].path == "src/auth.ts" and [h.rank for h in hits] == sorted(h.rank for h in hits)
    assert {h.language for h in e.search("money", min_score=0.01, language="ruby").collect()} == {"ruby"}
    assert e.search("connect", min_score=0.01, path_pattern="NOTHING").count() == 0
    (tmp_path / "p/src/auth.ts").write_text("export function authorizeRequest() {\n  return 1;\n}\n")
    (tmp_path / "p/src/util.rb").unlink()
    (tmp_path / "p/src/new.ts").write_text("export const fresh = () => 1;\n")
    assert e.reindex() == {"added": 1, "modified": 1, "deleted": 1, "processed": 2}
    after = {(r.path, r.symbol_name, r.content) for r in e.collections.scan(e.name).collect()}
    full = Engine(spark, f"file://{tmp_path}/p", f"file://{tmp_path}/store2")
    full.index()
    assert after == {(r.path, r.symbol_name, r.content) for r in full.collections.scan(full.name).collect()}
    assert e.reindex()["processed"] == 0 and e.status()["count"] == 3
    assert e.onboard("my-app")["vectordb"]["collectionName"] == "my_app"
    assert e.lock.acquire() and not e.lock.acquire()
    e.reset()
    e.clear(confirm=True)
    assert e.status()["count"] == 0


def test_stale_lock_is_taken_over(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}")
    folder.write("engine.lock", '{"pid": 999999999, "operation": "x", "since": 0}')
    assert Lock(folder).acquire()


def test_ladder_takes_the_first_rung_with_results(spark):
    rows = spark.createDataFrame(
        [("a", [1.0, 0.0], ["login"], "src/a"), ("b", [0.0, 1.0], ["base"], "src/b")],
        "id string, embedding array<double>, keywords array<string>, path string"
    )
    rungs = spark.createDataFrame(
        [(0, p, t, m, [0.8, 0.6]) for p, t, m in search.passes("auth", 0.9)],
        "query_id int, pass int, text string, min_score double, query array<double>"
    )
    out = search.search_ladder(rows, rungs, 2).collect()
    assert {r["pass"] for r in out} == {1} and {r.id for r in out} == {"a"}
    assert search.search_ladder(rows, rungs, 2, path_pattern="src/b").collect()[0]["pass"] == rungs.count() - 1


def test_streams(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.unionByName(events.limit(10)).write.parquet(f"{tmp_path}/in")
    q = feed.fresh_triggers(feed.stream(spark, f"{tmp_path}/in", events.schema)).writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fresh").count() == events.count()
    named, schema = [], "trigger bigint, path string"
    for rows in ([(1, "a"), (2, "b"), (3, "a")], [(4, None), (5, "a")], [(6, x) for x in "abc"], []):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        feed.reindex_feed(spark.readStream.schema(schema).parquet(f"{tmp_path}/feed"), named.append, f"{tmp_path}/check", listed=2).awaitTermination()
    assert named == [["a", "b"], None, None]


def test_ivf_with_all_cells_is_exact(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    placed, centroids = search.ivf_cells(rows, 8)
    q = list(map(float, rows.orderBy("id").first().embedding))
    exact = [r.id for r in search.top_k(rows, q, 10).collect()]
    assert [r.id for r in search.ivf_top_k(placed, centroids, q, 10, probe=8).collect()] == exact
    assert len(set(exact) & {r.id for r in search.ivf_top_k(placed, centroids, q, 10, probe=4).collect()}) >= 4


def test_truncation_and_snippets(spark):
    text = "\n".join(f"line {i}" for i in range(30))
    row = spark.createDataFrame([(text,)], "t string").select(
        T.snippet(F.col("t"), "snippet").alias("s"), T.snippet(F.col("t")).alias("h"), T.truncate_to_limit(F.col("t"), 30).alias("c")
    ).first()
    assert row.s.count("\n") == 9 and row.h.endswith("\n... (truncated)") and row.h.count("\n") == 15 and len(row.c) == len(text) // 2
