"""Goldens of text functions, worked out by hand from their definitions."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "tokens"), [
    ("function add(a, b) { return a + b; }", 15), ("class Calculator { sum(x, y) { return x + y; } }", 20), ("const multiply = (a, b) => a * b;", 16),
    ("function calculateSum(a: number, b: number) { return a + b; }", 19), ("", 0), ("a<b", 2)])
def test_token_counts(spark, text, tokens):
    assert one(spark, T.count_tokens(F.col("t")), t=text) == tokens


@pytest.mark.parametrize(
    ("path", "start", "end", "want"),
    [("src/a.ts", 1, 10, "chunk-stj45x"), ("src/utils/very/long/path.ts", 100, 2000, "chunk-d6zrp8"), ("src/utils/math.ts", 1, 3, "chunk-acz8ms")]
)
def test_chunk_ids(spark, path, start, end, want):
    assert one(spark, T.chunk_id(F.col("p"), F.col("s"), F.col("e")), p=path, s=start, e=end) == want


@pytest.mark.parametrize(("text", "want"), [
    (
        "function calculateSum(a: number, b: number) { return a + b; }", ["calculatesum", "number"]
    ), ("class Calculator { sum(x, y) { return x + y; } }", ["class", "calculator", "sum"])])
def test_chunk_keywords(spark, text, want):
    assert one(spark, T.chunk_keywords(F.col("t")), t=text) == want


@pytest.mark.parametrize(("query", "want"), [
    ("find authentication logic", [("find", 1 / 3), ("authentication", 1 / 3), ("logic", 1 / 3)]),
    ("where is the database connection configured?", [("where", 1 / 6), ("database", 1 / 6), ("connection", 1 / 6), ("configured", 0)]),
    (
        "show error handling patterns for error classes",
        [("error", 2 / 7), ("show", 1 / 7), ("handling", 1 / 7), ("patterns", 1 / 7), ("classes", 1 / 7)]
    )])
def test_query_keywords(spark, query, want):
    got = [(r.keyword, r.score) for r in one(spark, T.scored_keywords(F.col("q")), q=query)]
    assert [k for k, _ in got] == [k for k, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])


@pytest.mark.parametrize(("query", "want"), [
    (
        "  Auth  config for db ", "authentication configuration for database"
    ), ("API params", "interface parameters"), ("find auth service", "find authentication service")])
def test_preprocess(spark, query, want):
    assert T.preprocess_query(query) == want == one(spark, T.preprocess_column(F.col("q")), q=query)


def test_expansion_keeps_order_and_drops_repeats():
    assert T.expand_query("mock base")[:4] == ["mock base", "mock", "stub", "stub base"]
    assert T.expand_query("test test")[1:3] == ["test", "spec"]
    assert T.search_variations("auth")[:2] == ["auth", "authentication"]


@pytest.mark.parametrize(("query", "vector"), [
    ("find authentication logic", 0.7), ("where is the database connection configured?", 0.6), ("getUserById", 0.8), ("user_id", 0.8), ("error-handling code", 0.8), ("what is this.", 0.8)])
def test_weights(spark, query, vector):
    assert one(spark, T.vector_weight(F.col("q")), q=query) == vector
    assert one(spark, T.keyword_weight(F.col("q")), q=query) == pytest.approx(1 - vector)


def test_keyword_score_and_similarity(spark):
    kw = spark.createDataFrame([(["auth", "user"], ["Authentication", "login"]), ([], ["a"])], "q array<string>, c array<string>")
    assert [r.x for r in kw.select(T.keyword_score(F.col("q"), F.col("c")).alias("x")).collect()] == [0.5, 0.0]
    assert one(spark, T.keyword_similarity(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("a"), F.lit("c"))), x=1) == pytest.approx(1 / 3)


def test_identifier_keywords(spark):
    text = "// comment word\nfunction getUserName(user_id) { return \"string text\"; } # ruby note\nuserName /* block */ userName"
    assert one(spark, T.identifier_keywords(F.col("t")), t=text)[:2] == ["user", "name"]


@pytest.mark.parametrize(("language", "text", "want"), [
    (
        "typescript", "import a from 'x'\nconst b = require(\"y\")\nimport {c} from 'x'", ["x", "y"]
    ), ("ruby", "require 'json'\nrequire_relative 'b'", ["json", "b"]),
    ("python", "import os\nfrom a.b import c", ["os", "a.b", "c"]), ("go", "import x", [])])
def test_dependencies(spark, language, text, want):
    assert one(spark, T.dependencies(F.col("t"), F.col("l")), t=text, l=language) == want


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(
        vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.dot(F.col("a"), F.col("b")).alias("d"),
        vectors.euclidean(F.col("a"), F.col("b")).alias("e")
    ).collect()
    assert got[0].c == pytest.approx(0.96) and got[0].d == 24 and got[0].e == pytest.approx(2**0.5)
    assert got[1].c is None


def test_hash_embedder_is_unit_length_and_sees_likeness(spark):
    df = spark.createDataFrame(
        [(1, "parse the source file tree"), (2, "parse the source file list"), (3, "vector database connection"), (4, "")],
        "i int, t string"
    )
    v = {r.i: r.embedding for r in vectors.hash_embed(df, "i", "t").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert dot(1, 1) == pytest.approx(1) and dot(1, 2) > 0.6 > dot(1, 3) and not any(v[4])


def test_durations_and_hashes(spark):
    assert [one(spark, T.format_duration(F.col("m")), m=m) for m in (12.0, 1500.0, 90000.0, 7200000.0)] == ["12ms", "1.5s", "1.5m", "2.0h"]
    assert one(spark, T.string_hash(F.col("t"), "sha512"), t="a").startswith("1f40fc92")


def test_durations_round_as_printf(spark):
    import duckdb

    seconds = [k * 50.0 for k in range(20, 1200)]
    hours = [k * 180_000.0 for k in range(20, 600)] + [k * 997 * 180_000.0 for k in range(1, 40)] + [0.5, 1.5, 2.5, 999.5, 1.0e15 + 0.5, 3.6e21]
    odd = [k * 997 / 7 for k in range(0, 40_000, 13)] + [59_949.999999999993, 59_950.00000000001, 3_599_999.9]
    ms = [*seconds, *(60 * x for x in seconds), *hours, *odd]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(ms)], "i int, m double")
    got = [r.d for r in df.select("i", T.format_duration(F.col("m")).alias("d")).orderBy("i").collect()]
    case = """CASE WHEN m < 1000 THEN printf('%.0fms', m) WHEN m < 60000 THEN printf('%.1fs', m / 1000) WHEN m < 3600000 THEN printf('%.1fm', m / 60000)
      ELSE printf('%.1fh', m / 3600000) END"""
    assert got == [r[0] for r in duckdb.execute(f"SELECT {case} FROM (SELECT unnest(?::double[]) AS m)", [ms]).fetchall()]


def test_lines_offsets_and_metadata(spark):
    df = spark.createDataFrame([("ab\ncde\nf", 2, 3, 5)], "t string, a int, b int, o int")
    row = df.select(
        T.lines_between(F.col("t"), F.col("a"), F.col("b")).alias("l"), T.line_and_column(F.col("t"), F.col("o")).alias("p"),
        T.total_tokens(F.split("t", "\n")).alias("n")
    ).first()
    assert row.l == "cde\nf" and tuple(row.p) == (2, 2) and row.n == 3
    schema = "path string, last_modified timestamp, keywords array<string>"
    meta = spark.sql("SELECT struct('a' AS path, timestamp'2024-01-02 03:04:05.678' AS last_modified, array('k') AS keywords) AS m")
    text = meta.select(T.metadata_json(F.col("m")).alias("j"))
    assert '"2024-01-02T03:04:05.678Z"' in text.first().j
    assert text.select(T.metadata_from_json(F.col("j"), schema).alias("m")).first().m == meta.first().m


def test_jobs():
    import time

    from tessera.plans import jobs

    j = jobs.Jobs(keep=2)
    ids = [j.start("index", lambda report, i=i: report("parse", i, 4) or i) for i in range(4)]
    bad = j.start("index", lambda report: 1 / 0)
    for _ in range(200):
        if not j.running():
            break
        time.sleep(0.01)
    time.sleep(0.05)
    assert len(j.all()) == 2 and j.get(bad).status == "failed" and "zero" in j.get(bad).error
    assert j.get(ids[0]) is None
    assert jobs.bar(1, 4, 4) == "█░░░ 25.0%" and jobs.format_bytes(1536) == "1.5KB" and jobs.tier(96, 100) == "warning"
