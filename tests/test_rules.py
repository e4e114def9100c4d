"""Rules of the driver side and of a small project: what locks, errors, configuration, jobs, logs and the engine do, step by step."""

from __future__ import annotations

import io
import json
import logging

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera import errors
from tessera.functions import text as T
from tessera.operators import stats
from tessera.plans import config, gitstate, jobs, logs, providers
from tessera.operators.embedding import retry
from tessera.plans.engine import Engine, Lock
from tessera.session import work_dir
from tessera.sources import files
from tessera.sources.collections import Collections, Folder

RULES = {}


def rule(columns: str, rows: list[tuple]):
    """A function of (spark, sf_dir) with the rows that it should return."""

    def add(f):
        RULES[f.__name__] = f, columns, rows
        return f

    return add


@rule(
    "step, outcome",
    [
        ("create", "exists"), ("create again", "CollectionExists"), ("wrong size", "DimensionMismatch"), ("clear", "gone"),
        ("scan", "CollectionNotFound"), ("drop", "CollectionNotFound"), ("clear again", "gone")
    ]
)
def collection_rules(spark, sf_dir):
    """Existence, errors and clearing."""
    c, out = Collections(spark, work_dir(spark, "collections")), []
    wrong = spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "id string, embedding array<double>")
    found = lambda: "exists" if c.exists("v") else "gone"
    for step, call in (("create", lambda: c.create("v", 2)), ("create again", lambda: c.create("v", 2)), ("wrong size", lambda: c.insert("v", wrong)), ("clear", lambda: c.clear("v")),
                       ("scan", lambda: c.scan("v")), ("drop", lambda: c.drop("v")), ("clear again", lambda: c.clear("v"))):
        try:
            call()
            out.append((step, found()))
        except errors.CollectionError as e:
            out.append((step, type(e).__name__))
    return spark.createDataFrame(out, "step string, outcome string")


PROJECT = {
    "src/auth.ts": "export function authenticateUser(token: string) {\n  return validateLogin(token);\n}\n", "src/db.ts": "export class DatabaseConnection {\n  connect() { return openSocket(); }\n}\n",
    "src/util.rb": "def format_money(amount)\n  amount.round(2)\nend\n", "src/skip.test.ts": "function skipped() {}\n", "src/gen/made.ts": "function made() {}\n", ".gitignore": "# made by tools\nsrc/gen/\n",
}


CHANGED = {
    "src/auth.ts": "export function authorizeRequest() {\n  return 1;\n}\n", "src/new.ts": "export const fresh = () => 1;\n",
    "src/util.rb": None
}


def project(spark: SparkSession, **more) -> tuple[Engine, Folder]:
    root = work_dir(spark, "project")
    sources_ = Folder(spark, f"{root}/p")
    for path, text in PROJECT.items():
        sources_.write(path, text)
    return Engine(spark, f"{root}/p", f"{root}/store", **more), sources_


def change_project(sources_: Folder) -> None:
    for path, text in CHANGED.items():
        sources_.write(path, text) if text is not None else sources_.delete(path)


@rule(
    "path, symbol_name, chunk_type, start_line, end_line",
    [
        ("src/auth.ts", "authenticateUser", "function", 1, 3), ("src/db.ts", "DatabaseConnection, connect", "class", 1, 2),
        ("src/util.rb", "format_money", "method", 1, 3)
    ]
)
def engine_index(spark, sf_dir):
    """Discovery with globs, ignore file, languages and sizes; extraction; chunking; embedding; storage."""
    e, _ = project(spark)
    e.index()
    return e.collections.scan(e.name).select("path", "symbol_name", "chunk_type", "start_line", "end_line")


@rule(
    "path, symbol_name, added, modified, deleted, processed",
    [("src/auth.ts", "authorizeRequest", 1, 1, 1, 2), ("src/db.ts", "DatabaseConnection, connect", 1, 1, 1, 2), ("src/new.ts", "fresh", 1, 1, 1, 2)]
)
def engine_reindex(spark, sf_dir):
    """One file changed, one new, one gone: chunks after an incremental run, with its counts."""
    e, sources_ = project(spark)
    e.index()
    change_project(sources_)
    counts = e.reindex()
    return e.collections.scan(e.name).select(
        "path", "symbol_name", *(F.lit(counts[k]).cast("int").alias(k) for k in ("added", "modified", "deleted", "processed"))
    )


@rule(
    "step, outcome",
    [
        ("status before", "0 False"), ("index", "3 3 True"), ("status", "3 True"), ("locked", "RuntimeError"), ("reindex named", "1 1"),
        ("forced", "0"), ("health", "True True True"), ("clear unasked", "ValueError"), ("clear", "0 False")
    ]
)
def engine_operations(spark, sf_dir):
    """Status, index, lock, named reindex, preemption, reset, health and clear."""
    e, sources_ = project(spark)
    out = []
    state = lambda: f"{e.status()['count']} {e.status()['indexed']}"
    out.append(("status before", state()))
    r = e.index()
    out += [("index", f"{r['files']} {r['chunks']} {r['success']}"), ("status", state())]
    other = Lock(e.folder)
    other.acquire("held")
    try:
        e.reindex()
    except RuntimeError as x:
        out.append(("locked", type(x).__name__))
    other.release()
    named = e.reindex(["src/auth.ts", "src/none.ts"])
    out.append(("reindex named", f"{named['modified']} {named['deleted']}"))
    other.acquire("held")
    out.append(("forced", str(e.reindex(force=True)["processed"])))
    out.append(("health", " ".join(str(v) for v in e.health().values())))
    e.reset()
    try:
        e.clear()
    except ValueError as x:
        out.append(("clear unasked", type(x).__name__))
    e.clear(confirm=True)
    out.append(("clear", state()))
    return spark.createDataFrame(out, "step string, outcome string")


@rule("strategy, path, rank", [("hybrid", "src/auth.ts", 1), ("semantic", "src/auth.ts", 1)])
def engine_search(spark, sf_dir):
    """The best hit of a question by the hybrid and by the semantic strategy."""
    e, _ = project(spark)
    e.index()
    found = []
    for strategy in ("hybrid", "semantic"):
        e.config = config.merge(e.config, {"search": {"strategy": strategy}})
        best = e.search("authenticate user login", min_score=0.01).first()
        found.append((strategy, best.path, int(best["rank"])))
    return spark.createDataFrame(found, "strategy string, path string, rank int")


@rule("size, primary_language, languages, collection, batch", [("small", "typescript", "ruby,typescript", "my_app", 32)])
def engine_onboard(spark, sf_dir):
    e, _ = project(spark)
    c = e.onboard("my-app")
    listing = spark.createDataFrame([(p,) for p in PROJECT], "path string").withColumn("extension", stats.extension(F.col("path")))
    size = files.sample_files(listing).agg(stats.project_size(F.count("*")).alias("s")).first().s
    return spark.createDataFrame(
        [(
            size, stats.primary_language(listing.where("extension <> ''")).first()[0], ",".join(c["project"]["languages"]),
            c["vectordb"]["collectionName"], c["embedding"]["batchSize"]
        )],
        "size string, primary_language string, languages string, collection string, batch int"
    )


@rule(
    "case_, outcome",
    [
        ("free", "True"), ("held", "False"), ("ended process", "True"), ("other host", "False"), ("lease ended", "True"),
        ("forced", "True"), ("released by another", "held"), ("released", "free")
    ]
)
def lock_rules(spark, sf_dir):
    """When a lock is taken: on this host, on another one, after its lease, by force."""
    folder = Folder(spark, work_dir(spark, "locks"))
    out = [("free", str(Lock(folder).acquire())), ("held", str(Lock(folder).acquire()))]
    for case, text in (
        ("ended process", {"pid": 999999999}), ("other host", {"pid": 1, "host": "elsewhere", "until": 4e9}),
        ("lease ended", {"pid": 1, "host": "elsewhere", "until": 1.0})
    ):
        folder.write("engine.lock", json.dumps(text))
        out.append((case, str(Lock(folder).acquire())))
    last = Lock(folder)
    out.append(("forced", str(last.acquire(force=True))))
    Lock(folder).release()
    out.append(("released by another", "held" if last.held() else "free"))
    last.release()
    out.append(("released", "held" if folder.exists("engine.lock") else "free"))
    return spark.createDataFrame(out, "case_ string, outcome string")


@rule(
    "query_id, seq, text",
    [(0, i, t) for i, t in enumerate(
        ("find  auth", "find authentication", "find", "authentication", "auth", "auth find", "login", "login find", "credential", "credential find"),
        1
    )]
)
def query_variations(spark, sf_dir):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(T.search_variations("find  auth"), 1)], "query_id int, seq int, text string")


@rule("preset, strategy, form, results, score, size, chunk, host", [
    ("none", "hybrid", "hybrid", 10, 0.7, "1MB", 250, "none"), ("fast", "semantic", "snippet", 5, 0.6, "500KB", 500, "none"), (
        "quality", "hybrid", "context", 20, 0.75, "2MB", 200, "none"
    ),
    ("local", "hybrid", "hybrid", 10, 0.7, "1MB", 250, "none"), ("json", "hybrid", "hybrid", 3, 0.7, "1MB", 250, "h:1")])
def config_values(spark, sf_dir):
    """Defaults, presets, JSON text with environment values, and options that are not given."""
    found = [
        ("none", config.load()), *((p, config.load(preset=p)) for p in ("fast", "quality", "local")),
        ("json", config.load('{"search": {"maxResults": 3}, "vectordb": {"address": "${HOST}:1"}}', env={"HOST": "h"}))
    ]
    rows = [(
        n, c["search"]["strategy"], c["search"]["resultFormat"], c["search"]["maxResults"], float(c["search"]["minScore"]),
        c["performance"]["maxFileSize"], c["indexing"]["maxChunkSize"], c["vectordb"].get("address", "none")
    ) for n, c in found]
    return spark.createDataFrame(rows, "preset string, strategy string, form string, results int, score double, size string, chunk int, host string")


@rule(
    "case_, errors, warnings",
    [
        ("defaults", 0, 0), ("size", 1, 0), ("chunk", 1, 0), ("score", 1, 0), ("dims", 0, 1), ("weights", 0, 1), ("missing name", 1, 0),
        ("unknown preset", 1, 0)
    ]
)
def config_problems(spark, sf_dir):
    cases = {
        "defaults": {}, "size": {"performance": {"maxFileSize": "big"}}, "chunk": {"indexing": {"maxChunkSize": 0}},
        "score": {"search": {"minScore": 2}}, "dims": {"embedding": {"dimensions": 3}},
        "weights": {"search": {"hybrid": {"vectorWeight": 1.0, "keywordWeight": 1.0}}}
    }
    out = [(k, *map(len, config.problems(config.merge(config.DEFAULTS, v)))) for k, v in cases.items()]
    for case, call in (
        ("missing name", lambda: config.load('{"a": "${NO_SUCH_NAME}"}', env={})), ("unknown preset", lambda: config.load(preset="none"))
    ):
        try:
            call()
            out.append((case, 0, 0))
        except errors.ConfigError:
            out.append((case, 1, 0))
    return spark.createDataFrame(out, "case_ string, errors int, warnings int")


@rule("case_, code, message, again", [
    ("missing", "INDEXING_ERROR", "File not found: a.ts", False), (
        "large", "INDEXING_ERROR", "File too large: a.ts (9 bytes, max: 5 bytes)", False
    ), ("language", "PARSE_ERROR", "unsupported language: cobol", False),
    ("tree", "PARSE_ERROR", "Failed to parse AST for a.ts", False), (
        "results", "SEARCH_ERROR", "No results found for query: q", False
    ), ("config", "CONFIG_ERROR", "Invalid configuration for x: y", False),
    ("collection", "VECTOR_DB_ERROR", "Collection c not found", False), ("tokens", "EMBEDDING_ERROR", "Token count 9 exceeds maximum 5", False), (
        "401", "EMBEDDING_ERROR", "Failed to connect to p: Invalid API key", False
    ),
    ("404", "EMBEDDING_ERROR", "Model m is not available", False), (
        "429", "EMBEDDING_ERROR", "Rate limit exceeded, retrying...", True
    ), ("503", "EMBEDDING_ERROR", "p server error, retrying...", True),
    ("418", "none", "tea", False), ("timeout", "none", "a timeout", True)])
def error_rules(spark, sf_dir):
    """Code, text and retryability of each kind of error, and of the statuses of a model server."""
    kinds = {"missing": errors.FileMissing("a.ts"), "large": errors.FileTooLarge("a.ts", 9, 5), "language": errors.UnsupportedLanguage("cobol"), "tree": errors.SyntaxTreeError("a.ts"), "results": errors.NoResults("q"),
             "config": errors.InvalidConfig("x", "y"), "collection": errors.CollectionNotFound("c"), "tokens": errors.TokenLimitExceeded(9, 5)}
    kinds |= {str(s): errors.of_status(s, "p", "m", OSError("tea")) for s in (401, 404, 429, 503, 418)} | {"timeout": OSError("a timeout")}
    return spark.createDataFrame(
        [(k, getattr(e, "code", "none"), str(e), errors.may_pass(e)) for k, e in kinds.items()],
        "case_ string, code string, message string, again boolean"
    )


@rule("case_, calls, waited, outcome", [("fails", 3, 3.0, "OSError"), ("recovers", 2, 1.0, "ok"), ("cannot pass", 1, 0.0, "ProviderUnreachable")])
def retry_rules(spark, sf_dir):
    out = []
    for case, error, good in (("fails", OSError(), 9), ("recovers", OSError(), 2), ("cannot pass", errors.ProviderUnreachable("p"), 9)):
        calls, waits = [], [0.0]

        def call(calls=calls, error=error, good=good):
            calls.append(1)
            if len(calls) < good:
                raise error
            return "ok"

        try:
            got = retry(call, sleep=waits.append)
        except Exception as e:
            got = type(e).__name__
        out.append((case, len(calls), float(sum(waits)), got))
    return spark.createDataFrame(out, "case_ string, calls int, waited double, outcome string")


@rule("model, dimensions, max_tokens, requested, cost", [
    ("text-embedding-3-small", 1536, 8191, 0, 0.02), ("text-embedding-3-large", 256, 8191, 256, 0.13), ("text-embedding-ada-002", 1536, 8191, 0, 0.1), ("nomic-embed-text", 768, 8192, 0, 0.0),
    ("mxbai-embed-large", 1024, 512, 0, 0.0), ("all-minilm", 384, 512, 0, 0.0), ("unknown", 768, 8192, 0, 0.0)])
def model_tables(spark, sf_dir):
    """Sizes, limits and prices of models; a size is requested only where it is not the model's own."""
    names = (
        "text-embedding-3-small", "text-embedding-3-large", "text-embedding-ada-002", "nomic-embed-text", "mxbai-embed-large", "all-minilm",
        "unknown"
    )
    models = [providers.Model("p", n, 256 if n == "text-embedding-3-large" else None) for n in names]
    return spark.createDataFrame(
        [(m.name, m.dimensions, m.max_tokens, m.requested_dimensions() or 0, m.cost(1_000_000)["cost"]) for m in models],
        "model string, dimensions int, max_tokens int, requested int, cost double"
    )


@rule(
    "step, outcome",
    [("vectors", "2"), ("error", "ModelNotAvailable"), ("healthy", "True"), ("unreachable", "False"), ("models", "all-minilm,nomic-embed-text")]
)
def provider_rules(spark, sf_dir):
    """A model call with an override of the size and mapped errors; health; the models of a server that embed."""

    def missing(_):
        e = OSError("no")
        e.status = 404
        raise e

    model = providers.Model("p", "m", 2)
    out = [("vectors", str(len(providers.guarded(model, lambda t: [[1.0, 2.0, 3.0]])(["a"])[0])))]
    try:
        providers.guarded(model, missing)(["a"])
    except errors.EngineError as e:
        out.append(("error", type(e).__name__))
    out += [
        ("healthy", str(providers.healthy(lambda: 1))), ("unreachable", str(providers.healthy(lambda: missing(0)))),
        ("models", ",".join(sorted(providers.embedding_models(["gpt", "nomic-embed-text", "all-minilm"]))))
    ]
    return spark.createDataFrame(out, "step string, outcome string")


@rule(
    "done, total, tier, bar, percentage, eta",
    [
        (0, 4, "failed", "░░░░ 0.0%", 0.0, -1.0), (2, 4, "partial", "██░░ 50.0%", 50.0, 4.0),
        (96, 100, "warning", "███░ 96.0%", 96.0, 4.0 / 24), (4, 4, "success", "████ 100.0%", 100.0, 0.0)
    ]
)
def progress_values(spark, sf_dir):
    """Percentage, remaining time, bar and tier of runs that took four seconds so far."""
    rows = [(
        d, t, jobs.tier(d, t), jobs.bar(d, t, 4), jobs.progress("x", d, t, 4.0)["percentage"],
        -1.0 if d == 0 else jobs.progress("x", d, t, 4.0)["eta"]
    ) for d, t in ((0, 4), (2, 4), (96, 100), (4, 4))]
    return spark.createDataFrame(rows, "done int, total int, tier string, bar string, percentage double, eta double")


@rule("job, status, result", [("a", "completed", "1"), ("b", "failed", "no"), ("last", "completed", "10")])
def job_states(spark, sf_dir):
    """Jobs run and fail; of those that have ended, ten stay."""
    import time

    held = jobs.Jobs(keep=10)

    def run(work) -> jobs.Job:
        job = held.get(held.start("index", work))
        while job.end is None:
            time.sleep(0.01)
        return job

    def fails(report):
        raise ValueError("no")

    a, b = run(lambda report: 1), run(fails)
    for i in range(12):
        run(lambda report, i=i: i)
    time.sleep(0.2)
    return spark.createDataFrame(
        [("a", a.status, str(a.result)), ("b", b.status, b.error), ("last", "completed", str(len(held.all())))],
        "job string, status string, result string"
    )


@rule(
    "n, level, prefix, message, data",
    [(0, "info", "engine", "started", '{"files": 3}'), (1, "error", "engine:chunks", "failed", '{"error": "x", "name": "ValueError"}')]
)
def log_lines(spark, sf_dir):
    """Lines of two loggers as JSON; those below the level are silent, as all are before set-up."""
    out = io.StringIO()
    logs.set_up("INFO", pretty=False, stream=out)
    try:
        log = logs.logger("engine")
        log.debug("hidden")
        log.info("started", extra={"data": {"files": 3}})
        try:
            raise ValueError("x")
        except ValueError:
            log.getChild("chunks").error("failed", exc_info=True)
    finally:
        root = logging.getLogger(logs.ROOT)
        for h in [h for h in root.handlers if not isinstance(h, logging.NullHandler)]:
            root.removeHandler(h)
    rows = [json.loads(line) for line in out.getvalue().splitlines()]
    return spark.createDataFrame(
        [(i, r["level"], r["prefix"], r["message"], json.dumps(r["data"])) for i, r in enumerate(rows)],
        "n int, level string, prefix string, message string, data string"
    )


@rule("step, changed, paths", [("no state", False, ""), ("same", False, ""), ("commit", True, "b.ts"), ("branch", True, "b.ts")])
def git_changes(spark, sf_dir):
    """Git state of a repository made for this: nothing saved, nothing changed, a new commit, another branch."""
    import subprocess
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as root:  # on the driver alone, as git is

        def git(*args):
            subprocess.run(["git", "-C", root, "-c", "user.name=n", "-c", "user.email=e", *args], check=True, capture_output=True)

        git("init", "-q", "-b", "main")
        Path(root, "a.ts").write_text("1")
        git("add", ".")
        git("commit", "-qm", "one")
        folder, out = Folder(spark, work_dir(spark, "git")), []
        out.append(("no state", *gitstate.changed_since(root, gitstate.load(folder))))
        gitstate.save(folder, gitstate.current(root))
        out.append(("same", *gitstate.changed_since(root, gitstate.load(folder))))
        Path(root, "b.ts").write_text("2")
        git("add", ".")
        git("commit", "-qm", "two")
        out.append(("commit", *gitstate.changed_since(root, gitstate.load(folder))))
        git("checkout", "-qb", "other")
        out.append(("branch", *gitstate.changed_since(root, gitstate.load(folder))))
    return spark.createDataFrame([(s, c, ",".join(p)) for s, c, p in out], "step string, changed boolean, paths string")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(RULES))
def test_rule(spark, sf_dir, name):
    f, columns, want = RULES[name]
    got = [tuple(plain(v) for v in r) for r in f(spark, sf_dir).select(columns.split(", ")).collect()]
    assert sorted(got, key=repr) == sorted((tuple(plain(v) for v in r) for r in want), key=repr)
