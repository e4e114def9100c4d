"""Registered queries over texts as sources, stored indexes, trees, keyed streams, packed requests and vector caches.

Each reads the driver's tables whole; each has its rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions import text as T
from tessera.operators import ann, changes, embedding, extract, keywords, merkle, search, termstats
from tessera.plans import catalogue as base
from tessera.plans.catalogue import SQL_STATES, documents, query, sql_cosine, sql_tokens, states, table
from tessera.plans.engine import Engine
from tessera.session import work_dir
from tessera.sources.collections import Collections
from tessera.streaming import state

# ---- texts as sources: a declaration of each line --------------------------------------------

KINDS = {
    "en": ("typescript", "export function ", "() {\n  // ", "\n}"), "fr": ("javascript", "function ", "() {\n  // ", "\n}"),
    "de": ("ruby", "def ", "\n  # ", "\nend"), "es": ("ruby", "def ", "\n  # ", "\nend")
}


def declared(text, lang) -> F.Column:
    """A source with one declaration for each line of a text, named by the line's first word and number, the line its comment."""

    def one(head: str, middle: str, tail: str):
        return lambda line, i: F.concat(
            F.lit(head), F.lower(F.regexp_extract(line, "[A-Za-z]+", 0)), F.lit("_"), i.cast("string"), F.lit(middle), line, F.lit(tail)
        )

    out = F.lit(None).cast("string")
    for code, (_, *parts) in KINDS.items():
        out = F.when(lang == code, F.array_join(F.transform(F.split(text, "\n"), one(*parts)), "\n")).otherwise(out)
    return out


def text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.create_map(*(F.lit(x) for code, kind in KINDS.items() for x in (code, kind[0])))[F.col("lang")]
    return documents(spark, sf_dir).select(
        F.concat(F.lit("src/"), "doc_id", F.lit("."), "lang").alias("path"), language.alias("language"),
        declared(F.col("text"), F.col("lang")).alias("content")
    )


SQL_LANGUAGE = "CASE lang WHEN 'en' THEN 'typescript' WHEN 'fr' THEN 'javascript' ELSE 'ruby' END"
SQL_LINES = f"""(SELECT doc_id, lang, 'src/' || doc_id || '.' || lang AS path, {SQL_LANGUAGE} AS language, line, i, lower(regexp_extract(line, '[A-Za-z]+')) || '_' || i AS name
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))"""


@query(f"""SELECT path, language, i::int AS node_seq, CASE language WHEN 'ruby' THEN 'method' ELSE 'function' END AS type, name, (3 * i + 1)::int AS start_line, (3 * i + 3)::int AS end_line,
  CASE lang WHEN 'en' THEN 7 ELSE 0 END AS start_char, CASE language WHEN 'ruby' THEN 3 ELSE 1 END AS end_char, sha256(CASE language WHEN 'ruby' THEN 'def ' || name || chr(10) || '  # ' || line || chr(10) || 'end'
    ELSE 'function ' || name || '() {{' || chr(10) || '  // ' || line || chr(10) || '}}' END) AS content_sha256 FROM {SQL_LINES}""")
def node_extraction_texts(spark, sf_dir):
    """Declarations of sources that hold every line of every document, whatever is in it."""
    nodes = extract.extract_nodes(text_sources(spark, sf_dir))
    return nodes.withColumn("content_sha256", F.sha2(F.col("content").cast("binary"), 256)).drop("content", "error")


@query(f"""SELECT path, (3 * count(*))::int AS total_lines, (sum(length(name) + length(line) + CASE language WHEN 'ruby' THEN 4 + 5 + 4 ELSE CASE lang WHEN 'en' THEN 16 ELSE 9 END + 10 + 2 END + 1) - 1)::int AS total_chars,
  CASE any_value(language) WHEN 'ruby' THEN 'method' ELSE 'function' END AS chunk_types FROM {SQL_LINES} GROUP BY path""")
def parse_metadata_texts(spark, sf_dir):
    found = text_sources(spark, sf_dir)
    out = extract.parse_metadata(found, extract.extract_nodes(found))
    return out.select("path", "total_lines", "total_chars", F.array_join("chunk_types", ",").alias("chunk_types"))


SQL_MODULES = r"list_distinct(regexp_extract_all(text, '[A-Za-z]+'))"


@query(f"""SELECT doc_id, array_to_string(list_sort(ws), ' ') AS modules FROM (SELECT doc_id, {SQL_MODULES} AS ws FROM documents)""")
def dependencies_texts(spark, sf_dir):
    """Modules that sources name: an import of every word of a text."""
    words = F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]+"), F.lit(0))
    source = F.array_join(F.transform(words, lambda w: F.concat(F.lit("require '"), w, F.lit("'"))), "\n")
    found = documents(spark, sf_dir).select("doc_id", T.dependencies(source, F.lit("ruby")).alias("m"))
    return found.select("doc_id", F.array_join(F.array_sort("m"), " ").alias("modules"))


@query(base._expand_sql(f"SELECT item_id, {base._preprocess_sql(chr(39) + 'find  auth ' + chr(39) + ' || string_split(text, chr(32))[1]')} AS q FROM benchmark").replace(
    "SELECT query_id, text, row_number()", "SELECT query_id, text, 1 + row_number()"
)
       + " UNION ALL SELECT item_id, 'find  auth ' || string_split(text, ' ')[1], 1 FROM benchmark")
def query_variations_table(spark, sf_dir):
    """Variations of a table of questions: as asked, in full words, and expanded."""
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat(F.lit("find  auth "), F.split("text", " ")[0]).alias("q")
    )
    found = asked.select("query_id", F.posexplode(T.variations_column(F.col("q"))).alias("seq", "text"))
    return found.select("query_id", "text", (F.col("seq") + 1).cast("long").alias("seq"))


# ---- the engine over a table of sources ------------------------------------------------------


def engine_over(spark: SparkSession, sources: DataFrame) -> Engine:
    root = work_dir(spark, "engine")
    return Engine(spark, root, f"{root}/store", sources=sources)


def as_typescript(rows: DataFrame) -> DataFrame:
    """Sources (path, content) of texts (path, text)."""
    return rows.select(F.concat(F.lit("src/"), "path", F.lit(".ts")).alias("path"), declared(F.col("text"), F.lit("en")).alias("content"))


def names_by_path(rows: DataFrame) -> DataFrame:
    """Declarations of each file of a collection in order, and its lines: a cut declaration has its name in each piece."""
    one = F.array_sort(F.collect_list(F.struct("seq", "symbol_name")))  # the chunks of a file
    grouped = rows.groupBy("path").agg(one.alias("r"), F.min("start_line").alias("first"), F.max("end_line").alias("last"))
    names = F.array_distinct(F.flatten(F.transform("r", lambda x: F.split(x["symbol_name"], ", "))))
    return grouped.select("path", F.size(names).alias("names"), F.md5(F.array_join(names, ",").cast("binary")).alias("names_md5"), "first", "last")


def sql_names(state_: str) -> str:
    return f"""SELECT 'src/' || path || '.ts' AS path, count(*)::int AS names, md5(string_agg(lower(regexp_extract(line, '[A-Za-z]+')) || '_' || i, ',' ORDER BY i)) AS names_md5, 1 AS first, (3 * count(*))::int AS last
      FROM (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM {state_}) GROUP BY path"""


@query(f"WITH {SQL_STATES} {sql_names('old')}")
def engine_index_texts(spark, sf_dir):
    """Discovery, extraction, chunking, embedding and storage of all documents as sources."""
    e = engine_over(spark, as_typescript(states(spark, sf_dir)[0]))
    e.index()
    return names_by_path(e.collections.scan(e.name))


@query(f"""WITH {SQL_STATES}, c AS (SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'modified') AS modified, count(*) FILTER (WHERE change = 'deleted') AS deleted FROM diff)
  SELECT * FROM ({sql_names('new')}) n, c""")
def engine_reindex_texts(spark, sf_dir):
    """The collection after an incremental run over changed documents, with its counts."""
    old, new = states(spark, sf_dir)
    e = engine_over(spark, as_typescript(old))
    e.index()
    e.sources = as_typescript(new)
    counts = e.reindex()
    return names_by_path(e.collections.scan(e.name)).select("*", *(F.lit(counts[k]).cast("long").alias(k) for k in ("added", "modified", "deleted")))


@query("""WITH n AS (SELECT count(*) AS n FROM documents) SELECT unnest(['files', 'indexed', 'indexed again', 'modified', 'after clear']) AS step, unnest([n, 1, 0, 1, 0])::bigint AS value FROM n""")
def engine_states_texts(spark, sf_dir):
    """What index, status, reindex without changes, reindex of a named file and clear report over all documents."""
    old = as_typescript(states(spark, sf_dir)[0])
    e = engine_over(spark, old)
    out = [("files", e.index()["files"]), ("indexed", int(e.status()["indexed"])), ("indexed again", e.reindex()["processed"])]
    out.append(("modified", e.reindex([old.select("path").orderBy("path").first().path])["modified"]))
    e.clear(confirm=True)
    out.append(("after clear", e.status()["count"]))
    return spark.createDataFrame(out, "step string, value long")


@query("""SELECT 'small' AS size, 'typescript' AS languages, count(*) AS files FROM documents HAVING count(*) * 10 < 500 UNION ALL SELECT CASE WHEN count(*) < 500 THEN 'medium' WHEN count(*) < 3000 THEN 'large' ELSE 'massive' END, 'typescript', count(*) FROM documents HAVING count(*) * 10 >= 500""")
def project_profile_texts(spark, sf_dir):
    """Size and languages of a project whose sources are all documents, by the rules of onboarding."""
    from tessera.operators import stats
    from tessera.sources import files

    found = files.described(as_typescript(states(spark, sf_dir)[0]))
    row = found.agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    return row.select(stats.project_size(F.col("files")).alias("size"), "languages", "files")


# ---- the stored index of a collection --------------------------------------------------------


def indexed_vectors(spark: SparkSession, sf_dir: str) -> tuple[Collections, DataFrame]:
    """A collection with an index of all vectors, and every id divisible by 100 as a query."""
    c = Collections(spark, work_dir(spark, "collections"), parts=8)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    c.create("v", 64, "IVF_PQ")
    c.insert("v", rows)
    return c, rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


SQL_EXACT = f"""SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, {sql_cosine('e.embedding', 'q.embedding')} AS sc FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.label <> 3)) WHERE rank <= 10"""


@query(SQL_EXACT.replace("SELECT query_id, id, rank FROM", "SELECT query_id, id, rank::bigint AS rank FROM", 1))
def collection_index_exact(spark, sf_dir):
    """Search through the index with all cells probed, after some rows were deleted: the rows of brute force."""
    c, asked = indexed_vectors(spark, sf_dir)
    c.delete("v", c.scan("v").where("label = 3").select("id"))
    found = c.search("v", asked, 10, probe=ann.MOST_CELLS, refine=1000)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("SELECT count(*) FILTER (WHERE vec_id % 100 = 0) AS queries, true AS recall_of_090 FROM embeddings")
def collection_index_recall(spark, sf_dir):
    """Recall at 10 of the index as it was calibrated, against brute force, over all ids divisible by 100."""
    c, asked = indexed_vectors(spark, sf_dir)
    exact = search.batch_top_k(asked, c.scan("v"), 10)
    share = ann.recall(c.search("v", asked, 10), exact)
    return share.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("recall_of_090"))


# ---- trees -----------------------------------------------------------------------------------

DEEP = "regexp_replace(path, '^([^/]*)/([0-9]*)([0-9])([.])', '$1/d$2/$3$4')"
SQL_DEEP = r"regexp_replace(path, '^([^/]*)/([0-9]*)([0-9])([.])', '\1/d\2/\3\4')"


def deep_snapshots(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Both states with a folder for every ten documents."""
    return [changes.snapshot(s.withColumn("path", F.expr(DEEP)), content="text") for s in states(spark, sf_dir)]


SQL_LANES = ", ".join(f"sum(('0x' || substr(h, {15 * i + 1}, 15))::bigint)::hugeint AS l{i}" for i in range(merkle.LANES))


@query(rf"""WITH {SQL_STATES}, f AS (SELECT {SQL_DEEP} AS path, sha256(text) AS hash FROM new),
  a AS (SELECT sha256(path || chr(10) || hash) AS h, unnest(range(0, len(string_split(path, '/')))) AS depth, string_split(path, '/') AS parts FROM f),
  s AS (SELECT depth, array_to_string(list_slice(parts, 1, depth), '/') AS folder, count(*) AS files, {SQL_LANES} FROM a GROUP BY 1, 2)
  SELECT depth::int AS depth, folder, files, sha256(concat_ws(':', files, l0, l1, l2, l3)) AS digest FROM s""")
def merkle_folders(spark, sf_dir):
    """The digest of every folder of a snapshot."""
    return merkle.folders(deep_snapshots(spark, sf_dir)[1]).drop("parent")


@query(f"WITH {SQL_STATES} SELECT {SQL_DEEP} AS path, change FROM diff")
def merkle_descent(spark, sf_dir):
    """What differs between two stored trees, found from the root down."""
    root = work_dir(spark, "tree")
    old, new = (merkle.StoredTree(spark, f"{root}/{n}").write(s) for n, s in zip(("old", "new"), deep_snapshots(spark, sf_dir), strict=True))
    return merkle.tree_diff(old, new, f"{root}/scratch")[0]


# ---- keyed streams ---------------------------------------------------------------------------


@query(f"WITH {SQL_STATES} SELECT path, sha256(text) AS hash FROM new")
def stream_change_feed(spark, sf_dir):
    """A change feed in two batches, kept by path in the state store; the snapshot is what its changes leave."""
    root = work_dir(spark, "feed")
    old, new = states(spark, sf_dir)
    was, now = changes.snapshot(old, content="text"), changes.snapshot(new, content="text")
    change = changes.diff(was, now).join(now, "path", "left").select(
        "path", "hash", (F.col("change") == "deleted").alias("deleted"), F.lit(2).cast("long").alias("seq")
    )
    schema = "path string, hash string, deleted boolean, seq long"
    for rows in (was.select("path", "hash", F.lit(False).alias("deleted"), F.lit(1).cast("long").alias("seq")), change):
        rows.write.mode("append").parquet(f"{root}/in")
        found = state.file_changes(spark.readStream.schema(schema).parquet(f"{root}/in"))
        state.append_to(found, f"{root}/out", f"{root}/check").awaitTermination()
    return state.latest(spark.read.schema("path string, change string, hash string, seq bigint").parquet(f"{root}/out"))


SQL_BATCHES = """e AS (SELECT *, (event_id - min(event_id) OVER ()) / (max(event_id) OVER () - min(event_id) OVER ()) AS p FROM events), b AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 = 0 OR p >= 0.9 THEN 3 WHEN p < 0.5 THEN 1 ELSE 2 END AS batch FROM e)"""


@query(f"""WITH {SQL_BATCHES}, m AS (SELECT max(ts) - INTERVAL 3 DAY AS mark FROM b WHERE batch < 3)
  SELECT user_id AS key, count(*) AS triggers, arg_max(event_id, (ts, event_id)) AS last FROM b, m WHERE batch < 3 OR epoch_ms(ts) > epoch_ms(mark) GROUP BY user_id""")
def stream_trigger_sessions(spark, sf_dir):
    """Events in three batches, every seventh in the last one: those older than the watermark by then are dropped."""
    root = work_dir(spark, "sessions")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("trigger"), F.col("ts").cast("timestamp").alias("ts")
    )
    n = events.agg(F.min("trigger").alias("a"), F.max("trigger").alias("b")).first()
    half, most = n.a + (n.b - n.a) * 0.5, n.a + (n.b - n.a) * 0.9  # ids are numbered in order
    batch = F.when((F.col("trigger") % 7 == 0) | (F.col("trigger") >= most), 3).when(F.col("trigger") < half, 1).otherwise(2)
    for i in (1, 2, 3):
        events.where(batch == i).write.mode("append").parquet(f"{root}/in")
        found = state.trigger_sessions(spark.readStream.schema(events.schema).parquet(f"{root}/in"), "3 days", idle_ms=365 * 86_400_000)
        state.append_to(found, f"{root}/out", f"{root}/check").awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{root}/out").where("not idle")
    return rows.groupBy("key").agg(F.max("triggers").alias("triggers"), F.max_by("last", "triggers").alias("last"))


# ---- substrings and term statistics ----------------------------------------------------------


@query("""WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM benchmark), d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS run FROM documents)
  SELECT word, count(*) AS held_by, min(run) AS least, max(run) AS most FROM b JOIN d ON contains(run, word) GROUP BY word""")
def words_contained(spark, sf_dir):
    """All words of the benchmark within all words of the documents: how many contain each."""
    split = lambda df: df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("x"))
    words, runs = split(table(spark, sf_dir, "benchmark")).withColumnRenamed("x", "word"), split(documents(spark, sf_dir)).withColumnRenamed("x", "run")
    return keywords.containing(words, runs).groupBy("word").agg(
        F.count("*").alias("held_by"), F.min("run").alias("least"), F.max("run").alias("most")
    )


@query(f"""WITH {SQL_STATES}, w AS (SELECT path, unnest(list_filter({base.sql_plain_words('text')}, lambda w: w NOT IN {base.in_list(fixed.SCORED_STOP_WORDS)})) AS term FROM new)
  SELECT term, count(*) AS places, count(DISTINCT path) AS documents, round(ln((SELECT count(*) FROM new) / count(DISTINCT path)), 6) AS idf FROM w GROUP BY term""")
def term_statistics(spark, sf_dir):
    """Statistics of the old documents, changed by what has changed in three batches, one of them after a compaction: those of the new ones."""
    old, new = states(spark, sf_dir)
    stats_ = termstats.TermStatistics(spark, f"{work_dir(spark, 'terms')}/t")
    stats_.apply(0, None, old)
    change = changes.diff(changes.snapshot(old, content="text"), changes.snapshot(new, content="text"))
    of = lambda df, *kinds: df.join(change.where(F.col("change").isin(*kinds)).select("path"), "path", "left_semi")
    stats_.apply(1, of(old, "modified"), of(new, "modified"))
    stats_.compact()
    stats_.apply(2, of(old, "deleted"), of(new, "added"))
    return stats_.terms().withColumn("idf", F.round("idf", 6))


# ---- requests, vectors by content, metrics ---------------------------------------------------


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, doc_id // 100 AS g, {sql_tokens('text')} AS n FROM documents),
  ext AS (SELECT g, list(doc_id ORDER BY doc_id) AS ids, list(n ORDER BY doc_id) AS ns FROM t WHERE n <= 2000 GROUP BY g),
  p AS (SELECT g, 1 AS i, 0 AS request, 0 AS place, ns[1]::bigint AS s FROM ext UNION ALL
    SELECT g, i + 1, request + CASE WHEN x THEN 1 ELSE 0 END, CASE WHEN x THEN 0 ELSE place + 1 END, CASE WHEN x THEN n ELSE s + n END FROM (
      SELECT p.*, ns[i + 1] AS n, place + 1 = 16 OR s + ns[i + 1] > 3000 AS x FROM p JOIN ext USING (g) WHERE i < len(ids)) p),
  r AS (SELECT ids[i] AS doc_id, place, count(*) OVER (PARTITION BY p.g, request) AS together FROM p JOIN ext USING (g))
  SELECT doc_id, coalesce(place, -1)::bigint AS place, coalesce(together, -1)::bigint AS together, CASE WHEN n <= 2000 THEN n ELSE -1 END::bigint AS tokens FROM t LEFT JOIN r USING (doc_id)""")
def embed_requests(spark, sf_dir):
    """Requests of at most 16 texts and 3,000 tokens, groups apart, to a model that answers out of order; over 2,000 tokens nothing is sent."""

    def model(texts):
        return [(i, [float(len(texts[i])), float(i)]) for i in reversed(range(len(texts)))]

    rows = documents(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 100).alias("g"), F.col("text").alias("content"))
    dealt = rows.repartition("g").sortWithinPartitions("g", "doc_id")  # a hundred ids a group
    out = embedding.embed_requests(dealt, model, max_texts=16, max_tokens=3000, text_tokens=2000, group="g")
    right = (F.col("embedding")[0] == F.length("content")) & (F.col("embedding")[1] == F.col("place"))
    place = F.when(F.col("error").isNotNull(), -1).when(right, F.col("place"))
    return out.select(
        "doc_id", place.cast("long").alias("place"), F.coalesce("together", F.lit(-1)).cast("long").alias("together"),
        F.when(F.col("error").isNull(), T.count_tokens(F.col("content"))).otherwise(-1).cast("long").alias("tokens")
    )


@query(f"""WITH {SQL_STATES}, o AS (SELECT DISTINCT sha256(text) AS h FROM old), n AS (SELECT DISTINCT sha256(text) AS h FROM new)
  SELECT (SELECT count(*) FROM o) AS first_run, (SELECT count(*) FROM n WHERE h NOT IN (SELECT h FROM o)) AS second_run, (SELECT count(*) FROM o WHERE h NOT IN (SELECT h FROM n)) AS unused,
    (SELECT max(c) FROM (SELECT count(*) AS c FROM new GROUP BY text)) AS most_uses""")
def embedding_cache(spark, sf_dir):
    """Two runs over documents that change: what each embeds, what the second leaves without use, and the most uses of one vector."""
    root = work_dir(spark, "cache")
    counts, cache = [], None
    for s in states(spark, sf_dir):
        rows = s.select(embedding.content_key(F.col("text")).alias("hash"), F.col("text").alias("content"))
        seen = Observation()
        new = embedding.embed_requests(embedding.missing(rows, cache), embedding.hash_model(), text_tokens=1 << 30, max_texts=256)
        new.observe(seen, F.count("embedding").alias("n")).select("hash", "embedding").write.mode("append").parquet(f"{root}/vectors")
        cache = spark.read.schema("hash string, embedding array<float>").parquet(f"{root}/vectors")
        counts.append(seen.get["n"])
    unused = embedding.unused(cache, rows).agg(F.count("*").alias("unused"))
    most = embedding.uses(rows).agg(F.max("uses").alias("most_uses"))
    return unused.join(F.broadcast(most), F.lit(True)).select(
        F.lit(counts[0]).cast("long").alias("first_run"), F.lit(counts[1]).cast("long").alias("second_run"), "unused", "most_uses"
    )


@query(f"""SELECT 'read' AS step, count(*) AS n_rows, sum(strlen(text))::bigint AS bytes, sum({sql_tokens('text')})::bigint AS tokens FROM documents
  UNION ALL SELECT 'kept', count(*), sum(strlen(text))::bigint, sum({sql_tokens('text')})::bigint FROM documents WHERE length(text) > 200""")
def observed_progress(spark, sf_dir):
    """Rows, bytes and tokens as they pass two points of one running plan, without a pass of their own."""
    read, kept = Observation(), Observation()
    totals = [F.count("*").alias("n_rows"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(T.count_tokens(F.col("text"))).alias("tokens")]
    rows = documents(spark, sf_dir).select("doc_id", "text").observe(read, *totals).where("length(text) > 200").observe(kept, *totals)
    rows.write.parquet(f"{work_dir(spark, 'observed')}/out")
    return spark.createDataFrame(
        [(step, *(o.get[k] for k in ("n_rows", "bytes", "tokens"))) for step, o in (("read", read), ("kept", kept))],
        "step string, n_rows long, bytes long, tokens long"
    )
