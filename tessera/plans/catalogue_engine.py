"""Registered queries that go through collections, chunk functions and streams, over the driver's tables; each has its rows in SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import errors
from tessera.functions import text as T
from tessera.operators import changes, chunking, extract, search, stats
from tessera.plans import catalogue as base
from tessera.plans.catalogue import PATH, SQL_FILES, SQL_PATH, documents, query, source_files, sources, sql_cosine, sql_line_pieces, sql_tokens, table
from tessera.plans.engine import embed_with
from tessera.session import spread, work_dir
from tessera.sources import files
from tessera.sources.collections import Collections, Folder


# ---- collections -----------------------------------------------------------------------------


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("p/"), F.col("vec_id") % 97).alias("path"), "label", "embedding"
    )


def dimensions(rows: DataFrame) -> int:
    return rows.select(F.size("embedding")).first()[0]


@query("SELECT vec_id::varchar AS id, label FROM embeddings WHERE vec_id % 7 <> 0")
def collection_insert_delete(spark, sf_dir):
    """Create, two inserts, delete of a table of ids, scan."""
    rows, c = vector_rows(spark, sf_dir), Collections(spark, work_dir(spark, "collections"), parts=8)
    c.create("v", dimensions(rows))
    c.insert("v", rows.where("id % 2 = 0"))
    c.insert("v", rows.where("id % 2 = 1"))
    c.delete("v", rows.where("id % 7 = 0").select("id"))
    return c.scan("v").select("id", "label")


@query("""SELECT id, label FROM (SELECT vec_id::varchar AS id, label, vec_id % 97 AS p FROM embeddings) WHERE p >= 10 UNION ALL SELECT vec_id || '-new', label + 100 FROM embeddings WHERE vec_id % 97 < 5""")
def collection_merge(spark, sf_dir):
    """Rows of ten paths go, new ones of five come: only the parts of those paths are written."""
    rows, c = vector_rows(spark, sf_dir), Collections(spark, work_dir(spark, "collections"), parts=8)
    c.create("v", dimensions(rows))
    c.insert("v", rows)
    number = F.substring("path", 3, 9).cast("int")
    fresh = rows.where(number < 5).select(F.concat("id", F.lit("-new")).alias("id"), "path", (F.col("label") + 100).alias("label"), "embedding")
    c.merge("v", rows.where(number < 10).select("path").distinct(), fresh)
    c.vacuum("v")
    return c.scan("v").select("id", "label")


@query("SELECT count(*) AS count, max(len(embedding)) AS dimensions, count(*) > 0 AS indexed, 'FLAT' AS index_type, 'COSINE' AS metric_type FROM embeddings")
def collection_status(spark, sf_dir):
    rows, c = vector_rows(spark, sf_dir), Collections(spark, work_dir(spark, "collections"))
    c.ensure("v", dimensions(rows))
    c.ensure("v", dimensions(rows))
    c.insert("v", rows)
    return spark.createDataFrame(
        [tuple(c.stats("v").values())], "count long, dimensions long, indexed boolean, index_type string, metric_type string"
    )


@query(f"""SELECT vec_id::varchar AS id, round({sql_cosine('embedding', base.Q)}, 6) AS score FROM embeddings WHERE label = 1 ORDER BY {sql_cosine('embedding', base.Q)} DESC, vec_id::varchar LIMIT 10""")
def collection_search(spark, sf_dir):
    """Top k of a collection with a filter: what an inserted table answers."""
    rows, c = vector_rows(spark, sf_dir), Collections(spark, work_dir(spark, "collections"))
    c.create("v", dimensions(rows))
    c.insert("v", rows)
    return search.top_k(c.scan("v"), base.first_vector(spark, sf_dir), 10, filters={"label": 1}).select("id", F.round("score", 6).alias("score"))


# ---- chunks, sources and metadata ------------------------------------------------------------


@query(f"""SELECT x.doc_id, piece AS seq, first_line AS start_line, last_line AS end_line, md5(array_to_string(list_slice(string_split(text, chr(10)), first_line, last_line), chr(10))) AS content_md5, 'sliding-window' AS granularity
  FROM ({sql_line_pieces(50)}) x JOIN documents USING (doc_id) WHERE text <> ''""")
def sliding_window_chunks(spark, sf_dir):
    docs = spread(documents(spark, sf_dir).select("doc_id", "text")).select(
        F.col("doc_id").cast("string").alias("path"), F.lit("text").alias("language"), F.col("text").alias("content")
    )
    rows = chunking.chunks_by("sliding-window", docs, docs, distinct=True)
    return rows.select(
        F.col("path").cast("long").alias("doc_id"), "seq", "start_line", "end_line", T.content_hash(F.col("content")).alias("content_md5"),
        "granularity"
    )


@query("""SELECT 'src/p' || page_id || '.' || language AS path, lines AS total_lines, chars + wide * length(page_id::varchar) AS total_chars, types AS chunk_types FROM pages,
  (VALUES ('javascript', 3, 69, 1, 'function'), ('ruby', 6, 42, 1, 'method,module'), ('typescript', 6, 126, 4, 'class,function,interface,method')) t(language, lines, chars, wide, types)""")
def parse_metadata(spark, sf_dir):
    found = sources(spark, sf_dir)
    return extract.parse_metadata(found, extract.extract_nodes(found)).select(
        "path", "total_lines", "total_chars", F.array_join("chunk_types", ",").alias("chunk_types")
    )


@query(f"WITH {SQL_FILES} SELECT page_id, path FROM g WHERE language IN ('ruby', 'python')")
def language_filter(spark, sf_dir):
    return files.of_languages(source_files(spark, sf_dir), ["ruby", "python"]).select("page_id", "path")


@query(f"WITH {SQL_FILES} SELECT language, count(*) AS files, CASE WHEN count(*) * 10 < 500 THEN 'small' WHEN count(*) * 10 < 5000 THEN 'medium' WHEN count(*) * 10 < 30000 THEN 'large' ELSE 'massive' END AS size FROM g GROUP BY language")
def project_size(spark, sf_dir):
    n = source_files(spark, sf_dir).groupBy("language").agg(F.count("*").alias("files"))
    return n.withColumn("size", stats.project_size(F.col("files")))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS lines, len(string_split(substr(text, 1, 50), chr(10))) AS line, length(list_extract(string_split(substr(text, 1, 50), chr(10)), -1)) AS col FROM documents")
def line_helpers(spark, sf_dir):
    place = T.line_and_column(F.col("text"), F.lit(50))
    return documents(spark, sf_dir).select(
        "doc_id", T.lines_between(F.col("text"), F.lit(2), F.lit(3)).alias("lines"), place["line"].alias("line"),
        place["column"].alias("col")
    )


@query(f"SELECT conv_id, sum({sql_tokens('text')})::bigint AS tokens FROM conversations GROUP BY conv_id")
def total_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(T.count_tokens(F.col("text"))).alias("tokens"))


@query("SELECT event_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events")
def metadata_round_trip(spark, sf_dir):
    """Metadata to JSON with ISO times and back."""
    kept = table(spark, sf_dir, "events").select("event_id", F.struct("event_type", F.col("ts").cast("timestamp").alias("at")).alias("m"))
    back = kept.select("event_id", T.metadata_from_json(T.metadata_json(F.col("m")), "event_type string, at timestamp").alias("m"))
    return back.select("event_id", "m.event_type", F.date_format("m.at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query(f"SELECT d.doc_id, {SQL_PATH} AS path, sha256(text) AS hash FROM documents d")
def snapshot_store(spark, sf_dir):
    """A snapshot written, named in the store and read again."""
    folder = Folder(spark, work_dir(spark, "snapshots"))
    docs = documents(spark, sf_dir).select("doc_id", F.expr(PATH).alias("path"), "text")
    changes.snapshot(docs, content="text").write.parquet(f"{folder.root}/snapshot-1")
    folder.write("snapshot", "snapshot-1")
    snap = spark.read.parquet(f"{folder.root}/{folder.read('snapshot')}")
    return docs.select("doc_id", "path").join(snap, "path")


@query("SELECT doc_id, CASE WHEN length(text) % 5 = 0 THEN -1 ELSE length(text)::double END AS first, CASE WHEN length(text) % 5 = 0 THEN 'Model m is not available' ELSE '' END AS error FROM documents")
def embed_batches(spark, sf_dir):
    """Embedding in batches: one that fails has no vectors and its error, the others go on."""

    def model(texts):
        if any(len(t) % 5 == 0 for t in texts):
            raise errors.ModelNotAvailable("local", "m")
        return [[float(len(t)), 1.0] for t in texts]

    rows = embed_with(documents(spark, sf_dir).select("doc_id", F.col("text").alias("content")), model, batch=1)
    return rows.select(
        "doc_id", F.coalesce(F.col("embedding")[0].cast("double"), F.lit(-1.0)).alias("first"),
        F.coalesce("error", F.lit("")).alias("error")
    )


@query("SELECT item_id, unnest(list_slice(string_split(text, ' '), 1, 3)) AS word FROM benchmark")
def flatten_lists(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        "item_id", F.explode(F.flatten(F.array(F.slice(F.split("text", " "), 1, 2), F.slice(F.split("text", " "), 3, 1)))).alias("word")
    )


@query("SELECT doc_id FROM documents")
def shuffled_rows(spark, sf_dir):
    return stats.shuffled(documents(spark, sf_dir).select("doc_id"), 7)


@query("SELECT customer AS user_id, max(event_id) AS event_id FROM (SELECT user_id AS customer, event_id FROM events) GROUP BY 1")
def latest_rows(spark, sf_dir):
    """The last event of each user."""
    return stats.latest(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


# ---- streams ---------------------------------------------------------------------------------


@query("SELECT event_id, event_type FROM events")
def stream_fresh_triggers(spark, sf_dir):
    """The events twice in one stream: each trigger passes once, those too late for the watermark not at all (none in one batch)."""
    from tessera.streaming import feed

    root = work_dir(spark, "stream")
    events = table(spark, sf_dir, "events")
    events.unionByName(events).write.parquet(f"{root}/in")
    fresh = feed.fresh_triggers(feed.stream(spark, f"{root}/in", events.schema))
    fresh.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(fresh.schema).parquet(f"{root}/out").select("event_id", "event_type")
