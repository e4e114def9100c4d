"""Registered queries over the driver's tables, each with the same result in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed, vectors
from tessera.functions import text as T
from tessera.operators import changes, chunking, extract, keywords, search, stats
from tessera.session import spread
from tessera.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


PATH = "concat(source, '/', doc_id, '.', lang)"
SQL_PATH = "(source || '/' || doc_id || '.' || lang)"


def in_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


# ---- SQL fragments ---------------------------------------------------------------------------


def sql_tokens(x: str) -> str:
    return (rf"(len(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')) + len(regexp_extract_all({x}, '[.,;:!?(){{}}\[\]<>]'))"
            rf" + len(regexp_extract_all({x}, '[=+\-*/%&|^~<>]')) // 2)")  # fmt: skip


def sql_plain_words(x: str) -> str:
    return rf"list_filter(string_split_regex(lower(regexp_replace({x}, '[^\w\s]', ' ', 'g')), '\s+'), lambda w: length(w) > 2)"


def sql_chunk_keywords(table_: str, key: str, text: str, stop=fixed.CHUNK_STOP_WORDS, most: int = 10) -> str:
    """CTE body: key, list of keywords."""
    return f"""
      SELECT {key}, coalesce(list(w ORDER BY pos) FILTER (WHERE r <= {most}), []) AS kw FROM (
        SELECT {key}, w, pos, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS r FROM (
          SELECT {key}, w, min(pos) AS pos FROM (
            SELECT {key}, unnest({sql_plain_words(text)}) AS w, generate_subscripts({sql_plain_words(text)}, 1) AS pos FROM {table_})
          WHERE w NOT IN {in_list(stop)} GROUP BY {key}, w))
      GROUP BY {key}"""


def sql_cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::double[], {b}::double[])"


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").orderBy("vec_id").first()
    return list(map(float, row.embedding))


Q = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


# ---- vectors and search ----------------------------------------------------------------------


def _top_k(spark: SparkSession, sf_dir: str, metric: str, **more) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return search.top_k(rows, first_vector(spark, sf_dir), 10, metric, **more).select("id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS id, label, round({sql_cosine('embedding', Q)}, 6) AS score FROM embeddings ORDER BY {sql_cosine('embedding', Q)} DESC, vec_id LIMIT 10")
def vector_topk_cosine(spark, sf_dir):
    return _top_k(spark, sf_dir, "COSINE")


@query(f"SELECT vec_id AS id, label, round(list_distance(embedding::double[], {Q}::double[]), 6) AS score FROM embeddings ORDER BY list_distance(embedding::double[], {Q}::double[]), vec_id LIMIT 10")
def vector_topk_l2(spark, sf_dir):
    return _top_k(spark, sf_dir, "L2")


@query(f"SELECT vec_id AS id, label, round(list_inner_product(embedding::double[], {Q}::double[]), 6) AS score FROM embeddings ORDER BY list_inner_product(embedding::double[], {Q}::double[]) DESC, vec_id LIMIT 10")
def vector_topk_ip(spark, sf_dir):
    return _top_k(spark, sf_dir, "IP")


@query(f"""SELECT id, label, round(s, 6) AS score FROM (SELECT vec_id AS id, label, {sql_cosine('embedding', Q)} AS s FROM embeddings WHERE label = 1
           ORDER BY s DESC, vec_id LIMIT 10) WHERE s >= 0.1""")
def vector_topk_filtered(spark, sf_dir):
    return _top_k(spark, sf_dir, "COSINE", filters={"label": 1}, min_score=0.1)


@query(f"""WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS query FROM embeddings GROUP BY label),
  s AS (SELECT query_id, vec_id AS id, {sql_cosine('embedding', 'query')} AS sc FROM embeddings, q)
  SELECT query_id, id, rank, round(sc, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, id) AS rank FROM s) WHERE rank <= 5""")
def batch_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    queries = rows.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "id").alias("query"))
    return search.batch_top_k(queries, rows, 5).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 100 = 0),
  s AS (SELECT query_id, vec_id AS id, {sql_cosine('embedding', 'query')} AS sc FROM embeddings, q)
  SELECT query_id, id, rank, round(sc, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, id) AS rank FROM s) WHERE rank <= 10""")
def batch_topk_hundredth(spark, sf_dir):
    """Every row with an id divisible by 100 against all rows."""
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return search.batch_top_k(queries, rows, 10).select(
        "query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score")
    )


def indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents with vectors as chunks: (id, language, embedding), and what is read of the hits alone: (id, path, content)."""
    docs = documents(spark, sf_dir)
    vectors_ = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("language")).join(vectors_, "id")
    return rows, docs.select(F.col("doc_id").alias("id"), F.expr(PATH).alias("path"), F.col("text").alias("content"))


SEARCH_TEXT = "find things about the other"
SEARCH_WORDS = ("find", "things", "about", "other")


@query(f"""WITH kw AS ({sql_chunk_keywords('documents', 'doc_id', 'text')}),
  hits AS (SELECT d.doc_id AS id, {SQL_PATH} AS path, text, {sql_cosine('embedding', Q)} AS s FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id
           WHERE lang = 'en' ORDER BY s DESC, d.doc_id LIMIT 10),
  scored AS (SELECT h.*, s * 0.6 + 0.4 * len(list_filter({list(SEARCH_WORDS)}, lambda q: len(list_filter(coalesce(kw, []), lambda c: contains(c, q))) > 0)) / 4 AS h FROM hits h LEFT JOIN kw ON kw.doc_id = h.id WHERE s >= 0.05)
  SELECT id, path, row_number() OVER (ORDER BY h DESC, id) AS rank, round(h, 6) AS score, CASE WHEN len(string_split(text, chr(10))) <= 20 THEN text
    ELSE array_to_string(list_slice(string_split(text, chr(10)), 1, 15), chr(10)) || chr(10) || '... (truncated)' END AS snippet FROM scored""")
def hybrid_search(spark, sf_dir):
    rows, details = indexed(spark, sf_dir)
    hits = search.search_once(rows, SEARCH_TEXT, first_vector(spark, sf_dir), 10, 0.05, {"language": "en"}, details=details)
    return hits.select("id", "path", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "snippet")


#: (query, text, minimal score): the first has results at once, the second on an expanded rung, the third on the last.
LADDER = ((0, "create other things", 0.2), (1, "check the handler", 0.4), (2, "zzz", 0.99))


def ladder_rungs() -> list[tuple[int, int, str, float]]:
    return [(q, p, t, m) for q, text, least in LADDER for p, t, m in search.passes(T.preprocess_query(text), least)]


def _rung_keywords(text: str) -> list[str]:
    import re

    words = [w for w in re.split(r"\s+", re.sub(r"[^\w\s]", " ", text.lower(), flags=re.ASCII)) if len(w) > 2]
    return [w for w in dict.fromkeys(words) if w not in fixed.SCORED_STOP_WORDS][:10]


def _ladder_sql() -> str:
    rows = ", ".join(f"({q}, {p}, {m!r}::double, {0.6 if len(t.split()) > 3 else 0.7}, {_rung_keywords(t) or '[]::varchar[]'}::varchar[])" for q, p, t, m in ladder_rungs())
    return f"""WITH rungs(query_id, pass, min_score, vw, qk) AS (VALUES {rows}),
      r AS (SELECT rungs.*, embedding AS query FROM rungs JOIN embeddings ON vec_id = query_id * 7 + pass),
      kw AS ({sql_chunk_keywords('documents', 'doc_id', 'text')}),
      s AS (SELECT query_id, pass, min_score, vw, qk, d.doc_id AS id, {sql_cosine('e.embedding', 'query')} AS sc FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, r WHERE lang = 'en'),
      top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pass ORDER BY sc DESC, id) AS n FROM s) WHERE n <= 10 AND sc >= min_score),
      h AS (SELECT query_id, pass, id, sc * vw + (1 - vw) * CASE WHEN len(qk) = 0 THEN 0 ELSE len(list_filter(qk, lambda q: len(list_filter(coalesce(kw, []), lambda c: contains(c, q))) > 0)) / len(qk) END AS score
            FROM top LEFT JOIN kw ON kw.doc_id = id),
      k AS (SELECT *, row_number() OVER (PARTITION BY query_id, pass ORDER BY score DESC, id) AS rank FROM h)
      SELECT query_id, pass, id, rank, round(score, 6) AS score FROM k JOIN (SELECT query_id AS q2, min(pass) AS p2 FROM k GROUP BY 1) ON q2 = query_id AND p2 = pass"""


@query(_ladder_sql())
def search_ladder(spark, sf_dir):
    rungs = spark.createDataFrame(ladder_rungs(), "query_id int, pass int, text string, min_score double")
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("query"))
    rungs = rungs.join(vec, F.col("vec_id") == F.col("query_id") * 7 + F.col("pass"))
    rows, details = indexed(spark, sf_dir)
    hits = search.search_ladder(rows, rungs, 10, {"language": "en"}, details=details)
    return hits.select("query_id", "pass", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""SELECT id, url, rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (
  SELECT vec_id AS id, url, {sql_cosine('embedding', Q)} AS s FROM embeddings JOIN pages ON page_id = vec_id ORDER BY s DESC, vec_id LIMIT 50)) WHERE regexp_matches(url, '\\.html|[02468]$', 'i')""")
def path_filter_ranked(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").join(
        table(spark, sf_dir, "pages"), F.col("vec_id") == F.col("page_id")
    ).select(F.col("vec_id").alias("id"), "url", "embedding")
    hits = search.ranked(search.top_k(rows, first_vector(spark, sf_dir), 50))
    return search.path_filter(hits, r"\.html|[02468]$", "url").select(
        "id", "url", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score")
    )


# ---- text ------------------------------------------------------------------------------------


@query("""SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 10), chr(10)) AS snippet, text AS context,
  CASE WHEN len(string_split(text, chr(10))) <= 20 THEN text ELSE array_to_string(list_slice(string_split(text, chr(10)), 1, 15), chr(10)) || chr(10) || '... (truncated)' END AS hybrid FROM documents""")
def snippet_format(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", T.snippet(t, "snippet").alias("snippet"), T.context(t, "context").alias("context"), T.snippet(t, "hybrid").alias("hybrid")
    )


@query(f"SELECT doc_id, {sql_tokens('text')} AS tokens, ceil(n_chars / 4)::bigint AS by_chars, {sql_tokens('text')} * 4 AS chars FROM documents")
def token_count(spark, sf_dir):
    n = T.count_tokens(F.col("text")).cast("long")
    return documents(spark, sf_dir).select(
        "doc_id", n.alias("tokens"), T.tokens_from_chars(F.col("n_chars")).alias("by_chars"), T.chars_from_tokens(n).alias("chars")
    )


@query(f"SELECT doc_id, CASE WHEN n <= 100 THEN text ELSE substr(text, 1, floor(length(text) * (100::double / n))::int) END AS text FROM (SELECT *, {sql_tokens('text')} AS n FROM documents)")
def token_truncate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.truncate_to_limit(F.col("text"), 100).alias("text"))


@query(f"SELECT lang, count(*) FILTER (WHERE n > 250) AS oversized, sum(n)::bigint AS tokens FROM (SELECT lang, {sql_tokens('text')} AS n FROM documents) GROUP BY lang")
def oversized_chunks(spark, sf_dir):
    rows = documents(spark, sf_dir).select("lang", T.count_tokens(F.col("text")).alias("n"), T.exceeds_limit(F.col("text"), 250).alias("over"))
    return rows.groupBy("lang").agg(F.count(F.when(F.col("over"), 1)).alias("oversized"), F.sum("n").alias("tokens"))


def sql_line_pieces(overlap: int) -> str:
    """Recursive walk over line numbers: piece number of each line (and first line of each piece)."""
    back = -(-overlap // 10)
    return f"""WITH RECURSIVE l AS (SELECT doc_id, i, line, {sql_tokens('line')} AS t FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
      cum AS (SELECT *, sum(t) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM l),
      ext AS (SELECT doc_id, list(c ORDER BY i) AS c, list(t ORDER BY i) AS t, max(i) AS n, list(line ORDER BY i) AS lines FROM cum GROUP BY doc_id),
      p AS (SELECT doc_id, 0 AS piece, 1 AS a, 1 AS i, t[1]::bigint AS s, false AS cut, 0 AS b FROM ext
        UNION ALL
        SELECT p.doc_id, piece + CASE WHEN s + t[p.i + 1] > 250 THEN 1 ELSE 0 END,
          CASE WHEN s + t[p.i + 1] > 250 THEN greatest(a, p.i + 1 - {back}) ELSE a END, p.i + 1,
          CASE WHEN s + t[p.i + 1] > 250 THEN list_sum(list_slice(t, greatest(a, p.i + 1 - {back}), p.i + 1)) ELSE s + t[p.i + 1] END, s + t[p.i + 1] > 250, p.i
        FROM p JOIN ext USING (doc_id) WHERE p.i < n)
      SELECT p.doc_id, piece, min(a) AS first_line, max(p.i) AS last_line FROM p GROUP BY p.doc_id, piece"""


@query(f"""SELECT x.doc_id, piece, first_line, last_line, md5(array_to_string(list_slice(string_split(text, chr(10)), first_line, last_line), chr(10))) AS content_md5
  FROM ({sql_line_pieces(0)}) x JOIN documents USING (doc_id)""")
def line_chunks(spark, sf_dir):
    rows = spread(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", F.posexplode(chunking.split_lines(F.col("text"), F.lit(1))).alias("piece", "c")
    )
    return rows.select(
        "doc_id", "piece", F.col("c.start_line").alias("first_line"), F.col("c.end_line").alias("last_line"),
        T.content_hash(F.col("c.content")).alias("content_md5")
    )


@query(f"""SELECT x.doc_id, piece, md5(array_to_string(list_slice(string_split(text, chr(10)), first_line, last_line), chr(10))) AS content_md5
  FROM ({sql_line_pieces(50)}) x JOIN documents USING (doc_id)""")
def overlap_chunks(spark, sf_dir):
    rows = spread(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", F.posexplode(chunking.split_overlapping(F.col("text"))).alias("piece", "c")
    )
    return rows.select("doc_id", "piece", T.content_hash(F.col("c")).alias("content_md5"))


def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as nodes, two lines apart."""
    node = F.struct(
        F.lit("function").alias("type"), F.col("role").alias("name"), F.col("text").alias("content"),
        (F.col("turn") * 2).cast("int").alias("start_line"), (F.col("turn") * 2).cast("int").alias("end_line"),
        F.lit(0).alias("start_char"), F.length("text").alias("end_char")
    )
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", node.alias("n")))).alias("r"))
    return grouped.select("conv_id", F.transform("r", lambda x: x["n"]).alias("nodes"))


@query(f"""WITH RECURSIVE ext AS (SELECT conv_id, list(t ORDER BY turn, role, text) AS t, list(turn ORDER BY turn, role, text) AS turns, list(role ORDER BY turn, role, text) AS roles, list(text ORDER BY turn, role, text) AS texts, count(*) AS n
      FROM (SELECT *, {sql_tokens('text')} AS t FROM conversations) GROUP BY conv_id),
    p AS (SELECT conv_id, 0 AS g, 1 AS a, 1 AS i, t[1] AS s FROM ext UNION ALL
      SELECT p.conv_id, g + CASE WHEN x THEN 1 ELSE 0 END, CASE WHEN x THEN i + 1 ELSE a END, i + 1, CASE WHEN x THEN nt ELSE s + nt END FROM (
        SELECT p.*, t[i + 1] AS nt, s + t[i + 1] > 250 OR 2 * (turns[i + 1] - turns[i]) > 3 AS x FROM p JOIN ext USING (conv_id) WHERE i < n) p)
    SELECT conv_id, g AS seq, 2 * turns[a] AS start_line, 2 * turns[b] AS end_line, array_to_string(list_slice(roles, a, b), ', ') AS name,
      md5(array_to_string(list_slice(texts, a, b), chr(10) || chr(10))) AS content_md5 FROM (SELECT conv_id, g, min(a) AS a, max(i) AS b FROM p GROUP BY conv_id, g) JOIN ext USING (conv_id)""")
def merge_chunks(spark, sf_dir):
    rows = conversation_nodes(spark, sf_dir).select("conv_id", F.posexplode(chunking.merge_nodes(F.col("nodes"))).alias("seq", "c"))
    return rows.select(
        "conv_id", "seq", F.col("c.start_line").cast("long").alias("start_line"), F.col("c.end_line").cast("long").alias("end_line"),
        F.col("c.name").alias("name"), T.content_hash(F.col("c.content")).alias("content_md5")
    )


SQL_WRAP = "((({h} * 31 + {c}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"


@query(f"""SELECT doc_id, 'chunk-' || lower(to_base(abs(list_reduce(list_prepend(0::bigint, list_transform(string_split({SQL_PATH} || ':1:' || len(string_split(text, chr(10))), ''), lambda c: ord(c)::bigint)),
  lambda h, c: {SQL_WRAP.format(h='h', c='c')})), 36)) AS id FROM documents""")
def chunk_ids(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.chunk_id(F.expr(PATH), F.lit(1), F.size(F.split("text", "\n"))).alias("id"))


@query(f"SELECT d.doc_id, array_to_string(coalesce(kw, []), ' ') AS keywords FROM documents d LEFT JOIN ({sql_chunk_keywords('documents', 'doc_id', 'text')}) k USING (doc_id)")
def chunk_keywords(spark, sf_dir):
    return spread(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", F.array_join(T.chunk_keywords(F.col("text")), " ").alias("keywords")
    )


def sql_identifier_words(text: str) -> str:
    x = text
    for pattern in (r"(?m)//.*$", r"/\*[\s\S]*?\*/", r"(?m)#.*$", r'"[^"]*"', r"''[^'']*''", r"`[^`]*`"):
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    names = rf"regexp_extract_all({x}, '\b[a-zA-Z_][a-zA-Z0-9_]*\b')"
    parts = rf"flatten(list_transform({names}, lambda n: string_split_regex(regexp_replace(n, '([a-z])([A-Z])', '\1 \2', 'g'), '[_\s]+')))"
    return f"list_filter(list_transform({parts}, lambda p: lower(p)), lambda w: length(w) > 2 AND w NOT IN {in_list(fixed.IDENTIFIER_STOP_WORDS)})"


@query(f"""SELECT doc_id, keyword, rank FROM (SELECT doc_id, w AS keyword, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM (
  SELECT doc_id, w, count(*) AS n, min(pos) AS pos FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {sql_identifier_words('text')} AS ws FROM documents)) GROUP BY doc_id, w)) WHERE rank <= 10""")
def identifier_keywords(spark, sf_dir):
    return keywords.identifier_keywords(documents(spark, sf_dir), "doc_id", "text").withColumn("rank", F.col("rank").cast("long"))


def sql_scored(table_: str, key: str, text: str, corpus: bool) -> str:
    score = "n / size" + (f" * coalesce((SELECT ln((SELECT count(*) FROM {table_}) / count(*)) FROM {table_} d WHERE contains(lower(d.{text}), w) HAVING count(*) > 0), 0)" if corpus else "")
    return rf"""WITH raw AS (SELECT {key}, string_split_regex(lower({text}), '\s+') AS r, {sql_plain_words(text)} AS ws FROM {table_}),
      cand AS (SELECT {key}, w, min(pos) AS pos, any_value(size) AS size FROM (SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos, len(r) AS size FROM raw)
        WHERE w NOT IN {in_list(fixed.SCORED_STOP_WORDS)} GROUP BY {key}, w),
      cnt AS (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest(r) AS w FROM raw) GROUP BY {key}, w),
      sc AS (SELECT {key}, w AS keyword, pos, {score} AS s FROM (SELECT c.*, coalesce(n, 0) AS n FROM cand c LEFT JOIN cnt USING ({key}, w)))
      SELECT {key}, keyword, rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s DESC, pos) AS rank FROM sc) WHERE rank <= 10"""


@query(sql_scored("documents", "doc_id", "text", False))
def tf_top_keywords(spark, sf_dir):
    rows = keywords.scored_keywords(spread(documents(spark, sf_dir).select("doc_id", "text")), "doc_id", "text")
    return rows.select("doc_id", "keyword", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(sql_scored("benchmark", "item_id", "text", True))
def tfidf_top_keywords(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    rows = keywords.scored_keywords(items, "item_id", "text", corpus=items)
    return rows.select("item_id", "keyword", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""WITH k AS ({sql_chunk_keywords('documents', 'doc_id', 'text')}), j AS (SELECT a.doc_id, a.kw AS x, b.kw AS y FROM k a JOIN k b ON b.doc_id = a.doc_id + 1)
  SELECT doc_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM j WHERE len(list_concat(x, y)) > 0""")
def keyword_jaccard(spark, sf_dir):
    k = documents(spark, sf_dir).select("doc_id", T.chunk_keywords(F.col("text")).alias("kw")).where(F.size("kw") > 0)
    other = k.select((F.col("doc_id") - 1).alias("doc_id"), F.col("kw").alias("other"))
    return k.join(other, "doc_id").select("doc_id", F.round(T.keyword_similarity(F.col("kw"), F.col("other")), 6).alias("similarity"))


def _preprocess_sql(x: str) -> str:
    out = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    for short, long in fixed.ABBREVIATIONS:
        out = rf"regexp_replace({out}, '\b{short}\b', '{long}', 'gi')"
    return out


@query(f"SELECT item_id, {_preprocess_sql(chr(39) + 'find  auth config for db params ' + chr(39) + ' || text')} AS query FROM benchmark")
def query_preprocess(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        "item_id", T.preprocess_column(F.concat(F.lit("find  auth config for db params "), "text")).alias("query")
    )


def _expand_sql(queries: str) -> str:
    """Expansion of queries(query_id, q)."""
    synonyms = ", ".join(f"('{k}', {i}, '{s}')" for k, v in fixed.SYNONYMS.items() for i, s in enumerate(v))
    return rf"""WITH q(query_id, q) AS ({queries}), syn(word, k, s) AS (VALUES {synonyms}),
      w AS (SELECT query_id, q, string_split_regex(lower(q), '\s+') AS ws FROM q),
      e AS (SELECT query_id, ws, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
      all_ AS (SELECT query_id, q AS text, 0 AS i, 0 AS k, 0 AS o FROM q UNION ALL SELECT query_id, word, i, -1, 0 FROM e
        UNION ALL SELECT query_id, s, i, k, 0 FROM e JOIN syn USING (word)
        UNION ALL SELECT query_id, array_to_string(list_prepend(s, list_filter(ws, lambda x: x <> word)), ' '), i, k, 1 FROM e JOIN syn USING (word) WHERE len(list_filter(ws, lambda x: x <> word)) > 0)
      SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY f) AS seq FROM (SELECT query_id, text, min((i, k, o)) AS f FROM all_ GROUP BY query_id, text)"""


@query(_expand_sql("SELECT item_id, 'find auth ' || list_extract(['test', 'model', 'error', 'api'], (item_id % 4 + 1)::int) || ' ' || string_split(text, ' ')[1] FROM benchmark"))
def query_expand_table(spark, sf_dir):
    """Expansion of a table of queries, in columns."""
    kind = F.element_at(F.array(*map(F.lit, ("test", "model", "error", "api"))), (F.col("item_id") % 4 + 1).cast("int"))
    queries = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat(F.lit("find auth "), kind, F.lit(" "), F.split("text", " ")[0]).alias("q")
    )
    found = queries.select("query_id", F.posexplode(T.expand_column(F.col("q"))).alias("seq", "text"))
    return found.select("query_id", "text", (F.col("seq") + 1).cast("long").alias("seq"))


@query(r"""SELECT page_id, array_to_string(['lib/' || page_id, url, 'm' || (page_id + 1)], ' ') AS script, array_to_string(['json', 'helper' || page_id], ' ') AS ruby,
  array_to_string(['os', 'pkg' || page_id, 'name'], ' ') AS python FROM pages""")
def dependencies(spark, sf_dir):
    i = F.col("page_id").cast("string")
    script = F.concat(
        F.lit("import a from 'lib/"), i, F.lit("'\nconst b = require( '"), F.lit("m"), (F.col("page_id") + 1).cast("string"),
        F.lit("' )\nimport { c } from \""), "url", F.lit("\"\nrequire('lib/"), i, F.lit("')")
    )
    ruby = F.concat(F.lit("require 'json'\nrequire_relative \"helper"), i, F.lit("\"\nrequire 'json'"))
    python = F.concat(F.lit("import os\nfrom pkg"), i, F.lit(" import name\n"))
    join = lambda text, language: F.array_join(T.dependencies(text, F.lit(language)), " ")
    return table(spark, sf_dir, "pages").select(
        "page_id", join(script, "typescript").alias("script"), join(ruby, "ruby").alias("ruby"), join(python, "python").alias("python")
    )


@query("SELECT md5(text) AS hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(T.content_hash(F.col("text")).alias("hash")).agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies")
    )


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def string_hashes(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", *(T.string_hash(t, a).alias(a) for a in ("md5", "sha1", "sha256")))


# ---- changes ---------------------------------------------------------------------------------
# The second state of the tree: documents that are labelled toxic are gone, those of quality 0 are
# edited, and the benchmark items are new files.

SQL_STATES = f"""old AS (SELECT {SQL_PATH} AS path, text FROM documents),
  lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
  new AS (SELECT {SQL_PATH} AS path, CASE WHEN quality = 0 THEN text || '!' ELSE text END AS text FROM documents LEFT JOIN lab USING (doc_id) WHERE coalesce(toxic, 0) = 0
    UNION ALL SELECT 'bench/' || item_id AS path, text FROM benchmark),
  diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
    FROM old o FULL JOIN new n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR sha256(o.text) <> sha256(n.text))"""


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf_dir).withColumn("path", F.expr(PATH))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    new = docs.join(labels, "doc_id", "left").where("coalesce(toxic, 0) = 0").select(
        "path", F.when(F.col("quality") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text")
    )
    added = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench/"), "item_id").alias("path"), "text")
    return docs.select("path", "text"), new.unionByName(added)


def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = states(spark, sf_dir)
    return changes.diff(changes.snapshot(old, content="text"), changes.snapshot(new, content="text"))


@query(f"WITH {SQL_STATES} SELECT path, change FROM diff")
def snapshot_diff(spark, sf_dir):
    return difference(spark, sf_dir)


@query(f"""WITH {SQL_STATES} SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'modified') AS modified,
  count(*) FILTER (WHERE change = 'deleted') AS deleted, count(*) FILTER (WHERE change <> 'deleted') AS processed FROM diff""")
def diff_counts(spark, sf_dir):
    return changes.change_counts(difference(spark, sf_dir))


def sql_chunks(state: str) -> str:
    return f"SELECT path, i, line AS content FROM (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {state})"


@query(f"WITH {SQL_STATES} SELECT path, i, md5(content) AS content_md5 FROM ({sql_chunks('new')})")
def incremental_merge(spark, sf_dir):
    old, new = states(spark, sf_dir)
    lines = lambda s: s.select("path", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    merged = changes.incremental_merge(lines(old), difference(spark, sf_dir), lines(new))
    return merged.select("path", (F.col("i") + 1).cast("long").alias("i"), T.content_hash(F.col("content")).alias("content_md5"))


@query(f"""WITH {SQL_STATES} SELECT count(*) FILTER (WHERE change = 'added') AS chunks_added, count(*) FILTER (WHERE change = 'modified') AS chunks_updated
  FROM ({sql_chunks('new')}) JOIN diff USING (path) WHERE change <> 'deleted'""")
def chunk_counters(spark, sf_dir):
    _, new = states(spark, sf_dir)
    return changes.chunk_counters(new.select("path", F.explode(F.split("text", "\n"))), difference(spark, sf_dir))


@query("SELECT sha256(string_agg(h, '' ORDER BY h)) AS root_hash, count(*) AS file_count FROM (SELECT sha256(text) AS h FROM documents)")
def merkle_root_flat(spark, sf_dir):
    return changes.flat_root(changes.snapshot(documents(spark, sf_dir).select(F.expr(PATH).alias("path"), "text"), content="text"))


@query(f"""WITH RECURSIVE leaves AS (SELECT list(h ORDER BY path) AS l FROM (SELECT {SQL_PATH} AS path, sha256(text) AS h FROM documents)),
  t AS (SELECT l, len(l) AS leaves FROM leaves UNION ALL
    SELECT list_transform(range(1, (len(l) + 1) // 2 + 1), lambda i: CASE WHEN 2 * i <= len(l) THEN sha256(l[2 * i - 1] || l[2 * i]) ELSE l[2 * i - 1] END), leaves FROM t WHERE len(l) > 1)
  SELECT l[1] AS root_hash, leaves FROM t WHERE len(l) = 1""")
def merkle_root_pairwise(spark, sf_dir):
    return changes.pairwise_root(changes.snapshot(documents(spark, sf_dir).select(F.expr(PATH).alias("path"), "text"), content="text"))


# ---- files and estimates ---------------------------------------------------------------------


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as files: a path with an extension by length, and a size."""
    ext = F.element_at(F.array(*(F.lit(e) for e in (".ts", ".js", ".rb", ".py", ".md", ".tsx", ".mjs"))), (F.length("html") % 7 + 1).cast("int"))
    pages = table(spark, sf_dir, "pages")
    return files.described(pages.select(
        F.concat(
            F.when(F.length("url") % 3 == 0, "src/").when(F.length("url") % 3 == 1, "lib/a/").otherwise("node_modules/x/"), F.lit("f"),
            "page_id", F.when(F.length("html") % 5 == 0, ".test").otherwise(""), ext
        ).alias("path"),
        F.length("html").cast("long").alias("size"), "page_id"
    ))


SQL_FILES = """f AS (SELECT page_id, length(html)::bigint AS size, CASE length(url) % 3 WHEN 0 THEN 'src/' WHEN 1 THEN 'lib/a/' ELSE 'node_modules/x/' END || 'f' || page_id
    || CASE WHEN length(html) % 5 = 0 THEN '.test' ELSE '' END || ['.ts', '.js', '.rb', '.py', '.md', '.tsx', '.mjs'][length(html) % 7 + 1] AS path,
    ['.ts', '.js', '.rb', '.py', '.md', '.tsx', '.mjs'][length(html) % 7 + 1] AS ext FROM pages),
  g AS (SELECT *, CASE ext WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.rb' THEN 'ruby' WHEN '.py' THEN 'python' END AS language FROM f)"""


@query(f"WITH {SQL_FILES} SELECT page_id, path, ext AS extension, language FROM g")
def language_detect(spark, sf_dir):
    return source_files(spark, sf_dir).select("page_id", "path", "extension", "language")


@query(f"WITH {SQL_FILES} SELECT language, count(*) AS files, sum(size)::bigint AS bytes, grouping(language)::int AS total FROM g GROUP BY ROLLUP (language)")
def file_stats(spark, sf_dir):
    return stats.file_stats(source_files(spark, sf_dir)).withColumn("total", F.col("total").cast("int"))


@query(f"WITH {SQL_FILES} SELECT ext AS extension, count(*) AS files FROM g GROUP BY 1")
def extension_histogram(spark, sf_dir):
    return stats.extension_histogram(source_files(spark, sf_dir))


@query(f"""WITH {SQL_FILES} SELECT CASE ext WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.rb' THEN 'ruby' ELSE 'typescript' END AS primary_language
  FROM (SELECT ext, count(*) AS n, min(path) AS first FROM g GROUP BY ext ORDER BY n DESC, first LIMIT 1)""")
def primary_language(spark, sf_dir):
    return stats.primary_language(source_files(spark, sf_dir))


@query(f"WITH {SQL_FILES} SELECT page_id, path, size FROM g WHERE size <= 2048 AND language IS NOT NULL")
def size_filter(spark, sf_dir):
    return files.selected(source_files(spark, sf_dir), ["**"], [], max_bytes=files.parse_size("2KB")).select("page_id", "path", "size")


@query(f"""WITH {SQL_FILES} SELECT page_id, path FROM g WHERE (path LIKE 'src/%' OR path LIKE 'lib/%') AND NOT regexp_matches(path, '\\.test\\.(ts|rb)$') AND language IS NOT NULL
  AND NOT (path LIKE 'lib/%' AND regexp_matches(path, 'f[0-9]*1\\.'))""")
def path_glob_filter(spark, sf_dir):
    rules = files.ignore_rules("# generated\nlib/**/f*1.*\n")
    return files.selected(
        source_files(spark, sf_dir), ["src/**/*", "lib/**/*"], ["node_modules/**", "**/*.test.{ts,rb}"], rules, 1 << 30
    ).select("page_id", "path")


@query(f"""WITH {SQL_FILES}, n AS (SELECT language, count(*) AS files FROM g WHERE language IS NOT NULL GROUP BY language),
  c AS (SELECT *, floor(files * CASE language WHEN 'typescript' THEN 6.0 WHEN 'javascript' THEN 6.0 WHEN 'ruby' THEN 3.5 WHEN 'python' THEN 4.5 ELSE 4.0 END + 0.5)::bigint AS chunks FROM n),
  s AS (SELECT *, chunks / 28.0::double + files / 700.0::double + 10 AS sec, chunks * 175 * 0.02::double / 1e6 AS cost FROM c)
  SELECT language, files, chunks, round(sec, 6) AS seconds, CASE WHEN sec < 60 THEN '~' || floor(sec)::bigint || ' seconds' WHEN sec < 120 THEN '~1-2 minutes' ELSE '~' || floor(sec / 60)::bigint || '-' || (floor(sec / 60)::bigint + 1) || ' minutes' END AS time,
    CASE WHEN cost < 0.01 THEN printf('~$%.6f (<1 cent)', round(cost::decimal(18, 9), 6)::double) ELSE printf('~$%.4f', round(cost::decimal(18, 9), 4)::double) END AS cost FROM s""")
def preflight_estimate(spark, sf_dir):
    n = source_files(spark, sf_dir).where("language is not null").groupBy("language").agg(F.count("*").alias("files"))
    n = n.withColumn("chunks", stats.estimate_chunks(F.col("files"), F.col("language")))
    seconds = stats.estimate_seconds(F.col("files"), F.col("chunks"))
    return n.select(
        "language", "files", "chunks", F.round(seconds, 6).alias("seconds"), stats.time_text(seconds).alias("time"),
        stats.cost_text(F.col("chunks")).alias("cost")
    )


@query(f"""SELECT doc_id, round(n * 0.02 / 1e6, 12) AS small, round(n * 0.13 / 1e6, 12) AS large, round(n * 0.1 / 1e6, 12) AS ada FROM (SELECT doc_id, {sql_tokens('text')}::double AS n FROM documents)""")
def embedding_cost(spark, sf_dir):
    n = T.count_tokens(F.col("text"))
    names = {"small": "text-embedding-3-small", "large": "text-embedding-3-large", "ada": "text-embedding-ada-002"}
    return documents(spark, sf_dir).select("doc_id", *(F.round(stats.embedding_cost(n, m).cast("double"), 12).alias(k) for k, m in names.items()))


@query("""SELECT lang, chunks, embedded, chunks > 0 AND embedded >= 0.8 * chunks AS success FROM (
  SELECT lang, count(*) AS chunks, count(vec_id) AS embedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY lang)""")
def index_success_rate(spark, sf_dir):
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id"), F.col("vec_id") == F.col("doc_id"), "left")
    counts = rows.groupBy("lang").agg(F.count("*").alias("chunks"), F.count("vec_id").alias("embedded"))
    return counts.withColumn("success", stats.success_rate(F.col("chunks"), F.col("embedded")))


@query("SELECT count(*) AS count, max(len(embedding)) AS dimensions FROM embeddings")
def collection_stats(spark, sf_dir):
    return stats.collection_stats(table(spark, sf_dir, "embeddings"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM documents")
def batch_assign(spark, sf_dir):
    return stats.assign_batches(documents(spark, sf_dir).select("doc_id"), "doc_id")


@query("SELECT event_id, ts < (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE AS stale FROM events")
def trigger_window(spark, sf_dir):
    from tessera.streaming import feed

    return feed.stale_flags(table(spark, sf_dir, "events")).select("event_id", "stale")


@query("""SELECT time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS triggers FROM events GROUP BY 1, 2""")
def trigger_counts(spark, sf_dir):
    from tessera.streaming import feed

    return feed.windowed_counts(table(spark, sf_dir, "events")).select("start", "event_type", "triggers")


@query("""SELECT event_id, CASE WHEN ms < 1000 THEN printf('%.0fms', ms) WHEN ms < 60000 THEN printf('%.1fs', ms / 1000) WHEN ms < 3600000 THEN printf('%.1fm', ms / 60000) ELSE printf('%.1fh', ms / 3600000) END AS duration
  FROM (SELECT event_id, (event_id * 997)::double AS ms FROM events)""")
def format_duration(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.format_duration((F.col("event_id") * 997).cast("double")).alias("duration"))


@query("SELECT v.* FROM embeddings v ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) d ON v.vec_id = d.doc_id".replace("v.*", "vec_id, label"))
def delete_by_ids(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return changes.delete_ids(table(spark, sf_dir, "embeddings"), gone, "vec_id").select("vec_id", "label")


# ---- without SQL -----------------------------------------------------------------------------


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as TypeScript, JavaScript and Ruby sources: what extraction reads when the tables hold no code."""
    i = F.col("page_id").cast("string")
    ts = F.concat(
        F.lit("export class Page"), i, F.lit(" {\n  load(x: number): string { return `"), i, F.lit("`; }\n}\nexport const url"), i,
        F.lit(" = (a: string) => a;\ninterface I"), i, F.lit(" { a: string }\n")
    )
    js = F.concat(F.lit("function f"), i, F.lit("() { return /}/; }\nmodule.run = function () { return 1; };\n"))
    rb = F.concat(F.lit("module M"), i, F.lit("\n  def go(x)\n    x if x\n  end\nend\n"))
    rows = F.array(*(F.struct(F.lit(lang).alias("language"), code.alias("content")) for lang, code in (("typescript", ts), ("javascript", js), ("ruby", rb))))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(rows).alias("r")).select(
        F.concat(F.lit("src/p"), "page_id", F.lit("."), "r.language").alias("path"), "r.language", "r.content"
    )


#: What the sources above declare: (language, node, type, name, lines, first and last column), {i} a page's id and {n} its digits.
SQL_NODES = """(VALUES ('javascript', 0, 'function', 'f{i}', 1, 1, 0, 28, 1), ('javascript', 1, 'function', 'module.run', 2, 2, 13, 38, 0),
  ('ruby', 0, 'module', 'M{i}', 1, 5, 0, 3, 0), ('ruby', 1, 'method', 'go', 2, 4, 2, 5, 0),
  ('typescript', 0, 'class', 'Page{i}', 1, 3, 7, 1, 0), ('typescript', 1, 'method', 'load', 2, 2, 2, 40, 1), ('typescript', 2, 'function', 'url{i}', 4, 4, 19, 35, 1),
  ('typescript', 3, 'interface', 'I{i}', 5, 5, 0, 25, 1)) t(language, node_seq, type, name, start_line, end_line, start_char, end_char, wide)"""


@query(f"""SELECT 'src/p' || page_id || '.' || language AS path, language, node_seq, type, replace(name, '{{i}}', page_id::varchar) AS name, start_line, end_line,
  start_char + CASE WHEN name LIKE 'url%' THEN length(page_id::varchar) ELSE 0 END AS start_char, end_char + wide * length(page_id::varchar) AS end_char FROM pages, {SQL_NODES}""")
def node_extraction(spark, sf_dir):
    return extract.extract_nodes(sources(spark, sf_dir)).drop("content", "error")


SQL_SOURCE_CHUNKS = r"""SELECT 'src/p' || page_id || '.' || language AS path, language, replace(replace(content, '{i}', page_id::varchar), '~', chr(10)) AS content, end_line,
    end_char + CASE WHEN language = 'typescript' THEN length(page_id::varchar) ELSE 0 END AS end_char, type, replace(name, '{i}', page_id::varchar) AS name FROM pages, (VALUES
  ('javascript', 'function f{i}() { return /}/; }~~function () { return 1; }', 2, 38, 'function', 'f{i}, module.run'),
  ('ruby', 'module M{i}~  def go(x)~    x if x~  end~end~~def go(x)~    x if x~  end', 4, 5, 'module', 'M{i}, go'),
  ('typescript', 'class Page{i} {~  load(x: number): string { return `{i}`; }~}~~load(x: number): string { return `{i}`; }~~(a: string) => a~~interface I{i} { a: string }', 5, 25, 'class', 'Page{i}, load, url{i}, I{i}')
  ) t(language, content, end_line, end_char, type, name)"""


@query(f"""WITH c AS ({SQL_SOURCE_CHUNKS}), k AS ({sql_chunk_keywords('c', 'path', 'content')})
  SELECT 'chunk-' || lower(to_base(abs(list_reduce(list_prepend(0::bigint, list_transform(string_split(c.path || ':1:' || end_line, ''), lambda c: ord(c)::bigint)), lambda h, c: {SQL_WRAP.format(h='h', c='c')})), 36)) AS id,
    c.path, language, 0 AS seq, content, 1 AS start_line, end_line, CASE language WHEN 'typescript' THEN 7 ELSE 0 END AS start_char, end_char, type AS chunk_type, 'ast-split-merge' AS granularity, name AS symbol_name, type AS symbol_type,
    array_to_string(coalesce(kw, []), ' ') AS keywords, {sql_tokens('content')} AS token_count FROM c LEFT JOIN k ON k.path = c.path""")
def source_chunks(spark, sf_dir):
    return chunking.chunks(extract.nodes_by_file(extract.extract_nodes(sources(spark, sf_dir)))).withColumn("keywords", F.array_join("keywords", " "))


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: length(w) > 2)) AS w FROM documents),
  d AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::bigint AS h FROM w),
  v AS (SELECT doc_id, h % 64 AS i, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::double AS v FROM d GROUP BY 1, 2),
  n AS (SELECT doc_id, sqrt(sum(v * v)) AS n, max(abs(v)) AS top, sum(v * (i + 1)) AS weighted FROM v GROUP BY doc_id)
  SELECT doc_id, CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE 0.0 END AS norm, 64 AS dims, round(CASE WHEN n > 0 THEN top / n ELSE 0 END, 6) AS peak, round(CASE WHEN n > 0 THEN weighted / n ELSE 0 END, 6) AS weighted
  FROM documents LEFT JOIN n USING (doc_id)""")
def hash_embedding(spark, sf_dir):
    rows = vectors.hash_embed(documents(spark, sf_dir), "doc_id", "text")
    e = F.col("embedding")
    weighted = F.aggregate(F.transform(e, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select(
        "doc_id", F.round(vectors.norm(e), 6).alias("norm"), F.size(e).alias("dims"),
        F.round(F.array_max(F.transform(e, F.abs)), 6).alias("peak"), F.round(weighted, 6).alias("weighted")
    )


@query(f"SELECT vec_id AS id, round({sql_cosine('embedding', Q)}, 6) AS score FROM embeddings ORDER BY {sql_cosine('embedding', Q)} DESC, vec_id LIMIT 10")
def ivf_topk(spark, sf_dir):
    """Eight of 16 cells first; the cells' radii prove the result or name the cells that are searched as well, so it is that of all rows."""
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    placed, centroids = search.ivf_cells(rows, 16)
    radii = search.ivf_radii(placed, centroids)
    return search.ivf_top_k(placed, centroids, first_vector(spark, sf_dir), 10, 8, radii=radii).select("id", F.round("score", 6).alias("score"))


from tessera.plans import catalogue_engine, catalogue_index  # noqa: E402, F401  register the queries of collections, the engine, streams and indexes
