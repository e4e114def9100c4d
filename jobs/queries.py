"""The jobs as registered queries: each runs its function twice, into one new folder, and returns what that holds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import index_documents, keyword_index
from tessera.functions import fixed
from tessera.plans.catalogue import in_list, sql_line_pieces, sql_plain_words, sql_tokens


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that the session names; its files stay. A session without that setting is a local test's."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds no new file: its result is the index of the first."""
    output = new_folder(spark, "job1")
    for _ in range(2):
        out = index_documents.run(spark, f"{sf_dir}/documents.parquet*", output)
    return out


def job2_keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run replaces every partition with the same rows."""
    output = new_folder(spark, "job2")
    for _ in range(2):
        out = keyword_index.run(spark, f"{sf_dir}/documents.parquet", output)
    return out.withColumn("score", F.round("score", 6))


INDEX = rf"""WITH p AS ({sql_line_pieces(0)}),
  c AS (SELECT p.doc_id, lang, piece AS seq, first_line, last_line, array_to_string(list_slice(string_split(text, chr(10)), first_line, last_line), chr(10)) AS content FROM p JOIN documents USING (doc_id)),
  u AS (SELECT sha256(content) AS hash, any_value(content) AS content, count(*) AS uses FROM c GROUP BY 1),
  w AS (SELECT hash, unnest(list_filter(string_split_regex(lower(regexp_replace(content, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: length(w) > 2)) AS w FROM u),
  d AS (SELECT hash, ('0x' || substr(md5(w), 1, 8))::bigint AS h FROM w),
  v AS (SELECT hash, h % 64 AS i, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM d GROUP BY 1, 2),
  n AS (SELECT hash, count(*) FILTER (WHERE v <> 0) AS used, count(*) FILTER (WHERE v > 0) AS positive FROM v GROUP BY hash)
  SELECT doc_id, lang, seq, first_line AS start_line, last_line AS end_line, ({sql_tokens('c.content')})::int AS tokens, hash, uses, coalesce(used, 0)::int AS used, coalesce(positive, 0)::int AS positive
  FROM c JOIN u ON u.content = c.content LEFT JOIN n USING (hash)"""

KEYWORDS = f"""WITH w AS (SELECT doc_id, lang, list_filter({sql_plain_words('text')}, lambda w: w NOT IN {in_list(fixed.SCORED_STOP_WORDS)}) AS ws FROM documents),
  p AS (SELECT doc_id, lang, term, count(*) AS n, any_value(size) AS size FROM (SELECT doc_id, lang, unnest(ws) AS term, len(ws) AS size FROM w) GROUP BY ALL),
  t AS (SELECT lang, term, count(*) AS df FROM p GROUP BY ALL), l AS (SELECT lang, count(*) AS documents FROM documents GROUP BY lang)
  SELECT lang, term, doc_id, n, df, round(n / size * ln(documents / df), 6) AS score FROM p JOIN t USING (lang, term) JOIN l USING (lang)"""

QUERIES = {f.__name__: f for f in (job1_index_documents, job2_keyword_index)}
ORACLES = {"job1_index_documents": INDEX, "job2_keyword_index": KEYWORDS}
