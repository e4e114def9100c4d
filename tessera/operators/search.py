"""Vector search, hybrid re-scoring and the ladder of fallback queries."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.functions import text as T
from tessera.functions.vectors import METRICS
from tessera.session import ship


def literal_vector(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def equality_filter(filters: dict | None) -> Column:
    """Conjunction of equalities for text, number and boolean values; other values are left out."""
    kept = [F.col(k) == F.lit(v) for k, v in (filters or {}).items() if isinstance(v, str | int | float | bool)]
    return reduce(lambda a, b: a & b, kept, F.lit(True))


def top_k(
    vectors: DataFrame, query: Sequence[float] | Column, k: int = 10, metric: str = "COSINE", filters: dict | None = None,
    min_score: float | None = None, key: str = "id", vector: str = "embedding"
) -> DataFrame:
    """The k best rows by metric with their score; filters hold before the choice, min_score after it. Ties go by key."""
    function, rising = METRICS[metric]
    q = query if isinstance(query, Column) else literal_vector(query)
    scored = vectors.where(equality_filter(filters)).withColumn("score", function(F.col(vector), q)).where("score is not null")
    best = scored.orderBy(F.col("score").desc() if rising else F.col("score").asc(), F.col(key)).limit(k or 10)
    return best if min_score is None else best.where(F.col("score") >= min_score)


def _scores(rows: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """Scores of a block of rows with each query; NaN where a vector of length 0 has no angle. The last bits, which depend on the order of sums, are cut."""
    if metric == "L2":
        return np.round(np.stack([np.sqrt(((rows - q) ** 2).sum(axis=1)) for q in query], axis=1), 12)
    out = rows @ query.T
    if metric == "COSINE":
        size = np.sqrt((rows**2).sum(axis=1))[:, None] * np.sqrt((query**2).sum(axis=1))
        out = np.divide(out, size, out=np.full(out.shape, np.nan), where=size != 0)
    return np.round(out, 12)


#: Scores that one step of a task holds: rows times queries.
STEP = 1 << 20


class Best:
    """The k best rows of each query of a task, as batches of rows come: k rows a query are held, and one step's scores."""

    def __init__(self, queries: int, k: int, metric: str):
        self.k, self.metric, self.rising = k, metric, METRICS[metric][1]
        self.bar = np.full(queries, np.inf)  # a query's k-th score so far, the least the best
        self.q, self.ids, self.score = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, x: np.ndarray, ids: pa.Array, numbers: np.ndarray, matrix: np.ndarray) -> None:
        """Compare rows (vectors x, ids) with queries (their numbers and vectors); of ties with the k-th row the least ids stay."""
        found = []
        step = max(1, STEP // max(1, len(x)))
        for lo in range(0, len(numbers), step):
            some = numbers[lo : lo + step]
            score = _scores(x, matrix[lo : lo + step], self.metric)
            good = np.nan_to_num(-score if self.rising else score, nan=np.inf)
            limit = self.bar[some]
            if len(x) > self.k:
                limit = np.minimum(limit, np.partition(good, self.k - 1, axis=0)[self.k - 1])
            r, c = np.nonzero((good <= limit) & np.isfinite(good))  # ties with the k-th stay until ids decide
            found.append((some[c], r, score[r, c]))
        q, r, score = (np.concatenate(part) for part in zip(*found, strict=True)) if found else ([],) * 3
        if not len(q):
            return
        new = ids.take(pa.array(r))
        q, score = np.concatenate([self.q, q]), np.concatenate([self.score, score])
        new = new if self.ids is None else pa.concat_arrays([self.ids, new])
        place = pc.rank(new, sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False)
        good = -score if self.rising else score
        order = np.lexsort((place, good, q))
        first = np.searchsorted(q[order], q[order])
        kept = order[np.arange(len(order)) - first < self.k]
        self.q, self.ids, self.score = q[kept], new.take(pa.array(kept)), score[kept]
        held = np.bincount(self.q, minlength=len(self.bar))
        last = np.cumsum(held) - 1
        full = held == self.k
        self.bar[full] = good[kept][last[full]]

    def batch(self) -> Iterator[pa.RecordBatch]:
        if self.ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array(self.q.astype(np.int32)), self.ids, pa.array(self.score)], ["q", "id", "score"])


def batch_top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "COSINE", key: str = "id", query_key: str = "query_id",
    query_bytes: int = 8 << 20
) -> DataFrame:
    """The k best vectors of each query row (query_key, query): a stated set of queries against all rows, in blocks.

    A block of queries, bounded by bytes, is sent to all tasks as one matrix. A task multiplies its batches of rows by
    it, some queries at a time, and keeps k rows a query, so what reaches the rank is k rows a query and task, whatever
    the number of rows, and a task holds STEP scores, whatever the number of queries."""
    _, rising = METRICS[metric]
    spark = vectors.sparkSession
    rows = queries.select(query_key, F.col("query").cast("array<double>").alias("query"))
    size = rows.agg(F.sum(F.size("query") * 8 + 16)).first()[0] or 0
    parts = -(-size // query_bytes) or 1
    pairs = vectors.select(
        F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("v")
    ).where("v is not null and not exists(v, x -> x is null)")
    schema = f"q int, id {vectors.schema[key].dataType.simpleString()}, score double"
    ship(spark)

    def best(block, many: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Best(many, k, metric)
            for b in batches:
                column = b.column(1)
                lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(lengths) - lengths
                for dims, (numbers, matrix) in block.value.items():
                    of = np.flatnonzero(lengths == dims)
                    if len(of):
                        held.add(flat[starts[of][:, None] + np.arange(dims)], b.column(0).take(pa.array(of)), numbers, matrix)
            yield from held.batch()

        return run

    found = []
    for p in range(parts):
        some = (rows if parts == 1 else rows.where(F.pmod(F.xxhash64(query_key), F.lit(parts)) == p)).collect()  # at most query_bytes
        matrices: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dims in {len(r.query) for r in some if r.query and None not in r.query}:
            at = [i for i, r in enumerate(some) if r.query and len(r.query) == dims and None not in r.query]
            matrices[dims] = np.array(at), np.array([some[i].query for i in at])
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(some)], StructType([StructField("q", IntegerType()), rows.schema[query_key]]))
        scored = pairs.mapInArrow(best(spark.sparkContext.broadcast(matrices), len(some)), schema)
        found.append(scored.join(F.broadcast(names), "q").drop("q"))  # as many rows as queries in the block
    scored = reduce(DataFrame.unionByName, found).select(query_key, F.col("id").alias(key), "score")
    order = F.col("score").desc() if rising else F.col("score").asc()
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(order, F.col(key)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def with_details(hits: DataFrame, details: DataFrame | None, key: str) -> DataFrame:
    """The few hits of a search with the columns of `details`; keywords are taken of their contents where details has none."""
    if details is None:
        return hits
    out = details.join(F.broadcast(hits), key)  # k rows a query
    return out if "keywords" in out.columns else out.withColumn("keywords", T.chunk_keywords(F.col("content")))


def hybrid_rescore(hits: DataFrame, query: str, strategy: str = "hybrid") -> DataFrame:
    """Scores mixed with the share of query keywords that the hits' keywords contain."""
    if strategy != "hybrid":
        return hits
    text = F.lit(query)
    words = F.transform(T.scored_keywords(F.lower(text)), lambda x: x["keyword"])
    mixed = F.col("score") * T.vector_weight(text) + T.keyword_score(words, F.col("keywords")) * T.keyword_weight(text)
    return hits.withColumn("score", mixed)


def ranked(hits: DataFrame, key: str = "id") -> DataFrame:
    """Rank by score among the few hits of a search (their number is the limit of the search)."""
    return hits.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), F.col(key))))


def path_filter(hits: DataFrame, pattern: str | None, path: str = "path") -> DataFrame:
    """Rows whose path matches anywhere, case ignored; ranks stay."""
    return hits.where(F.col(path).rlike(f"(?i){pattern}")) if pattern else hits


def formatted(hits: DataFrame, form: str = "hybrid", content: str = "content") -> DataFrame:
    return hits.withColumn("snippet", T.snippet(F.col(content), form)).withColumn("context", T.context(F.col(content), form))


def search_once(
    vectors: DataFrame, query: str, vector: Sequence[float], k: int = 10, min_score: float = 0.7, filters: dict | None = None,
    strategy: str = "hybrid", form: str = "hybrid", path_pattern: str | None = None, metric: str = "COSINE", key: str = "id",
    details: DataFrame | None = None
) -> DataFrame:
    """filter, limit, minimal score, hybrid score, rank, path filter: in this order.

    With `details` (key, path, content), vectors needs only key, embedding and what is filtered by: contents are read for the hits alone."""
    hits = with_details(top_k(vectors, vector, k, metric, filters, min_score, key), details, key)
    return formatted(path_filter(ranked(hybrid_rescore(hits, query, strategy), key), path_pattern), form)


def passes(processed: str, min_score: float) -> list[tuple[int, str, float]]:
    """(pass, text, minimal score) of the ladder: the query, its expansions, and the query once more."""
    rungs = [(processed, min_score), *((x, min_score * 0.8) for x in T.expand_query(processed) if x != processed), (processed, 0.3)]
    return [(i, text, least) for i, (text, least) in enumerate(rungs)]


def search_ladder(
    vectors: DataFrame, rungs: DataFrame, k: int = 10, filters: dict | None = None, path_pattern: str | None = None, metric: str = "COSINE",
    key: str = "id", strategy: str = "hybrid", details: DataFrame | None = None
) -> DataFrame:
    """Results of the first rung of each query that has any: all rungs in one plan instead of a loop.

    rungs: query_id, pass, text, min_score, query (the text's vector). Only the strategy "hybrid" mixes in keywords.
    details: as in search_once; without it, vectors has all columns."""
    shape = F.transform(T.scored_keywords(F.lower(F.col("text"))), lambda x: x["keyword"])
    rungs = rungs.select(
        "query_id", "pass", F.struct("query_id", "pass").alias("rung"), "min_score", "query", shape.alias("words"),
        T.vector_weight(F.col("text")).alias("vw"), T.keyword_weight(F.col("text")).alias("kw")
    )
    hits = batch_top_k(rungs.select("rung", "query"), vectors.where(equality_filter(filters)), k, metric, key, "rung").drop("rank")
    hits = hits.join(F.broadcast(rungs.drop("query")), "rung").where(F.col("score") >= F.col("min_score"))  # as many rows as rungs
    hits = with_details(hits, vectors.drop("embedding") if details is None else details, key)
    if strategy == "hybrid":
        hits = hits.withColumn("score", F.col("score") * F.col("vw") + T.keyword_score(F.col("words"), F.col("keywords")) * F.col("kw"))
    hits = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "pass").orderBy(F.col("score").desc(), F.col(key))))
    hits = path_filter(hits, path_pattern)
    first = F.min("pass").over(W.partitionBy("query_id"))
    return hits.withColumn("first", first).where(F.col("pass") == F.col("first")).drop("first", "rung", "words", "vw", "kw", "min_score")


def ivf_cells(vectors: DataFrame, cells: int, seed: int = 1, key: str = "id") -> tuple[DataFrame, list[list[float]]]:
    """Vectors with the cell of their nearest centroid, and the centroids (fitted on a bounded sample of 100 a cell)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = vectors.select(key, "embedding").orderBy(F.xxhash64(key)).limit(100 * cells)
    model = KMeans(k=cells, seed=seed, featuresCol="v", predictionCol="cell").fit(sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v")))
    placed = model.transform(vectors.withColumn("v", array_to_vector(F.col("embedding").cast("array<double>")))).drop("v")
    return placed, [list(map(float, c)) for c in model.clusterCenters()]


def ivf_radii(placed: DataFrame, centroids: list[list[float]]) -> list[tuple[float, float]]:
    """For each cell the largest distance and the largest angle of its vectors to its centroid: one row a cell."""
    centre = F.element_at(F.array(*(literal_vector(c) for c in centroids)), F.col("cell") + 1)
    v = F.col("embedding").cast("array<double>")
    cosine = F.least(F.greatest(METRICS["COSINE"][0](v, centre), F.lit(-1.0)), F.lit(1.0))
    far = placed.groupBy("cell").agg(
        F.max(METRICS["L2"][0](v, centre)).alias("distance"), F.max(F.acos(cosine)).alias("angle"),
        F.count(F.when(cosine.isNull(), 1)).alias("open")
    )
    found = {r.cell: (r.distance, math.pi if r.open or r.angle is None else r.angle) for r in far.collect()}
    return [found.get(i, (0.0, 0.0)) for i in range(len(centroids))]


def ivf_bound(centre: Sequence[float], radius: tuple[float, float], query: Sequence[float], metric: str) -> float:
    """The best score that a vector of a cell can have (triangle inequality, of distances or angles)."""
    distance, angle = radius
    norm = lambda x: math.sqrt(sum(a * a for a in x))
    dot = sum(a * b for a, b in zip(centre, query, strict=True))
    if metric == "L2":
        return max(math.dist(centre, query) - distance, 0.0)
    if metric == "IP":
        return dot + norm(query) * distance
    size = norm(centre) * norm(query)
    return math.cos(max(math.acos(min(max(dot / size, -1.0), 1.0)) - angle, 0.0)) if size else 1.0


def ivf_top_k(
    placed: DataFrame, centroids: list[list[float]], query: Sequence[float], k: int = 10, probe: int = 10, metric: str = "COSINE",
    key: str = "id", radii: list[tuple[float, float]] | None = None
) -> DataFrame:
    """top_k among the `probe` cells nearest to the query; exact when probe covers all cells.

    With the cells' radii it is exact at any probe: cells whose bound reaches the k-th score found are searched as well."""
    order = sorted(range(len(centroids)), key=lambda i: sum((a - b) ** 2 for a, b in zip(centroids[i], query, strict=True)))
    cells = order[:probe]
    hits = top_k(placed.where(F.col("cell").isin(cells)), query, k, metric, key=key)
    if radii is None or len(cells) == len(order):
        return hits
    scores = [r.score for r in hits.select("score").collect()]  # k rows
    rising, slack = METRICS[metric][1], 1e-6
    worst = None if len(scores) < (k or 10) else min(scores) if rising else max(scores)
    bounds = {i: ivf_bound(centroids[i], radii[i], query, metric) for i in order[probe:]}
    room = slack * max(1.0, abs(worst or 0.0))
    more = [i for i, b in bounds.items() if worst is None or (b >= worst - room if rising else b <= worst + room)]
    return top_k(placed.where(F.col("cell").isin(cells + more)), query, k, metric, key=key) if more else hits
