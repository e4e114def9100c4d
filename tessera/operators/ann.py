"""Approximate nearest neighbours: inverted cells with product-quantised codes, and an exact re-rank.

A model holds centroids of cells and, for each group of SUB dimensions, 256 code words of what is left of a
vector beside its centroid. Every row gets the cell of its nearest centroid and one byte a group. A search
reads the codes of the cells nearest to its queries, adds up table entries, and compares the vectors of the
best `refine * k` rows of each query exactly.

The model is fitted on a sample of at most `sample` rows (those with the least hashes of their ids); all rows
are encoded. COSINE works on vectors of length 1, so its cells and codes are those of directions.

Defined results: rows whose vector is null, holds null, or (COSINE) has length 0 have no score under any search
and are not indexed; rows that repeat an id are rows of their own; ties go by id; no rows give no index rows,
and a model without cells finds nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.vectors import METRICS
from tessera.operators.search import Best, batch_top_k
from tessera.session import ship

SUB, WORDS, MOST_CELLS = 2, 256, 1 << 14
#: Numbers that one step of a task holds: rows times queries times groups.
STEP = 1 << 22
#: Rows that codes name for a block of queries: so many can be sent to all tasks. Where there may be more, vectors are compared where they are read.
NAMED = 1 << 17


@dataclass(frozen=True)
class Model:
    """centroids: (cells, dims), not finite for cells that were split; words: (groups, WORDS, SUB)."""

    centroids: np.ndarray
    words: np.ndarray
    metric: str = "COSINE"

    @property
    def cells(self) -> np.ndarray:
        return np.flatnonzero(np.isfinite(self.centroids).all(axis=1))

    def save(self, spark: SparkSession, path: str) -> None:
        """One row a cell and code word: at most MOST_CELLS and WORDS for each group."""
        rows = [("metric", 0, 0, [], self.metric)]
        rows += [("cell", i, 0, c, None) for i, c in enumerate(self.centroids.tolist())]
        rows += [("word", g, i, w, None) for g, words in enumerate(self.words.tolist()) for i, w in enumerate(words)]
        spark.createDataFrame(rows, "kind string, a int, b int, v array<double>, name string").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: (r.kind, r.a, r.b))
        cells, words = [r.v for r in rows if r.kind == "cell"], [r.v for r in rows if r.kind == "word"]
        metric = next(r.name for r in rows if r.kind == "metric")
        return Model(np.array(cells).reshape(len(cells), -1), np.array(words).reshape(-1, WORDS, SUB), metric)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Place of the nearest centre of each row; those that are not finite are none."""
    good = np.isfinite(centres).all(axis=1)
    c = np.where(good[:, None], centres, 0)
    far = np.where(good, (c**2).sum(axis=1), np.inf)
    out = np.empty(len(x), np.int64)
    step = max(1, STEP // max(len(c), 1))
    for lo in range(0, len(x), step):
        out[lo : lo + step] = np.argmin(far - 2 * (x[lo : lo + step] @ c.T), axis=1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k centres of a bounded sample; where it has fewer different rows, some centres repeat."""
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        of = nearest(x, centres)
        n = np.bincount(of, minlength=k)
        sums = np.stack([np.bincount(of, x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[r.integers(0, len(x), k)])
    return centres


def usable(embedding: pa.Array, dims: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that have a score, and their vectors (of length 1 for COSINE)."""
    lengths = embedding.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = embedding.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    at = np.flatnonzero(lengths == dims)
    x = values[starts[at][:, None] + np.arange(dims)] if len(at) else np.zeros((0, dims))
    good = np.isfinite(x).all(axis=1)
    size = np.sqrt((x**2).sum(axis=1))
    if metric == "COSINE":
        good &= size > 0
        x = x / np.where(size > 0, size, 1)[:, None]
    return at[good], x[good]


def padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % SUB)))


def sample_of(vectors: DataFrame, rows: int, metric: str, key: str = "id") -> np.ndarray:
    """Vectors of at most `rows` rows, for the driver."""
    found = vectors.where("embedding is not null").select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    some = found.orderBy(F.xxhash64(key), key).limit(rows).select("embedding").toArrow()
    column = some.column(0).combine_chunks()
    dims = max(column.value_lengths().to_pylist(), default=0)
    return usable(column, dims, metric)[1]


def fit(vectors: DataFrame, metric: str = "COSINE", cells: int | None = None, sample: int = 20_000, key: str = "id") -> Model:
    """A model of `cells` cells (by default one for 40 rows of the sample)."""
    x = sample_of(vectors, sample, metric, key)
    dims = x.shape[1] if len(x) else 0
    cells = min(MOST_CELLS, cells or max(1, len(x) // 40)) if len(x) else 0
    if not cells:
        return Model(np.zeros((0, dims)), np.zeros((0, WORDS, SUB)), metric)
    centroids = k_means(x, cells)
    rest = padded(x - centroids[nearest(x, centroids)])
    words = np.stack([k_means(rest[:, i : i + SUB], WORDS, 8) for i in range(0, rest.shape[1], SUB)])
    return Model(centroids, words, metric)


def encoded(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, code and squared length of what the code stands for, of each vector."""
    cell = nearest(x, model.centroids)
    rest = padded(x - model.centroids[cell])
    code = np.stack([nearest(rest[:, g * SUB : (g + 1) * SUB], w) for g, w in enumerate(model.words)], axis=1).astype(np.uint8)
    stands = np.concatenate([model.words[g][code[:, g]] for g in range(code.shape[1])], axis=1)[:, : x.shape[1]] + model.centroids[cell]
    return cell, code, (stands**2).sum(axis=1)


def encode(vectors: DataFrame, model: Model) -> DataFrame:
    """vectors with cell, code and size, of the rows that have a score."""
    dims, send = model.centroids.shape[1], vectors.sparkSession.sparkContext.broadcast(model)
    schema = StructType(list(vectors.schema.fields)).add("cell", "integer").add("code", "binary").add("size", "double")
    at = vectors.columns.index("embedding")

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            good, x = usable(b.column(at), dims, send.value.metric)
            if not len(good) or not len(send.value.cells):
                continue
            cell, code, size = encoded(x, send.value)
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(good)).columns, pa.array(cell.astype(np.int32)), codes, pa.array(size)], schema.names)

    ship(vectors.sparkSession)
    return vectors.mapInArrow(rows, schema)


def probes(q: np.ndarray, model: Model, probe: int) -> np.ndarray:
    """(queries, probe): the cells to search for each query; fewer columns where there are fewer cells."""
    cells = model.cells
    c = model.centroids[cells]
    near = q @ c.T if model.metric == "IP" else 2 * (q @ c.T) - (c**2).sum(axis=1)
    return cells[np.argsort(-near, axis=1, kind="stable")[:, :probe]]


def _by_cell(q: np.ndarray, model: Model, probe: int) -> dict[int, np.ndarray]:
    """The queries of each cell that some query is to be looked for in."""
    found = probes(q, model, probe)
    order = np.argsort(found, axis=None, kind="stable")
    cells, first = np.unique(found.ravel()[order], return_index=True)
    return {int(c): of // found.shape[1] for c, of in zip(cells, np.split(order, first[1:]), strict=True)}


def _block(numbers: np.ndarray, q: np.ndarray, model: Model, probe: int) -> tuple:
    """What a task needs of a block of queries: for each cell its queries, table entries, and products with centroids."""
    by_cell = _by_cell(q, model, probe)
    parts = padded(q).reshape(len(q), -1, SUB)
    table = np.einsum("qgs,gws->qgw", parts, model.words).astype(np.float32)
    base = {c: (q[of] @ model.centroids[c]).astype(np.float32) for c, of in by_cell.items()}
    return numbers, by_cell, table, base, model.metric


def _cell_scores(block, k: int, dims: int, metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's k best rows of each query: all rows of the cells nearest to it are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, by_cell, q = block.value
        held = Best(int(numbers.max()) + 1, k, metric)
        for b in batches:
            good, x = usable(b.column(2), dims, "IP")  # scores are those of the vectors as they are
            cell = np.asarray(b.column(1))[good]
            for c in np.unique(cell):
                of = by_cell.get(int(c))
                if of is not None:
                    at = np.flatnonzero(cell == c)
                    held.add(x[at], b.column(0).take(pa.array(good[at])), numbers[of], q[of])
        yield from held.batch()

    return run


def _code_scores(block, best: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's best rows of each query by their codes."""

    def keep(q: np.ndarray, ids: pa.Array, score: np.ndarray) -> np.ndarray:
        """Places of the best rows of each query; of equal codes those of the least ids, as repeated vectors have."""
        place = pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False)
        order = np.lexsort((place, -score, q))
        first = np.searchsorted(q[order], q[order])
        return order[np.arange(len(order)) - first < best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, by_cell, table, base, metric = block.value
        held: tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray] | None = None
        for b in batches:
            cell, size = np.asarray(b.column(1)), np.asarray(b.column(3)).astype(np.float32)
            for c in np.unique(cell):
                of = by_cell.get(int(c))
                if of is None:
                    continue
                rows = np.flatnonzero(cell == c)
                code = np.frombuffer(b"".join(b.column(2).take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
                step = max(1, STEP // max(1, len(of) * code.shape[1]))
                for lo in range(0, len(rows), step):
                    some = rows[lo : lo + step]
                    entries = table[of][:, np.arange(code.shape[1])[None, :], code[lo : lo + step]]
                    score = entries.sum(axis=2) + base[int(c)][:, None]
                    score = 2 * score - size[some] if metric == "L2" else score
                    limit = np.partition(score, len(some) - best, axis=1)[:, -best] if len(some) > best else np.full(len(of), -np.inf)
                    at, place = np.nonzero(score >= limit[:, None])
                    new = of[at], b.column(0).take(pa.array(some[place])), score[at, place], np.full(len(at), c, np.int32)
                    if held is not None:
                        new = np.concatenate([held[0], new[0]]), pa.concat_arrays([held[1], new[1]]), np.concatenate([held[2], new[2]]), np.concatenate([held[3], new[3]])
                    kept = keep(*new[:3])
                    held = new[0][kept], new[1].take(pa.array(kept)), new[2][kept], new[3][kept]
        if held is not None:
            columns = [pa.array(numbers[held[0]].astype(np.int32)), pa.array(held[3]), held[1], pa.array(held[2].astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, ["q", "cell", "id", "near"])

    return run


def search(
    rows: DataFrame, model: Model, queries: DataFrame, k: int = 10, probe: int = 16, refine: int = 10, key: str = "id",
    query_key: str = "query_id", query_bytes: int = 8 << 20
) -> DataFrame:
    """query_key, key, score and rank of the k best rows found for each query (query_key, query).

    rows: key, embedding, cell, code, size, and what a filter before this needs. Only the cells that some query of a
    block is nearest to are read, first their codes, then the vectors of the best rows; with all cells probed and as
    many rows refined as there are, the result is exact. Where the best rows of all queries are more than can be sent
    to all tasks (NAMED), or the queries' tables more than one block, the vectors of those cells are read at once and all
    compared in their task, which keeps k rows a query: no row that codes would name is missed, and no name is sent."""
    spark, best = rows.sparkSession, k * refine
    dims = model.centroids.shape[1]
    asked = queries.select(query_key, F.col("query").cast("array<double>").alias("query"))
    row = asked.agg(F.sum(F.size("query") * 8 + 16).alias("size"), F.count("*").alias("n")).first()
    size, table_bytes = row["size"] or 0, 1 + model.words.shape[0] * WORDS * 4 // max(1, dims * 8)  # a query's table beside the query
    by_code = size * table_bytes <= query_bytes and row["n"] * best <= NAMED
    parts = 1 if by_code else -(-size // query_bytes) or 1
    function, rising = METRICS[model.metric]
    id_type = rows.schema[key].dataType.simpleString()
    found = []
    ship(spark)
    for p in range(parts):
        some = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64(query_key), F.lit(parts)) == p)).collect()  # at most query_bytes
        column = pa.array([r.query for r in some], pa.list_(pa.float64()))
        good, q = usable(column, dims, model.metric)
        if not len(good) or not len(model.cells):
            continue
        names = spark.createDataFrame(
            [(i, r.query, r[query_key]) for i, r in enumerate(some)],
            StructType([*asked.select(F.lit(0).alias("q"), "query").schema.fields, asked.schema[query_key]])
        )
        if not by_code:
            by_cell = _by_cell(q, model, probe)
            of_cells = rows.where(F.col("cell").isin(list(by_cell)))
            block = good, by_cell, np.array([some[i].query for i in good])
            near = of_cells.select(key, "cell", "embedding").mapInArrow(
                _cell_scores(spark.sparkContext.broadcast(block), k, dims, model.metric), f"q int, id {id_type}, score double"
            )
            scored = near.join(F.broadcast(names.drop("query")), "q")  # as many rows as queries in the block
            found.append(scored.select(query_key, F.col("id").alias(key), "score"))
            continue
        block = _block(good, q, model, probe)
        of_cells = rows.where(F.col("cell").isin(list(block[1])))
        near = of_cells.select(key, "cell", "code", "size").mapInArrow(
            _code_scores(spark.sparkContext.broadcast(block), best), f"q int, cell int, id {id_type}, near double"
        )
        rank = F.row_number().over(W.partitionBy("q").orderBy(F.col("near").desc(), "id"))
        chosen = near.withColumn("r", rank).where(F.col("r") <= best).select(
            "q", F.col("cell").alias("in_cell"), F.col("id").alias("of_id")
        ).distinct()
        same = (F.col("cell") - F.col("in_cell") == 0) & (F.col(key) == F.col("of_id"))  # cells are listed: nothing is left for dynamic pruning
        held = of_cells.select("cell", key, "embedding").join(F.broadcast(chosen), same)  # at most NAMED rows
        scored = held.join(F.broadcast(names), "q").select(query_key, key, function(F.col("embedding"), F.col("query")).alias("score"))
        found.append(scored.where("score is not null"))
    if not found:
        return asked.select(
            query_key, F.lit(None).cast(id_type).alias(key), F.lit(None).cast("double").alias("score"), F.lit(0).alias("rank")
        ).where("false")
    order = F.col("score").desc() if rising else F.col("score").asc()
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(order, F.col(key)))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k)


def split_cells(rows: DataFrame, model: Model, most: int, sample: int = 20_000) -> tuple[Model, list[int]]:
    """A model in which each cell of more than `most` rows is parted, and the numbers of those cells.

    Their old numbers end (no search probes them): their rows are to be encoded anew, all others stay."""
    sizes = {r.cell: r["count"] for r in rows.groupBy("cell").count().where(F.col("count") > most).collect()}  # one row a cell
    over = sorted(c for c in sizes if c in set(model.cells.tolist()))
    centroids = model.centroids.copy()
    for c in over:
        x = sample_of(rows.where(F.col("cell") == c).select("id", "embedding"), sample, model.metric)
        parts = min(-(-sizes[c] // most) + 1, MOST_CELLS - len(centroids))
        if parts < 2 or len(np.unique(x, axis=0)) < 2:  # equal vectors cannot be parted
            over = [o for o in over if o != c]
            continue
        centroids = np.concatenate([centroids, np.unique(k_means(x, parts), axis=0)])
        centroids[c] = np.nan
    return Model(centroids, model.words, model.metric), over


def calibrated(rows: DataFrame, model: Model, k: int = 10, target: float = 0.95, queries: int = 100, key: str = "id") -> tuple[int, int]:
    """(probe, refine): how many rows to compare exactly for each one asked for, and how many cells to search, so that a
    sample of the rows, as queries, has the recall asked for; powers of two, the least ones found from below."""
    some = rows.orderBy(F.xxhash64(key, F.lit(1)), key).limit(queries).select(
        F.monotonically_increasing_id().alias("query_id"), F.col("embedding").alias("query")
    )
    spark, cells = rows.sparkSession, len(model.cells)
    asked = spark.createDataFrame(some.collect(), some.schema)  # at most `queries` rows
    exact = batch_top_k(asked, rows, k, model.metric, key)
    exact = spark.createDataFrame(exact.collect(), exact.schema)  # k rows a query

    def reached(probe: int, refine: int) -> bool:
        found = recall(search(rows, model, asked, k, probe, refine, key), exact, key).agg(F.avg("recall")).first()[0]
        return found is None or found >= target

    refine = probe = 1
    while refine < 256 and not reached(max(cells, 1), refine * 4):
        refine *= 2
    while probe < cells and not reached(probe, refine * 4):
        probe *= 2
    return min(probe, max(cells, 1)), refine * 4


def recall(found: DataFrame, exact: DataFrame, key: str = "id", query_key: str = "query_id") -> DataFrame:
    """query_key and the share of its exact rows that were found."""
    hit = exact.select(query_key, key).join(found.select(query_key, key, F.lit(1).alias("hit")).distinct(), [query_key, key], "left")
    return hit.groupBy(query_key).agg((F.count("hit") / F.count("*")).alias("recall"))
