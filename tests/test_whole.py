"""Whole jobs: recall of searches over a set of queries."""

import pytest

from tessera.operators import search
from tessera.plans import catalogue


@pytest.mark.parametrize("metric", ["COSINE", "L2", "IP"])
def test_ivf_recall_over_all_ids_divisible_by_100(spark, metric):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumnRenamed("vec_id", "id")
    placed, centroids = search.ivf_cells(rows, 16)
    placed = placed.cache()
    radii = search.ivf_radii(placed, centroids)
    queries = rows.where("id % 100 = 0").selectExpr("id as query_id", "embedding as query")
    exact, shares = {}, []
    for r in search.batch_top_k(queries, rows, 10, metric).collect():
        exact.setdefault(r.query_id, set()).add(r.id)
    for r in queries.collect():
        hits = search.ivf_top_k(placed, centroids, list(map(float, r.query)), 10, 8, metric, radii=radii).collect()
        shares.append(len(exact[r.query_id] & {h.id for h in hits}) / 10)
    placed.unpersist()
    assert len(shares) == queries.count() >= 20 and sum(shares) / len(shares) >= 0.9 and min(shares) >= 0.9


def test_batch_queries_are_all_ids_divisible_by_100(spark):
    sf = "/root/testdata/sf0.01"
    out = catalogue.QUERIES["batch_topk_hundredth"](spark, sf).collect()
    ids = [r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 100 = 0").collect()]
    assert sorted((r.query_id, r["rank"]) for r in out) == [(i, k) for i in sorted(ids) for k in range(1, 11)]
