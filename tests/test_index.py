"""The stored index of collections: recall, exactness, filters, changes, splits, odd vectors; and writers at the same time."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ann, search
from tessera.sources.collections import Collections, ConcurrentChange


def vectors(n, dims=16, seed=3):
    """Vectors in 20 clusters of very different sizes, two of them one vector repeated."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, dims))
    of = np.minimum(r.geometric(0.2, n) - 1, 19)
    x = centres[of] + 0.3 * r.normal(size=(n, dims))
    return np.where((of == 3)[:, None], centres[3], x)


@pytest.fixture(scope="module")
def rows(spark):
    x = vectors(3000)
    return spark.createDataFrame(
        [(f"{i:05d}", f"p/{i % 97}", i % 5, v.tolist()) for i, v in enumerate(x)],
        "id string, path string, label int, embedding array<double>"
    ).repartition(4)


def asked(rows):
    return rows.where("cast(id as int) % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


def hits(df):
    return sorted((r.query_id, r["rank"], r.id) for r in df.select("query_id", "rank", "id").collect())


@pytest.mark.parametrize("metric", ["COSINE", "L2", "IP"])
def test_index_recall_and_exactness(spark, rows, tmp_path, metric):
    """All ids divisible by 100 as queries: recall of 0.9 or more with the probes found, equal to brute force with all."""
    c = Collections(spark, f"file://{tmp_path}", parts=4)
    c.create("v", 16, "IVF_PQ", metric)
    c.insert("v", rows)
    head = c.header("v")
    model = c._model("v", head["index"]["model"])
    assert c.stats("v")["index_type"] == "IVF_PQ" and head["index"]["probe"] < len(model.cells)
    exact = search.batch_top_k(asked(rows), rows, 10, metric).cache()
    found = c.search("v", asked(rows), 10)
    shares = [r.recall for r in ann.recall(found, exact).collect()]
    assert len(shares) == 30 and np.mean(shares) >= 0.9
    assert hits(c.search("v", asked(rows), 10, probe=10**6, refine=1000)) == hits(exact)
    filtered = c.search("v", asked(rows), 10, {"label": 2}, probe=10**6, refine=1000)
    assert hits(filtered) == hits(search.batch_top_k(asked(rows), rows.where("label = 2"), 10, metric))


def test_index_plan_reads_probed_cells_only(spark, rows, tmp_path):
    c = Collections(spark, f"file://{tmp_path}", parts=4)
    c.create("v", 16)
    c.insert("v", rows)
    built = c.build_index("v")
    found = c.search("v", asked(rows).limit(1), 10, probe=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "cell" in x]
    assert built["cells"] > 2 and scans and all("cell#" in x.split("PartitionFilters:")[1] for x in scans)
    codes = [x for x in scans if "code#" in x.split("Batched")[0]]
    assert codes and not any("embedding#" in x.split("Batched")[0] for x in codes)  # codes are read without vectors
    read = {r.f for r in c._index_table("v", c.header("v")).where("cell in (0, 1)").select(F.regexp_extract(F.input_file_name(), r"cell=(\d+)", 1).alias("f")).distinct().collect()}
    assert read <= {"0", "1"}


def test_index_follows_changes_and_splits(spark, rows, tmp_path):
    c = Collections(spark, f"file://{tmp_path}", parts=4)
    c.create("v", 16, "IVF_PQ")
    c.insert("v", rows.where("label < 2"))
    c.insert("v", rows.where("label = 2"))
    fresh = rows.where("label = 3").withColumn("path", F.lit("p/7"))
    c.merge("v", rows.where("path = 'p/7'").select("path").distinct(), fresh)
    c.delete("v", ["00000", "00001", "00002"])
    now = c.scan("v").drop("part")
    assert now.count() == c._index_table("v", c.header("v")).count()
    whole = lambda: hits(c.search("v", asked(rows), 10, probe=10**6, refine=1000))
    want = hits(search.batch_top_k(asked(rows), now, 10))
    assert whole() == want
    before = c._model("v", c.header("v")["index"]["model"])
    over = c.split_cells("v", 60)
    after = c._model("v", c.header("v")["index"]["model"])
    assert over and len(after.cells) > len(before.cells) and not set(over) & set(after.cells.tolist())
    assert whole() == want and c.vacuum("v") is not None and whole() == want
    c.insert("v", rows.where("label = 4"))
    assert whole() == hits(search.batch_top_k(asked(rows), c.scan("v"), 10))
    c.replace("v", rows.limit(0))
    assert c.scan("v") is None and c.search("v", asked(rows)).collect() == []


def test_index_of_odd_vectors(spark, tmp_path):
    odd = [
        ("a", [1.0, 0.0, 0.0]), ("a", [1.0, 0.0, 0.0]), ("z", [0.0, 0.0, 0.0]), ("b", [0.0, 1.0, None]), ("c", None),
        ("d", [0.6, 0.8, 0.0]), ("e", [1.0, 2.0])
    ]
    rows = spark.createDataFrame(odd, "id string, embedding array<double>")
    model = ann.fit(rows)
    coded = ann.encode(rows, model)
    assert sorted(r.id for r in coded.collect()) == ["a", "a", "d"]
    q = spark.createDataFrame([(1, [1.0, 0.1, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0])], "query_id int, query array<double>")
    assert [(r.query_id, r.id) for r in sorted(ann.search(coded, model, q, 3).collect(), key=lambda r: r["rank"])] == [(1, "a"), (1, "a"), (1, "d")]
    none = ann.fit(rows.limit(0))
    assert ann.encode(rows, none).collect() == [] and ann.search(coded, none, q).collect() == []
    assert ann.split_cells(coded, model, 1)[0].cells.tolist() == ann.split_cells(coded, model, 1)[0].cells.tolist()


def test_writers_at_the_same_time(spark, rows, tmp_path):
    """Inserts from four threads all survive; of two merges of one part, none is lost."""
    c = Collections(spark, f"file://{tmp_path}", parts=4)
    c.create("v", 16)
    failed = []

    def work(call):
        try:
            call()
        except Exception as e:
            failed.append(e)

    def together(*calls):
        threads = [threading.Thread(target=work, args=(f,)) for f in calls]
        [t.start() for t in threads], [t.join() for t in threads]

    together(*(lambda i=i: Collections(spark, f"file://{tmp_path}").insert("v", rows.where(F.col("label") == i)) for i in range(4)))
    assert not failed and c.scan("v").count() == rows.where("label < 4").count()
    gone = lambda p: spark.createDataFrame([(p,)], "path string")
    together(*(lambda p=p: Collections(spark, f"file://{tmp_path}").merge("v", gone(p), tries=10) for p in ("p/1", "p/2", "p/3")))
    assert not failed and c.scan("v").count() == rows.where("label < 4 and path not in ('p/1', 'p/2', 'p/3')").count()

    class Slow(Collections):
        def _write(self, name, rows):
            out = super()._write(name, rows)
            c.merge("v", gone("p/4"), rows.limit(1).withColumn("path", F.lit("p/5")))  # another writer, meanwhile
            return out

    with pytest.raises(ConcurrentChange):
        Slow(spark, f"file://{tmp_path}").merge("v", gone("p/4"), rows.limit(1).withColumn("path", F.lit("p/5")), tries=1)


def test_header_of_a_writer_that_died(spark, rows, tmp_path):
    c = Collections(spark, f"file://{tmp_path}")
    c.create("v", 16)
    c.insert("v", rows.limit(5))
    (tmp_path / "v" / f"header-{2:010d}.json").write_text('{"dimen')
    c.insert("v", rows.limit(3))
    assert c.scan("v").count() == 8
