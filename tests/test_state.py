"""Keyed streams over batches (late, repeated, out of order), and descents of stored trees."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import changes, merkle
from tessera.streaming import state

FEED = "path string, hash string, deleted boolean, seq bigint"


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_file_changes_over_batches(spark, tmp_path):
    root = f"file://{tmp_path}"

    def run(rows):
        put(spark, rows, FEED, f"{root}/in")
        state.append_to(state.file_changes(spark.readStream.schema(FEED).parquet(f"{root}/in")), f"{root}/out", f"{root}/check").awaitTermination()
        return spark.read.parquet(f"{root}/out")

    before = spark.conf.get(state.PROVIDER, None)
    one = run([("a", "1", False, 1), ("b", "1", False, 1), ("c", "1", False, 1), ("c", "2", False, 2), (None, "x", False, 1), ("n", "1", None, None)])
    assert sorted((r.path, r.change, r.hash) for r in one.collect()) == [
        ("a", "added", "1"), ("b", "added", "1"), ("c", "added", "1"), ("c", "modified", "2")
    ]
    run([("a", "1", False, 5), ("b", None, True, 5), ("c", "0", False, 1), ("d", None, True, 5)])  # same hash, deleted, out of order, unknown
    three = run([("b", "9", False, 6), ("b", "9", False, 6), ("a", "3", None, 7)])
    got = sorted((r.seq, r.path, r.change) for r in three.collect() if r.seq > 2)
    assert got == [(5, "b", "deleted"), (6, "b", "added"), (7, "a", "modified")]
    assert sorted(tuple(r) for r in state.latest(three).collect()) == [("a", "3"), ("b", "9"), ("c", "2")]
    assert spark.conf.get(state.PROVIDER, None) == before


def test_sessions_drop_late_and_repeated_triggers_and_end(spark, tmp_path):
    root, schema = f"file://{tmp_path}", "key string, trigger bigint, ts timestamp"
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)

    def run(rows):
        put(spark, rows, schema, f"{root}/in")
        out = state.trigger_sessions(spark.readStream.schema(schema).parquet(f"{root}/in"))
        state.append_to(out, f"{root}/out", f"{root}/check").awaitTermination()
        return sorted((r.key, r.triggers, r.last, r.idle) for r in spark.read.parquet(f"{root}/out").collect())

    run([("p", 1, at(0)), ("p", 1, at(0)), ("q", 2, at(1)), (None, 3, at(1))])
    run([("p", 4, at(30)), ("p", 1, at(0))])  # a repeat of an old trigger
    rows = run([("p", 5, at(10)), ("p", 6, at(28)), ("q", 7, at(29))])  # 5 is older than the watermark of minute 25
    assert ("p", 3, 4, False) in rows and ("q", 2, 7, False) in rows and all(r[2] != 5 for r in rows)
    rows = run([("r", 8, at(300))])
    rows = run([("r", 9, at(301))])
    assert ("p", 3, 4, True) in rows and ("q", 2, 7, True) in rows  # idle for an hour of event time
    rows = run([("p", 10, at(302))])
    assert ("p", 1, 10, False) in rows


def snapshot(spark, n, edit=()):
    rows = [(f"d{i % 20}/s{i % 7}/f{i}.ts", f"h{i}") for i in range(n)] + [("top.ts", "t"), ("d1/x/y/z/deep.ts", "d")]
    rows = [(p, "new" if p in edit else h) for p, h in rows]
    return spark.createDataFrame(rows, "path string, hash string")


@pytest.mark.parametrize("listed", [500, 0])
def test_tree_descends_into_changed_folders_only(spark, tmp_path, listed):
    old, new = snapshot(spark, 2000), snapshot(spark, 2000, {"d3/s3/f3.ts", "d1/x/y/z/deep.ts"})
    new = new.where("path <> 'd4/s4/f4.ts'").union(spark.createDataFrame([("d99/new/f.ts", "n"), ("root2.ts", "r")], new.schema))
    a, b = (merkle.StoredTree(spark, f"file://{tmp_path}/{n}").write(s) for n, s in (("a", old), ("b", new)))
    found, read = merkle.tree_diff(a, b, f"file://{tmp_path}/scratch", listed)
    want = sorted(tuple(r) for r in changes.diff(old, new).collect())
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) == 5
    assert [r["differ"] for r in read] == [1, 4, 4, 1, 1, 0]
    assert read[1]["folders"] == 21 and read[2]["folders"] <= 4 * 8  # only below the four that differ
    if listed:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "In(folder" in plan or "EqualTo(folder" in plan
    same, read = merkle.tree_diff(a, a, f"file://{tmp_path}/scratch", listed)
    assert same.collect() == [] and read == [{"depth": 0, "folders": 1, "differ": 0}]


def test_trees_of_odd_snapshots(spark, tmp_path):
    schema = "path string, hash string"
    none, odd = spark.createDataFrame([], schema), spark.createDataFrame(
        [("a", ""), ("a/b", "1"), ("a b/ü/c", "2"), ("/lead", "3"), ("x\ny/z", "4")], schema
    )
    trees = [merkle.StoredTree(spark, f"file://{tmp_path}/{i}").write(s) for i, s in enumerate((none, odd))]
    assert trees[0].root() == merkle.EMPTY != trees[1].root()
    found, _ = merkle.tree_diff(*trees, f"file://{tmp_path}/scratch")
    assert sorted(tuple(r) for r in found.collect()) == sorted((r.path, "added") for r in odd.collect())
    back, _ = merkle.tree_diff(trees[1], trees[0], f"file://{tmp_path}/scratch")
    assert {r.change for r in back.collect()} == {"deleted"} and back.count() == 5
    digest = {r.folder: r.digest for r in merkle.folders(odd).collect()}
    shuffled = {r.folder: r.digest for r in merkle.folders(odd.orderBy(F.desc("path"))).collect()}
    assert digest == shuffled and merkle.folders(odd.union(odd.limit(1))).where("depth = 0").first().digest != digest[""]
