"""The pipeline's stages one by one against brute force, and as a whole."""

import corpus_pipeline as cp
from tessera.llm import quality_rules
from tests.llm import brute


def test_stages_follow_the_contract(spark, sf_dir):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = docs
    for name, stage in cp.STAGES[:-1]:
        out = cp.staged(stage(spark, out, sf_dir), name)
        assert out.columns == columns
        got = {r.doc_id: r.text for r in out.collect()}
        if name == "quality_rules":
            model = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            want = {r.doc_id for r in quality_rules.quality_rules(docs, model).where("kept").collect()}
            assert set(got) == want
            for d in want:
                c = brute.counts(rows[d])
                assert c[0] >= 10 and 100 * c[4] <= 20 * c[0]
        elif name == "line_dedup":
            want = {}
            for d, gone in brute.line_dedup(sorted(rows.items())):
                lines = rows[d].split("\n")
                left = [x for i, x in enumerate(lines) if i not in gone]
                if not gone or any(brute.plain(x) for x in left):
                    want[d] = "\n".join(left)
            assert got == want
        elif name == "ngram_join":
            want = {d: rows[d] for d, _, c in brute.components(sorted(rows.items())) if d == c}
            assert got == want
        else:
            want = {d: rows[d] for d, *_, bad in brute.contamination(sorted(rows.items()), bench) if not bad}
            assert got == want
        rows = got
    last = cp.STAGES[-1][1](spark, out, sf_dir).collect()
    assert {r.doc_id for r in last} == set(rows) and all(r.n_tokens > 0 for r in last)


def test_run_gives_the_same_rows_as_the_stages(spark, sf_dir):
    once = cp.run(spark, sf_dir)
    assert once.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert once.count() > 100


def test_stages_on_odd_rows_and_empty_tables(spark, sf_dir):
    """Nulls in any column, no ids, repeated rows, empty and very long texts; and no rows at all."""
    prose = " ".join(f"w{i * i % 997}" for i in range(120)) + "\nsecond line of words that stays here"
    long = " ".join(f"v{i * 7919 % 100_003}" for i in range(30_000))
    rows = [(1, prose), (1, prose), (2, prose), (None, prose), (3, None), (4, ""), (5, "\n \n"), (6, "x" * 100_000), (7, long), (None, None), (8, "É 日本 " * 3)]
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.createDataFrame([(d, t, None, None, None if t is None else len(t)) for d, t in rows], schema)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    for table, left in ((docs, {None, 1, 7}), (docs.limit(0), set())):
        out = table
        for name, stage in cp.STAGES[:-1]:
            out = cp.staged(stage(spark, out, sf_dir), name)
            assert out.columns == docs.columns
        assert {r.doc_id for r in out.collect()} <= left
        last = cp.STAGES[-1][1](spark, out, sf_dir)
        assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == out.count()
    kept = {r.doc_id for r in cp.STAGES[0][1](spark, docs, sf_dir).collect()}
    assert not kept & {3, 4, 5, 6, 8}  # fewer than ten words
