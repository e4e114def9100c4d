"""Whole jobs: shapes of input that no fixed number of rounds, lines or passages covers."""

import random

import duckdb
import numpy as np
import pytest

from tessera.llm import bpe, decontaminate, licenses, ngram_join, oracles, pii, quality_mil, quality_rules
from tessera.llm.graph import connected_components
from tessera.llm.queries import word_bpe_path
from tessera.llm.textnum import Words
from tests.llm import brute


def test_components_of_long_chains_and_other_shapes(spark):
    """A chain of 1,000 nodes with random ids, a star around the greatest id, a cycle, a loop and a repeated edge."""
    r = random.Random(2)
    chain = r.sample(range(-(10**12), 10**12), 1000)
    edges = list(zip(chain[:-1], chain[1:], strict=True))
    star = [(3 * 10**12, 2 * 10**12 + i) for i in range(50)]
    cycle = [(4 * 10**12 + i, 4 * 10**12 + (i + 1) % 9) for i in range(9)]
    rows = edges + star + cycle + [(5, 5), star[0], star[0][::-1]]
    r.shuffle(rows)
    want = {n: min(chain) for n in chain} | {n: 2 * 10**12 for e in star for n in e} | {n: 4 * 10**12 for e in cycle for n in e}
    out = connected_components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert len(out) == len(want) and {x.node: x.root for x in out} == want
    few = [(a, b) for a, b in rows if a not in set(chain[60:])]
    out = connected_components(spark.createDataFrame(few, "a long, b long"), last=0).collect()  # by contraction alone
    assert {x.node: x.root for x in out} == {n: min(chain[:61]) for n in chain[:61]} | {n: t for n, t in want.items() if n not in set(chain)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize(("whole", "block"), [(256, 128), (5, 3), (2, 2)])
def test_ngram_join_of_cut_components(spark, whole, block):
    """Chains, families that meet in a shared passage, and pairs near the threshold, in blocks of any size."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts, passage = [], [word() for _ in range(90)]
    for size, edits in ((40, 1), (25, 3), (12, 2)):
        w = [word() for _ in range(30)] + passage  # more than half of the lanes are shared by all families
        for _ in range(size):
            w = list(w)
            for _ in range(edits):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    base = [word() for _ in range(100)]
    texts += [" ".join(base[:i] + [word() for _ in range(i, i + 14)] + base[i + 14 :]) for i in range(0, 80, 4)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sorted(tuple(x) for x in ngram_join.components(docs, whole, block).collect())
    assert out == sorted(brute.components(rows))
    assert len({c for *_, c in out}) > 3


def test_ngram_join_of_runs_that_are_cut(spark):
    """More near copies in one batch than make a run long, in several batches."""
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        w[r.randrange(60)] = f"x{i % 50}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(x) for x in ngram_join.components(docs).collect()) == sorted(brute.components(rows))


def test_licenses_wrapped_over_lines(spark):
    """Every template wrapped at any width and place, with comment signs and one foreign word; its words far apart are no notice."""
    r = random.Random(4)
    rows, want = [], []
    for text, label in licenses.TEMPLATES:
        for width in (1, 2, 3, 5, 7):
            w = text.split()
            w.insert(len(w) // 2, "foreign")
            before = [f"x{r.randrange(99)}" for _ in range(r.randrange(150))]
            lines = [" ".join(before), *("# " + " ".join(w[i : i + width]) for i in range(0, len(w), width)), "other words"]
            rows.append((len(rows), "\n".join(lines)))
            want.append(label)
    far = "\n".join(w + " pad" * 20 for w in "licensed under a creative commons attribution 4 0 international license".split())
    rows += [(len(rows), far), (len(rows) + 1, "\n"), (len(rows) + 2, None)]
    out = sorted(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert [x.doc_id for x in out] == [d for d, _ in rows]
    assert all(label in x.labels.split(",") and x.score == 1.0 for x, label in zip(out, want, strict=False))
    assert [(x.labels, x.score) for x in out[len(want) :]] == [("", 0.0)] * 3


def test_quality_scores_all_passages_of_a_long_document(spark):
    """Passages have one size at any length, and a score is the softmax over all of them."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    texts = [" ".join(word() for _ in range(n)) for n in (64 * 900 - 5, 64 * 65, 30)] + ["", "a " * 70 + "B! " * 200]
    raw = [t.encode() for t in texts]
    words = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    x, first = quality_mil.bags(words)
    assert np.diff(first).tolist() == [900, 65, 1, 1, 5]
    assert np.expm1(x[:, 0] * 4).max() == pytest.approx(64, rel=1e-4)
    assert np.diff(quality_mil.bounded(x, first, 64)[1]).tolist() == [64, 64, 1, 1, 5]
    model = quality_mil.Attention()
    model._start()
    want = model._forward(x, first)[-1]
    for step in (1, 7, 64, 4096):
        assert model.score(x, first, step) == pytest.approx(want)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [o.score for o in sorted(quality_mil.score(docs, model).collect())] == pytest.approx(list(want))


@pytest.mark.parametrize("table_bytes", [16 << 20, 400])
def test_benchmark_rows_without_an_id_are_found(spark, tmp_path, table_bytes):
    word = lambda i: f"w{i}"
    passage = lambda a: " ".join(map(word, range(a, a + 14)))
    items = [(None, passage(0)), (None, passage(100)), (1, passage(0)), (2, passage(200)), (3, None), (None, None)]
    docs = [(1, f"x {passage(0)} y"), (2, f"{passage(100)} {passage(200)}"), (3, passage(100)), (4, "x y z"), (5, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", rows), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    out = decontaminate.digest(decontaminate.contamination(rows, bench, table_bytes=table_bytes, unnamed=True))
    names = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    assert out.columns == names.split(", ")
    want = con.execute(f"SELECT {names} FROM ({oracles.SQL['op3_decontamination']}) ORDER BY doc_id").fetchall()
    assert sorted(map(tuple, out.collect())) == want
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(rows, bench, table_bytes=table_bytes, unnamed=True).collect()) == [4, 5]


def test_spans_and_tokens_of_very_long_texts(spark):
    """Cost grows with the text: 50,000 matches, and words of 200,000 letters."""
    from tokenizers import Tokenizer

    texts = [" ".join(f"user{i}@mail{i}.com" for i in range(50_000)), " ".join(f"{i % 256}.2.3.4" for i in range(65 * 64 + 1)), "é 1.2.3.4 " * 64]
    out = sorted(pii.digest(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect())
    for r, t in zip(out, texts, strict=True):
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii(t)))
    r = random.Random(1)
    tokens, own = Tokenizer.from_file(word_bpe_path()), bpe.WordBPE(word_bpe_path())
    words = ["".join(r.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "eé日t") for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 5000)]
    words += ["short", "a" * 3001, "abab" * 700, "".join(r.choice("etaoinshrdlu") for _ in range(200_000))]
    for w in words:
        assert own.encode(w) == tokens.encode(w, add_special_tokens=False).ids
    assert max(map(len, [*own.known, *own.chunks])) <= bpe.KEPT


def planted(kind, text):
    """A text with personal data of a kind that the fixed patterns alone may miss."""
    return {"secret": f'{text} token = "{brute.sha(text)[:40]}" {text}', "phone": f"{text} call +1 555 123 {len(text):04d} {text}", "email": f"{text} mail a{len(text)}@b.com {text}"}[kind]


def test_recall_of_planted_personal_data(spark, sf_dir):
    """Spans find what is planted, secrets too, which only the trained method adds; texts without digits or @ have none."""
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if r.text and not any(c.isdigit() or c in "@+" for c in r.text)][:90]
    kinds = ("secret", "phone", "email")
    rows = [(i, planted(kinds[i % 3], t[:400])) for i, (_, t) in enumerate(base)] + [(1000 + i, t) for i, (_, t) in enumerate(base)]
    out = {r.doc_id: r.spans for r in pii.digest(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    found = {k: np.mean([k in out[i] for i in range(len(base)) if kinds[i % 3] == k]) for k in kinds}
    assert min(found.values()) >= 0.95, found
    assert not any(out[1000 + i] for i in range(len(base)))


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "\n \n"), (-4, "one"), (-5, "Same Words! " * 3000 + "# # 1"), (-5, "É 日本 a\nÉ 日本 a"), (None, "no id")], "doc_id long, text string")
    return docs, docs.select("doc_id", "text").unionByName(odd), spark.read.parquet(f"{sf}/labels.parquet")


def test_tree_verdicts_against_plain_walks(labelled):
    """op10 with a fitted model: features, trees and verdict of every document, odd ones among them."""
    docs, rows, labels = labelled
    trees = quality_rules.fit(docs, labels)
    want = {}
    for r in rows.collect():
        c, s = brute.counts(r.text), brute.tree_score(trees, brute.rule_features(r.text))
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        want.setdefault(r.doc_id, []).append((*c, failed, not failed and s >= 0.3, pytest.approx(s)))
    out = quality_rules.quality_rules(rows, trees)
    assert out.columns[-3:] == ["base_failed", "kept", "score"]
    for r in out.collect():
        assert tuple(r)[1:] in want[r.doc_id]
    kept = quality_rules.keep_good(rows, trees)
    assert kept.columns == rows.columns and kept.count() == sum(w[-2] for x in want.values() for w in x)


def test_attention_scores_against_plain_sums(labelled):
    """op6 with a fitted model: inputs and scores of every tenth document and of odd ones."""
    docs, rows, labels = labelled
    model = quality_mil.fit(docs, labels)
    some = [r for r in rows.collect() if r.doc_id is None or r.doc_id < 0 or r.doc_id % 10 == 0]
    got = {}
    for r in quality_mil.score(rows, model).collect():
        got.setdefault(r.doc_id, []).append((r.score, r.predicted))
    for r in some:
        raw = (r.text or "").encode()
        x, first = quality_mil.bags(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        w = brute.plain(r.text)
        n = max(-(-len(w) // 64), 1)
        assert first.tolist() == [0, n]
        for k in range(n):
            want = brute.passage_inputs(w[k * len(w) // n : (k + 1) * len(w) // n], len(w))
            assert all(a == pytest.approx(b, abs=1e-4) for a, b in zip(want, x[k].tolist(), strict=False))
        s = brute.attention_score(model.p, x.tolist())
        assert (pytest.approx(s, abs=1e-6), int(s >= 0.3)) in got[r.doc_id]


def test_keep_one_of_odd_rows(spark):
    """Nulls, no ids, repeated rows and ids, empty and short texts, and columns with clashing names."""
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(58))
    rows = [(3, a), (3, a), (5, b), (None, a), (7, None), (8, ""), (8, ""), (9, "x y"), (10, "x y"), (2, "other words " * 40), (None, None)]
    docs = spark.createDataFrame([(d, t, 1, 2, "r", 3) for d, t in rows], "doc_id long, text string, k int, s1 int, root string, n int")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(3, a), (3, a), (None, a), (7, None), (8, ""), (8, ""), (9, "x y"), (2, "other words " * 40), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert ngram_join.keep_one(docs.limit(0)).collect() == []


@pytest.mark.parametrize("table_bytes", [16 << 20, 100])
def test_ids_of_any_type_in_decontamination(spark, table_bytes):
    """Texts as ids, of documents and of items, at any number of parts."""
    passage = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([("a", f"x {passage}"), ("b", "short note here"), (None, None)], "doc_id string, text string")
    bench = spark.createDataFrame([("item-2", passage), ("item-1", "short note"), ("item-10", passage + " end")], "item_id string, text string")
    out = {r.doc_id: r for r in decontaminate.digest(decontaminate.contamination(docs, bench, table_bytes=table_bytes)).collect()}
    assert (out["a"].n_items, out["a"].items_sha256, out["a"].n_hit) == (2, brute.sha("item-10,item-2"), 14)
    assert (out["b"].n_items, out["b"].items_sha256, out["b"].n_hit) == (1, brute.sha("item-1"), 2) and not out[None].contaminated
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench, table_bytes=table_bytes).collect()] == [None]
