"""Each operator against a plain statement of its result, on a real table and on one of odd cases."""

import os
import random
import zlib

import numpy as np
import pytest

from tessera.llm import bpe, decontaminate, licenses, line_dedup, ngram_join, pii, quality_mil, quality_rules, sharding, substring_dedup
from tests.llm import brute

#: Columns with names that the operators use themselves.
EXTRA = "k long, h long, row long, w string, n int, i int, score double, copy string, g long, s1 long, dup string, component_id long, rank int, label string, words string"
ODD_SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def odd_texts():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long = prose(6000)
    base = [word() for _ in range(120)]
    edited = [base[:50] + ["zz"] + base[51:], base[:20] + base[21:], base[:70] + ["yy"] + base[70:], base[:10] + ["q"] * 60 + base[70:]]
    passage = prose(60)
    line = prose(20)
    near_line = line.split()
    near_line[5] = "changed"
    return [
        None, "", " ", "\n\n", "one", "a b c d", "a b c d e", long, long, long + " end", " ".join(base), *(" ".join(e) for e in edited),
        prose(40) + " " + passage + " " + prose(30), prose(50) + "\n" + passage, passage, f"{line}\n{prose(12)}", f"{prose(9)}\n{' '.join(near_line)}\n{line}", f"{line} more",
        "same line twice here now yes ok go on\nsame line twice here now yes ok go on\n\n", "É é ÀÉ ß İ 日本 😀 text nbsp sep", "x" * 5000, "a@b.c_d@e.f x@y 1.2.3.4.5 256.1.1.1 001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (555) 123-4567 +12 3",
        "Released under the MIT License. Apache License, Version 2.0 and CC BY-NC 4.0; under the mit licenses", "password=0123456789abcdef0123456789abcdef token", "<|endoftext|> I'LL go's 12 3",
        "9" * 40 + " " + "1.1" * 30,
    ]


@pytest.fixture(scope="module")
def odd(spark):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (10, texts[10]), (10, texts[10]), (None, texts[10]), (None, None), (-5, texts[18])]
    extra = EXTRA.count(",") + 1
    return spark.createDataFrame([(d, t, None, None, None) + (None,) * extra for d, t in rows], ODD_SCHEMA).repartition(3), rows


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["odd", "real"])
def case(request):
    return request.getfixturevalue(request.param)


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_pii(case):
    docs, rows = case
    want = []
    for d, t in rows:
        p = brute.pii(t)
        want.append((d, *(sum(k == x for k, _, _ in p) for x in ("email", "ip", "card", "phone")), brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in p))))
    out = pii.digest(pii.find_pii(docs)).collect()
    same([tuple(r)[:6] for r in out], want)
    for r in out:  # base spans stay
        spans = set(r.spans.split(",")) - {""}
        assert len(spans) >= r.n_email + r.n_ip + r.n_card + r.n_phone


def test_pii_in_extreme_runs(spark):
    texts = ["a@b" + ".c" * 20_000 + " x", "9" * 4000, "1.2.3." + "4" * 5000, "99999999999999999999.1.1.1 " + "0" * 400 + "1.2.3.4", "1 " * 3000, "+1" * 5000, "a" * 4000 + "@", "x_1" * 3000, "+1 " + "(2) " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii(t)))) for i, t in enumerate(texts)]
    same([(r.doc_id, r.base_sha256) for r in pii.digest(pii.find_pii(docs)).collect()], want)


def test_pii_reliabilities_favour_agreeing_labelers(spark):
    # code: check + 3 * gazetteer + 9 * context + 27 * shape; 0 no, 1 yes, 2 abstain
    rows = [(1 + 3 * 2 + 9 * 1 + 27, 1, 200), (0 + 3 * 2 + 9 * 2 + 0, 2, 300), (1 + 3 * 0 + 9 * 2 + 27, 3, 20)]
    model = pii.reliabilities(spark.createDataFrame(rows, "v int, f int, n long")).first()
    assert model.m[1] > model.m[3] and model.w[1] > 0 > model.w[2]


def test_substring_dedup(case):
    docs, rows = case
    same(substring_dedup.dedup_digest(docs).collect(), brute.substring(rows))


def test_fingerprint_log_compacts_and_keeps_counts(spark, real, tmp_path):
    """Batches one after another, by an index that is opened anew for each, find what one count over the whole table finds."""
    docs, _ = real
    prints = substring_dedup.fingerprints(docs, 5).where("not whole").persist()
    found, runs = set(), []
    for i in range(5):
        log = substring_dedup.FingerprintLog(spark, f"file://{tmp_path}/log", buckets=3, fanout=2)
        found |= {(r.h, r.k) for r in log.append(prints.where(f"batch = {i}").select("h", "k", "n")).collect()}
        runs.append(len(log.runs()))
    assert runs == [1, 1, 2, 1, 2]
    again = prints.groupBy("h").sum("n").where("`sum(n)` > 1").select("h")
    assert found == {(r.h, r.k) for r in prints.join(again, "h").collect()}
    # an earlier run takes part in a merge join as it lies: neither shuffled nor sorted
    older = log._table(log.runs()[-1])
    plan = older.join(log._table(log.runs()[0]).withColumnRenamed("n", "m"), "h")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    prints.unpersist()


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup_in_any_number_of_batches(odd, batches):
    docs, rows = odd
    same(substring_dedup.dedup_digest(docs, batches).collect(), brute.substring(rows))


def benchmark_rows(rows):
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(i, " ".join(t.split()[5:25])) for i, t in enumerate(texts[:20])]
    return [*items, (100, None), (101, ""), (102, "a b c"), (103, "one"), (104, items[0][1]), (None, "x")]


@pytest.mark.parametrize("bound", [16 << 20, 500])
def test_contamination(spark, case, bound):
    docs, rows = case
    items = benchmark_rows(rows)
    want = brute.contamination(rows, [(i, t) for i, t in items if i is not None])
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(decontaminate.digest(decontaminate.contamination(docs, bench, table_bytes=bound)).collect(), want)
    kept = decontaminate.drop_contaminated(docs, bench, table_bytes=bound)
    assert kept.columns == docs.columns
    same([(r.doc_id,) for r in kept.collect()], [(w[0],) for w in want if not w[5]])


def test_bpe(case):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    docs, rows = case
    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    want, round_trip = [], []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False))))
        round_trip.append((d, ids, t.decode(ids, skip_special_tokens=False)))
    same(bpe.digest_documents(docs, path("word_bpe_49k.json")).collect(), want)
    same(bpe.encode_documents(docs, path("word_bpe_49k.json")).collect(), round_trip)


@pytest.mark.parametrize("limit", [1, 3000, 20000, 1 << 40])
def test_sharding(case, limit):
    docs, rows = case
    out = sharding.extendible_shards(docs, limit).collect()
    same([(r.doc_id,) for r in out], [(d,) for d, _ in rows])
    import hashlib

    bits = {d: bin(int(hashlib.md5(b"" if d is None else str(d).encode()).hexdigest()[:12], 16))[2:].zfill(48) for d, _ in rows}
    size = lambda p: sum(len((t or "").encode()) for d, t in rows if bits[d].startswith(p))
    for r in out:
        assert bits[r.doc_id].startswith(r.shard) and len(r.shard) == r.depth
        assert size(r.shard) == r.shard_bytes and r.fits == (r.shard_bytes <= limit)
        assert r.fits or r.depth == 48
        assert r.depth == 0 or size(r.shard[:-1]) > limit  # no bucket splits without need


def folds(ids):
    return np.array([zlib.crc32(str(i).encode()) % 5 for i in ids])


def test_quality_classifier_is_good_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r.doc_id: r for r in quality_mil.score(docs, quality_mil.fit(docs, labels)).collect()}
    held = [(out[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(o.held_out for o, _ in held)
    assert np.mean([o.predicted == q for o, q in held]) > 0.95


def test_quality_classifier_without_labels_and_on_odd_texts(spark, odd):
    docs, rows = odd
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_mil.score(docs, quality_mil.fit(docs, none)).collect()
    assert len(out) == len(rows) and {r.score for r in out} == {0.5}
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(25)], none.schema)
    out = quality_mil.score(docs, quality_mil.fit(docs, some)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)


def test_line_dedup(case):
    docs, rows = case
    least = -(2**63)
    want = brute.line_dedup([(least if d is None else d, t) for d, t in rows])
    out = line_dedup.dedup_digest(docs).collect()
    same([(least if r.doc_id is None else r.doc_id, r.removed_lines) for r in out], [(d, ",".join(map(str, g))) for d, g in want])
    texts = [("\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in g) if t is not None else None, g, t) for (_, t), (_, g) in zip(rows, want, strict=True)]
    kept = line_dedup.dedup_documents(docs)
    assert kept.columns == docs.columns
    gone = lambda t, g: bool(g) and len(g) == sum(bool(brute.plain(x)) for x in t.split("\n"))
    same([(r.text,) for r in kept.select("text").collect()], [(x,) for x, g, t in texts if not gone(t or "", g)])


@pytest.mark.parametrize("words", [1, 3])
def test_line_dedup_of_shorter_lines(spark, odd, words):
    """The bound from which lines may be near copies is a parameter, down to lines of one word."""
    r = random.Random(words)
    rows = [(i, "\n".join(" ".join(r.choice("abcd") for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 5)))) for i in range(60)] + [(100 + i, t) for i, (_, t) in enumerate(odd[1]) if t is None or len(t) < 2000]
    out = line_dedup.dedup_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words).collect()
    same([(x.doc_id, x.removed_lines) for x in out], [(d, ",".join(map(str, g))) for d, g in brute.line_dedup(rows, words)])


def test_within_one_is_the_edit_distance():
    r = random.Random(3)
    for _ in range(3000):
        a = [r.choice("ab") for _ in range(r.randint(0, 5))]
        b = [r.choice("ab") for _ in range(r.randint(0, 5))]
        assert line_dedup.within_one(a, b) == brute.edit_within_one(a, b)


def test_licenses(case):
    docs, rows = case
    out = licenses.scan_licenses(docs).collect()
    same([tuple(r)[:6] for r in out], [(d, *brute.licenses(t)) for d, t in rows])
    sets = licenses.template_sets()
    texts = dict(rows)
    for r in out:
        if [d for d, _ in rows].count(r.doc_id) > 1:
            continue
        want, best = set(filter(None, r.base_labels.split(","))), 0.0
        for line in (texts[r.doc_id] or "").split("\n"):
            w = set(brute.alnum(line))
            for _, label, s, need in sets:
                if len(w & s) >= need:
                    want.add(label)
                    best = max(best, len(w & s) / len(s))
        assert r.labels == ",".join(sorted(want)) and r.score == pytest.approx(1.0 if r.n_base else best)


def test_ngram_join(case):
    docs, rows = case
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(docs).collect()]
    big = 2**62  # a null doc_id is the least of a class only if there is no other
    want = [(None if d == big else d, n, None if c == big else c) for d, n, c in brute.components([(big if d is None else d, t) for d, t in rows])]
    same(got, want)


def test_ngram_join_of_a_large_family(spark):
    """Hot lanes: a family of near copies, and documents that share a passage only."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base, passage = [word() for _ in range(150)], [word() for _ in range(40)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(i % 5):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join([word() for _ in range(r.randint(20, 60))] + passage)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same([tuple(x) for x in ngram_join.components(docs).collect()], brute.components(rows))


def test_pigeonhole_bound_holds_for_sketches():
    """Filled lanes that agree are at least t for every pair within the threshold."""
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 7, 30, 127, 128, 160, 300, 1000):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        drop = len(a) // 8
        b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**63, drop, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        doc = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
        ent, key, of, level, t = ngram_join.sketch_lanes(doc, np.concatenate([a, b]), np.array([len(a), len(b)]))
        agree = {}
        for e1 in np.flatnonzero(of == 0):
            for e2 in np.flatnonzero((of == 1) & (level == level[e1])):
                agree[level[e1]] = (len(np.intersect1d(key[ent == e1], key[ent == e2])), max(t[e1], t[e2]))
        assert agree and any(n >= max(least, 1) for n, least in agree.values())


def test_quality_rules(case):
    docs, rows = case
    out = quality_rules.quality_rules(docs, None).collect()
    want = []
    for d, t in rows:
        c = brute.counts(t)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        want.append((d, *c, failed, not failed, 1.0))
    same(out, want)
    kept = quality_rules.keep_good(docs, None)
    assert kept.columns == docs.columns
    same([(r.doc_id,) for r in kept.collect()], [(w[0],) for w in want if w[-2]])


def test_trees_are_monotone_and_separate_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    trees = quality_rules.fit(docs, labels)
    out = {r.doc_id: r for r in quality_rules.quality_rules(docs, trees).collect()}
    held = [(out[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(o.score >= 0.3) == (q == 1) for o, q in held]) > 0.95
    r = np.random.default_rng(2)
    x = r.random((300, len(quality_rules.FEATURES)))
    for j in np.flatnonzero(quality_rules.MONOTONE):
        y = x.copy()
        y[:, j] += r.random(300)
        assert (quality_rules.MONOTONE[j] * (trees.margin(y) - trees.margin(x)) >= -1e-9).all()


def test_empty_tables(spark, odd, sf_dir):
    docs = odd[0].limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    from tessera.llm.queries import word_bpe_path

    for out in (
        pii.digest(pii.find_pii(docs)), substring_dedup.dedup_digest(docs), decontaminate.digest(decontaminate.contamination(docs, bench)), bpe.digest_documents(docs, word_bpe_path()),
        sharding.extendible_shards(docs), quality_mil.score(docs, quality_mil.fit(docs, labels)), line_dedup.dedup_digest(docs), line_dedup.dedup_documents(docs), licenses.scan_licenses(docs),
        ngram_join.components(docs), quality_rules.quality_rules(docs, quality_rules.fit(docs, labels)), ngram_join.keep_one(docs),
    ):
        assert out.count() == 0
    assert os.path.isdir(sf_dir)
