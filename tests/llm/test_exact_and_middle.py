"""Exact deduplication and fill-in-the-middle against brute force, on odd rows too."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import exact_dedup, fill_middle
from tests.llm import brute

LONG = "Line of a very long text\n" * 20_000


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def odd_rows():
    r = random.Random(11)
    texts = ["Same Text\nhere", "same text\nHERE", "other", None, "", "", "É", "é", "a\n\n\nb\n", "\n", "\r\n x", "<P> in it", "ends <M", "<S" * 3, LONG, LONG.upper(), LONG + "x"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, f"copy {i % 3}\nsecond line\nthird") for i in range(300)]  # hot groups
    rows += [(None, "no id")] * 40 + [(None, "Other")] + [(77, "twice\nthe row")] * 3 + [(76, "twice\nthe row")]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, 1, b"s", 2, 3, "n", 4) for d, t in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, key long, sha binary, n int, p int, form string, __id int").repartition(5)


def groups(rows):
    out = {}
    for d, t in rows:
        out.setdefault(lowered(t), []).append(d)
    return out


@pytest.mark.parametrize(("bits", "limit"), [(64, 8 << 20), (64, 100), (3, 1), (1, 8 << 20)])
def test_exact_dedup_of_odd_rows(odd, bits, limit):
    """Full keys, and keys of few bits: all texts collide in chains that only their bytes tell apart."""
    held, got = groups(odd_rows()), {}
    for r in exact_dedup.mark(odd, limit, bits).collect():
        got.setdefault(r.text_sha256, []).append(r)
    assert sorted(got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in held)
    for t, ids in held.items():
        rows = got[hashlib.sha256(t.encode()).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, ids))
        assert {(r.keep_id, r.group_size) for r in rows} == {(keep, len(ids))}
        assert [r.doc_id for r in rows if r.kept] == [keep]  # exactly one row


@pytest.mark.parametrize("bits", [64, 2])
def test_dropped_duplicates_keep_their_columns(odd, bits):
    kept = exact_dedup.drop_duplicates(odd, bits=bits)
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    want = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups(odd_rows()).items()}
    rows = kept.collect()
    assert len(rows) == len(want) and {lowered(r.text): r.doc_id for r in rows} == want
    assert all(tuple(r)[2:] == (1, bytearray(b"s"), 2, 3, "n", 4) for r in rows)


def test_directory_doubles_and_only_overfull_buckets_split():
    sizes = np.zeros(1 << 6)
    sizes[[0, 1, 2, 40]] = [5, 5, 5, 7]
    slots, depth = exact_dedup.directory(sizes, 10)
    g = len(slots).bit_length() - 1
    held = {}
    for prefix, size in enumerate(sizes):
        bucket = slots[prefix >> (6 - g)]
        held[bucket] = held.get(bucket, 0) + size
    assert max(held.values()) <= 10 and g == 5
    assert sorted(depth.tolist()) == [1, 2, 3, 4, 5, 5]
    assert sum(2.0**-d for d in depth) == 1 and (np.diff(slots) >= 0).all()  # buckets are ranges of keys
    assert exact_dedup.directory(sizes, 100)[1].tolist() == [0]
    one = np.zeros(1 << 6)
    one[9] = 100
    assert len(exact_dedup.directory(one, 10)[0]) == 1 << 6  # one key cannot split: the bits end


def test_index_files_hold_ordered_chains(odd):
    index = exact_dedup.ExactIndex(odd, 100, 2)
    rows = index.entries.collect()
    assert max(r.link for r in rows) > 0 and min(r.n for r in rows) > 1
    for r in rows:
        assert r.bucket == exact_dedup.bucket_of(index.slots, np.array([r.key], np.int64).view(np.uint64))[0]


def middle(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("seed", "rate", "spm"), [(7, 100, 50), (3, 60, 20)])
def test_middle_of_odd_rows(odd, seed, rate, spm):
    made = fill_middle.fill_in_middle(odd, seed, rate, spm)
    own = ["fim_form", "fim_units", "fim_prefix_chars", "fim_middle_chars", "fim_text"]
    assert made.columns == odd.columns + own
    rows = made.collect()
    got = sorted(((r.doc_id, r.text, r.fim_units, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_text) for r in rows), key=repr)
    assert got == sorted(((d, t, *middle(d, t, seed, rate, spm)) for d, t in odd_rows()), key=repr)
    assert all((r.key, r.n, r.p, r.form, r["__id"]) == (1, 2, 3, "n", 4) for r in rows)


def test_middle_is_restored_from_output_and_form(odd):
    got = sorted((tuple(r) for r in fill_middle.digest(odd).collect()), key=repr)
    want = []
    for d, t in odd_rows():
        n, form, p, m, out = middle(d, t)
        want.append((d, n, form, p, m, brute.sha(out), brute.sha(t or "")))
    assert got == sorted(want, key=repr)


def test_no_rows_and_ids_of_other_types(odd, spark):
    assert exact_dedup.mark(odd.limit(0)).collect() == [] and exact_dedup.drop_duplicates(odd.limit(0)).collect() == []
    assert fill_middle.digest(odd.limit(0)).collect() == []
    for kind, ids in (("string", ("a", "b", None)), ("int", (1, 2, None))):
        rows = [(i, "Some text\nmore") for i in ids]
        docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        assert [r.doc_id for r in exact_dedup.mark(docs).where("kept").collect()] == [ids[1]]
        got = {r.doc_id: r.fim_text for r in fill_middle.fill_in_middle(docs).collect()}
        assert got == {d: middle(d, t)[-1] for d, t in rows}


@pytest.mark.parametrize("kind", ["string", "int"])
def test_ids_of_any_type_in_row_wise_operators(spark, kind):
    """BPE, the classifier and the rules carry ids of their own type through fitting and scoring; 10,000 rows have none."""
    from tessera.llm import bpe, quality_mil, quality_rules
    from tessera.llm.queries import word_bpe_path

    r = random.Random(3)
    text = lambda good: " ".join((f"word{r.randrange(900)}" if good else "# # !!") for _ in range(40))
    rows = [(str(i) if kind == "string" else i, text(i % 2)) for i in range(200)] + [(None, f"row {i}") for i in range(10_000)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    labels = spark.createDataFrame([(d, i % 2) for i, (d, _) in enumerate(rows[:200])], f"doc_id {kind}, quality int")
    made = [bpe.digest_documents(docs, word_bpe_path()), quality_mil.score(docs, quality_mil.fit(docs, labels)), quality_rules.quality_rules(docs, quality_rules.fit(docs, labels))]
    for df in made:
        assert df.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and df.count() == len(rows)
    scores = {x.doc_id: x.score for x in made[1].where("doc_id is not null").collect()}
    assert np.mean([scores[d] > 0.5 for d, _ in rows[1:200:2]]) > 0.9 > np.mean([scores[d] > 0.5 for d, _ in rows[0:200:2]])
