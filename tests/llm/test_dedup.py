import random

import numpy as np
import pyarrow as pa
import pytest
from brute import near, repeats, shingles
from pyspark.sql import functions as F

from quadrille.llm import exact_dedup, minhash, suffixdedup
from quadrille.llm.components import components


def texts(n, seed, vocabulary=60):
    """Documents with exact copies, near copies of several grades, and a passage that many share."""
    r = random.Random(seed)
    make = lambda k: [f"w{r.randrange(vocabulary)}" + "x" * r.randrange(4) for _ in range(k)]
    passage, out = make(40), []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.15:
            t = r.choice(out)
        elif out and kind < 0.55:
            w = r.choice(out).split(" ")
            for _ in range(r.randrange(1, 6)):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            t = " ".join(w)
        else:
            w = make(r.randrange(1, 120))
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w[at:at] = passage
            t = " ".join(w)
        out.append(t)
    return [(i * 7 % n if n % 7 else i, t) for i, t in enumerate(out)]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


# ---- exact copies


def test_collisions_are_told_apart(spark):
    docs = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "b"), (7, "c")]
    for hash_of in (exact_dedup._md5, lambda t: F.lit(b"same"), lambda t: F.unhex(F.hex(F.length(t)))):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(frame(spark, docs), hash_of=hash_of).collect()}
        assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (6, 2, False), 6: (6, 2, True), 4: (5, 2, False), 5: (5, 2, True), 7: (7, 1, True)}
    low = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(frame(spark, docs), keep="min").collect()}
    assert low == {1: 1, 3: 1, 2: 2, 6: 2, 4: 4, 5: 4, 7: 7}


def test_exact_odd_rows(odd, none):
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == 9 and sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in rows)[:3] == [(0, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True)]
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_exact_copies(none).count() == 0
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 6, 7]


def test_exact_rows_keep_null_texts(spark):
    assert exact_dedup.drop_exact_copies(frame(spark, [(1, None)])).collect()[0]["text"] is None


# ---- near copies


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 2, 80), (2, 5, 80), (3, 1, 60)])
def test_near_by_definition(spark, seed, width, percent):
    docs = texts(150, seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, docs), width=width, percent=percent).collect()}
    assert got == near(docs, width, percent)


def test_near_group_beyond_its_leader(spark):
    """A chain whose ends aren't alike, and many far variants of one text: components need more than the leader's links."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    docs = []
    for i in range(120):
        w = list(base)
        for k in r.sample(range(100), r.choice([2, 6, 10, 12])):
            w[k] = f"z{i}_{k}"
        docs.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, docs), width=1).collect()}
    assert got == {i: c for i, (_, c) in near(docs, 1).items()}


def test_near_blocks_of_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "COUNTERS", 64)  # frequencies that tell little
    test_near_group_beyond_its_leader(spark)


def test_near_texts_around_a_passage(spark, monkeypatch):
    """Texts that are mostly one passage, at similarities just below and above the threshold, with rests that sometimes overlap."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "LARGE", 8)
    r = random.Random(9)
    passage = [f"p{i}" for i in range(80)]
    docs = []
    for i in range(160):
        rest = [f"r{r.randrange(6)}_{k}" if r.random() < 0.3 else f"x{i}_{k}" for k in range(r.choice([2, 8, 12, 16, 20]))]
        w = list(passage)
        for k in r.sample(range(80), r.choice([0, 0, 1, 3])):
            w[k] = f"y{i}_{k}"
        docs.append((i, " ".join(w + rest)))
    expected = near(docs, 1)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(frame(spark, docs), width=1).collect()}
    assert got == {i: c for i, (_, c) in expected.items()} and 3 < len(set(got.values())) < 150


@pytest.mark.parametrize("percent", [50, 60, 75, 80, 90, 100])
def test_prefixes_and_bands(percent):
    bands, rows = minhash.banding(percent / 100)
    assert (1 - min(percent / 100, 0.999999) ** rows) ** bands <= minhash.LOST and (percent != 80 or (bands, rows) == (40, 5))
    r = random.Random(percent)
    for _ in range(3000):  # similar sets share a shingle of their prefixes, in any order
        base = set(r.sample(range(60), r.randrange(1, 30)))
        other = {x for x in base if r.random() < 0.9} | set(r.sample(range(60), r.randrange(3)))
        if other and 100 * len(base & other) >= percent * len(base | other):
            firsts = [set(sorted(x)[: minhash.prefix_length(len(x), percent)]) for x in (base, other)]
            assert firsts[0] & firsts[1]


def test_near_odd_rows(odd, none):
    rows = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd, width=2).collect()}
    assert rows[None, 0] == (None, True) and rows[1, 0] == (1, True) and rows[3, 0] == (3, True) and rows[4, 1] == (4, True) and rows[5, 1] == (4, False) and rows[7, 2] == (7, True)
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_near_copies(none).count() == 0
    kept = minhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 6, 7]


def test_shingle_sets():
    t = ["A b\tC", "a B c", "one", "", "  x\ny  ", "É é", "a b a b a b"]
    for width in (1, 2, 3, 5):
        sets = list(minhash.shingle_sets(pa.array(t), width))
        assert [len(s) for s in sets] == [len(shingles(x, width)) for x in t] and (sets[0] == sets[1]).all()
    assert not set(next(minhash.shingle_sets(pa.array(["a b"]), 5)).tolist()) & set(next(minhash.shingle_sets(pa.array(["b a"]), 5)).tolist())


def test_sequential_limits():
    limits = minhash.least_equal(0.8, 200)
    assert [n for n, _ in limits] == [40, 80, 120, 160, 200] and all(0 < m < 0.8 * n for n, m in limits)


def test_components(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(5, 3), (3, 9), (100, 7), (7, 100), (50, 50)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(10, 41), 10) | {3: 3, 5: 3, 9: 3, 7: 7, 100: 7, 50: 50}


# ---- repeated passages


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_by_definition(spark, seed, monkeypatch):
    monkeypatch.setattr(suffixdedup, "ANCHOR_BYTES", 4096)  # several partitions of both kinds
    monkeypatch.setattr(suffixdedup, "TEXT_BYTES", 4096)
    docs = texts(90, seed) + [(500, "ab" * 200), (501, "ab" * 60), (502, "é" * 40), (503, "é" * 30 + "x"), (504, "q" * 49), (505, "q" * 50), (506, "q" * 51)]
    rows = suffixdedup.repeated_passages(frame(spark, docs)).collect()
    assert sorted(tuple(r) for r in rows) == repeats(docs)


def test_repeats_same_id_and_odd_rows(spark, odd, none):
    passage = "0123456789" * 6
    docs = [(3, passage), (3, "x" + passage), (1, "short"), (9, passage + "tail"), (2, None)]
    assert sorted(tuple(r) for r in suffixdedup.repeated_passages(frame(spark, docs)).collect()) == repeats(docs)
    assert suffixdedup.repeated_passages(odd).count() == 9 and suffixdedup.repeated_passages(none).count() == 0
    late = suffixdedup.repeated_passages(spark.createDataFrame([(None, passage), (8, passage)], "doc_id long, text string"), carry_bytes=True).collect()
    assert {(r["doc_id"], r["n_removed"], bytes(r["kept_bytes"])) for r in late} == {(None, 60, b""), (8, 0, passage.encode())}


def test_deep_shallow_order():
    r = np.random.default_rng(3)
    for width in (5, 24, 42):
        rows = r.integers(97, 99, (400, width)).astype(np.uint8)
        rows[:, : width // 2] = 97  # long common prefixes
        rows[200:] = rows[r.integers(0, 200, 200)]  # and ties
        order = suffixdedup.deep_shallow(rows)
        assert sorted(order.tolist()) == list(range(400)) and [rows[i].tobytes() for i in order] == sorted(x.tobytes() for x in rows)


def test_blind_trie():
    strings = sorted({bytes(np.random.default_rng(i).integers(0, 3, 12).astype(np.uint8)) for i in range(200)})
    trie = suffixdedup.BlindTrie(strings[57])
    for i, s in enumerate(strings):
        if i != 57:
            trie.insert(s)
    assert list(trie.sorted()) == strings


def test_bucket_is_sparks(spark):
    import zlib

    rows = [(i, t) for i in (0, 1, -5, 10**12, 2**63 - 1) for t in ("", "é text", "x" * 1000)]
    there = [r[0] for r in spark.createDataFrame(rows, "id long, t string").select(F.pmod(F.xxhash64("id").bitwiseXOR(F.crc32(F.col("t").cast("binary"))), F.lit(17))).collect()]
    checks = np.array([zlib.crc32(t.encode()) for _, t in rows], dtype=np.uint32)
    assert suffixdedup.bucket_of(np.array([i for i, _ in rows], dtype=np.int64), checks, 17).tolist() == there
    data = np.random.default_rng(2).integers(0, 256, 400).astype(np.uint8)
    hashes, at = suffixdedup.anchors(data, np.array([0, 400]))
    assert len(at) and suffixdedup.gram_hash(np.stack([data[i : i + suffixdedup.GRAM] for i in at])).tolist() == hashes.tolist()


@pytest.mark.parametrize("hot", [1, 3, 10**9])
def test_repeats_of_hot_anchors(spark, monkeypatch, hot):
    """A passage at other places, between other words, in most documents; many null ids and one id for many texts. Whether anchors count as hot changes nothing."""
    monkeypatch.setattr(suffixdedup, "ANCHOR_BYTES", 4096)
    monkeypatch.setattr(suffixdedup, "TEXT_BYTES", 4096)
    monkeypatch.setattr(suffixdedup, "HELD", 300)
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    r = random.Random(1)
    passage = "a passage that stands in most of the documents, word by word, since it is a notice."
    some = lambda: " ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(12)))
    docs = [(i, f"{some()} {passage} {some()}") for i in range(150)] + [(7, f"{some()} {passage}") for _ in range(40)]
    assert sorted(tuple(x) for x in suffixdedup.repeated_passages(frame(spark, docs)).collect()) == repeats(docs)
    nulls = docs + [(None, f"{some()} {passage} {some()}") for _ in range(120)]
    got = sorted(tuple(x)[1:] for x in suffixdedup.repeated_passages(frame(spark, nulls)).collect())
    assert got == sorted(x[1:] for x in repeats([(10**9 if i is None else i, t) for i, t in nulls]))
