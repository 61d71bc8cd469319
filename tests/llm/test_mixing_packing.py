import zlib
from collections import defaultdict

import numpy as np
import pytest
from brute import words
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import mixing, packing


def corpus(spark, n=600):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        source = [None, "a", "b", "c", "hot", "hot", "hot", "tiny"][rng.integers(0, 8)]
        size = int(rng.pareto(1.5) * 20) if source != "tiny" else 3
        rows.append((i, " ".join(["w"] * size), source))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def filled(sizes, share=1.5):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over


def test_targets_and_rounding(spark):
    rows, docs = corpus(spark)
    got = mixing.mix(docs).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(words(t))
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
    expected = filled(sizes)
    for r in got:
        assert r["target"] == pytest.approx(expected[r["source"]])
    for s, t in expected.items():
        assert abs(taken[s] - t) <= max(2, 0.01 * t)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)  # reruns agree
    assert sum(r["copies"] for r in got) == mixing.mix_rows(docs).count()


@pytest.mark.parametrize("eps", [mixing.EPS, 0.05])
def test_rounding_by_definition(spark, monkeypatch, eps):
    """Copies from the rates, document by document: large ones absorb the error in order of size, the rest go by one sorted list."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "EPS", eps)
    monkeypatch.setattr(mixing, "BINS", 16)
    _, docs = corpus(spark, 900)
    u = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id").cast("string"), "text"), F.lit(1 << 40)) / float(1 << 40)).collect()}
    by = defaultdict(list)
    for r in mixing.mix(docs).collect():
        by[r["source"]].append(r)
    for xs in by.values():
        total, error, expected = xs[0]["source_size"], 0.0, {}
        large = [r for r in xs if r["size"] and r["size"] * 2 > total * eps]
        for r in sorted(large, key=lambda r: (-r["size"], u[r["doc_id"]], r["doc_id"])):
            want = error + r["rate"] * r["size"]
            expected[r["doc_id"]] = int(min(2, max(0, np.floor(want / r["size"] + 0.5))))
            error = want - expected[r["doc_id"]] * r["size"]
        rest = [r for r in xs if r["doc_id"] not in expected]
        need = round(sum(r["rate"] * r["size"] for r in rest) + error - sum(int(r["rate"]) * r["size"] for r in rest), 3)
        for r in rest:
            expected[r["doc_id"]] = int(r["rate"])
        choice, so_far = sorted((u[r["doc_id"]] - r["rate"] % 1, r["doc_id"], r["size"]) for r in rest if r["size"] and r["rate"] < 2 and r["rate"] % 1), 0
        for _, i, size in choice:
            so_far += size
            expected[i] += need > 0 and so_far - size / 2 <= need
        assert {r["doc_id"]: r["copies"] for r in xs} == expected


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(1)
    sizes = {f"s{i:04d}": int(rng.pareto(0.7) * 50) for i in range(700)} | {None: 10**6, "": 0}
    df = spark.createDataFrame(list(sizes.items()), "src string, S long").repartition(5)
    got = {r["src"]: r["T"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


def test_rates_are_tilted(spark):
    """Rates solve the dual: min(2, exp(lambda size)) with one lambda a source, and meet the target before rounding."""
    rows, docs = corpus(spark)
    by = defaultdict(list)
    for r in mixing.mix(docs).collect():
        by[r["source"]].append((r["size"], r["rate"], r["target"]))
    for xs in by.values():
        assert sum(n * r for n, r, _ in xs) == pytest.approx(xs[0][2], rel=1e-5)
        slopes = [np.log(r) / n for n, r, _ in xs if n and 0.01 < r < 1.999]
        assert not slopes or max(slopes) == pytest.approx(min(slopes), rel=1e-3, abs=1e-6)


def test_thresholds_of_small_documents(spark):
    """Many small documents: the threshold's bin and its prefix decide, not the large ones' feedback."""
    docs = spark.range(30000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "if(id % 3 = 0, 'x', 'y') as source")
    got = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "first"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["first(target)"]) <= 8


def test_mix_odd_rows(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 9 and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mix_rows(none).count() == 0
    assert mixing.mix_rows(odd).columns == odd.columns
    assert mixing.mix(odd.where("text is null")).agg({"taken": "sum"}).first()[0] == 0


# ---- packing


@pytest.fixture(scope="module")
def tokens():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


TEXTS = ["", "Hello, world! It's 2020.\n\n  Two  spaces\t", "naïve café Ünïcode \U0001f600 日本語", "<|endoftext|> inside", "x" * 3000, "a. " * 4000, " lead", "trail ", "\r\n\x0b\x0c  ", "don't you'll we've I'm he'd they're", "a" + " " * 300_000 + "b\n" * 5 + "\t" * 2000, "9" * 50_000, "%$#" * 20_000]


def test_ids_equal_the_tokenizers(tokens):
    encoder = packing.Encoder(None)
    for t in TEXTS:
        assert encoder.ids(t).tolist() == tokens(t)


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_ids_of_any_text(t):
    public = pytest.importorskip("public_tokenizers")
    if not hasattr(test_ids_of_any_text, "both"):
        from tokenizers import Tokenizer

        test_ids_of_any_text.both = packing.Encoder(None), Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    fast, slow = test_ids_of_any_text.both
    assert fast.ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_round_trip(spark, tokens, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")).repartition(2)
    monkeypatch.setattr(packing, "BLOCK", 6000)  # many blocks
    rows = packing.packing(docs).collect()
    ids = {r["doc_id"]: np.array([*tokens(r["text"]), 1], dtype="<u4") for r in docs.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids.keys()
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d]) and r["ids_crc32"] == zlib.crc32(ids[d][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[d])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.02 * sum(map(len, ids.values()))


def best_cost(places, penalties):
    """The recurrence without a queue."""
    p, f = [0, *places], [0]
    for j in range(1, len(p)):
        costs = [f[i] + (0 if (n := p[j] - p[i]) & (n - 1) == 0 else packing.SIZE - n) for i in range(j) if p[j] - p[i] <= packing.SIZE]
        f.append(min(costs) + penalties[j - 1] + packing.ONE)
    return f[-1]


@given(st.lists(st.tuples(st.integers(1, 900), st.sampled_from([0, 2, 24])), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_windows_are_optimal(steps):
    places = np.cumsum([s for s, _ in steps])
    penalties = np.array([p for _, p in steps])
    cuts = packing.pack(places, penalties)
    at = {int(x): int(p) for x, p in zip(places, penalties, strict=True)}
    lengths = np.diff([0, *cuts])
    assert cuts[-1] == places[-1] and lengths.max() <= packing.SIZE
    cost = sum((0 if n & (n - 1) == 0 else packing.SIZE - n) + packing.ONE for n in lengths.tolist()) + sum(at[c] for c in cuts)
    assert cost == best_cost(places.tolist(), penalties.tolist())


def test_pack_odd_rows(odd, none):
    rows = packing.packing(odd).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] in (1, 2)) == 2 and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.packing(none).count() == 0
