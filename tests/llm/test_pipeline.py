from collections import Counter, defaultdict

from brute import near, words


def test_stages_by_brute_force(spark, small):
    """Every stage on what the one before kept."""
    import corpus_pipeline

    from quadrille.llm import toxicity
    from quadrille.llm._common import cut

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, small))
        seen.append(out.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = out
    start, clean, distinct, far, mixed, packed = seen
    bad = {r["doc_id"] for r in toxicity.toxicity(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")).where("predicted = 1").collect()}
    assert Counter(clean) == Counter(r for r in start if r["doc_id"] not in bad)
    best = {}
    for r in clean:
        if r["text"] not in best or r["doc_id"] > best[r["text"]]["doc_id"]:
            best[r["text"]] = r
    assert Counter(distinct) == Counter(best.values())
    groups = near([(r["doc_id"], r["text"]) for r in distinct], 5, 80)
    assert Counter(far) == Counter(r for r in distinct if groups[r["doc_id"]][1] == r["doc_id"])
    copies = Counter(mixed)
    assert set(copies) <= set(far) and max(copies.values()) <= 2
    total, taken = sum(len(words(r["text"])) for r in far), sum(len(words(r["text"])) * n for r, n in copies.items())
    assert abs(taken - 1.5 * total) <= 0.03 * total
    pieces = defaultdict(int)
    for r in packed:
        pieces[r["doc_id"]] += r["length"]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in packed}
    assert pieces == {r["doc_id"]: tokens[r["doc_id"]] * n for r, n in Counter({r: n for r, n in copies.items()}).items()}


def test_run_is_the_stages(spark, small):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_on_odd_rows_and_none(spark, small, odd, none):
    """Nulls, empty and long texts, repeated rows and clashing columns go through all stages; no documents give none."""
    import corpus_pipeline

    from quadrille.llm._common import cut

    for start in (odd, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, docs, small))
            assert name == "packing" or out.columns == start.columns
            before, docs = docs, out
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= {r["doc_id"] for r in start.select("doc_id").collect()} and (start is odd or docs.count() == 0)
        assert docs.agg({"length": "sum"}).first()[0] == docs.where("start = 0").agg({"doc_tokens": "sum"}).first()[0]
        assert before.count() == docs.where("start = 0").count()
