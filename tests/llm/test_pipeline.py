"""The pipeline's stages against brute force on the smallest tables."""

import corpus_pipeline
from assetlake.llm import packing
from assetlake.llm.scratch import written

DATA = "/root/testdata/sf0.001"


def _shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages(spark):
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, DATA), name)
        seen[name] = (before.toPandas(), docs.toPandas())
        if name != "packing":
            assert docs.columns == before.columns
            assert set(seen[name][1].doc_id) <= set(seen[name][0].doc_id)
    before, after = seen["quality_rules"]
    gone = before[~before.doc_id.isin(after.doc_id)]
    assert all(len(t.split()) >= 10 for t in after.text) and len(after) > 0.7 * len(before) and len(gone)

    before, after = seen["quality_classifier"]
    assert len(after) > 0.9 * len(before)

    before, after = seen["near_dedup"]
    sets = {r.doc_id: _shingles(r.text) for r in before.itertuples()}
    kept = sorted(after.doc_id)
    pairs = [(a, b) for i, a in enumerate(kept) for b in kept[i + 1 :] if sets[a] and len(sets[a] & sets[b]) > 0.85 * len(sets[a] | sets[b])]
    assert not pairs
    for r in before[~before.doc_id.isin(kept)].itertuples():
        assert any(len(sets[r.doc_id] & sets[k]) >= 0.6 * len(sets[r.doc_id] | sets[k]) for k in sets if k != r.doc_id)

    before, after = seen["benchmark_decontamination"]
    items = [_shingles(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas().itertuples()]
    dirty = {r.doc_id for r in before.itertuples() if any(x and len(x & _shingles(r.text)) >= 0.8 * len(x) for x in items)}
    assert set(before.doc_id) - set(after.doc_id) == dirty

    before, after = seen["packing"]
    encode = packing.token_ids(packing.default_tokenizer())
    assert after.length.sum() == sum(len(x) for x in encode(before.text.tolist()))
    assert after.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
