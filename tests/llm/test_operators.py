"""The operators on a small awkward table: nulls, empty and repeated rows, clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assetlake.llm import decontamination, language_id, license_scan, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, token_output, toxicity
from assetlake.llm.scratch import written

PROSE = "the quick brown fox jumps over the lazy dog and runs to the river of that old town in the green valley for a drink of water"
ROWS = [
    (0, PROSE, "en"), (1, PROSE + " again", "en"), (2, None, None), (3, "", "en"), (4, PROSE, "en"), (4, PROSE, "en"), (None, "no id here", None), (6, "x", "de"),
    (7, "Released under the MIT License. " + PROSE[::-1], "de"), (8, "y " * 9000, "de"), (9, "1 2 3 ... !", "fr"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return written(spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("theirs") for c in ("score", "kept", "leaks", "n_words", "chunk", "key", "perplexity")}), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return written(spark.createDataFrame([], SCHEMA), "empty")


def test_licenses(docs, empty):
    got = {r.doc_id: [x.license for x in r.licenses] for r in license_scan.scan_licenses(docs).collect()}
    assert got[7] == ["MIT"] and got[2] == got[3] == got[0] == []
    assert license_scan.scan_licenses(empty).count() == 0


def test_toxicity_without_and_with_labels(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    many = spark.createDataFrame([(i, PROSE + (" idiot scum" if i % 2 else " friend peace"), "en") for i in range(40)], SCHEMA)
    fitted = toxicity.fit(many, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(many.union(spark.createDataFrame([(99, None, None)], SCHEMA)), fitted).collect()}
    assert got[1].score > got[0].score and 0 <= got[99].score <= 1
    assert toxicity.fit(empty, labels) is None
    assert toxicity.toxicity(docs, None).filter("score = 0").count() == len(ROWS)


def test_language(docs, empty):
    fitted = language_id.fit(docs.select("text", "lang"))
    got = language_id.identify(docs, fitted).collect()
    assert len(got) == len(ROWS) and {r.lang_pred for r in got if r.doc_id in (2, 3, 9)} == {"und"}
    assert language_id.fit(empty) is None and language_id.identify(docs, None).filter("lang_pred = 'und'").count() == len(ROWS)


def test_quality_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert got[0].kept and not got[2].kept and got[2].n_words == 0 and got[8].base_failed
    assert quality_rules.quality_rules(empty).count() == 0


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(5, PROSE), (6, "tiny"), (7, None)], "item_id long, text string")
    got = {r.doc_id: [x.item for x in r.leaks] for r in decontamination.find_leaks(docs, bench).collect()}
    assert got[0] == got[1] == got[4] == [5] and got[2] == got[3] == got[8] == []
    assert decontamination.find_leaks(empty, bench).count() == 0
    assert decontamination.find_leaks(docs, bench.limit(0)).filter("size(leaks) > 0").count() == 0


def test_near_duplicates(docs, empty):
    got = near_dedup.near_duplicates(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.class_id, r.class_size))
    assert len(got) == len(ROWS)
    assert by[0] == by[1] == by[4] == {(0, 4)} and by[2] == {(2, 1)} and by[6] == {(6, 1)}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_lm_scores(docs, empty):
    got = lm_scoring.lm_scores(docs.select("doc_id", "text"), F.col("doc_id") < 5).collect()
    assert len(got) == len(ROWS)
    one = {r.doc_id: r for r in got}
    assert one[2].n_tokens == one[3].n_tokens == 1 and one[2].score == one[3].score < 0 and one[0].score / 120 > one[7].score / 120
    assert lm_scoring.lm_scores(empty, F.lit(True)).count() == 0
    assert lm_scoring.lm_scores(docs.select("doc_id", "text"), F.lit(False)).filter("n_known = 0").count() == len(ROWS)


def test_quality_classifier(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (1, 1), (4, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.quality_classifier(docs, labels).collect()
    assert len(got) == len(ROWS) and not any(r.keep for r in got if r.doc_id in (2, 3))
    assert quality_classifier.quality_classifier(empty, labels).count() == 0
    assert quality_classifier.quality_classifier(docs, labels.limit(0)).filter("keep").count() == len(ROWS) - 2


def test_packing_covers_every_id(docs, empty):
    got = packing.pack(docs.select("doc_id", "text"), capacity=64).collect()
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 64 and sorted(fill) == list(range(len(fill)))
    assert sum(r.length for r in got if r.doc_id == 8) == 9001 and sum(r.length for r in got if r.doc_id == 2) == 1
    assert packing.pack(empty).count() == 0


def test_tokenizers_of_another_form_get_whole_texts():
    import public_tokenizers

    said = ["It's  two\n\nlines, \u00c9T\u00c9 12,345!", "", PROSE]
    for name, divisible in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        own, plain = packing.TokenIds(path), Tokenizer.from_file(path)
        assert own.divisible is divisible
        assert [x.tolist() for x in own(said)] == [[*plain.encode(s, add_special_tokens=False).ids, packing.END_ID] for s in said]


def test_binary_output_round_trip(docs, empty, tmp_path):
    made = token_output.token_sequences(docs, capacity=64, block_tokens=500)
    sequences = token_output.write_sequences(made, str(tmp_path / "matrices"))
    assert sequences.schema == made.schema and sequences.count() == made.count()
    assert sequences.filter("octet_length(input_ids) != 4 * n_tokens OR n_tokens > 64 OR octet_length(position_ids) != 4 * n_tokens").count() == 0
    parts = sorted(((r.doc_id if r.doc_id is not None else -1, r.start, bytes(r.input_ids)) for r in token_output.unpack(sequences).collect() if r.doc_id != 4))
    whole = {}
    for i, _, x in parts:
        whole[i] = whole.get(i, b"") + x
    plain = Tokenizer.from_file(packing.default_tokenizer())
    for i, text, _ in ROWS:
        if i != 4:
            ids = [*plain.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
            assert np.frombuffer(whole[-1 if i is None else i], "<u4").tolist() == ids, i
    for r in sequences.collect():
        bounds, places = np.frombuffer(r.cu_seqlens, "<i4"), np.frombuffer(r.position_ids, "<i4")
        assert bounds[0] == 0 and bounds[-1] == r.n_tokens and len(bounds) == len(r.doc_ids) + 1 and (np.diff(bounds) > 0).all()
        assert places.tolist() == [p for n in np.diff(bounds) for p in range(n)]
    assert token_output.token_sequences(empty).count() == 0


def test_token_ids_are_those_of_the_tokenizer(docs):
    whole = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.token_ids(packing.default_tokenizer())
    texts = [t or "" for _, t, _ in ROWS] + ["  two  spaces\n\tand tabs ", "naïve café 12,5 % — “x”", "a" * 3000, "日本語 text"]
    for text, got in zip(texts, encode(texts)):
        assert got.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2], text


def test_short_items_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(12))) for _ in range(120)] + [None, "A b  C\nd"]
    items = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(5))) for _ in range(25)] + [None, "a b", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, x.item) for r in decontamination.find_leaks(docs, bench).collect() for x in r.leaks}
    inside = lambda t, i: any(t[k : k + len(i)] == i for k in range(len(t) - len(i) + 1))
    split = lambda x: (x or "").lower().split()
    assert got == {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if split(x) and inside(split(t), split(x))}


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    spark.createDataFrame([(1, PROSE[::-1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1), (1, 1), (4, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    theirs = ("pattern", "kept", "quality", "keep", "leaks", "perplexity", "threshold", "rep_id", "rep_key", "near_dedup_key", "a.b", "key", "chunk")
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("theirs") for c in theirs})
    stages = (quality_rules.stage_quality_rules, quality_classifier.stage_quality_classifier, near_dedup.stage_near_dedup, decontamination.stage_decontamination)
    for stage in stages:
        for table, name in ((docs, "some"), (docs.limit(0), "none")):
            before = written(table, name)
            after = stage(spark, before, str(tmp_path))
            rows = after.collect()
            assert after.columns == before.columns and len(rows) <= len(ROWS) * (name == "some"), stage
            assert all(r[c] == "theirs" for r in rows for c in theirs), stage
            if name == "some":
                ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in rows)
                assert 0 in ids and (stage is not near_dedup.stage_near_dedup or (1 not in ids and 4 not in ids and 2 in ids)), (stage, ids)
