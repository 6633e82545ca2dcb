"""Near-duplicate classes against brute force on large buckets."""

import random
import zlib

import numpy as np
import pyarrow as pa

from assetlake.llm import near_dedup
from assetlake.llm.grams import text_buffers


def _classes(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def _found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return [r.class_id for r in near_dedup.near_duplicates(rows).orderBy("doc_id").collect()]


def _sets(texts, idf):
    data, offsets = text_buffers(pa.array(texts))
    found, counts, sizes = near_dedup.features(data, offsets)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    w = near_dedup.weights(found, counts, idf)
    return [(found[a:b], w[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], near_dedup.bands(data, offsets, idf)[0]


def _by_brute_force(spark, texts):
    """Components of all similar pairs that share a band."""
    idf = near_dedup.inverse_frequencies(*near_dedup.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string")))
    sets, keys = _sets(texts, idf)
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if (keys[a] == keys[b]).any() and near_dedup.similarity(sets[a], sets[b]) >= near_dedup.THRESHOLD]
    return _classes(len(texts), pairs)


def _drifting(n=400, seed=3):
    """Versions that share a passage; each changes some words of the one before, the last of a run more."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(50)]
    own, out = [f"o{i}" for i in range(50)], []
    for i in range(n):
        for _ in range(1 if i % 9 else 4):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**9)}"
        out.append(" ".join(passage + own))
    rng.shuffle(out)
    return out


def test_a_drifting_chain(spark):
    texts = _drifting()
    want = _by_brute_force(spark, texts)
    assert 1 < len(set(want)) < len(texts) and _found(spark, texts) == want


def test_a_bucket_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 15)
    texts = _drifting(250, 4)
    assert _found(spark, texts) == _by_brute_force(spark, texts)


def test_merged_is_brute_force():
    texts = _drifting(200, 5)
    sets, _ = _sets(texts, np.ones(near_dedup.DF_BUCKETS, np.float32))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if near_dedup.similarity(sets[a], sets[b]) >= 0.8]
    given = [(x, x - x % 2) for x in range(40)]
    labels = _classes(len(texts), given)
    groups = near_dedup.merged(np.concatenate([s for s, _ in sets]), np.concatenate([w for _, w in sets]), np.array([len(s) for s, _ in sets]), labels, 0.8)
    least = {label: min(g) for g in groups for label in g}
    assert [least.get(x, x) for x in labels] == _classes(len(texts), pairs + given)


def _crafted(shared):
    """In place of near_dedup.bands: keys of a text's own, but in the shared bands one of all texts."""

    def bands(data, offsets, idf):
        sizes = near_dedup.features(data, offsets)[2]
        own = [zlib.crc32(bytes(data[a:b])) for a, b in zip(offsets[:-1], offsets[1:])]
        keys = np.array([[x + (k << 40) for k in range(near_dedup.BANDS)] for x in own], np.uint64).reshape(-1, near_dedup.BANDS)
        keys[:, shared] = 5
        return keys, sizes

    return bands


def test_links_between_texts_that_matched_a_head(spark, monkeypatch):
    """A chain of 60 texts in the same buckets: each is similar to the next, and to no other."""
    texts = [" ".join(f"w{j}" for j in range(4 * i, 4 * i + 60)) for i in range(60)]
    monkeypatch.setattr(near_dedup, "bands", _crafted([2, 7, 11]))
    assert _found(spark, texts) == [0] * 60


def test_a_pair_that_shares_large_buckets_only(spark, monkeypatch):
    """60 texts share exactly bands 2 and 7; two of them are similar."""
    texts = [" ".join(f"t{i}w{j}" for j in range(40)) for i in range(59)]
    texts.append(texts[17] + " end")
    monkeypatch.setattr(near_dedup, "bands", _crafted([2, 7]))
    assert _found(spark, texts) == list(range(59)) + [17]
