"""Ranked lexical search: shared sums against plain ones, results against the formula in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlake.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t, Counter(t)) for i, t in held if t]
    n_docs, total = len(held), sum(len(t) for _, t, _ in held)
    df = Counter(w for _, _, c in held for w in c)
    out = []
    for item, text in items:
        found = []
        for i, t, c in held:
            m = 50 + 50 * len(t) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_shared_sums(seed):
    rng = np.random.default_rng(seed)
    common = rng.permutation(40)[:12]
    items = [np.unique(np.concatenate([rng.permutation(40)[: rng.integers(0, 15)], common[: rng.integers(0, 12)]])) for _ in range(20)]
    made = S.SharedSums(items, 40)
    cells = rng.random((40, 7)) < 0.5
    term, doc = np.nonzero(cells)
    value = rng.integers(1, 10**12, len(term))
    dense = np.zeros((40, 7), np.int64)
    dense[term, doc] = value
    assert (made.scores(term, doc, value, 7) == np.stack([dense[x].sum(axis=0) for x in items])).all()
    assert sum(map(len, made.nodes)) + len(made.pairs) < sum(map(len, items))  # fewer sums than without sharing


def test_same_items_are_one_class_and_shared_pairs_are_made_once():
    made = S.SharedSums([np.array([0, 1, 2, 3]), np.array([0, 1, 2, 4]), np.array([5, 0, 1])], 6)
    assert made.of_term[0] == made.of_term[1] != made.of_term[2] and made.classes == 5
    assert made.pairs == [tuple(sorted((made.of_term[0], made.of_term[2])))]


def corpus(n=120):
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "ÉTÉ", "x1y2", "中文"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(n)]
    docs += [docs[3], (500, docs[3][1]), (None, docs[4][1]), (501, None), (502, ""), (503, "?! ..."), (504, "W1,w1;w1 " * 9000), (505, "\x00w2\x00W3")]
    items = [(i, " ".join(rng.choices(vocabulary, k=9))) for i in range(12)] + [(3, "w1 w2 W1"), (None, "w5"), (90, None), (91, "..."), (92, "absent")]
    return docs, items


@pytest.mark.parametrize("block_terms", [10**6, 20])
def test_search_against_the_formula(spark, block_terms):
    docs, items = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("theirs") for c in ("score", "rank", "item_id", "item", "group", "terms")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("theirs"))
    got = S.search(table.repartition(5), asked, k=20, block_terms=block_terms).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, 20)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([(1, "one two")], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert S.search(docs.limit(0), items).count() == 0
    assert S.search(docs, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in S.search(docs, items).collect()] == [(1, 1, 1)]


def test_lengths_past_64_bits():
    assert S.length_marks(np.array([10**9]), 10**12, 10**15).tolist() == [50 + 50 * 10**9 * 10**12 // 10**15]
