"""The classifier's thresholds against the perplexities that it gives."""

import math
import random

import pytest

from assetlake.llm import quality_classifier
from assetlake.llm.scratch import written

RARE = 240


@pytest.fixture(scope="module")
def judged(spark):
    """3,000 trusted rows, RARE of them in a rare language, and a bad row of noise for every thirtieth of them."""
    rng = random.Random(1)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(300)] for lang, letters in (("en", "etaoinshr"), ("xx", "kqzwyujb"))}
    rows = []
    for i in range(3000):
        lang = "xx" if i < RARE else "en"
        rows.append((i, " ".join(rng.choices(words[lang], k=rng.randint(20, 60))), lang))
    rows += [(3000 + i, "".join(chr(rng.randint(33, 126)) for _ in range(200)), "en") for i in range(100)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), "docs")
    labels = spark.createDataFrame([(r[0], int(r[0] < 3000)) for r in rows], "doc_id long, quality int")
    trained = set(quality_classifier._trained(docs, labels.filter("quality = 1").select("doc_id"), 600).tolist())
    return trained, [r for r in quality_classifier.quality_classifier(docs, labels, sample_docs=600).collect()]


def test_thresholds_are_quantiles_drawn_towards_that_of_all(judged):
    trained, got = judged
    at = lambda held: held[math.ceil(0.995 * len(held)) - 1]
    held = {lang: sorted(r.perplexity for r in got if lang in (None, r.lang) and r.doc_id < 3000 and r.doc_id not in trained) for lang in (None, "en", "xx")}
    every = at(held[None])
    for lang in ("en", "xx"):
        n, own = len(held[lang]), at(held[lang])
        assert n >= (2000 if lang == "en" else 30)
        (threshold,) = {r.threshold for r in got if r.lang == lang}
        assert threshold == pytest.approx(math.exp((n * math.log(own) + 25 * math.log(every)) / (n + 25)), rel=1e-12)
    assert all(r.keep == (r.perplexity <= r.threshold) for r in got)


@pytest.mark.parametrize(("counts", "total", "want"), [([5, 100, 100], 60, [5, 27.5, 27.5]), ([10, 10], 100, [10, 10]), ([3, 9, 50, 1000], 62, [3, 9, 25, 25]), ([7], 3, [3])])
def test_shares_of_languages(spark, counts, total, want):
    table = spark.createDataFrame([(f"l{i}" if i else None, c) for i, c in enumerate(counts)], "lang string, count long")
    got = {r.lang: r.share for r in quality_classifier._shares(table, total).collect()}
    assert [got[f"l{i}" if i else None] * c for i, c in enumerate(counts)] == pytest.approx(want)


def test_each_language_trains_and_bad_rows_go(judged):
    trained, got = judged
    rare = sum(i < RARE for i in trained)
    assert 150 <= rare <= RARE and 350 <= len(trained) - rare <= 450
    assert not any(r.keep for r in got if r.doc_id >= 3000)
