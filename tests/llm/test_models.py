"""The fitted models against plain versions: dictionaries, loops, numeric gradients, simulated votes."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from assetlake.llm import language_id, quality_classifier, quality_rules
from assetlake.llm.scratch import written

START, END = 0xFE, 0xFF


def symbols(text):
    return [START] * 4 + list((text or "").encode()) + [END]


class Dictionaries:
    """Interpolated modified Kneser-Ney over 5-grams of bytes."""

    def __init__(self, texts):
        grams = Counter(tuple(s[i - 4 : i + 1]) for s in map(symbols, texts) for i in range(4, len(s)))
        self.levels = {5: grams}
        for k in (4, 3, 2, 1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.own = {}
        for k, counts in self.levels.items():
            n = [max(1, sum(c == j for c in counts.values())) for j in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            d = [0] + [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.1), j - 0.05) for j in (1, 2, 3)]
            total, left = Counter(), defaultdict(float)
            for g, c in counts.items():
                total[g[:-1]] += c
                left[g[:-1]] += min(c, d[min(c, 3)])
            self.own[k] = d, total, left

    def p(self, gram):
        if not gram:
            return 1 / 256
        k, below = len(gram), self.p(gram[1:])
        d, total, left = self.own[k]
        context = gram[:-1]
        if not total[context]:
            return below
        c = self.levels[k][gram]
        return max(c - d[min(c, 3)], 0) / total[context] + left[context] / total[context] * below

    def perplexity(self, text):
        s = symbols(text)
        return math.exp(-sum(math.log(self.p(tuple(s[i - 4 : i + 1]))) for i in range(4, len(s))) / (len(s) - 4))


def test_perplexities_against_dictionaries(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["the", "tin", "Straße", "of", "rest", "中文", "a"], k=rng.randint(0, 30))), "en") for i in range(80)] + [(80, None, "en"), (81, "", None), (82, rows_text := "zebra " * 40, "en"), (83, rows_text, "en")]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), "docs")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(84)], "doc_id long, quality int")
    trained = quality_classifier._trained(docs, labels.filter("quality = 1").select("doc_id"), 30).tolist()
    assert 10 < len(trained) < 60
    plain = Dictionaries([text for i, text, _ in rows if i in trained])
    got = {r.doc_id: r for r in quality_classifier.quality_classifier(docs, labels, sample_docs=30).collect()}
    assert len(got) == len(rows) and not got[80].keep and not got[81].keep
    for i, text, _ in rows:
        assert got[i].perplexity == pytest.approx(plain.perplexity(text), rel=1e-9)


def plain_log_probabilities(windows, net):
    out = []
    for w in windows:
        hidden = []
        for f, filt in enumerate(net.filters):
            places = len(w) - len(filt) + 1
            score = max(sum(float(filt[k] @ net.embed[w[p + k]]) for k in range(len(filt))) for p in range(places))
            hidden.append(max(0.0, score + net.bias[f]))
        z = np.array(hidden) @ net.out + net.out_bias
        out.append(z - np.log(np.exp(z - z.max()).sum()) - z.max())
    return np.array(out)


def test_tables_against_plain_convolution():
    rng = np.random.default_rng(5)
    net = language_id.Network(3)
    net.bias = rng.normal(0, 0.3, len(net.bias))
    windows = rng.integers(0, 256, (4, language_id.WINDOW)).astype(np.uint8)
    assert np.allclose(language_id.log_probabilities(windows, net, net.tables()), plain_log_probabilities(windows, net), atol=1e-4)


def test_a_training_step_goes_against_the_numeric_gradient():
    rng = np.random.default_rng(6)
    windows, labels = rng.integers(0, 256, (6, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    net, moved = language_id.Network(3), language_id.Network(3)
    moved.train(windows, labels, epochs=1, batch=len(labels))  # one step: each number moves by the rate, against the sign of its slope

    def loss():
        return -plain_log_probabilities(windows, net)[np.arange(len(labels)), labels].mean()

    checked = 0
    for name in ("out", "out_bias", "bias", "filters", "embed"):
        values, step = getattr(net, name), getattr(moved, name) - getattr(net, name)
        flat = np.flatnonzero(np.abs(step.ravel()) > 3e-3)
        for at in rng.permutation(flat)[:6]:
            kept = values.ravel()[at]
            values.ravel()[at] = kept + 1e-5
            up = loss()
            values.ravel()[at] = kept - 1e-5
            slope = (up - loss()) / 2e-5
            values.ravel()[at] = kept
            if abs(slope) > 1e-6:
                assert np.sign(step.ravel()[at]) == -np.sign(slope), (name, at)
                checked += 1
    assert checked > 15


def test_accuracies_of_simulated_votes():
    rng = np.random.default_rng(7)
    n, rules = 200_000, 5
    share, right_good, right_bad, speaks = 0.8, np.array([0.99, 0.98, 0.995, 0.97, 0.99]), np.array([0.6, 0.8, 0.5, 0.7, 0.9]), np.array([1, 0.9, 0.7, 1, 0.8])
    good = rng.random(n) < share
    right = rng.random((n, rules)) < np.where(good[:, None], right_good, right_bad)
    votes = np.where(rng.random((n, rules)) < speaks, np.where(right == good[:, None], 1, 2), 0)
    patterns, counts = np.unique((votes * 3 ** np.arange(rules)).sum(1), return_counts=True)
    found, accuracies, posterior = quality_rules.fit(patterns, counts, rules)
    assert found == pytest.approx(share, abs=0.02)
    assert np.allclose(accuracies[0], right_good, atol=0.01) and np.allclose(accuracies[1], right_bad, atol=0.05)
    v = np.stack([patterns // 3**i % 3 for i in range(rules)], 1)
    likely = [np.prod(np.where(v == yes, a, np.where(v == no, 1 - a, 1)), 1) for a, yes, no in ((right_good, 1, 2), (right_bad, 2, 1))]
    true = share * likely[0] / (share * likely[0] + (1 - share) * likely[1])
    assert (counts * np.abs(true - posterior)).sum() / n < 0.01
