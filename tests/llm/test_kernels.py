import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from assetlake.llm import decontamination, kneser_ney, license_scan, lm_scoring, near_dedup, packing, quality_rules
from assetlake.llm.grams import blocks, byte_codes, shingles, tally, text_buffers, word_hashes, words

TEXTS = ["", "  ", "one", "a b\tc\nd  e", None, "é ß ñ " * 9, "x" * 300, "The the THE", "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5", "l\nl\n\nl \n#|$ &"] + [" ".join(random.Random(i).choices("ab cd ef gh ij kl".split(), k=40)) for i in range(5)]


def test_words_are_runs_without_white_space():
    data, offsets = text_buffers(pa.array(TEXTS))
    starts, ends, first = words(data, offsets)
    for i, t in enumerate(TEXTS):
        own = [bytes(data[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
        assert own == re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert sum((hi - lo for lo, hi in blocks(offsets, 64))) == len(TEXTS)


def test_quality_measures_match_brute_force():
    data, offsets = text_buffers(pa.array(TEXTS))
    got = list(zip(*(x.tolist() for x in quality_rules.measures(data, offsets)[:5])))
    for t, row in zip(TEXTS, got):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert row == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_weak_supervision_finds_the_bad_cluster():
    good, bad = sum(3**i for i in range(8)), sum(3**i for i in range(6)) + 2 * 3**6 + 2 * 3**7
    _, _, posterior = quality_rules.fit(np.array([good, bad]), np.array([900, 100]))
    assert posterior[0] > 0.9 and posterior[1] < 0.5


def _every(codes, levels):
    """Probabilities of all symbols after the contexts of the codes."""
    context = np.repeat(codes >> np.uint64(8), 256) << np.uint64(8)
    return (context | np.tile(np.arange(256, dtype=np.uint64), len(codes))).astype(np.uint64)


@pytest.mark.parametrize("model", ["ppm", "kneser_ney"])
def test_models_are_distributions(model):
    data, offsets = text_buffers(pa.array(TEXTS[3:9]))
    grams, counts = tally(byte_codes(data, offsets))
    asked = np.append(grams[::9], np.uint64(0x0102030405))
    every = _every(asked, None)
    if model == "ppm":
        low = lm_scoring.sum_by(grams & kneser_ney.mask(2), counts)
        p = 10 ** lm_scoring.log10_probability(every, lm_scoring.tries(low, grams, counts))
        p = p.reshape(-1, 256)[:, [*range(0xFE), 0xFF]]  # START is never predicted
    else:
        p = kneser_ney.probability(every, [*kneser_ney.lower_levels(grams), kneser_ney.Level(grams, counts)]).reshape(-1, 256)
    assert np.allclose(p.sum(1), 1, atol=1e-9)


def _ppm_by_hand(history, symbol, tries):
    """log10 probability by walking contexts one at a time."""
    excluded, out = set(), 0.0
    for k in range(4, -1, -1):
        seen = {s: n for s, n in tries[k].get(history[4 - k :], {}).items()}
        if not seen:
            continue
        rest = {s: n for s, n in seen.items() if s not in excluded}
        total = sum(rest.values())
        if symbol in rest:
            return out + np.log10((2 * rest[symbol] - 1) / (2 * total))
        if rest:
            out += np.log10(len(rest) / (2 * total))
        excluded |= set(seen)
    return out - np.log10(255 - len(excluded))


def test_ppm_matches_a_walk_over_contexts():
    data, offsets = text_buffers(pa.array(["abracadabra", "abc abd", "zz"]))
    codes = byte_codes(data, offsets)
    grams, counts = tally(codes)
    tries = [dict() for _ in range(5)]
    for g, n in zip(grams.tolist(), counts.tolist()):
        b = g.to_bytes(5)
        for k in range(5):
            at = tries[k].setdefault(b[4 - k : 4], Counter())
            at[b[4]] += n
    asked = np.array([int.from_bytes(h + bytes([s])) for h in (b"abra", b"zzzz", b"xbra", b"\xfe\xfeab") for s in (b"a"[0], b"c"[0], b"q"[0], 255)], np.uint64)
    got = lm_scoring.log10_probability(asked, lm_scoring.tries(lm_scoring.sum_by(grams & kneser_ney.mask(2), counts), grams, counts))
    want = [_ppm_by_hand(int(g).to_bytes(5)[:4], int(g) & 255, tries) for g in asked]
    assert np.allclose(got, want)


def test_patience_aligns_in_order():
    a, b = [9, 1, 2, 3, 8, 4, 5], [1, 2, 7, 3, 4, 5, 6]
    pairs = license_scan.patience(a, b)
    assert [a[i] for i, _ in pairs] == [1, 2, 3, 4, 5] and pairs == sorted(pairs)
    assert license_scan.longest_increasing([(0, 3), (1, 1), (2, 2), (3, 0)]) == [(1, 1), (2, 2)]


def test_packing_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([8, 32, 100])
        lengths = sorted((rng.randint(1, rng.choice([capacity, max(1, capacity // 4)])) for _ in range(rng.randint(0, 120))), reverse=True)
        rooms = []
        for n in lengths:
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - n)
        plan = packing.plan(Counter(lengths), capacity)
        assert sorted(w.room for w in plan for _ in range(w.count)) == sorted(rooms)
        filled = Counter()
        slots = packing.Slots.of(plan)
        for n, k in Counter(lengths).items():
            sequence, offset = slots.find(np.full(k, n), np.arange(k))
            filled.update((s, o + i) for s, o in zip(sequence.tolist(), offset.tolist()) for i in range(n))
        assert not filled or max(filled.values()) == 1
        assert len(filled) == sum(lengths)


def test_minhash_finds_all_contained_items():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(8, 60))) for _ in range(60)]
    docs = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 900))) + " " + x + " " + " ".join(rng.choices(vocabulary, k=rng.randint(0, 900))) for x in items]
    classes = decontamination.size_classes(decontamination._item_sets(pa.array(items)), 20)
    data, offsets = text_buffers(pa.array(docs))
    starts, ends, first = words(data, offsets)
    found, owner, _ = shingles(word_hashes(data, starts, ends), first)
    pairs = decontamination.candidates(found, owner, classes)
    assert {(i, i) for i in range(60)} <= pairs and len(pairs) < 70


def test_consistent_weighted_samples_follow_similarity():
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    near = base[:]
    for i in range(0, 400, 50):
        near[i] = "changed"
    data, offsets = text_buffers(pa.array([" ".join(base), " ".join(near), " ".join(reversed(base)), "too short"]))
    idf = np.ones(near_dedup.DF_BUCKETS, np.float32)
    keys, sizes = near_dedup.bands(data, offsets, idf)
    assert (keys[0] == keys[1]).any() and not (keys[0] == keys[2]).any() and sizes[3] == 0
