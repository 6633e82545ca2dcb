"""License scans: patience alignment against its definition, and planted notices."""

import random
from collections import Counter

import pytest

from assetlake.llm import license_scan as L


def plain(a, b):
    """Aligned words by the definition: equal ends, then words unique on both sides, their longest increasing run, then the gaps."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + plain(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + plain(a[:-1], b[:-1])
    once = {w for w in a if a.count(w) == 1 and b.count(w) == 1}
    places = [(i, b.index(w)) for i, w in enumerate(a) if w in once]
    if not places:
        return 0
    chosen = L.longest_increasing(places)
    longest = [1] * len(places)
    for i, (_, y) in enumerate(places):
        longest[i] = 1 + max((longest[j] for j in range(i) if places[j][1] < y), default=0)
    assert len(chosen) == max(longest) and all(p in places for p in chosen)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(chosen, chosen[1:]))
    edges = [(-1, -1), *chosen, (len(a), len(b))]
    return len(chosen) + sum(plain(a[x + 1 : u], b[y + 1 : v]) for (x, y), (u, v) in zip(edges, edges[1:]))


@pytest.mark.parametrize("seed", range(60))
def test_patience_against_its_definition(seed):
    rng = random.Random(seed)
    b = [rng.randrange(rng.choice([4, 12, 40])) for _ in range(rng.randint(0, 40))]
    a = [w for w in b if rng.random() < 0.8]
    for _ in range(rng.randint(0, 10)):
        a.insert(rng.randint(0, len(a)), rng.randrange(40))
    pairs = L.patience(a, b)
    assert len(pairs) == plain(a, b)
    assert all(a[x] == b[y] for x, y in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_planted_notices(spark):
    rng, rows, want = random.Random(4), [], {}
    filler = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    whole = " ".join(f"clause{i} shall apply to part{i % 17} of the work" for i in range(120))  # 960 words, many of them repeated
    templates = (*L.TEMPLATES, ("Whole-1.0", whole))
    for t, (name, notice) in enumerate(templates):
        words = notice.split()
        for share in (1.0, 0.9, 0.5):
            kept = sorted(rng.sample(range(len(words)), max(1, round(share * len(words)))))
            own, place = [words[i] for i in kept], len(rows) * 37 % 400
            rows.append((len(rows), " ".join([*filler(place), *own, *filler(50)])))
            want[len(rows) - 1] = (t, len(kept) / len(words), place)
    got = {r.doc_id: {x.template: x for x in r.licenses} for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()}
    for i, (t, share, place) in want.items():
        if share >= L.THRESHOLD:
            # Words that repeat in a notice may stay unaligned beside a cut, so a cut notice may fall just below its share.
            assert t in got[i] or share < 0.95, (i, templates[t][0], share)
            if share == 1:
                x = got[i][t]
                assert (x.coverage, x.first_word, x.words) == (1.0, place, len(templates[t][1].split()))
        elif max(Counter(w for w in templates[t][1].split()).values()) == 1:
            assert t not in got[i]
    cut = [i for i, (_, share, _) in want.items() if L.THRESHOLD < share < 1]
    assert sum(want[i][0] in got[i] for i in cut) >= 0.8 * len(cut)
    clean = spark.createDataFrame([(i, " ".join(filler(300))) for i in range(50)], "doc_id long, text string")
    assert L.scan_licenses(clean, templates=templates).filter("size(licenses) > 0").count() == 0
