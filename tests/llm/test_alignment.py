"""Cross-tokenizer alignment: cuts and counts against plain intersections of token ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlake.llm import alignment as A

PATHS = A.default_tokenizers()
ODD = [
    "", None, " ", "  ", "a", "Hello world", " leading  and   trailing  ", "line\nbreaks \n\n and\ttabs\r\n", "naïve Straße 中文 日本語 🙂🙃", "<|endoftext|> is text <s> </s> <unk> <0x0A>",
    "U+2581 ▁ is no blank", "x\x00y\x1c z\x1d w", "1234567890 3.14159 !!!??? #$%", "don't we'll I'm", " nbsp em　wide", "é é ﬁ ①", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
]


@pytest.fixture(scope="module")
def both():
    return A.aligner(*PATHS)


def plain(both, text):
    """(ids a, ids b, groups, links) of one text by sets of ends, on the whole text at once."""
    if not text:
        return [], [], [], []
    own = {number: token for token, number in both.one.get_vocab(with_added_tokens=True).items()}
    sign = A.byte_level()
    a = both.one.encode(" " + text, add_special_tokens=False).ids
    b = both.other.encode(text)
    bytes_a = [bytes(sign[c] for c in own[i]) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if both.other.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, both.other.id_to_piece(i)) for i in b)]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], [], [], []
    ends_a, ends_b = (np.cumsum([len(x) for x in xs]).tolist() for xs in (bytes_a, bytes_b))
    groups, i, j = [], 0, 0
    place_a, place_b = ({end: i for i, end in enumerate(ends)} for ends in (ends_a, ends_b))
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = place_a[end] + 1, place_b[end] + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return a, b, groups, [(x[-1], y[-1]) for x, y in groups]


def expected(both, docs):
    made = {i: plain(both, t) for i, t in enumerate(t for _, t in docs)}
    counts = Counter(link for *_, links in made.values() for link in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = []
    for i, (doc_id, _) in enumerate(docs):
        a, b, groups, links = made[i]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        rows.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(rows, key=str)


def words(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(["the", "ing", "Qx", "straße", "中", " ", " ", "  ", "\n", ".", "'s", "12", "🙂", "\t", "tion"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_the_shared_ends(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 200, rng.integers(1, 6))
    ends, lasts, base = ([], []), ([], []), 0
    for n in lengths:
        base += n
        for side in range(2):
            inner = np.flatnonzero(rng.random(n - 1) < rng.choice([0.02, 0.3, 0.9])) + base - n + 1
            ends[side].extend([*inner, base])
            lasts[side].append(len(ends[side]) - 1)
    a, b, last_a, last_b = (np.array(x, np.int64) for x in (*ends, *lasts))
    cuts_a, cuts_b = A.shared_cuts(a, b, last_a, last_b)
    shared = np.intersect1d(a, b)
    assert (a[cuts_a] == shared).all() and (b[cuts_b] == shared).all()


def test_no_texts_and_an_interval_without_a_cut():
    none = np.zeros(0, np.int64)
    assert [len(x) for x in A.shared_cuts(none, none, none, none)] == [0, 0]
    a, b = np.append(np.arange(1, 2000, 2), 4001), np.append(np.arange(2, 4000, 2), 4001)
    cuts = A.shared_cuts(a, b, np.array([len(a) - 1]), np.array([len(b) - 1]))
    assert cuts[0].tolist() == [len(a) - 1] and cuts[1].tolist() == [len(b) - 1]


def test_parts_give_the_tokens_of_the_whole(both, monkeypatch):
    monkeypatch.setattr(A, "PART", 7)
    monkeypatch.setattr(A, "KEPT", 30)
    for seed in range(40):
        text = words(seed, 400) + (" " if seed % 2 else "")
        parts = both.parts(text)
        assert " ".join(w for p in parts for w in p) == text and len(parts) > 1
        x, good = both.align(parts)
        a, b, groups, _ = plain(both, text)
        if good.all():
            assert x.a.tolist() == a and x.b.tolist() == b and len(x.cuts_a) == len(groups)
        else:
            assert not groups


def test_counts_against_plain_intersections(spark, both, monkeypatch):
    docs = list(enumerate(ODD)) + [(100 + s, words(s, 60)) for s in range(30)] + [(7, ODD[7]), (None, "no id"), (200, words(1, 60)), (300, words(5, 100_000)), (301, "word " * 70_000), (302, "x" * 3_000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("theirs") for c in ("n_a", "pairs", "groups")})
    got = sorted(map(tuple, A.alignment_counts(table.repartition(3)).collect()), key=str)
    assert got == expected(both, docs)
    assert A.alignment_counts(table.limit(0)).count() == 0


def test_groups_themselves(spark, both):
    docs = [(i, t) for i, t in enumerate(ODD)]
    got = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in A.align(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: plain(both, t)[2] for i, t in docs}
