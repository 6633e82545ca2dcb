"""Ids of words by the first tokenizer, made in one text, against those of each word."""

import random

from assetlake.llm import alignment as A

ALPHABET = [*"aAbZ09.,'-_@#*", *"\u00e9\u0130\u0301\u00a0\u0085\x1c\u4e2d\u0915\u093c\u2581\U0001f600", "'s", "'LL", "<|endoftext|>", "Stra\u00dfe"]


def test_words_in_one_text(monkeypatch):
    both, rng = A.Aligner(*A.default_tokenizers()), random.Random(2)
    words = sorted({"".join(rng.choices(ALPHABET, k=rng.randrange(9))) for _ in range(6000)} | {"", " ", "a b", "\n", "x\u3000"})
    rng.shuffle(words)
    want = both.whole_ids(words)
    assert both.first_ids(words) == want
    solid = [(w, x) for w, x in zip(words, want) if w.split() == [w]]
    assert len(solid) > 2000
    monkeypatch.setattr(both, "whole_ids", lambda some: [] if not some else 1 / 0)
    assert both.first_ids([w for w, _ in solid]) == [x for _, x in solid]


def test_words_are_kept():
    both = A.Aligner(*A.default_tokenizers())
    slices = [{f"w{i}" for i in range(low, low + 50_000)} for low in range(0, 300_000, 50_000)]
    for some in slices:
        both.learn(some)
    both.one = both.other = None
    for some in slices:
        both.learn(some)
