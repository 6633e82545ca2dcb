"""Ids of texts part by part against those of the whole texts."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from assetlake.llm import packing

#: Letters, digits, marks, white space, and what must stay whole: signs that join, compose or change their length.
ALPHABET = [*"aAbZz09 .,!#*$%&'-_@\n\t", *"\u00e9\u00c9\u00d7\u0130\u0149\u00b5\u0301\u00a0\u0085\x1c\u4e2d\u0915\u093c\u2260\u00df\u1e9e\u01c5\u024f\u0250\u0660", "'s", "'LL", "<|endoftext|>", "Stra\u00dfe", " thingh,"]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(packing.default_tokenizer())


def expected(whole, texts):
    return [[*e.ids, packing.END_ID] for e in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("kept", [40, packing.CACHED_PARTS])
def test_odd_texts(whole, monkeypatch, kept):
    monkeypatch.setattr(packing, "CACHED_PARTS", kept)
    monkeypatch.setattr(packing, "ENCODED", 50)
    rng, own = random.Random(kept), packing.TokenIds(packing.default_tokenizer())
    for _ in range(20):
        texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(50))) for _ in range(100)]
        assert [x.tolist() for x in own(texts)] == expected(whole, texts)
    assert [x.tolist() for x in own([])] == [] and [x.tolist() for x in own(["", " \n"])] == [[packing.END_ID]] * 2


def test_known_words_are_not_tokenized_again():
    own = packing.TokenIds(packing.default_tokenizer())
    texts = [" ".join(f"{''.join(chr(97 + int(d)) for d in str(i))}, x" for i in range(low, low + 20_000)) for low in range(100_000, 340_000, 20_000)]
    first = [own([t])[0].tolist() for t in texts]
    own.tokenizer = own.lean = None
    assert [own([t.upper()])[0].tolist() for t in texts] == first


def test_words_of_one_hash_are_told_apart(whole, monkeypatch):
    monkeypatch.setattr(packing, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    texts = ["one two six", "three, seven", "ten ten TEN"]
    assert [x.tolist() for x in packing.TokenIds(packing.default_tokenizer())(texts)] == expected(whole, texts)
