"""Alignment of two tokenizations of the same bytes, and how often each pair of ids ends together.

Divide and conquer at shared cuts: of an interval whose borders both tokenizations share, a common
end near the middle is looked for, by bisecting the other side's ends for the end of the middle
token, then of those beside it, in rings that double. Both halves are cut on; an interval in which the sides share no
end is a group. All intervals of a slice of texts are cut at once, level by level.

A link is a pair of tokens that end together. Of such a pair the shorter token is a suffix of the
longer one, so different pairs are at most as many as the bytes of both vocabularies (some
hundred thousand, whatever the corpus): their counts are summed in Spark and carried to the tasks.
Texts are tokenized once; what is stored between the passes are each document's distinct pairs.

Texts are tokenized by words that begin with a blank after a visible character: no
pre-token of the first and no piece of the second tokenizer spans that place, which is checked against both files (else
whole texts are). Ids of a word are kept once found; long texts are aligned part by part.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .annotate import annotate
from .grams import segment_sums, settle, sum_by
from .packing import texts
from .scratch import written

PART = 1 << 16  # words after which a long text is cut
BATCH = 1 << 20  # characters that are aligned at once
KEPT = 600_000  # words whose ids are kept from slice to slice, about
ENCODED = 8192  # words that are tokenized at once
#: Between a character that is no white space and a blank. U+001C to U+001F are none, unlike in Python.
_CUT = re.compile("(?<=[\\S\x1c-\x1f])(?= )")
#: A blank that is at the beginning or after white space.
_RUN = re.compile("(?:^|[^\\S\x1c-\x1f]) ")
BLANK = "▁"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Strings:
    """Strings of bytes or ids by number, to be put end to end without a loop."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        self.data, self.sizes = data, sizes
        self.first = np.cumsum(sizes) - sizes

    @staticmethod
    def of(values: list[bytes]) -> Strings:
        return Strings(np.frombuffer(b"".join(values), np.uint8), np.array([len(v) for v in values], np.int64))

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes[numbers]
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.data[np.repeat(self.first[numbers], sizes) + place]

    def only(self, numbers: np.ndarray) -> Strings:
        return Strings(self.joined(numbers), self.sizes[numbers])

    def more(self, values: list) -> Strings:
        sizes = np.array([len(v) for v in values], np.int64)
        added = np.fromiter(chain.from_iterable(values), self.data.dtype, int(sizes.sum()))
        return Strings(np.concatenate([self.data, added]), np.concatenate([self.sizes, sizes]))


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of a and of b that end together, in order.

    ends: where each token ends, rising; last: of each text its last token, which ends together with the other side's.
    """
    # First and last tokens of the intervals, on both sides.
    (low_a, high_a), (low_b, high_b) = ((np.concatenate([[0], last + 1])[:-1], last) for last in (last_a, last_b))
    cuts_a, cuts_b = [last_a], [last_b]

    def shared(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(ends_b, ends_a[token])
        return ends_b[at] == ends_a[token], at

    while True:
        open_ = (low_a < high_a) & (low_b < high_b)
        low_a, high_a, low_b, high_b = (x[open_] for x in (low_a, high_a, low_b, high_b))
        if not len(low_a):
            break
        cut_a = (low_a + high_a - 1) // 2
        hit, cut_b = shared(cut_a)
        left, ring = np.flatnonzero(~hit), 1  # intervals without a cut so far; distances [ring, 2 * ring) from the middle are next
        middle = cut_a[left]
        while len(left):
            steps = np.stack([np.arange(ring, 2 * ring), -np.arange(ring, 2 * ring)], axis=1).ravel()
            tried = middle[:, None] + steps
            inside = (tried >= low_a[left][:, None]) & (tried < high_a[left][:, None])
            row, column = np.nonzero(inside)
            token = tried[row, column]
            good, at = shared(token)
            row, token, at = row[good], token[good], at[good]
            nearest = np.flatnonzero(np.diff(row, prepend=-1))
            found = left[row[nearest]]
            cut_a[found], cut_b[found], hit[found] = token[nearest], at[nearest], True
            going = inside.any(axis=1)
            going[row] = False
            left, middle, ring = left[going], middle[going], 2 * ring
        low_a, high_a, low_b, high_b, cut_a, cut_b = (x[hit] for x in (low_a, high_a, low_b, high_b, cut_a, cut_b))
        cuts_a.append(cut_a)
        cuts_b.append(cut_b)
        low_a, high_a, low_b, high_b = (np.concatenate(x) for x in ((low_a, cut_a + 1), (cut_a, high_a), (low_b, cut_b + 1), (cut_b, high_b)))
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


@dataclass
class Aligned:
    """Texts end to end: ids and bounds of tokens by text on both sides, last tokens of groups, first groups of texts."""

    a: np.ndarray
    b: np.ndarray
    bounds_a: np.ndarray
    bounds_b: np.ndarray
    cuts_a: np.ndarray
    cuts_b: np.ndarray
    groups: np.ndarray


class Aligner:
    """Two tokenizers: a byte-level one of the tokenizers library and a piece model of sentencepiece."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        import sentencepiece
        from tokenizers import Tokenizer

        self.one, self.other = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.one.encode_special_tokens = True
        sign = byte_level()
        vocabulary = self.one.get_vocab(with_added_tokens=True)
        own: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            own[number] = bytes(sign[c] for c in token) if all(c in sign for c in token) else token.encode()
        pieces = [self.other.id_to_piece(i) for i in range(self.other.get_piece_size())]
        self.bytes_a = Strings.of(own)
        self.bytes_b = Strings.of([bytes([int(p[3:5], 16)]) if self.other.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)])
        self.numbers = [f"{i}{mark}".encode() for i in range(max(len(own), len(pieces))) for mark in (",", "|", ";")]
        self.digits = np.array([len(x) for x in self.numbers], np.int64)
        self.blank = self.other.piece_to_id(BLANK)
        self.known: dict[str, int] = {}
        self.ids = [Strings(np.zeros(0, np.int32), np.zeros(0, np.int64)) for _ in range(2)]  # of both sides, by the known words' numbers
        rule = json.loads(self.one.pre_tokenizer.__getstate__()) if self.one.pre_tokenizer else {}
        own_rule = self.one.normalizer is None and rule.get("type") == "ByteLevel" and rule.get("use_regex") and not rule.get("add_prefix_space")
        self.divisible = bool(own_rule) and not any(BLANK in p.lstrip(BLANK) for p in pieces)

    def words(self, text: str) -> list[str]:
        """The text's words, each but the first without the blank before it."""
        if not self.divisible:
            return [text]
        if not _RUN.search(text):
            return text.split(" ")
        first, *more = _CUT.split(text)
        return [first, *(w[1:] for w in more)]

    def parts(self, text: str) -> list[list[str]]:
        """The words of a text in runs of PART."""
        words = self.words(text)
        return [words[i : i + PART] for i in range(0, len(words), PART)]

    def learn(self, words: set[str]) -> None:
        known = self.known
        fresh = [w for w in words if w not in known]
        if len(known) + len(fresh) > KEPT:
            kept = [w for w in words if w in known]
            numbers = np.array([known[w] for w in kept], np.int64)
            self.ids = [x.only(numbers) for x in self.ids]
            self.known = known = {w: i for i, w in enumerate(kept)}
        made: tuple[list, list] = [], []
        for low in range(0, len(fresh), ENCODED):
            some = fresh[low : low + ENCODED]
            made[0].extend(self.first_ids(some))
            # Of an empty word, which follows a last blank, only that blank is left.
            made[1].extend(x if w else [self.blank] for w, x in zip(some, self.other.encode(some, num_threads=1)))
        if fresh:
            self.ids = [x.more(new) for x, new in zip(self.ids, made)]
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))

    def first_ids(self, words: list[str]) -> list[list[int]]:
        """Ids by the first tokenizer of each word with a blank before it: words without white space in one text, which is cut where they end."""
        if self.divisible and (solid := [w for w in words if w.split() == [w]]):
            ids = self.one.encode(" " + " ".join(solid), add_special_tokens=False).ids
            ends, wanted = np.cumsum(self.bytes_a.sizes[ids]), np.cumsum([len(w.encode()) + 1 for w in solid])
            at = np.minimum(np.searchsorted(ends, wanted), len(ends) - 1)
            if np.array_equal(ends[at], wanted) and at[-1] == len(ends) - 1:
                cuts = [0, *(at + 1).tolist()]
                found = {w: ids[a:b] for w, a, b in zip(solid, cuts[:-1], cuts[1:])}
                rest = [w for w in words if w not in found]
                found.update(zip(rest, self.whole_ids(rest)))
                return [found[w] for w in words]
        return self.whole_ids(words)

    def whole_ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.one.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]

    def align(self, parts: list[list[str]]) -> tuple[Aligned, np.ndarray]:
        """(aligned, good): parts, each as its words with a blank before each; those whose tokens are not these bytes on both sides are not good and have no tokens."""
        self.learn(set().union(*parts))
        raw = [(" " + " ".join(p)).encode() for p in parts]
        whole = np.array([len(r) for r in raw], np.int64)
        good = np.ones(len(parts), bool)
        flat, sizes, n_words = [], [], np.array([len(p) for p in parts], np.int64)
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, int(n_words.sum()))
        for known, strings in zip(self.ids, (self.bytes_a, self.bytes_b)):
            every, n = known.joined(numbers).astype(np.int64), segment_sums(known.sizes[numbers], n_words)
            good &= segment_sums(strings.sizes[every], n) == whole
            flat.append(every)
            sizes.append(n)
        for side, strings in enumerate((self.bytes_a, self.bytes_b)):
            own = np.flatnonzero(good)
            kept = flat[side][np.repeat(good, sizes[side])]
            wrong = strings.joined(kept) != np.frombuffer(b"".join(raw[i] for i in own) or b"", np.uint8)
            good[own[segment_sums(wrong.astype(np.int64), whole[own]) > 0]] = False
        (a, b), (n_a, n_b) = (x[np.repeat(good, n)] for x, n in zip(flat, sizes)), (np.where(good, n, 0) for n in sizes)
        bounds_a, bounds_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        last_a, last_b = bounds_a[1:][good] - 1, bounds_b[1:][good] - 1
        cuts_a, cuts_b = shared_cuts(np.cumsum(self.bytes_a.sizes[a]), np.cumsum(self.bytes_b.sizes[b]), last_a, last_b)
        return Aligned(a, b, bounds_a, bounds_b, cuts_a, cuts_b, np.searchsorted(cuts_a, bounds_a)), good

    def written_groups(self, x: Aligned) -> tuple[bytes, np.ndarray]:
        """(text, bounds): groups as ``a1,a2|b1;`` end to end, and where those of each part begin."""
        last_a, last_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
        last_a[x.cuts_a], last_b[x.cuts_b] = 1, 1
        of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b  # groups
        before_b = np.concatenate([[0], x.cuts_b + 1])  # b's tokens before a group
        mixed = np.empty(len(x.a) + len(x.b), np.int64)
        mixed[np.arange(len(x.a)) + before_b[of_a]] = 3 * x.a + last_a
        mixed[np.arange(len(x.b)) + x.cuts_a[of_b] + 1] = 3 * x.b + 2 * last_b
        sizes = np.concatenate([[0], np.cumsum(self.digits[mixed])])
        return b"".join(map(self.numbers.__getitem__, mixed.tolist())), sizes[x.bounds_a + x.bounds_b]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    key = path_a, path_b
    if key not in _aligners:
        _aligners[key] = Aligner(path_a, path_b)
    return _aligners[key]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _batches(parts: list[tuple[int, list[str]]]):
    """parts in runs of BATCH characters, or one longer part."""
    held, size = [], 0
    for part in parts:
        own = sum(map(len, part[1]))
        if held and size + own > BATCH:
            yield held
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield held


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """docs' columns and ``groups``: an array of (a, b), the ids of both tokenizers in each group, in order.

    A null or empty text has no groups, nor has one whose tokens are not its bytes on both sides. A column groups of docs is replaced.
    """
    paths = tokenizers or default_tokenizers()

    def compute(data, offsets, batch):
        both, found = aligner(*paths), []
        for text in texts(data, offsets):
            own, fine = [], bool(text)
            for part in both.parts(text) if text else []:
                x, good = both.align([part])
                fine &= bool(good[0])
                own += [{"a": a.tolist(), "b": b.tolist()} for a, b in zip(np.split(x.a, x.cuts_a + 1)[:-1], np.split(x.b, x.cuts_b + 1)[:-1])]
            found.append(own if fine else [])
        return [found]

    return annotate(docs, "groups array<struct<a:array<int>,b:array<int>>>", compute)


def _documents(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times): of each document its tokens, groups, and distinct pairs (a * size of b + b) with their numbers."""

    def compute(data, offsets, batch):
        both, n = aligner(*paths), len(offsets) - 1
        width = len(both.bytes_b.sizes)
        sums, digests, fine = np.zeros((3, n), np.int64), [hashlib.sha256() for _ in range(n)], np.diff(offsets) > 0
        keys, begun = [], np.zeros(n, bool)
        parts = [(d, p) for d, text in enumerate(texts(data, offsets)) if text for p in both.parts(text)]
        for some in _batches(parts):
            owner = np.array([d for d, _ in some])
            x, good = both.align([p for _, p in some])
            fine[owner[~good]] = False
            for total, bounds in zip(sums, (x.bounds_a, x.bounds_b, x.groups)):
                np.add.at(total, owner, np.diff(bounds))
            text, at = both.written_groups(x)
            for d, low, high in zip(owner.tolist(), at[:-1].tolist(), at[1:].tolist()):
                if begun[d]:
                    digests[d].update(b";")
                begun[d] = True
                digests[d].update(memoryview(text)[low : max(low, high - 1)])
            pair = x.a[x.cuts_a] * width + x.b[x.cuts_b]
            ordered = np.lexsort((pair, owner := np.repeat(owner, np.diff(x.groups))))
            keys.append(np.stack([owner[ordered], pair[ordered]]))
        found = np.concatenate(keys, axis=1) if keys else np.zeros((2, 0), np.int64)
        found = found[:, fine[found[0]]]
        found = found[:, np.lexsort((found[1], found[0]))]
        new = np.flatnonzero(np.concatenate([[True], (found[:, 1:] != found[:, :-1]).any(axis=0)])) if found.shape[1] else np.zeros(0, np.int64)
        times = np.diff(np.append(new, found.shape[1]))
        lists = pa.array(np.searchsorted(found[0][new], np.arange(n + 1)).astype(np.int32))
        return [
            *(pa.array(np.where(fine, s, 0)) for s in sums),
            pa.array([d.hexdigest() if ok else "" for d, ok in zip(digests, fine)]),
            pa.ListArray.from_arrays(lists, pa.array(found[1][new])),
            pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32))),
        ]

    return annotate(docs, "n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>", compute, carry=["doc_id"])


def _pair_counts(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order, and how many links of found(pairs, times) have each; at most as many pairs as the vocabularies have bytes."""

    def run(batches):
        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            own = [batch.column(i).flatten().to_numpy() for i in range(2)]
            pairs, n = sum_by(np.concatenate([pairs, own[0]]), np.concatenate([n, own[1].astype(np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])
        settle()

    rows = found.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs, n = (rows.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pairs)
    return pairs[order], n[order]


def alignment_counts(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each of docs(doc_id, text).

    n_links: pairs of tokens that end together; a pair's count: its links in all documents; n_best:
    links whose count is the highest of those with their second id, ties included; count_sum: of all links. A null or
    empty text has zeros and no digest, as has one whose tokens are not its bytes on both sides. Rows repeated count as often as they
    occur; other columns are not read. An empty table gives no rows.
    """
    paths = tokenizers or default_tokenizers()
    docs = docs.select("doc_id", "text")
    found = written(_documents(docs, paths), "aligned")
    pairs, n = _pair_counts(found)
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    highest = np.zeros(width, np.int64)
    np.maximum.at(highest, pairs % width, n)
    model = docs.sparkSession.sparkContext.broadcast((pairs, n, n == highest[pairs % width]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches):
        known, count, best = model.value
        for batch in batches:
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            sizes = column["pairs"].value_lengths().to_numpy().astype(np.int64)
            at = np.searchsorted(known, column["pairs"].flatten().to_numpy())
            times = column["times"].flatten().to_numpy().astype(np.int64)
            links, good, total = (pa.array(segment_sums(x, sizes)) for x in (times, times * best[at], times * count[at]))
            yield pa.RecordBatch.from_arrays([column["doc_id"], column["n_a"], column["n_b"], column["n_groups"], links, good, total, column["groups_sha256"]], names=names)
        settle()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_tokenizer_alignment(spark, sf_dir):
    """Every document's tokens by two tokenizers, aligned."""
    return alignment_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
