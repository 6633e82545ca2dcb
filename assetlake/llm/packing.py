"""Packing documents into token sequences of fixed capacity by best-fit decreasing.

Overlong documents are cut into full windows first; what remains of them, and shorter documents, are
pieces of 1 to CAPACITY - 1 tokens. Best-fit decreasing puts each piece, longest first, into the
open window with the least room that still holds it; a segment tree over remaining capacities
finds that window. Pieces of one length, and windows with the same room, are interchangeable, so the
packing is planned on the histogram of lengths: a table of at most CAPACITY rows, whatever the
corpus. The plan says which ranks of each length go to which windows; ranks are counted in Spark
in salted groups, so that no length, however frequent, meets in one task. The result is that of
placing every piece one by one.
"""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .annotate import annotate
from .grams import SPACE, positions_in, settle, word_hashes, words
from .scratch import written

CAPACITY = 4096
END_ID = 2
SALTS, FULL_SALTS = 64, 1 << 14  # groups in which pieces of one length are ranked, and full windows, of which long texts make many
CACHED_PARTS = 500_000  # parts of words kept from slice to slice, some 40 bytes each; a worker lives on after its task, and so does what it keeps
ENCODED = 8192  # words that are tokenized at once
MARKS = b".,!#*$%&"
#: Normalizers and split of a tokenizer whose words, and whose letters and the marks between them, can be tokenized apart.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


#: Classes of bytes: white space, letters and DIGITS that are cut as one, MARKS, and ODD ones, whose words stay whole.
BLANK, LETTER, DIGIT, MARK, ODD = range(5)
_CLASS = np.full(256, ODD, np.uint8)
_CLASS[SPACE] = BLANK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_CLASS[[*range(0x30, 0x3A)]] = DIGIT
_CLASS[[*MARKS]] = MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte. Of other characters the letters U+00C0 to U+024F are letters, but U+0130, whose small letter is two characters."""
    out = _CLASS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    lead = lead[lead + 1 < len(data)]
    code = (data[lead].astype(np.int32) & 31) << 6 | data[lead + 1] & 63
    lead = lead[(code < 0x250) & (code != 0xD7) & (code != 0xF7) & (code != 0x130)]
    out[lead] = out[lead + 1] = LETTER
    return out


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first, whole): byte ranges of the parts of texts, of each text its first part's number, and which parts are not letters alone or MARKS alone."""
    kind = _classes(data)
    starts, ends, first = words(data, offsets)
    odd = np.add.reduceat(kind == ODD, starts, dtype=np.int64) > 0 if len(starts) else np.zeros(0, bool)
    mark = kind == MARK
    border = np.zeros(len(data) + 1, bool)
    border[1:-1] = (mark[1:] != mark[:-1]) & (kind[1:] != BLANK) & (kind[:-1] != BLANK)
    cuts = np.flatnonzero(border)
    word = np.searchsorted(starts, cuts, "right") - 1
    cuts = cuts[~odd[word] & (cuts > starts[word])]
    every = np.sort(np.concatenate([starts, cuts]))
    stops = np.sort(np.concatenate([ends, cuts]))
    uncut = np.add.reduceat((kind == ODD) | (kind == DIGIT), every, dtype=np.int64) > 0 if len(every) else np.zeros(0, bool)
    return every, stops, np.searchsorted(every, offsets), uncut


class Strings:
    """Strings of bytes or ids by number, to be put end to end without a loop."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        self.data, self.sizes = data, sizes
        self.first = np.cumsum(sizes) - sizes

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        place = np.arange(int(ends[-1]) if len(ends) else 0)
        place += np.repeat(self.first[numbers] - ends + sizes, sizes)
        return self.data[place]

    def with_(self, more: Strings) -> Strings:
        return Strings(np.concatenate([self.data, more.data]), np.concatenate([self.sizes, more.sizes]))


class RoomTree:
    """A segment tree over rooms 0..capacity that knows which rooms some open window has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = np.zeros(2 * self.size, bool)

    def set(self, room: int, some: bool) -> None:
        at = self.size + room
        self.some[at] = some
        while at > 1:
            at //= 2
            value = self.some[2 * at] or self.some[2 * at + 1]
            if self.some[at] == value:
                break
            self.some[at] = value

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that some window has."""
        at = self.size + least
        if self.some[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


@dataclass
class _Windows:
    """Windows filled alike: how many, and the runs (length, first rank, pieces in each window, offset) in them."""

    count: int
    room: int
    runs: list[tuple[int, int, int, int]] = field(default_factory=list)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[_Windows]:
    """Best-fit decreasing of histogram[length] pieces of each length.

    In a run (length, first, each, offset) of windows numbered 0..count-1, window w holds the pieces
    of that length with the ranks first + w * each to first + (w + 1) * each - 1, from offset on.
    """
    tree, open_, closed = RoomTree(capacity), {}, []

    def put(w: _Windows) -> None:
        if w.room:
            open_.setdefault(w.room, []).append(w)
            tree.set(w.room, True)
        else:
            closed.append(w)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                group = _Windows(max(1, left // (capacity // length)), capacity)
                room = capacity
            else:
                group = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    tree.set(room, False)
            each = room // length  # a window stays the tightest until it holds no more
            full = min(group.count, left // each)
            if full < group.count:
                rest = _Windows(group.count - full, room, list(group.runs))
                for i, (n, first, k, offset) in enumerate(rest.runs):
                    rest.runs[i] = (n, first + full * k, k, offset)
                if full == 0:
                    # fewer pieces than one window takes: one window gets them all
                    one = _Windows(1, room, list(rest.runs))
                    if rest.count > 1:
                        others = _Windows(rest.count - 1, room, [(n, first + k, k, offset) for n, first, k, offset in rest.runs])
                        put(others)
                    one.runs.append((length, rank, left, capacity - room))
                    one.room = room - left * length
                    put(one)
                    rank, left = rank + left, 0
                    continue
                if rest.room < capacity:
                    put(rest)
            group.count = full
            group.runs.append((length, rank, each, capacity - room))
            group.room = room - each * length
            rank, left = rank + full * each, left - full * each
            put(group)
    for some in open_.values():
        closed += some
    return closed


@dataclass
class Slots:
    """A plan as ordered arrays: for (length, rank) the sequence and the offset in it."""

    key: np.ndarray
    first: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequence: np.ndarray

    @staticmethod
    def of(windows: list[_Windows]) -> Slots:
        rows, sequence = [], 0
        for w in windows:
            rows += [(length, first, each, offset, sequence) for length, first, each, offset in w.runs]
            sequence += w.count
        rows.sort()
        length, first, each, offset, sequence_ = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
        return Slots((length << 48) | first, first, each, offset, sequence_)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) | rank, "right") - 1
        past = rank - self.first[at]
        return self.sequence[at] + past // self.each[at], self.offset[at] + past % self.each[at] * length


class TokenIds:
    """Token ids of texts; by a tokenizer of the form of NORMALIZERS and SPLIT part by part, ids of a part being kept once found, else by whole texts.

    A part is a word (no token spans white space), or of a word of letters, digits and MARKS alone each run of
    MARKS and each run between them, as none of their tokens spans that border. Case does not count. Parts are looked up by a
    hash; where the bytes found differ from the text's, its slice is tokenized as whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

        self.tokenizer = Tokenizer.from_file(path)
        normalizer, rule = (json.loads(x.__getstate__()) if x else {} for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        split = (rule.get("pretokenizers") or [{}])[0]
        self.divisible = [x["type"] for x in normalizer.get("normalizers", [])] == NORMALIZERS and split.get("pattern") == {"Regex": SPLIT} and split.get("invert") is True and split.get("behavior") == "Removed"
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.divisible &= all((_classes(np.frombuffer(t, np.uint8)) == ODD).any() and not SPACE[[*t]].any() for t in added)
        # Letters alone are one word each by the rule, so they need no regular expression; the model is shared.
        self.lean, self.suffix = Tokenizer(self.tokenizer.model), self.tokenizer.model.end_of_word_suffix
        self.lean.pre_tokenizer = Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(0, bool)  # by id: whether a word ends with it
        if self.divisible and self.suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(self.suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in the order of the hashes
        self.parts, self.ids = Strings(np.zeros(0, np.uint8), np.zeros(0, np.int64)), Strings(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def __call__(self, texts: list[str], end: int = END_ID) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        return self.of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), end)

    def of(self, data: np.ndarray, offsets: np.ndarray, end: int = END_ID) -> list[np.ndarray]:
        """Of each text its ids and ``end``."""
        found = self.divided(data, offsets, end) if self.divisible else None
        if found is None:
            return [np.array([*e.ids, end], np.uint32) for e in self.tokenizer.encode_batch_fast(list(texts(data, offsets)), add_special_tokens=False)]
        return found

    def divided(self, data: np.ndarray, offsets: np.ndarray, end: int) -> list[np.ndarray] | None:
        starts, ends, first, whole = _parts(data, offsets)
        hashed = word_hashes(data, starts, ends)
        distinct, example, which = np.unique(hashed, return_index=True, return_inverse=True)
        at = positions_in(self.hashes, distinct)
        fresh = example[at < 0]
        if len(fresh):
            if len(self.hashes) + len(fresh) > CACHED_PARTS:
                self.forget()
                fresh = example
            self.learn(data, starts[fresh], ends[fresh], hashed[fresh], whole[fresh])
            at = positions_in(self.hashes, distinct)
        numbers = self.numbers[at][which] if len(which) else np.zeros(0, np.int64)
        if not np.array_equal(self.parts.joined(numbers), _LOWER[data[~SPACE[data]]]):
            return None
        tokens = np.diff(np.concatenate([[0], np.cumsum(self.ids.sizes[numbers])])[first])
        bounds = np.cumsum(np.concatenate([[0], tokens + 1]))
        flat = np.full(bounds[-1], end, np.uint32)
        inner = np.ones(len(flat), bool)
        inner[bounds[1:] - 1] = False
        flat[inner] = self.ids.joined(numbers)
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray, whole: np.ndarray) -> None:
        """Parts in the order of their hashes, which are not known; whole: those that the rule may cut."""
        raw = [bytes(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        words = [r.decode().lower() if not w else r.decode() for r, w in zip(raw, whole.tolist())]
        lean = ~whole if len(self.last) else np.zeros(len(words), bool)
        plain = np.flatnonzero(lean)
        made, sizes = [], np.zeros(len(words), np.int64)
        order = np.concatenate([plain, np.flatnonzero(~lean)])
        for low in range(0, len(plain), ENCODED):
            some = plain[low : low + ENCODED]
            ids = np.array(self.lean.encode(" ".join([words[i] for i in some]), add_special_tokens=False).ids, np.uint32)
            sizes[some] = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
            made.append(ids)
        for low in range(len(plain), len(words), ENCODED):
            some = order[low : low + ENCODED]
            each = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False)]
            sizes[some] = [len(x) for x in each]
            made.append(np.array([i for x in each for i in x], np.uint32))
        known = len(self.parts.sizes)
        self.parts = self.parts.with_(Strings(_LOWER[np.frombuffer(b"".join([raw[i] for i in order]), np.uint8)], (ends - starts)[order]))
        self.ids = self.ids.with_(Strings(np.concatenate(made), sizes[order]))
        numbers = np.empty(len(words), np.int64)
        numbers[order] = known + np.arange(len(words))
        place = np.searchsorted(self.hashes, hashed)
        self.hashes, self.numbers = np.insert(self.hashes, place, hashed), np.insert(self.numbers, place, numbers)


_tokenizers: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    if path not in _tokenizers:
        _tokenizers[path] = TokenIds(path)
        settle()
    return _tokenizers[path]


def texts(data: np.ndarray, offsets: np.ndarray):
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield bytes(data[a:b]).decode()


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, carry=("doc_id",)) -> DataFrame:
    """(carry..., start, length, ids_crc32, doc_tokens): full windows of each document, and the rest of it."""

    def compute(data, offsets, batch):
        found = []
        for ids in token_ids(tokenizer).of(data, offsets):
            found.append([{"start": s, "length": min(capacity, len(ids) - s), "ids_crc32": zlib.crc32(ids[s : s + capacity].astype("<u4").tobytes()), "doc_tokens": len(ids)} for s in range(0, len(ids), capacity)])
        return [found]

    cut = annotate(docs, "pieces array<struct<start:long,length:long,ids_crc32:long,doc_tokens:long>>", compute, carry=carry)
    return cut.select(*carry, F.explode("pieces").alias("piece")).select(*carry, "piece.*")


def packed_pieces(cut: DataFrame, *, capacity: int = CAPACITY, order=("doc_id", "start", "ids_crc32")) -> DataFrame:
    """cut(length, ...) with sequence_id (from 0, without gaps) and offset: the place of each piece.

    Pieces of one length are ranked by a hash salt, then by ``order``; rows equal in all of that
    are interchangeable. Any piece longer than capacity is an error. No rows give no rows.
    """
    salts = F.when(F.col("length") == capacity, FULL_SALTS).otherwise(SALTS)
    cut = written(cut.withColumn("salt", F.pmod(F.xxhash64(*order), salts)), "pieces")
    counts = cut.groupBy("length", "salt").count()
    table = counts.toPandas()  # capacity * SALTS + FULL_SALTS rows at most
    histogram = {int(k): int(v) for k, v in table.groupby("length")["count"].sum().items()}
    if histogram and max(histogram) > capacity:
        raise ValueError("a piece is longer than a sequence")
    slots = cut.sparkSession.sparkContext.broadcast(Slots.of(plan(histogram, capacity)))
    base = table.sort_values(["length", "salt"])
    base["base"] = base.groupby("length")["count"].cumsum() - base["count"]
    bases = cut.sparkSession.sparkContext.broadcast(((base["length"] * FULL_SALTS + base["salt"]).to_numpy(), base["base"].to_numpy()))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)
    names = cut.columns

    def place(batches):
        for batch in batches:
            length, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "salt", "rank"))
            keys, first = bases.value
            sequence, offset = slots.value.find(length, rank + first[np.searchsorted(keys, length * FULL_SALTS + salt)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, c in enumerate(names) if c != "salt"), pa.array(sequence), pa.array(offset)], names=[*(c for c in names if c != "salt"), "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name != "salt")
    return ranked.select(*names, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, tokenizer: str | None = None, *, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the end id; a null or empty text is the end id alone. Each id lies
    in one piece; whole texts are packed. Repeated rows are packed as often as they occur.
    """
    return packed_pieces(pieces(docs, tokenizer or default_tokenizer(), capacity=capacity), capacity=capacity)


def op4_packing(spark, sf_dir):
    """A row for each piece of each document, with its place (see pack for nulls, empty texts and repeats)."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage_packing(spark, docs, sf_dir):
    """A row for each piece of the documents (see pack); the last stage, so that other columns end here."""
    return pack(docs.select("doc_id", "text"))
