"""Array kernels for text columns: words, word shingles and byte n-grams of many texts at once.

Each function works on one Arrow column slice held by a task: the UTF-8 bytes of its texts
end to end, and their offsets. Spark partitions, shuffles and joins; these only replace
per-character Python loops. Words are runs of bytes outside ``\\x20 \\x09-\\x0D``. A null text is an empty text. Words and shingles go by 64-bit hashes that depend on
nothing but the words, so they can be compared between tasks. A-Z count as a-z unless a caller
says otherwise.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Arrow's own allocator keeps what it has freed; what comes from the C library's can be given back (see settle).
pa.set_memory_pool(pa.system_memory_pool())

BLOCK_BYTES = 1 << 20
START, END = 0xFE, 0xFF  # never part of UTF-8

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(0x5EED)
_PLAIN = _rng.integers(0, 2**64, 256, np.uint64)
_FOLD = _PLAIN.copy()
_FOLD[ord("A") : ord("Z") + 1] = _FOLD[ord("a") : ord("z") + 1]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = _rng.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_power = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        _power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _STEP))])
    return _power


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def settle() -> None:
    """Gives back what freed arrays still hold: a Python worker outlives its task, and what it holds counts beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone
    if trim is not None:
        trim(0)


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together (a longer text is a range of its own)."""
    low, last = 0, len(offsets) - 1
    while low < last:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, last)
        low = min(high, last)


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of the words, and of each text its first word's number. apart: which bytes are in no word."""
    solid = ~apart[data]
    begin, stop = solid.copy(), solid.copy()
    if len(data):
        begin[1:] &= ~solid[:-1]
        stop[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        left = inner[inner < len(data)]
        begin[left] = solid[left]
        right = inner[inner > 0] - 1
        stop[right] = solid[right]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, apart: np.ndarray = SPACE) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z unless fold is false. The words must be all of those in ``data``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    solid = data[~apart[data]]
    place = np.arange(len(solid)) - np.repeat(first, sizes)
    return mix(np.add.reduceat((_FOLD if fold else _PLAIN)[solid] * _powers(int(sizes.max()))[place], first) + sizes.astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, word): each run of n words of a text, the text's number, its first word's number."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += hashes[j : m + j] * _ODD[j]
    at = np.flatnonzero(text[:m] == text[n - 1 :])
    return mix(out[at]), text[at], at


def byte_codes(data: np.ndarray, offsets: np.ndarray, order: int = 4) -> np.ndarray:
    """For each byte of each text and the end after it: the ``order`` symbols before it and itself, as one integer.

    Before a text stand START symbols, after it one END; a text of n bytes has n + 1 codes.
    """
    n = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64)
    total = int(offsets[-1]) + n * (order + 1)
    shift = np.arange(n) * (order + 1) + order
    symbols = np.full(total, START, np.uint8)
    symbols[np.arange(int(offsets[-1])) + np.repeat(shift, np.diff(offsets))] = data
    symbols[offsets[1:] + shift] = END
    codes = np.zeros(total - order, np.uint64)
    for j in range(order + 1):
        codes = (codes << np.uint64(8)) | symbols[j : total - order + j]
    return codes[symbols[order:] != START]


def tally(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and their counts."""
    codes = np.sort(codes)
    return runs(codes)


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of an ordered array, and their counts."""
    if not len(ordered):
        return ordered, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[new], np.diff(np.append(new, len(ordered)))


def sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(counts, new)


def placed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes, counts, places): codes under 2**40, at most 2**24 of them in one call."""
    assert len(codes) <= 1 << 24
    keyed = (codes << np.uint64(24)) | np.arange(len(codes), dtype=np.uint64)
    keyed.sort()
    distinct, counts = runs(keyed >> np.uint64(24))
    return distinct, counts, (keyed & np.uint64(0xFFFFFF)).astype(np.int64)


def sums_by_text(codes: np.ndarray, sizes: np.ndarray, value) -> np.ndarray:
    """Of each text the sum of value(code) over its codes; value is called once for all distinct codes of a piece."""
    if not len(codes):
        return np.zeros(len(sizes))
    out = np.empty(len(codes))
    for low in range(0, len(codes), 1 << 24):
        piece = codes[low : low + (1 << 24)]
        distinct, counts, places = placed(piece)
        part = np.empty(len(piece))
        part[places] = np.repeat(value(distinct), counts)
        out[low : low + len(piece)] = part
    return segment_sums(out, sizes)


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values; an empty run sums to 0."""
    out = np.zeros(len(sizes), values.dtype if values.dtype != bool else np.int64)
    some = sizes > 0
    if some.any():
        first = np.cumsum(sizes) - sizes
        out[some] = np.add.reduceat(values, first[some], dtype=out.dtype)
    return out


def positions_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands in an ordered table, -1 where it does not."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)
