"""Benchmark decontamination: size-partitioned MinHash containment search for test items inside documents.

Items and documents are sets of hashed 5-word shingles. Items are partitioned by size, each class
at most sqrt(2) times as wide as it is narrow. For a class whose largest item has u shingles, a
document is cut into blocks of u/2 shingles, and three blocks in a row make a window, so that any
passage as long as an item lies in one window and makes up about half of it or more: containment
in the document becomes a Jaccard similarity that MinHash can see. A window and an item that
agree on any of ``hashes`` minima are a candidate; it is verified by the exact share of the item's
shingles that the whole document holds.

An item of 0.8 containment at the narrow end of its class has a similarity of 0.34 to its window at
least; 20 minima miss it with probability 2e-4, and an unchanged item with 3e-6. Whole texts are searched, whatever their length.
Documents never move: items do, in blocks of bounded size. All blocks are in one plan, so the benchmark
(not the corpus) has to fit the driver and each task.

An item of fewer than five words is one shingle of all its words, looked for among the runs of as many words of
each text: its set has one member, whose minimum is the member itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .annotate import annotate
from .grams import positions_in, shingles, text_buffers, word_hashes, words
from .scratch import veiled

SHINGLE = 5
ITEM_BLOCK_BYTES = 8 << 20  # of item text that one pass over the documents carries to the tasks
_MINIMA = np.random.default_rng(10).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BITS = 20
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


class _SizeClass:
    """Items of about one size: which shingle sets, and their minima for each hash function."""

    def __init__(self, members: list[int], sets: list[np.ndarray], hashes: int):
        self.half = max(1, (max(len(sets[i]) for i in members) + 1) // 2)
        self.bits = min(_BITS, len(members).bit_length() + 7)  # tables of 128 places an item or more; each class and hash function has one
        self.tables = []
        for k in range(hashes):
            minima = np.array([(sets[i] * _MINIMA[k]).min() for i in members], np.uint64)
            order = np.argsort(minima, kind="stable")
            seen = np.zeros(1 << self.bits, bool)
            seen[_slot(minima, self.bits)] = True
            self.tables.append((minima[order], np.array(members)[order], seen))


def _slot(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def _item_sets(column) -> list[np.ndarray]:
    data, offsets = text_buffers(column)
    starts, ends, first = words(data, offsets)
    found, item, _ = shingles(word_hashes(data, starts, ends), first, SHINGLE)
    bounds = np.searchsorted(item, np.arange(len(offsets)))
    return [np.unique(found[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _short_items(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(words, shingles in order, their items) for items of one to four words, by their length."""
    data, offsets = text_buffers(column)
    starts, ends, first = words(data, offsets)
    hashes, out = word_hashes(data, starts, ends), []
    for n in range(1, SHINGLE):
        found, item, _ = shingles(hashes, first, n)
        exact = np.diff(first)[item] == n
        order = np.argsort(found[exact], kind="stable")
        if len(order):
            out.append((n, found[exact][order], item[exact][order]))
    return out


def _short_leaks(hashes: np.ndarray, first: np.ndarray, short: list) -> set[tuple[int, int]]:
    """(text, item): short items whose words the text has in a row."""
    pairs: set[tuple[int, int]] = set()
    for n, table, items in short:
        found, owner, _ = shingles(hashes, first, n)
        at = positions_in(table, found)
        for text, key in set(zip(owner[at >= 0].tolist(), found[at >= 0].tolist())):
            a, b = np.searchsorted(table, np.array([key], table.dtype), "left")[0], np.searchsorted(table, np.array([key], table.dtype), "right")[0]
            pairs.update((text, int(i)) for i in items[a:b])
    return pairs


def size_classes(sets: list[np.ndarray], hashes: int) -> list[_SizeClass]:
    members: dict[int, list[int]] = {}
    for i, x in enumerate(sets):
        if len(x):
            members.setdefault(math.ceil(2 * math.log2(len(x)) - 1e-9), []).append(i)
    return [_SizeClass(m, sets, hashes) for _, m in sorted(members.items())]


def candidates(found: np.ndarray, text: np.ndarray, classes: list[_SizeClass]) -> set[tuple[int, int]]:
    """(text, item) pairs of which a window of the text and the item share a minimum."""
    pairs: set[tuple[int, int]] = set()
    if not len(found) or not classes:
        return pairs
    place = np.arange(len(text)) - np.searchsorted(text, text)
    cuts = []
    for c in classes:
        cut = np.flatnonzero(place % c.half == 0)
        owner = text[cut]
        cuts.append((cut, owner, [owner[step:] == owner[:-step] for step in (1, 2)]))
    for k in range(len(classes[0].tables)):
        hashed = found * _MINIMA[k]
        for (cut, owner, same), c in zip(cuts, classes):
            lows = np.minimum.reduceat(hashed, cut)
            window = lows.copy()
            for step in (1, 2):
                np.minimum(window[:-step], lows[step:], out=window[:-step], where=same[step - 1])
            minima, items, seen = c.tables[k]
            some = np.flatnonzero(seen[_slot(window, c.bits)])
            for w in some[positions_in(minima, window[some]) >= 0]:
                a, b = np.searchsorted(minima, window[w], "left"), np.searchsorted(minima, window[w], "right")
                pairs.update((int(owner[w]), int(i)) for i in items[a:b])
    return pairs


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, hashes: int = 20, carry=None) -> DataFrame:
    """docs with a column ``leaks``: for each test item that the text contains, item, shared, size and containment.

    Item: benchmark's ``item_id``; shared: of the item's ``size`` distinct 5-word shingles those that the
    text has; containment: their share, at least ``threshold``. Items come in order of item_id.
    An item of one to four words is one shingle of them all. Null and empty texts, and null and empty items, have no leaks. Rows repeated in
    either table are kept as they are: each document row is judged alone, and an item in the table
    twice is reported twice. Either table may be empty. docs' other columns are kept; one that is
    called leaks is replaced, and no column may be called "leaks of blocks before".
    """
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("body"))
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    passes = max(1, math.ceil(1.5 * total / ITEM_BLOCK_BYTES))
    kind = items.schema["item"].dataType.simpleString()
    added = f"leaks array<struct<item:{kind},shared:int,size:int,containment:double>>"
    for part in range(passes):
        block = items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(passes)) == part).orderBy("item", "body").toArrow()
        ids, sets, short = block.column(0).to_pylist(), _item_sets(block.column(1)), _short_items(block.column(1))

        def compute(data, offsets, batch, ids=ids, sets=sets, short=short, made=[]):
            if not made:
                made.append(size_classes(sets, hashes))
            starts, ends, first = words(data, offsets)
            hashed = word_hashes(data, starts, ends)
            found, owner, _ = shingles(hashed, first, SHINGLE)
            leaks: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
            for d, i in sorted(candidates(found, owner, made[0])):
                a, b = np.searchsorted(owner, [d, d + 1])
                shared = int(np.isin(sets[i], found[a:b]).sum())
                if shared >= threshold * len(sets[i]):
                    leaks[d].append({"item": ids[i], "shared": shared, "size": len(sets[i]), "containment": shared / len(sets[i])})
            for d, i in sorted(_short_leaks(hashed, first, short)):
                leaks[d].append({"item": ids[i], "shared": 1, "size": 1, "containment": 1.0})
            for found_in in leaks:
                found_in.sort(key=lambda x: (x["item"] is not None, x["item"]))
            return [leaks]

        if part == 0:
            docs = annotate(docs, added, compute, text=text, carry=carry if passes == 1 else None)
        else:
            kept = docs.withColumnRenamed("leaks", "leaks of blocks before")
            docs = annotate(kept, added, compute, text=text).withColumn("leaks", F.array_sort(F.concat("`leaks of blocks before`", "leaks"))).drop("leaks of blocks before")
    return docs if passes == 1 or carry is None else docs.select(*[c for c in docs.columns if c in carry or c == "leaks"])


def op10_decontamination(spark, sf_dir):
    """A row for each document and test item in it: doc_id, item_id, shared, size, containment."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", F.col("leak.item").alias("item_id"), "leak.shared", "leak.size", "leak.containment")


def stage_decontamination(spark, docs, sf_dir):
    """The documents that contain no test item, with the columns they had, whatever the names of these.

    Null and empty texts stay; equal texts stay or go together; an empty table gives an empty one.
    """
    own, unveil = veiled(docs, ("text",))
    return unveil(find_leaks(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(F.size("leaks") == 0))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

#: The exact containment that the search above is verified by, of all pairs.
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS k, item_id, {_WORDS} AS w FROM benchmark),
bs AS (SELECT DISTINCT k, item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least({SHINGLE}, len(w)) AS n FROM b WHERE len(w) > 0))),
ds AS (SELECT DISTINCT r, doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bs))),
sizes AS (SELECT k, count(*) AS size FROM bs GROUP BY k),
found AS (SELECT r, doc_id, k, item_id, count(*) AS shared FROM ds JOIN bs USING (n, s) GROUP BY r, doc_id, k, item_id)
SELECT doc_id, item_id, shared::INT AS shared, size::INT AS size, shared::DOUBLE / size AS containment
FROM found JOIN sizes USING (k) WHERE shared >= 0.8 * size
"""
