"""Ranked lexical search of many queries at once, with shared parts of the queries evaluated once.

Queries (items) are sets of terms. Terms that the very same items have form one class, and pairs of
classes or earlier pairs that several items share become nodes too, the most shared first, until no
two items share a pair: a directed graph in which every item is a sum of few nodes. For a slice of documents each node
has one accumulator, a score for each document; it is made once, from its two parts, whatever number
of items use it, and an item's scores are the sum of its nodes' accumulators.

Documents stay in their tasks: a pass counts document frequencies of the items' terms and lengths,
another scores slices and keeps each item's best ``k`` of the task; only those are shuffled, and
ranked in two steps, so that no group holds more than its share of tasks. Items go in blocks of
about BLOCK_TERMS terms, each with two passes of its own; what a pass carries to the tasks is a block.
All arithmetic after the weights is in 64-bit integers, so results are the same however rows are dealt.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .annotate import annotate
from .grams import blocks, positions_in, segment_sums, settle, sum_by, tally, text_buffers, word_hashes, words

#: Bytes that are in no term, and the constants of the score.
APART = np.zeros(256, bool)
APART[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
SCALE, TF_UNIT, LENGTH_UNIT, HALF = 1_000_000_000, 1000, 20, 50

TOP = 50
BLOCK_TERMS = 50_000  # of items that one pass over the documents looks for
GROUPS = 256  # in which the tasks' best are ranked first
SLICE_BYTES = 1 << 20
_MAX = np.iinfo(np.int64).max


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): a 64-bit hash of each term, A-Z as a-z, and of each text its first term's number."""
    starts, ends, first = words(data, offsets, APART)
    return word_hashes(data, starts, ends, apart=APART), first


class SharedSums:
    """A graph of sums: ``classes`` groups of terms, ``pairs`` of earlier nodes, and of each item its nodes."""

    def __init__(self, items: list[np.ndarray], terms: int):
        """items: of each item its distinct terms' numbers, below ``terms``."""
        holders: dict[int, list[int]] = defaultdict(list)
        for q, own in enumerate(items):
            for t in own.tolist():
                holders[t].append(q)
        number: dict[tuple[int, ...], int] = {}
        self.of_term = np.array([number.setdefault(tuple(holders[t]), len(number)) for t in range(terms)], np.int64)
        self.classes = len(number)
        nodes: list[set[int]] = [set() for _ in items]
        for held, c in number.items():
            for q in held:
                nodes[q].add(c)
        self.pairs: list[tuple[int, int]] = []
        self._share(nodes)
        self.nodes = [np.array(sorted(x), np.int64) for x in nodes]

    def _share(self, nodes: list[set[int]]) -> None:
        counts: Counter = Counter()
        for own in nodes:
            ordered = sorted(own)
            counts.update((a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :])
        heap = [(-n, pair) for pair, n in counts.items() if n > 1]
        heapq.heapify(heap)
        where: dict[int, set[int]] = defaultdict(set)
        for q, own in enumerate(nodes):
            for x in own:
                where[x].add(q)
        while heap:
            n, (a, b) = heapq.heappop(heap)
            both = where[a] & where[b]
            if len(both) < 2:
                continue
            if len(both) < -n:  # an earlier node took some of these items
                heapq.heappush(heap, (-len(both), (a, b)))
                continue
            new = self.classes + len(self.pairs)
            self.pairs.append((a, b))
            beside: Counter = Counter()
            for q in both:
                nodes[q] -= {a, b}
                beside.update(nodes[q])
                nodes[q].add(new)
            where[a] -= both
            where[b] -= both
            where[new] = both
            for other, m in beside.items():
                if m > 1:
                    heapq.heappush(heap, (-m, (other, new)))

    def scores(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """(items x docs): each item's sum of the values (term, doc, value) of its terms."""
        made = np.zeros((self.classes + len(self.pairs), docs), np.int64)
        keys, sums = sum_by(self.of_term[term] * docs + doc, value)
        made.ravel()[keys] = sums
        for i, (a, b) in enumerate(self.pairs, self.classes):
            np.add(made[a], made[b], out=made[i])
        return np.stack([made[own].sum(axis=0) for own in self.nodes])


class Block:
    """A block of items: their terms in order, and the graph of their sums."""

    def __init__(self, items: list[np.ndarray]):
        self.terms = np.unique(np.concatenate([*items, np.zeros(0, np.uint64)]))
        self.sums = SharedSums([np.searchsorted(self.terms, x) for x in items], len(self.terms))
        self.size = len(items)

    def counted(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(term, doc, tf, n): occurrences of the block's terms by document, and each document's number of terms of any kind."""
        hashes, first = terms_of(data, offsets)
        n = np.diff(first)
        at = positions_in(self.terms, hashes)
        some = at >= 0
        codes, tf = tally(np.repeat(np.arange(len(n)), n)[some] * len(self.terms) + at[some])
        return codes % max(1, len(self.terms)), codes // max(1, len(self.terms)), tf, n


def query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, terms): distinct terms of each item, as hashes."""

    def compute(data, offsets, batch):
        hashes, first = terms_of(data, offsets)
        return [[np.unique(hashes[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:])]]

    own = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    return annotate(own, "terms array<long>", compute, carry=["item_id"])


def statistics(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """(N, L, df): documents with a term, their terms, and of each of the block's terms the documents that have it; docs(text)."""

    def run(batches):
        df, n_docs, total = np.zeros(len(block.terms), np.int64), 0, 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for low, high in blocks(offsets, SLICE_BYTES):
                term, _, _, n = block.counted(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                df += np.bincount(term, minlength=len(df))
                n_docs, total = n_docs + int((n > 0).sum()), total + int(n.sum())
        some = np.flatnonzero(df)
        keys, counts = np.concatenate([[-2, -1], some]), np.concatenate([[n_docs, total], df[some]])
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["key", "n"])
        settle()

    found = {r["key"]: r["n"] for r in docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the block
    df = np.array([found.get(i, 0) for i in range(len(block.terms))], np.int64)
    return found.get(-2, 0), found.get(-1, 0), df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def length_marks(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """A document's m by its number of terms; in Python's integers where 64 bits could overflow."""
    if len(n) and int(n.max()) * n_docs * HALF > _MAX:
        return np.array([100 - HALF + HALF * x * n_docs // total for x in n.tolist()], np.int64)
    return 100 - HALF + HALF * n * n_docs // total


class _Best:
    """The best k of each item so far: highest score, then lowest id, nulls last."""

    def __init__(self, items: int, k: int):
        self.k, self.held = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(items)]
        self.least = np.zeros(items, np.int64)  # a score below this is not among the best

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        some = (scores > 0) & (scores >= self.least[:, None])
        for q in np.flatnonzero(some.any(axis=1)):
            at = np.flatnonzero(some[q])
            s, i, z = (np.concatenate(x) for x in zip(self.held[q], (scores[q, at], ids[at], nulls[at])))
            order = np.lexsort((i, z, -s))[: self.k]
            self.held[q] = s[order], i[order], z[order]
            if len(order) == self.k:
                self.least[q] = s[order[-1]]

    def batch(self, group: int) -> pa.RecordBatch:
        sizes = [len(s) for s, _, _ in self.held]
        s, i, z = (np.concatenate([h[j] for h in self.held]) for j in range(3))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()), pa.array(s), pa.array(i, mask=z), pa.array(np.full(len(s), group), pa.int32())], names=["item", "score", "doc_id", "group"])


def _ranked(block: Block, docs: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of docs(doc_id, text); item: the number in the block."""
    n_docs, total, df = statistics(docs.select("text"), block)
    weight = weights(n_docs, df)

    def run(batches):
        best = _Best(block.size, k)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            for low, high in blocks(offsets, SLICE_BYTES):
                term, doc, tf, n = block.counted(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                if len(term):
                    value = weight[term] * (SCALE * tf // (TF_UNIT * tf + LENGTH_UNIT * length_marks(n, n_docs, total)[doc]))
                    best.add(block.sums.scores(term, doc, value, high - low), ids[low:high], nulls[low:high])
        yield best.batch(TaskContext.get().partitionId() % GROUPS)
        settle()

    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = docs.select("doc_id", "text").mapInArrow(run, "item int, score long, doc_id long, group int")
    for keys in (["item", "group"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return found.select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, *, item_id: str = "item_id", item_text: str = "text", k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): of each of items its k best of docs(doc_id, text) with a score over 0, or all if fewer.

    Null, empty and term-less texts of either side find nothing and are not found. Equal scores go by ascending doc_id, null last; rows
    repeated in docs are documents of their own, and rows repeated in items are items of their own. An item
    of any length is evaluated whole. Other columns of either table are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    asked = query_terms(items, item_id, item_text).filter("size(terms) > 0")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_terms))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = asked.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for b in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("terms"), F.lit(n_blocks)) == b).collect()  # a block, or one longer item
        if rows:
            found = _ranked(Block([np.array(r["terms"], np.int64).view(np.uint64) for r in rows]), docs, k)
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind.simpleString()}")
            out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_lexical_search(spark, sf_dir):
    """Each benchmark item's 50 best documents."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    return search(docs, items)


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP13_SQL = f"""WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
q AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS}) AS terms FROM benchmark WHERE text IS NOT NULL),
sizes AS (SELECT doc, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
totals AS (SELECT count(*)::bigint AS docs, sum(n)::bigint AS total FROM sizes),
asked AS (SELECT item, item_id, unnest(terms) AS term FROM q),
held AS (SELECT doc, term, count(*)::bigint AS tf FROM (SELECT doc, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weighed AS (SELECT term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM held, totals GROUP BY term, docs),
marked AS (SELECT doc, doc_id, {100 - HALF} + ({HALF} * n * docs) // total AS m FROM sizes, totals),
scored AS (SELECT item, item_id, doc, doc_id, sum(w * (({SCALE} * tf) // ({TF_UNIT} * tf + {LENGTH_UNIT} * m)))::bigint AS score
  FROM asked JOIN held USING (term) JOIN weighed USING (term) JOIN marked USING (doc) GROUP BY item, item_id, doc, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST)::int AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
