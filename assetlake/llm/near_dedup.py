"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF word shingles.

A text is the set of its 5-word shingles, each weighted by how often it occurs times its inverse
document frequency. Document frequencies are counted over all documents into DF_BUCKETS hashed
counters (one table of fixed size; a shingle's counter also holds what shares its bucket, a constant
part of the corpus, so weights behave alike at every size). Consistent weighted sampling draws from
each text BANDS x ROWS samples, two texts agreeing on each with the probability of their weighted
Jaccard similarity; texts that agree on all samples of a band are candidates, and candidates are
verified by the exact weighted Jaccard similarity of their whole texts.

Equal texts are collapsed before anything else, so copies cost one row each. Classes are the connected
components of all similar pairs that share a band: each such pair is compared, or its texts are of one
class already. Bands are taken in ROUNDS, and a round leaves out buckets that are of one class by then.
A bucket is dealt to tasks in blocks, each with HEADS texts that all its blocks have. A task compares the
texts of a block, all against all but those of one class; two texts can only be similar if they share one
of their rarest shingles (a prefix of a fifth of their weight), so texts that merely share a passage are
not compared at all. What buckets of several blocks still hold apart after the rounds is compared across blocks:
each text outside the bucket's largest class with each text of the bucket. Nothing per document reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .annotate import annotate
from .grams import blocks, mix, runs, segment_sums, settle, shingles, text_buffers, word_hashes, words
from .scratch import dropped, veiled, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 3
DF_BUCKETS = 1 << 18
BLOCK, BLOCK_BYTES = 1000, 4 << 20  # texts and their bytes that a task compares with each other, about
HEADS = 3
ROUNDS = ((0,), (1, 2, 3), tuple(range(4, BANDS)))  # bands of each
_DRAWS = 1 << 15
_r = np.random.default_rng(8)
_ODD = _r.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _draws():
    """For each sample a table of r, ln c and beta: r and c of the gamma distribution with shape 2."""
    rng = np.random.default_rng(88)
    size = (BANDS * ROWS, _DRAWS)
    return rng.gamma(2, 1, size).astype(np.float32), np.log(rng.gamma(2, 1, size)).astype(np.float32), rng.random(size, np.float32)


_tables: list = []


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, counts, how many distinct ones each text has): distinct shingles of each text, in order."""
    starts, ends, first = words(data, offsets)
    found, text, _ = shingles(word_hashes(data, starts, ends), first, SHINGLE)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    if not len(found):
        return found, np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (text[1:] != text[:-1])]))
    return found[new], np.diff(np.append(new, len(found))), np.bincount(text[new], minlength=len(offsets) - 1)


def _bucket(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - 18)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, counters): how many documents have a shingle of each bucket."""

    def run(batches):
        counts = np.zeros(DF_BUCKETS, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for low, high in blocks(offsets):
                at = offsets[low : high + 1]
                found, _, _ = features(data[at[0] : at[-1]], at - at[0])
                counts += np.bincount(_bucket(found), minlength=DF_BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])
        settle()

    table = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # DF_BUCKETS rows at most
    counters = np.zeros(DF_BUCKETS, np.int64)
    counters[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return docs.count(), counters


def inverse_frequencies(total: int, counters: np.ndarray) -> np.ndarray:
    """A logarithm of documents over those with the shingle and a hundredth of all, so that rare shingles weigh alike."""
    return np.log1p(max(1, total) / (np.maximum(counters, 1) + total / 100)).astype(np.float32)


def weights(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts * idf[_bucket(found)]


def bands(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, distinct shingles): BANDS keys of each text; meaningless for a text without shingles."""
    if not _tables:
        _tables.append(_draws())
    rs, lncs, betas = _tables[0]
    found, counts, sizes = features(data, offsets)
    keys = np.zeros((len(sizes), BANDS), np.uint64)
    some = sizes > 0
    if not some.any():
        return keys, sizes
    lnw = np.log(weights(found, counts, idf)).astype(np.float32)
    sizes_some = sizes[some]
    first = np.cumsum(sizes_some) - sizes_some
    sampled = np.zeros((int(some.sum()), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        at = ((found * _ODD[k]) >> np.uint64(64 - 15)).astype(np.int32)
        r, beta = rs[k][at], betas[k][at]
        t = np.floor(lnw / r + beta)
        cost = lncs[k][at] - r * (t - beta) - r
        least = np.minimum.reduceat(cost, first)
        ties = np.flatnonzero(cost == np.repeat(least, sizes_some))
        best = ties[np.searchsorted(ties, first)]  # of equal costs the smallest shingle's
        band = k // ROWS
        sampled[:, band] = mix(sampled[:, band] ^ found[best] ^ (mix(t[best].astype(np.int64).astype(np.uint64)) + _ODD[k]))
    keys[some] = sampled
    return keys, sizes


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts' (ordered shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    whole = float(a[1].sum() + b[1].sum()) - both
    return both / whole if whole > 0 else 0.0


def merged(found: np.ndarray, weight: np.ndarray, sizes: np.ndarray, labels: list, threshold: float) -> list[list]:
    """Labels that belong together, by texts (as of ``features``, with weights) that are similar enough; texts of a label do anyway.

    Small classes first: each text is compared with those not reached yet that have one of its prefix's shingles.
    """
    n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    _, ids, uses = np.unique(found, return_inverse=True, return_counts=True)
    order = np.lexsort((ids, uses[ids], owner))
    ids, weight, cuts = ids[order], weight[order], np.concatenate([[0], np.cumsum(sizes)])
    total, running = np.add.reduceat(weight, cuts[:-1]), np.concatenate([[0], np.cumsum(weight)])
    prefix = running[:-1] - running[cuts[:-1]][owner] <= (1 - threshold + 1e-6) * total[owner]
    own, own_cuts = ids[prefix], np.concatenate([[0], np.cumsum(np.bincount(owner[prefix], minlength=n))])
    by = np.argsort(own, kind="stable")
    having, bounds = owner[prefix][by], np.searchsorted(own[by], np.arange(len(uses) + 1))
    members: dict = {}
    for i, label in enumerate(labels):
        members.setdefault(label, []).append(i)
    fresh, left, dense, out = np.ones(n, bool), n, np.zeros(len(uses)), []
    for start in sorted(members, key=lambda x: len(members[x])):
        if not left:
            break
        if not fresh[members[start][0]]:
            continue
        group, at = [start], 0
        fresh[members[start]] = False
        left -= len(members[start])
        while at < len(group) and left:
            for y in members[group[at]]:
                shared = own[own_cuts[y] : own_cuts[y + 1]]
                many = bounds[shared + 1] - bounds[shared]
                near = having[np.arange(many.sum()) + np.repeat(bounds[shared] - np.cumsum(many) + many, many)]
                near = np.unique(near[fresh[near]])
                near = near[np.minimum(total[near], total[y]) >= (threshold - 1e-6) * np.maximum(total[near], total[y])]
                if not len(near):
                    continue
                mine, lengths = slice(cuts[y], cuts[y + 1]), sizes[near]
                first = np.cumsum(lengths) - lengths
                places = np.arange(lengths.sum()) + np.repeat(cuts[near] - first, lengths)
                dense[ids[mine]] = weight[mine]
                both = np.add.reduceat(np.minimum(dense[ids[places]], weight[places]), first)
                dense[ids[mine]] = 0
                for other in near[both / (total[y] + total[near] - both) >= threshold]:
                    if fresh[other]:
                        group.append(labels[other])
                        fresh[members[labels[other]]] = False
                        left -= len(members[labels[other]])
                if not left:
                    break
            at += 1
        if len(group) > 1:
            out.append(group)
    return out


def _merges(rows: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b): root a belongs to the class of root b, from rows(bucket, block, root, text), each block compared in one task."""

    def compare(table: pa.Table, starts: np.ndarray):
        data, offsets = text_buffers(table.column("text"))
        roots, low = table.column("root").to_pylist(), 0
        while low < len(starts) - 1:
            high = max(low + 1, int(np.searchsorted(offsets[starts], offsets[starts[low]] + BLOCK_BYTES, "right")) - 1)
            at = offsets[starts[low] : starts[high] + 1]
            found, counts, sizes = features(data[at[0] : at[-1]], at - at[0])
            w, cuts, base = weights(found, counts, idf.value), np.concatenate([[0], np.cumsum(sizes)]), starts[low]
            for x, y in zip(starts[low:high], starts[low + 1 : high + 1]):
                p, q, labels = cuts[x - base], cuts[y - base], roots[x:y]
                if y - x == 2:
                    half = cuts[x + 1 - base]
                    groups = [labels] if labels[0] != labels[1] and similarity((found[p:half], w[p:half]), (found[half:q], w[half:q])) >= threshold else []
                else:
                    groups = merged(found[p:q], w[p:q], sizes[x - base : y - base], labels, threshold)
                for group in groups:
                    least = min(group)
                    yield from ((label, least) for label in group if label != least)
            low = high

    def run(batches):
        tail = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if tail is None else pa.concat_tables([tail, table])
            if not table.num_rows:
                continue
            bucket, block = table.column("bucket").to_numpy(), table.column("block").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])) + 1])
            tail = table.slice(starts[-1])
            yield from told(compare(table.slice(0, starts[-1]), starts))
        if tail is not None:
            yield from told(compare(tail, np.array([0, tail.num_rows])))
        settle()

    def told(pairs):
        pairs = list(pairs)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

    dealt = rows.select("bucket", "block", "root", "text").repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    return written(dealt.mapInArrow(run, "a binary, b binary"), "merges")


def components(links: DataFrame) -> DataFrame:
    """(key, root): each linked key with the least key of its component.

    Each round gives a key the least root among its neighbours and then that root's own root, so
    that a chain of n links takes about log n rounds; the loop ends when no root changes.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    roots = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "key"), "roots")
    before = roots
    while True:
        near = both.join(roots.select(F.col("key").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near.withColumnRenamed("a", "key"), "key").select("key", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("key").alias("root"), F.col("root").alias("further"))
        after = written(step.join(jump, "root", "left").select("key", "old", F.least("root", "further").alias("root")), "roots")
        changed = not after.filter("old != root").isEmpty()
        dropped(before)
        before, roots = after, after.select("key", "root")
        if not changed:
            dropped(both)
            return roots


def _together(roots: DataFrame, merges: DataFrame) -> DataFrame:
    """roots(key, root) after merges(a, b) of them."""
    if merges.isEmpty():
        dropped(merges)
        return roots
    further = components(merges).select(F.col("key").alias("root"), F.col("root").alias("further"))
    after = written(roots.join(further, "root", "left").select("key", F.coalesce("further", "root").alias("root")), "roots")
    dropped(merges, roots)
    return after


def _sized(buckets: DataFrame) -> DataFrame:
    """buckets(bucket, band, key, bytes) of two keys and more, with the number of blocks that they are compared in."""
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    counts = buckets.groupBy("bucket").agg(F.count("*").alias("n"), parts.alias("parts")).filter("n > 1").drop("n")
    return buckets.join(counts, "bucket")


def _apart(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """buckets with roots, without those that are of one root."""
    rows = buckets.join(roots, "key")
    several = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    return rows.join(several, "bucket", "left_semi")


def _block(seed: int, parts):
    return F.pmod(F.xxhash64("key", "bucket", F.lit(seed)), parts).cast("int")


def _within(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(bucket, block, root, text): each text in its block, and the heads of a bucket of several blocks in all of them."""
    least = F.array(*(F.min(F.struct(F.xxhash64("key", "bucket", F.lit(i)), "key"))["key"] for i in range(HEADS)))
    heads = rows.filter("parts > 1").groupBy("bucket").agg(least.alias("heads"))
    every = F.array_contains("heads", F.col("key"))
    blocks_of = F.when(every, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_block(HEADS, F.col("parts"))))
    return rows.join(heads, "bucket", "left").select("bucket", "key", "root", blocks_of.alias("blocks")).join(texts, "key").select("bucket", F.explode("blocks").alias("block"), "root", "text")


def _across(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(bucket, block, root, text): blocks of texts outside their bucket's largest class, each with each block of the bucket's texts."""
    sizes = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("all"), F.sum("bytes").alias("all_bytes"), F.max(F.struct("n", "root", "bytes")).alias("most"))
    few = F.greatest(F.ceil((F.col("all") - F.col("most.n")) / BLOCK), F.ceil((F.col("all_bytes") - F.col("most.bytes")) / BLOCK_BYTES), F.lit(1)).cast("int")
    known = rows.join(largest.select("bucket", "main", few.alias("few")), "bucket").join(texts, "key")
    one, two = _block(HEADS + 1, F.col("few")), _block(HEADS, F.col("parts"))
    everywhere = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda i: i * F.col("parts") + two)
    outside = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: one * F.col("parts") + j)
    blocks_of = F.when(F.col("root") == F.col("main"), everywhere).otherwise(F.array_union(everywhere, outside))
    return known.select("bucket", F.explode(blocks_of).alias("block"), "root", "text")


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, key, class_id, class_key, class_size): a row for each row of docs(doc_id, text).

    key: the MD5 of the text. Rows of equal texts, and rows of texts linked by chains of verified
    links, are one class; class_id is its least doc_id (null if it has a null one), class_key the
    key of the row it belongs to. Texts of fewer than five words have no shingles: only equal ones
    are a class. A row with a null text is a class of its own: its class_id is its doc_id, its
    class_key null, its class_size 1. Repeated rows are rows of one class. An empty table gives none.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("key"))
    total, counters = document_frequencies(rows)
    idf = spark.sparkContext.broadcast(inverse_frequencies(total, counters))

    def sketch(data, offsets, batch):
        keys, sizes = bands(data, offsets, idf.value)
        return [[row.tolist() if n else [] for row, n in zip(keys.astype(np.int64), sizes)], np.diff(offsets)]

    sketches = written(annotate(rows, "bands array<long>, bytes long", sketch, carry=["doc_id", "key"]), "sketches")
    nodes = sketches.filter("key IS NOT NULL AND size(bands) > 0").groupBy("key").agg(F.first("bands").alias("bands"), F.first("bytes").alias("bytes"))
    spread = nodes.select("key", "bytes", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "band", "key", "bytes")
    buckets = written(_sized(spread), "buckets")
    needed = buckets.select("key").distinct()
    texts = rows.select("key", "text").join(needed, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    texts = written(texts, "texts")
    roots = written(needed.select("key", F.col("key").alias("root")), "roots")
    for some in ROUNDS:
        apart = _apart(buckets.filter(F.col("band").isin(*some)), roots)
        roots = _together(roots, _merges(_within(apart, texts), idf, threshold))
    apart = written(_apart(buckets.filter("parts > 1"), roots), "apart")
    if not apart.isEmpty():
        roots = _together(roots, _merges(_across(apart, texts), idf, threshold))
    dropped(apart, buckets, texts)
    joined = sketches.select("doc_id", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = joined.filter("key IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("rep"), F.count("*").alias("size"))
    return joined.join(classes, "root", "left").select(
        "doc_id", "key", F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("class_id"), F.col("rep.key").alias("class_key"), F.coalesce("size", F.lit(1)).alias("class_size")
    )


def op8_near_dedup(spark, sf_dir):
    """A row for each document: doc_id, class_id, class_size, and representative: it is the class's own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("key").eqNullSafe(F.col("class_key"))).alias("representative"))


def stage_near_dedup(spark, docs, sf_dir):
    """One document of each class, with the columns it had: the row of the least doc_id, and of equal such rows one.

    Rows with a null text stay; empty texts are equal texts; an empty table gives an empty one. Extra columns may have any names.
    """
    docs, unveil = veiled(docs, ("doc_id", "text"))
    found = near_duplicates(docs.select("doc_id", "text"))
    reps = found.filter("class_key IS NOT NULL").select(F.col("class_id").alias("rep_id"), F.col("class_key").alias("rep_key")).distinct()
    keyed = docs.withColumn("near_dedup_key", F.unhex(F.md5("text")))
    kept = keyed.filter("near_dedup_key IS NOT NULL").join(reps, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("near_dedup_key") == F.col("rep_key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "near_dedup_key"]).unionByName(keyed.filter("near_dedup_key IS NULL")).transform(unveil)
