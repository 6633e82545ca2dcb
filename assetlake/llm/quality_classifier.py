"""Quality by the perplexity of an interpolated modified Kneser-Ney model over byte 5-grams.

The model is trained on trusted texts: all rows labelled good but a fifth, which sets the thresholds. Which rows
train is found by a join of ids alone and goes to the scan's tasks as one bit a row. Counts are made
and joined in shards: each distinct 5-gram of the corpus gets its log-probability in a shard that
holds all n-grams with the same end of context, and goes back to the chunks of documents that have
it (see lookups). A text's perplexity is that of its bytes and its end. A text is kept if it is not
above its language's threshold, a quantile of the perplexities of all trusted texts that did not train.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grams import blocks, byte_codes, runs, sum_by, sums_by_text, tally, text_buffers
from .kneser_ney import ORDER, Level, SYMBOLS, continuations, count_of_counts, discounts, mask
from .lookups import found_at, listed_keys, score_chunks, suffix_groups
from .scratch import veiled, written

QUANTILE, ACCURACY = 0.995, 100_000  # the quantile's rank is right to one in ACCURACY
PRIOR = 25  # rows that the threshold of all languages counts for beside a language's own


def _sum(parts: list) -> tuple[np.ndarray, np.ndarray]:
    return sum_by(*(np.concatenate(x) for x in zip(*parts)))


def _merged(parts: list) -> list:
    """parts, the last ones added up as long as they are not smaller than those before them: what is held stays near the distinct keys."""
    while len(parts) > 1 and len(parts[-1][0]) >= len(parts[-2][0]):
        parts[-2:] = [_sum(parts[-2:])]
    return parts


def _listed(docs: DataFrame, learns: dict[int, tuple[int, bytes]]) -> DataFrame:
    """(chunk, key, n) of docs(text): of each chunk its distinct 5-grams, and how often the rows that learn have each."""
    shared = docs.sparkSession.sparkContext.broadcast(learns)

    def keys(rows: pa.Table):
        data, offsets = text_buffers(rows.column("text"))
        use = rows.column("learns").to_numpy()
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for low, high in blocks(offsets):
            at = offsets[low : high + 1]
            codes, learned = byte_codes(data[at[0] : at[-1]], at - at[0], ORDER), np.repeat(use[low:high], np.diff(at) + 1)
            k, times = tally(codes[learned])
            every = tally(codes)[0]
            n = np.zeros(len(every), np.int64)
            n[np.searchsorted(every, k)] = times
            parts = _merged([*parts, (every, n)])
        return _sum(parts)

    def marked(batches):
        n, bits = shared.value.get(TaskContext.get().partitionId(), (0, b""))
        use, at = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool), 0
        for batch in batches:
            own = use[at : at + batch.num_rows]
            at += batch.num_rows
            if len(own) == batch.num_rows:
                yield batch.append_column("learns", pa.array(own))
        if at != n:
            raise ValueError("the table was dealt out otherwise than before; store it first")

    return listed_keys(docs, keys, before=marked)


def _learning(docs: DataFrame, learned: DataFrame) -> dict[int, tuple[int, bytes]]:
    """Of each scan task of docs(doc_id) its number of rows, and a bit for each: whether learned(doc_id) has it."""

    def places(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), batch.column(0)], names=["part", "at", "doc_id"])
            at += n

    def bits(rows: pa.Table) -> pa.Table:
        use = np.zeros(rows.num_rows, bool)
        use[rows.column("at").to_numpy()] = rows.column("learns").to_numpy()
        return pa.table({"part": rows.column("part")[:1].cast(pa.int32()), "n": pa.array([len(use)], pa.int64()), "bits": pa.array([np.packbits(use).tobytes()], pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.mapInArrow(places, f"part int, at long, doc_id {kind}").join(learned.withColumn("learns", F.lit(True)), "doc_id", "left")
    rows = placed.select("part", "at", F.coalesce("learns", F.lit(False)).alias("learns")).groupBy("part").applyInArrow(bits, "part int, n long, bits binary")
    return {r.part: (r.n, bytes(r.bits)) for r in rows.toLocalIterator()}


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, n = table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _ladder(keys: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of 3, 4 and 5 symbols: a shard holds all that these need."""
    seen = counts > 0
    steps = [(keys[seen], counts[seen])]
    for symbols in (ORDER, ORDER - 1):
        steps.append(continuations(steps[-1][0], symbols))
    return steps[::-1]


def _statistics(table: pa.Table) -> pa.Table:
    """Counts of counts by n-gram size, and of each 2-gram how many symbols precede it."""
    ladder = _ladder(*_columns(table))
    kinds, keys, n = [], [], []
    for symbols, (_, counts) in enumerate(ladder, 3):
        for j, x in enumerate(count_of_counts(counts)):
            kinds.append(symbols), keys.append(j), n.append(int(x))
    pairs, before = continuations(ladder[0][0], 2)
    return pa.table({"kind": pa.array(kinds + [2] * len(pairs), pa.int32()), "key": pa.array(keys + pairs.astype(np.int64).tolist(), pa.int64()), "n": pa.array(n + before.tolist(), pa.int64())})


def gram_costs(listed: DataFrame) -> DataFrame:
    """(key, value): of each listed 5-gram the log-probability of its last symbol after the others."""
    counts = listed.groupBy("key").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    grouped = suffix_groups(counts, counts.count(), ORDER).groupBy("part")
    table = grouped.applyInArrow(_statistics, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toPandas()  # 65,548 rows at most
    pairs = table[table["kind"] == 2].sort_values("key")
    two = (pairs["key"].to_numpy(np.uint64), pairs["n"].to_numpy(np.int64))
    low = [Level(*continuations(two[0], 1)), Level(*two)]
    by = [discounts(table[table["kind"] == k].sort_values("key")["n"].to_numpy()) if len(two[0]) else None for k in (3, 4, 5)]
    shared = listed.sparkSession.sparkContext.broadcast((low, by))

    def cost(group: pa.Table) -> pa.Table:
        keys, n = _columns(group)
        lower, found = shared.value
        p = np.full(len(keys), 1 / SYMBOLS)
        for symbols, level in enumerate(lower, 1):
            p = level.refine(p, keys, symbols)
        for symbols, (grams, counts), d in zip((3, 4, 5), _ladder(keys, n), found):
            p = Level(grams, counts, d).refine(p, keys, symbols)
        return pa.table({"key": keys.astype(np.int64), "value": np.log(p)})

    return written(grouped.applyInArrow(cost, "key long, value double"), "costs")


def perplexities(docs: DataFrame, listed: DataFrame, costs: DataFrame) -> DataFrame:
    """docs with a column perplexity."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def score(rows: pa.Table, keys: np.ndarray, values: np.ndarray) -> pa.Table:
        data, offsets = text_buffers(rows.column("text"))
        found = [np.zeros(0)]
        for a, b in blocks(offsets):
            at = offsets[a : b + 1] - offsets[a]
            sizes = np.diff(at) + 1
            total = sums_by_text(byte_codes(data[offsets[a] : offsets[b]], at, ORDER), sizes, lambda c: values[found_at(keys, c)])
            found.append(np.exp(-total / sizes))
        return rows.append_column("perplexity", pa.array(np.concatenate(found)))

    return score_chunks(docs, listed.select("chunk", "key").join(costs, "key"), score, f"{kinds}, perplexity double")


def _shares(counts: DataFrame, total: int) -> DataFrame:
    """(lang, share) of counts(lang, count): the same number of rows for each language, and what some have not for the others, ``total`` in all; stored."""
    smaller = Window.orderBy("count", "lang")  # a row for each language
    rest = F.lit(total) - F.coalesce(F.sum("count").over(smaller.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # What is left after the smaller ones, dealt equally, is largest where the level settles.
    level = counts.select((rest / (F.count("*").over(Window.partitionBy()) - F.row_number().over(smaller) + 1)).alias("level")).agg(F.max("level")).first()[0]
    return written(counts.select("lang", F.least(F.lit(1.0), F.lit(float(level or 0)) / F.col("count")).alias("share")), "shares")


def _by_lang(df: DataFrame, table: DataFrame) -> DataFrame:
    """df with the columns of table(lang, ...), null languages being one language."""
    own = table.withColumnRenamed("lang", "_lang")
    return df.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")


_HELD = "pmod(xxhash64(doc_id, 5), 5) = 0"  # trusted rows that never train


def _trained(docs: DataFrame, trusted: DataFrame, sample_docs: int) -> np.ndarray:
    """doc_ids that train: about ``sample_docs`` at most, drawn by a hash within each language, none of a fifth of all."""
    able = docs.select("doc_id", "lang").join(trusted.filter(f"NOT {_HELD}"), "doc_id").distinct()
    drawn = _by_lang(able, _shares(able.groupBy("lang").count(), sample_docs)).filter(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    return np.array(sorted({r["doc_id"] for r in drawn.select("doc_id").collect()}), np.int64)  # bounded


def _thresholds(scored: DataFrame, held: DataFrame, quantile: float) -> DataFrame:
    """scored(doc_id, lang, perplexity, ...) with its language's threshold, set by the rows of held(doc_id): trusted ones that did not train.

    The logarithm of a language's own quantile and that of all languages' are averaged, weighted by its n rows and by PRIOR.
    """
    held = scored.join(held, "doc_id", "left_semi")
    cut = F.percentile_approx("perplexity", quantile, ACCURACY)
    every = held.agg(cut).first()[0]
    if every is None:
        return scored.withColumn("threshold", F.lit(None).cast("double"))
    by = held.groupBy("lang").agg(F.count("*").alias("n"), cut.alias("own"))
    own = F.exp((F.col("n") * F.log("own") + PRIOR * F.log(F.lit(every))) / (F.col("n") + PRIOR))
    by = written(by.select("lang", own.alias("threshold")), "thresholds")
    return _by_lang(scored, by).withColumn("threshold", F.coalesce("threshold", F.lit(every)))


def quality_classifier(docs: DataFrame, labels: DataFrame, *, sample_docs: int | None = None, quantile: float = QUANTILE, carry=None) -> DataFrame:
    """docs (or its columns in carry) with perplexity, threshold and keep.

    docs(doc_id, text, lang, ...) must be a stored table; labels(doc_id, quality): rows with
    quality 1 are trusted. A fifth of them, by a hash of doc_id, never train; all others do, unless a caller
    wants fewer: then about ``sample_docs`` at most, as many of each language as it has up to an equal part. All that did
    not train set the thresholds: of each language the ``quantile`` of their perplexities, drawn
    towards that of all languages as if by PRIOR rows more; null is a language, and one without such rows has that of
    all. keep: the text is not empty and its perplexity is within the
    threshold. A null or empty text is not kept. Nothing trusted: every text that is not empty is kept,
    and thresholds are null. Equal texts have equal perplexities. Columns with the names of the new ones are replaced.
    """
    new = ("perplexity", "threshold", "keep")
    docs = docs.drop(*new, "_lang")
    trusted = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    if sample_docs is None:
        learned, held = trusted.filter(f"NOT {_HELD}"), trusted.filter(_HELD)
    else:
        learned = docs.sparkSession.createDataFrame([(int(i),) for i in _trained(docs, trusted, sample_docs)], "doc_id long")
        held = trusted.join(learned, "doc_id", "left_anti")
    learns = _learning(docs.select("doc_id"), learned)
    listed = written(_listed(docs.select("text"), learns), "keys")
    costs = gram_costs(listed)
    names = docs.columns if carry is None else list(carry)
    inputs = docs.select(*dict.fromkeys([*names, "doc_id", "text", "lang"]))
    scored = perplexities(inputs, listed, costs).withColumn("some", F.coalesce(F.octet_length("text") > 0, F.lit(False)))
    scored = written(scored.select(*dict.fromkeys([*names, "doc_id", "lang"]), "some", "perplexity"), "scored")
    out = _thresholds(scored, held, quantile) if any(any(bits) for _, bits in learns.values()) else scored.withColumn("threshold", F.lit(None).cast("double"))
    out = out.withColumn("keep", F.col("some") & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return out.select(*names, *new)


def op9_quality_classifier(spark, sf_dir):
    """Each document's perplexity, its language's threshold and whether it is kept (see quality_classifier)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=["doc_id", "lang"])


def stage_quality_classifier(spark, docs, sf_dir):
    """The documents that the classifier keeps, with the columns they had, whatever the names of these; docs is a stored table.

    Null and empty texts go; equal texts of a language stay or go together; an empty table gives an empty one.
    """
    own, unveil = veiled(docs, ("doc_id", "text", "lang"))
    return unveil(quality_classifier(own, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("keep"))
