"""Language-model scoring by prediction by partial matching over bytes, and a unigram baseline.

The model is a trie of byte contexts of 0 to 4 symbols, trained on all texts of the training rows:
the counts of their 5-grams, START symbols before each text and one END after it. A symbol is
predicted in its longest context that training has seen; where the context has not seen the symbol,
its escape probability (method D: distinct symbols over twice the occurrences) is paid and
the next shorter context tried, without the symbols that the longer one has seen (symbol exclusion);
below the empty context every symbol not yet excluded is equally likely. Because a context's symbols
are among those of each of its suffixes, what is excluded depends on the next longer context only,
and the code length of a byte is a function of its 5-gram: it is computed once for each distinct
5-gram of the corpus, in shards by the end of the context, and joined to chunks of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import blocks, byte_codes, positions_in, runs, sum_by, sums_by_text, segment_sums, tally, text_buffers, word_hashes, words
from .kneser_ney import ORDER, mask
from .lookups import found_at, listed_keys, score_chunks, suffix_groups
from .scratch import written
from .toxicity import remainder

SYMBOLS = 255  # bytes and END; START is never predicted
_WORD = np.uint64(1 << 63)  # set in keys of words; a 5-gram has 40 bits


class _Trie:
    """Of one order: n-grams and counts, contexts with occurrences and distinct symbols."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts
        self.contexts, sizes = runs(grams >> np.uint64(8))
        first = np.cumsum(sizes) - sizes
        self.total = np.add.reduceat(counts, first) if len(grams) else np.zeros(0, np.int64)
        self.distinct = sizes

    def count(self, grams):
        at = positions_in(self.grams, grams)
        return np.where(at >= 0, self.counts[at] if len(self.counts) else 0, 0)

    def context(self, contexts):
        at = positions_in(self.contexts, contexts)
        known = at >= 0
        if not len(self.contexts):
            return known, np.zeros(len(at)), np.zeros(len(at))
        return known, np.where(known, self.total[at], 0), np.where(known, self.distinct[at], 0)


def tries(low: tuple[np.ndarray, np.ndarray], grams: np.ndarray, counts: np.ndarray, order: int = ORDER) -> list[_Trie]:
    """Tries for contexts of 0 to ``order`` symbols; those of 0 and 1 from ``low``, the corpus' 2-grams."""
    found = [_Trie(*sum_by(low[0] & mask(1), low[1])), _Trie(*low)]
    seen = counts > 0
    grams, counts = grams[seen], counts[seen]
    for symbols in range(3, order + 2):
        found.append(_Trie(*sum_by(grams & mask(symbols), counts)))
    return found


def log10_probability(codes: np.ndarray, levels: list[_Trie]) -> np.ndarray:
    """Of each 5-gram the log10 probability of its last symbol after the others."""
    out = np.zeros(len(codes))
    done = np.zeros(len(codes), bool)
    above = np.zeros(len(codes), bool)  # a longer context has been seen, and excludes its symbols
    for k in range(len(levels) - 1, -1, -1):
        trie = levels[k]
        grams = codes & mask(k + 1)
        known, total, distinct = trie.context(grams >> np.uint64(8))
        count = trie.count(grams)
        if k + 1 < len(levels):
            # What the next longer context has seen, counted in this one.
            longer = levels[k + 1]
            context = (codes & mask(k + 2)) >> np.uint64(8)
            need = np.unique(context[above & ~done])
            lost, gone = _excluded(need, longer, trie, k)
            at = positions_in(need, context)
            use = above & (at >= 0)
            total = np.where(use, total - lost[at] if len(need) else total, total)
            distinct = np.where(use, distinct - gone[at] if len(need) else distinct, distinct)
        live = known & ~done
        hit = live & (count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[hit] += np.log10((2 * count[hit] - 1) / (2 * total[hit]))
            miss = live & ~hit & (distinct > 0)
            out[miss] += np.log10(distinct[miss] / (2 * total[miss]))
        done |= hit
        above |= known
    seen = levels[0].distinct.sum() if len(levels[0].grams) else 0
    out[~done] -= np.log10(max(1, SYMBOLS - seen))
    return out


def _excluded(contexts: np.ndarray, longer: _Trie, trie: _Trie, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each context of the longer trie: the count in the shorter one of the symbols it has seen, and how many."""
    low = np.searchsorted(longer.grams, contexts << np.uint64(8))
    high = np.searchsorted(longer.grams, (contexts << np.uint64(8)) | np.uint64(255), "right")
    sizes = high - low
    at = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    counts = trie.count(longer.grams[at] & mask(symbols + 1))
    return segment_sums(counts, sizes), sizes


def _chunk_keys(texts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts): distinct 5-grams and words of the texts, and their counts in the training ones."""
    data, offsets = text_buffers(texts.column("text"))
    train = texts.column("train").combine_chunks().to_numpy(zero_copy_only=False)
    parts = []
    for low, high in blocks(offsets, 4 << 20):
        own = offsets[low : high + 1]
        piece, at = data[own[0] : own[-1]], own - own[0]
        use = train[low:high]
        for keys, sizes in ((byte_codes(piece, at, ORDER), np.diff(at) + 1), _word_keys(piece, at)):
            learned = np.repeat(use, sizes)
            k, n = tally(keys[learned])
            other = np.setdiff1d(keys[~learned], k)
            parts += [(k, n), (other, np.zeros(len(other), np.int64))]
    return sum_by(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _word_keys(data, offsets):
    starts, ends, first = words(data, offsets)
    return word_hashes(data, starts, ends) | _WORD, np.diff(first)


def lm_scores(docs: DataFrame, train, *, carry=()) -> DataFrame:
    """(doc_id, carry..., n_tokens, n_known, train_tokens, base_score, score) for each row of docs(doc_id, text, ...).

    train: a boolean column, true for rows to learn from. Tokens are the words, A-Z as a-z, and one
    end; base_score is their add-one unigram log10 probability, score the model's log10 probability
    of the text's bytes and its end. A null text is an empty one, which has one token. Rows with
    a null or repeated doc_id are rows like any other. Nothing learned: the unigram and the trie are
    empty, and each symbol costs log10 of 1 / SYMBOLS. Words are told apart by 64-bit hashes.
    """
    rows = docs.select("doc_id", "text", *carry, F.coalesce(train, F.lit(False)).alias("train"))
    listed = written(listed_keys(rows, _chunk_keys), "keys")
    counts = listed.groupBy("key").agg(F.sum("n").alias("n"))
    words_only, grams = F.col("key") < 0, F.col("key") >= 0
    row = listed.agg(F.sum(F.when(words_only, F.col("n"))).alias("tokens")).first()
    ends = rows.agg(F.count_if("train").alias("ends")).first()["ends"]
    size = counts.agg(F.count_if(words_only & (F.col("n") > 0)).alias("v"), F.count_if(grams).alias("g")).first()
    train_tokens = (row["tokens"] or 0) + ends
    distinct_tokens = size["v"] + (1 if ends else 0)
    pairs = counts.filter(grams & (F.col("n") > 0)).groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).toPandas().sort_values("pair")  # 65,536 rows at most
    low = (pairs["pair"].to_numpy(np.uint64), pairs["n"].to_numpy(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(low)

    def cost(table: pa.Table) -> pa.Table:
        keys, n = table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        return pa.table({"key": keys.astype(np.int64), "value": log10_probability(keys, tries(shared.value, keys, n))})

    costs = suffix_groups(counts.filter(grams), size["g"], ORDER).groupBy("part").applyInArrow(cost, "key long, value double")
    costs = costs.unionByName(counts.filter(words_only).select("key", F.col("n").cast("double").alias("value")))
    values = listed.select("chunk", "key").join(costs, "key")
    known_end = 1 if ends else 0
    scale = float(train_tokens + distinct_tokens + 1)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name == "doc_id" or f.name in carry)

    def score(texts: pa.Table, keys: np.ndarray, values: np.ndarray) -> pa.Table:
        data, offsets = text_buffers(texts.column("text"))
        split = int(np.searchsorted(keys, _WORD))
        gram_keys, gram_values, word_keys, word_counts = keys[:split], values[:split], keys[split:], values[split:]
        word_logs = np.log10((word_counts + 1) / scale)
        found = []
        for a, b in blocks(offsets):
            own = offsets[a : b + 1]
            piece, at = data[own[0] : own[-1]], own - own[0]
            codes, sizes = byte_codes(piece, at, ORDER), np.diff(at) + 1
            bits = sums_by_text(codes, sizes, lambda c: gram_values[found_at(gram_keys, c)])
            own_words, n = _word_keys(piece, at)
            place = found_at(word_keys, own_words)
            found.append((n + 1, segment_sums((word_counts[place] > 0).astype(np.int64), n) + known_end, segment_sums(word_logs[place], n) + np.log10((ends + 1) / scale), bits))
        n, known, base, bits = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(4))
        return pa.table([*(texts.column(c) for c in ["doc_id", *carry]), pa.array(n), pa.array(known), pa.array(np.full(len(n), train_tokens)), pa.array(base), pa.array(bits)], names=["doc_id", *carry, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score_chunks(rows, values, score, f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_scoring(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    return lm_scores(docs.withColumn("held_out", held), ~F.col("held_out"), carry=["held_out"])
