"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule says good, bad or nothing of a text. Votes are counted over all documents by pattern
(3 ** rules patterns at most, whatever the corpus holds); expectation-maximisation on that table
estimates the share of good texts and each rule's accuracy; the posterior probability that a
text is good replaces all-must-pass filtering. The counts are one small shuffle; texts do not move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .annotate import annotate
from .grams import SPACE, segment_sums, shingles, word_hashes, words
from .scratch import veiled

#: The symbols that the base columns count.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages that the rules know.
FUNCTION_WORDS = "the of and to in that is was for with der die und das von den zu le la les des et que un une el los las de en y".split()
RULES = ("length", "word_size", "symbols", "duplicate_lines", "repeated_words", "upper_case", "exclamations", "function_words")

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS.encode())] = 1
_LEAD = np.array([0 if 0x80 <= b < 0xC0 else 1 for b in range(256)])  # one for each code point
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_LOWER = np.array([0x61 <= b <= 0x7A for b in range(256)])
_joined = np.frombuffer(" ".join(FUNCTION_WORDS).encode(), np.uint8)
_s, _e, _ = words(_joined, np.array([0, len(_joined)]))
_FUNCTION = np.sort(word_hashes(_joined, _s, _e))


def repeated_words(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> np.ndarray:
    """Of each text, how many words lie in n-word windows that the text has twice or more."""
    found, text, at = shingles(hashes, first, n)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(found):
        order = np.lexsort((found, text))
        f, t = found[order], text[order]
        same = (f[1:] == f[:-1]) & (t[1:] == t[:-1])
        twice = np.zeros(len(f), bool)
        twice[1:] |= same
        twice[:-1] |= same
        begin = at[order][twice]
        covered[begin] = 1
    recent = np.cumsum(covered[:-1])
    recent = recent - np.concatenate([np.zeros(min(n, len(recent)), np.int64), recent[:-n]])
    return segment_sums((recent > 0).astype(np.int64), np.diff(first))


def repeated_lines(text: str) -> tuple[int, int]:
    """(lines that equal an earlier line, lines), of those lines that have a word."""
    seen: set[str] = set()
    total = again = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            total += 1
            again += line in seen
            seen.add(line)
    return again, total


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, 2, np.where(good, 1, 0))


def measures(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the vote pattern of each text."""
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    sizes, n = np.diff(offsets), np.diff(first)
    space = SPACE[data]
    chars = segment_sums(_LEAD[data] * ~space, sizes)
    symbols = segment_sums(_SYMBOL[data], sizes)
    repeats = repeated_words(word_hashes(data, starts, ends, fold=False), first)
    lines = np.array([repeated_lines(bytes(data[a:b]).decode()) for a, b in zip(offsets[:-1], offsets[1:])]).reshape(-1, 2)
    upper, lower = segment_sums(_UPPER[data], sizes), segment_sums(_LOWER[data], sizes)
    loud = segment_sums((data[ends - 1] == ord("!")).astype(np.int64), n) if len(ends) else np.zeros(len(n), np.int64)
    common = segment_sums(np.isin(hashes, _FUNCTION).astype(np.int64), n)
    some = np.maximum(n, 1)
    votes = [
        _vote(n >= 20, n < 10),
        _vote((chars >= 3 * n) & (chars <= 10 * n), (chars < 2 * n) | (chars > 15 * n)),
        _vote(symbols <= 0.05 * n, symbols > 0.15 * n),
        _vote((lines[:, 0] == 0) & (lines[:, 1] > 1), lines[:, 0] > 0.3 * lines[:, 1]),
        _vote(repeats <= 0.05 * n, 100 * repeats > 20 * n),
        _vote(upper <= 0.2 * (upper + lower), upper > 0.5 * (upper + lower)),
        _vote(loud <= 0.05 * some, loud > 0.3 * some),
        _vote((common >= 2) & (common >= 0.04 * n), (n >= 50) & (common == 0)),
    ]
    pattern = sum(v * 3**i for i, v in enumerate(votes))
    return [n, chars, symbols, lines[:, 0], repeats, pattern]


def fit(patterns: np.ndarray, counts: np.ndarray, rules: int = len(RULES), rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good texts, accuracies, posterior of each pattern); accuracies: of each rule on good and on bad texts.

    A rule that speaks of a good text is right with its first accuracy, of a bad text with its
    second, independently of the other rules; how often it abstains tells nothing. The start takes
    texts with a bad vote for doubtful. First accuracies stay within 0.9 and 0.9999, second ones
    within 0.02 and 0.98 (a rule sees its own kind of fault only), so 'good' keeps its meaning.
    """
    votes = np.stack([patterns // 3**i % 3 for i in range(rules)], 1)
    good, bad = votes == 1, votes == 2
    posterior = np.where(bad.any(1), 0.2, 0.98)
    share, accuracies, total = 0.8, np.zeros((2, rules)), max(1, counts.sum())
    for _ in range(rounds):
        before = posterior
        share = float(np.clip((counts * posterior).sum() / total, 0.05, 0.98)) if len(counts) else share
        w = (counts * posterior)[:, None]
        v = (counts * (1 - posterior))[:, None]
        accuracies = np.stack(
            [
                np.clip(((good * w).sum(0) + 1) / (((good | bad) * w).sum(0) + 1.01), 0.9, 0.9999),
                np.clip(((bad * v).sum(0) + 0.2) / (((good | bad) * v).sum(0) + 1), 0.02, 0.98),
            ]
        )
        right, wrong = np.log(accuracies), np.log1p(-accuracies)
        for_good = np.log(share) + (good * right[0] + bad * wrong[0]).sum(1)
        for_bad = np.log1p(-share) + (bad * right[1] + good * wrong[1]).sum(1)
        posterior = 1 / (1 + np.exp(np.clip(for_bad - for_good, -700, 700)))
        if not len(posterior) or np.abs(posterior - before).max() < 1e-9:
            break
    return share, accuracies, posterior


def quality_rules(docs: DataFrame, *, text: str = "text", threshold: float = 0.5, carry=None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality and kept.

    quality: the posterior probability that the text is good; kept: it is at least ``threshold`` and
    base_failed is false. Words, counts and repeats are those of the whole text; words are
    equal if all their bytes are. A null text has no words, so that base_failed is true, as for
    empty and very short texts. Equal rows get equal verdicts; an empty table gives an empty table;
    input columns with the names of the new ones are replaced.
    """
    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, pattern int"
    scored = annotate(docs, added, lambda data, offsets, batch: measures(data, offsets), text=text, carry=carry)
    table = scored.groupBy("pattern").count().toPandas().sort_values("pattern")  # 3 ** rules rows at most
    patterns = table["pattern"].to_numpy(np.int64)
    _, _, posterior = fit(patterns, table["count"].to_numpy(np.int64))
    spark = docs.sparkSession
    verdicts = spark.createDataFrame(list(zip(patterns.tolist(), posterior.tolist())), "pattern int, quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        scored.drop("quality", "base_failed", "kept")
        .join(F.broadcast(verdicts), "pattern", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
        .drop("pattern")
    )


def op5_quality_rules(spark, sf_dir):
    """A row for each document: doc_id, its counts, base_failed, kept and quality (see quality_rules for nulls and repeats)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_rules(docs, carry=["doc_id"]).select("doc_id", *counts, "base_failed", "kept", "quality")


def stage_quality_rules(spark, docs, sf_dir):
    """The documents that the rules keep, with the columns they had, whatever the names of these.

    Null, empty and very short texts go; equal texts stay or go together; an empty table gives an empty one.
    """
    own, unveil = veiled(docs, ("text",))
    return unveil(quality_rules(own).filter("kept"))
