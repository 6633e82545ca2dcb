"""Toxicity by class-conditional Kneser-Ney models over the byte 5-grams of words.

Two models, one of toxic and one of ordinary texts, count the longer n-grams (3 to 5 symbols)
each for itself and back off to one shared model of the shorter ones, counted over both samples,
so that a rare expression is smoothed alike by both and speaks for neither. Contexts begin at a
word's start: what a word is matters, not in which language's order words come. A text's evidence
is the difference of its two log-likelihoods over its length; a logistic curve fitted to texts
that the models have not seen turns it into a score. The models are fitted on a bounded sample of
labelled rows and then carried to the tasks; counting is done in Spark, and texts are never
shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .annotate import annotate
from .grams import SPACE, byte_codes, segment_sums, sum_by, sums_by_text, tally, text_buffers, word_hashes, words
from .kneser_ney import ORDER, Level, lower_levels, mask, probability

SAMPLE_DOCS = 3000  # of each class
DAMPING = 32  # symbols without evidence that each text is taken to have, so that a few words prove little
SHARED = 2  # n-grams of so many symbols and fewer are counted over both classes


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, sizes): the byte n-grams of all words, each word for itself, and how many of them each text has.

    A-Z count as a-z. A word equal to the one before it is left out, so that a text of one word
    said a thousand times has the evidence of that word once.
    """
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    begin = first[:-1]
    fresh[begin[begin < len(hashes)]] = True
    sizes = ends - starts
    solid = data[~SPACE[data]]
    solid = solid[np.repeat(fresh, sizes)]
    solid = np.where((solid >= 0x41) & (solid <= 0x5A), solid + 32, solid).astype(np.uint8)
    own = sizes[fresh]
    codes = byte_codes(solid, np.concatenate([[0], np.cumsum(own)]), ORDER)
    return codes, segment_sums(np.where(fresh, sizes + 1, 0), np.diff(first))


def gram_counts(docs: DataFrame, by: str) -> DataFrame:
    """(by, code, n): how often each 5-gram occurs in the texts of each value of ``by``."""
    kind = docs.schema[by].dataType.simpleString()

    def run(batches):
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), object)
            for label in dict.fromkeys(labels.tolist()):
                data, offsets = text_buffers(batch.column(1).filter(pa.array(labels == label)))
                codes, n = tally(word_codes(data, offsets)[0])
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(codes), batch.schema.field(0).type), pa.array(codes.astype(np.int64)), pa.array(n)], names=[by, "code", "n"])

    return docs.select(by, "text").mapInArrow(run, f"{by} {kind}, code long, n long").groupBy(by, "code").agg(F.sum("n").alias("n"))


class Models:
    """evidence(codes): log probability under the toxic model less that under the ordinary one."""

    def __init__(self, toxic: tuple[np.ndarray, np.ndarray], ordinary: tuple[np.ndarray, np.ndarray]):
        self.shared = lower_levels(np.union1d(toxic[0], ordinary[0]))[:SHARED]
        self.own = [[Level(*sum_by(grams & mask(k), counts)) for k in range(SHARED + 1, ORDER + 2)] for grams, counts in (toxic, ordinary)]

    def evidence(self, codes: np.ndarray) -> np.ndarray:
        base = probability(codes, self.shared)
        found = []
        for levels in self.own:
            p = base
            for symbols, level in enumerate(levels, SHARED + 1):
                p = level.refine(p, codes, symbols)
            found.append(np.log(p))
        return found[0] - found[1]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """(slope, offset) of a logistic curve by Newton's method, with a small ridge."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    scale = max(float(np.std(x)), 1e-9)
    rows = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve(rows.T @ (rows * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), rows.T @ (weight * (y - p)) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0] / scale), float(w[1])


def _evidence(models):
    def compute(data, offsets, batch):
        codes, sizes = word_codes(data, offsets)
        return [sums_by_text(codes, sizes, models.value.evidence) / (sizes + DAMPING)]

    return compute


def fit(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS):
    """(models as a broadcast, slope, offset) from docs(doc_id, text) and labels(doc_id, toxic); None without both classes.

    Of each class at most ``sample_docs`` rows train, in the order of a hash of doc_id, and of
    ordinary ones twice as many as of toxic ones; a quarter of them fit the curve,
    weighed as the classes are among all labels. A doc_id with both labels counts as toxic; null labels are left out.
    """
    spark = docs.sparkSession
    one = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = []
    for c in (1, 0):
        limit = min(sample_docs, 2 * len(picked)) if picked else sample_docs
        picked += one.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", "toxic").collect()  # bounded
    if not picked:
        return None
    sample = spark.createDataFrame([(r[0], r[1]) for r in picked], "doc_id long, toxic int")
    texts = docs.filter("text IS NOT NULL").join(F.broadcast(sample), "doc_id").withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0)
    table = gram_counts(texts.filter("NOT held"), "toxic").toPandas().sort_values("code")
    by = [(x["code"].to_numpy(np.uint64), x["n"].to_numpy(np.int64)) for x in (table[table["toxic"] == 1], table[table["toxic"] == 0])]
    if not len(by[0][0]) or not len(by[1][0]):
        return None
    models = spark.sparkContext.broadcast(Models(*by))
    seen = annotate(texts.filter("held").select("toxic", "text"), "evidence double", _evidence(models), carry=["toxic"]).toPandas()
    y = seen["toxic"].to_numpy(float)
    there = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}  # two rows
    rarer = there.get(0, 1) / max(1, sum(r[1] == 0 for r in picked)) / (there.get(1, 1) / max(1, sum(r[1] == 1 for r in picked)))
    slope, offset = logistic(seen["evidence"].to_numpy(float), y, np.where(y == 1, 1.0, max(1.0, rarer)))
    return models, slope, offset


def toxicity(docs: DataFrame, fitted, *, threshold: float = 0.7, carry=None) -> DataFrame:
    """docs with evidence, score and predicted.

    evidence: log-likelihood ratio over the number of symbols; score: 0 to 1; predicted: 1 if the score is at
    least ``threshold``, else 0. A null text is scored as an empty one; an empty text has evidence
    0. Without models (no labelled rows of a class) every score is 0. Each row is scored alone, the
    whole text however long; equal rows get equal scores.
    """
    if fitted is None:
        base = docs.select(*[c for c in docs.columns if c not in ("evidence", "score", "predicted") and (carry is None or c in carry)])
        return base.select("*", F.lit(0.0).alias("evidence"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    models, slope, offset = fitted
    inner = _evidence(models)

    def compute(data, offsets, batch):
        (evidence,) = inner(data, offsets, batch)
        evidence = np.where(np.diff(offsets) == 0, 0.0, evidence)
        score = 1 / (1 + np.exp(-np.clip(slope * evidence + offset, -30, 30)))
        return [evidence, score, (score >= threshold).astype(np.int32)]

    return annotate(docs, "evidence double, score double, predicted int", compute, carry=carry)


def remainder(doc_id: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(n))


def op2_toxicity(spark, sf_dir):
    """A row for each document: doc_id, held_out, score, predicted, evidence (see toxicity for nulls, empty texts and repeats)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    fitted = fit(docs, labels.filter(remainder("doc_id", 3) != 1))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return toxicity(docs, fitted, carry=["doc_id"]).withColumn("held_out", held).select("doc_id", "held_out", "score", "predicted", "evidence")
