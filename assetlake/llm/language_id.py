"""Language identification by a byte convolutional network, trained in numpy on labelled text.

Bytes are embedded; filters of widths 2, 3 and 4 slide over fixed windows of WINDOW bytes; each
filter's maximum over the window goes through a softmax over the learned languages. A text is cut
into windows, all of which are scored; their log-probabilities, weighed by the bytes they hold, add
up to the text's. Training takes all windows of a bounded sample of labelled texts, as many for each
language; the network of a few thousand numbers goes to the tasks, and texts are never shuffled.

To apply the network, the embedding and the filters are folded into two tables over byte pairs, so
that a window's filters are two lookups and one addition for each place.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .annotate import annotate
from .grams import segment_sums, text_buffers
from .scratch import written
from .toxicity import remainder

WINDOW = 128
EMBED, FILTERS, WIDTHS = 8, 12, (2, 3, 4)
SAMPLE_DOCS = 150  # of each language, all windows of each
SAMPLE_ALL = 30_000  # of all languages
_LETTER = re.compile("[A-Za-z]")


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, bytes in each, windows of each text): texts cut into windows; zeros fill the last of each."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    first = np.cumsum(n) - n
    flat = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    flat[np.arange(int(offsets[-1])) + np.repeat(first * WINDOW - offsets[:-1], sizes)] = data
    held = np.full(int(n.sum()), WINDOW)
    last = (first + n - 1)[n > 0]
    held[last] = (sizes - (n - 1) * WINDOW)[n > 0]
    return flat.reshape(-1, WINDOW), held, n


class Network:
    def __init__(self, classes: int, seed: int = 7):
        r = np.random.default_rng(seed)
        wide = max(WIDTHS)
        self.embed = r.normal(0, 0.5, (256, EMBED))
        self.filters = r.normal(0, 0.3, (len(WIDTHS) * FILTERS, wide, EMBED))
        for i, w in enumerate(WIDTHS):
            self.filters[i * FILTERS : (i + 1) * FILTERS, w:] = 0
        self.live = self.filters != 0
        self.bias = np.zeros(len(self.filters))
        self.out = r.normal(0, 0.2, (len(self.filters), classes))
        self.out_bias = np.zeros(classes)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What the filters make of the byte pairs at their places 0, 1 and at 2, 3."""
        each = np.einsum("be,fwe->wbf", self.embed, self.filters)
        pairs = [(each[k][:, None] + each[k + 1][None]).reshape(65536, -1).astype(np.float32) for k in (0, 2)]
        return pairs[0], pairs[1]

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 4e-3) -> None:
        r = np.random.default_rng(17)
        names = ("embed", "filters", "bias", "out", "out_bias")
        moments = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in names}
        step, wide, places = 0, max(WIDTHS), WINDOW - max(WIDTHS) + 1
        for _ in range(epochs):
            order = r.permutation(len(windows))
            for low in range(0, len(order), batch):
                x, y = windows[order[low : low + batch]].astype(np.int64), labels[order[low : low + batch]]
                rows = np.arange(len(x))
                e = self.embed[x]
                patches = np.lib.stride_tricks.sliding_window_view(e, wide, 1).transpose(0, 1, 3, 2).reshape(len(x) * places, -1)
                scores = (patches @ self.filters.reshape(len(self.filters), -1).T).reshape(len(x), places, -1)
                top = scores.argmax(1)
                raw = np.take_along_axis(scores, top[:, None], 1)[:, 0] + self.bias
                hidden = np.maximum(raw, 0)
                z = hidden @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[rows, y] -= 1
                p /= len(x)
                back = (p @ self.out.T) * (raw > 0)
                chosen = patches.reshape(len(x), places, -1)[rows[:, None], top]  # (batch, filter, width * embed)
                g = {"out": hidden.T @ p, "out_bias": p.sum(0), "bias": back.sum(0)}
                g["filters"] = np.einsum("bf,bfk->fk", back, chosen).reshape(self.filters.shape) * self.live
                at = x[rows[:, None, None], top[:, :, None] + np.arange(wide)]
                g["embed"] = np.zeros_like(self.embed)
                np.add.at(g["embed"], at.ravel(), (back[:, :, None, None] * self.filters[None]).reshape(-1, EMBED))
                step += 1
                for k in names:
                    m, v = moments[k]
                    m += 0.1 * (g[k] - m)
                    v += 0.001 * (g[k] ** 2 - v)
                    setattr(self, k, getattr(self, k) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))


def log_probabilities(windows: np.ndarray, network: Network, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    places = WINDOW - max(WIDTHS) + 1
    out = np.empty((len(windows), network.out.shape[1]))
    for low in range(0, len(windows), 256):
        x = windows[low : low + 256].astype(np.int32)
        pair = x[:, :-1] * 256 + x[:, 1:]
        scores = tables[0][pair[:, :places]]
        scores += tables[1][pair[:, 2 : 2 + places]]
        z = np.maximum(scores.max(1) + network.bias, 0) @ network.out + network.out_bias
        z -= z.max(1, keepdims=True)
        out[low : low + 256] = z - np.log(np.exp(z).sum(1, keepdims=True))
    return out


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


def fit(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_all: int = SAMPLE_ALL):
    """(languages, network) from docs(text, lang), null lang and texts without a letter left out; None if nothing is left.

    Of each language about ``sample_docs`` distinct texts are drawn by a hash, never more than twice as
    many, and fewer if that would be over ``sample_all`` for all languages; all windows of a drawn text train. Copies of a text count as one.
    """
    known = docs.filter("lang IS NOT NULL AND octet_length(text) > 0")
    there = written(known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")), "languages")  # no text or hash is moved
    languages = there.count()
    if not languages:
        return None
    each = max(1, min(sample_docs, sample_all // languages))
    drawn = known.join(there, "lang").filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1_000_003)) < F.lit(1.5 * each * 1_000_003) / F.col("n"))
    texts = drawn.select("lang", "text").dropDuplicates()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text", F.lit(7)), "text")  # of about 1.5 * each rows
    few = texts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 2 * each)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            windows, held, n = cut(data, offsets)
            good = np.array([has_letter(t) for t in batch.column(1).to_pylist()], bool)
            owner = np.repeat(np.arange(len(n)), n)
            some = np.flatnonzero(good[owner])
            langs = batch.column(0).take(pa.array(owner[some]))
            yield pa.RecordBatch.from_arrays([langs, pa.array([windows[i].tobytes() for i in some], pa.binary())], names=["lang", "bytes"])

    rows = sorted((r["lang"], bytes(r["bytes"])) for r in few.select("lang", "text").mapInArrow(run, "lang string, bytes binary").collect())  # bounded
    if not rows:
        return None
    names = sorted({r[0] for r in rows})
    network = Network(len(names))
    network.train(np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW), np.array([names.index(r[0]) for r in rows]))
    return names, network


def identify(docs: DataFrame, fitted, *, carry=None) -> DataFrame:
    """docs with lang_pred and score.

    lang_pred: the likeliest learned language, or ``und`` if the text is null or has no letter, or
    nothing was learned; score: its probability, 0 for ``und``. Ties go to the language first in the
    alphabet. Every window of a text counts; each row is judged alone. Other columns are kept.
    """
    if fitted is None:
        base = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score") and (carry is None or c in carry)])
        return base.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((*fitted, fitted[1].tables()))

    def compute(data, offsets, batch):
        names, network, tables = shared.value
        windows, held, n = cut(data, offsets)
        logs = log_probabilities(windows, network, tables) * (held / WINDOW)[:, None]
        total = np.stack([segment_sums(np.ascontiguousarray(logs[:, k]), n) for k in range(len(names))], 1)
        total -= total.max(1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(1, keepdims=True)
        found = [has_letter(bytes(data[a:b]).decode()) for a, b in zip(offsets[:-1], offsets[1:])]
        best = p.argmax(1)
        return [[names[k] if ok else "und" for k, ok in zip(best, found)], np.where(found, p.max(1), 0.0) if len(found) else []]

    return annotate(docs, "lang_pred string, score double", compute, carry=carry)


def op7_language_id(spark, sf_dir):
    """Each document's language, learned from those whose crc32(doc_id) mod 4 is not 2 (see identify)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    fitted = fit(docs.filter(~held).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), fitted, carry=["doc_id"]).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")
