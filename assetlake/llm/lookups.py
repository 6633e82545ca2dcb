"""Corpus-wide counts brought to texts by sharded joins on distinct keys.

A model over a corpus may be as large as the corpus, so it is never carried whole to a task.
A chunk is a run of rows of one scan task with some MB of text. Each chunk lists its distinct keys
(byte 5-grams, word hashes) once; the keys' values are computed in shards of their own and joined
back to (chunk, key); then the chunk's rows, packed and compressed, meet the values they need.
What is shuffled: the texts once, compressed, and of each chunk its distinct keys, which are a
small part of its text. A key in all chunks (a frequent word) has one row for each chunk, never
one for each occurrence; adaptive skew joins split such keys.

Chunks are found anew in each pass, so the table must be a stored one (or any plan that deals the
same rows to the same tasks each time); a scan does, also when a lost task runs again. A text
whose keys are missing stops the job rather than being scored wrongly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import settle

CHUNK_BYTES = 24 << 20
GROUP_KEYS = 1_000_000  # distinct n-grams that one task holds, on average


def chunks(batches: Iterator[pa.RecordBatch], text: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """(chunk, rows): the task's rows cut wherever their texts pass ``limit`` bytes, whatever batches they come in."""
    number = TaskContext.get().partitionId() << 32
    held, size = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            base = int(sizes[low - 1]) if low else 0
            high = max(int(np.searchsorted(sizes, base + limit - size, "right")), low + (not held))
            if high > low:
                held.append(batch.slice(low, high - low))
                size += int(sizes[high - 1]) - base
                low = high
            if low < batch.num_rows:
                yield number, pa.Table.from_batches(held)
                number, held, size = number + 1, [], 0
    if held:
        yield number, pa.Table.from_batches(held)


def listed_keys(docs: DataFrame, keys, before=None) -> DataFrame:
    """(chunk, key, n): keys(rows of a chunk) gives the distinct keys and their counts. docs must have a column text; before adds columns to a task's batches."""
    text = docs.columns.index("text")

    def run(batches):
        for chunk, rows in chunks(before(batches) if before else batches, text):
            found, n = keys(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), chunk)), pa.array(found.astype(np.int64)), pa.array(n)], names=["chunk", "key", "n"])
        settle()

    return docs.mapInArrow(run, "chunk long, key long, n long")


def packed(docs: DataFrame) -> DataFrame:
    """(chunk, rows): each chunk's rows in one compressed value."""
    text = docs.columns.index("text")

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
        for chunk, rows in chunks(batches, text):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_table(rows)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "rows"])
        settle()

    return docs.mapInArrow(run, "chunk long, rows binary")


def suffix_groups(codes: DataFrame, n: int, order: int) -> DataFrame:
    """codes with a column part: codes whose contexts end in the same order-2 symbols are in one part.

    All orders from three symbols up of such codes can be counted inside a part. The symbols are
    at most 256 ** (order - 2) values, with at most 256 ** 3 codes each, whatever the corpus holds.
    """
    parts = max(1, math.ceil(n / GROUP_KEYS))
    end = F.shiftrightunsigned("key", 8).bitwiseAND((1 << 8 * (order - 2)) - 1)
    return codes.withColumn("part", F.pmod(F.xxhash64(end), F.lit(parts)).cast("int"))


def score_chunks(docs: DataFrame, values: DataFrame, score, schema: str) -> DataFrame:
    """Rows of score(rows of a chunk, ordered keys, their values) for each chunk of docs.

    values: (chunk, key, value double) for each key that the chunk has listed.
    """

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        keys = found.column("key").to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        keys, own = keys[order], found.column("value").to_numpy()[order]
        made = [score(pa.ipc.open_stream(x.as_py()).read_all(), keys, own) for x in rows.column("rows")]
        del keys, own, order
        settle()
        return pa.concat_tables(made) if made else pa.table({})

    return packed(docs).groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(run, schema)


def found_at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted keys; an error if one is missing."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    if len(wanted) and (not len(keys) or (keys[at] != wanted).any()):
        raise ValueError("the table was dealt out otherwise than before; store it first")
    return at
