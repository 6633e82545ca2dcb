"""Training sequences as binary matrices: packed ids, cumulative segment lengths and position resets.

Each scan task tokenizes its documents and packs them in blocks of BLOCK_TOKENS ids by best-fit
decreasing (see packing: the same plan and segment tree), so documents are never shuffled and a
task holds one block at a time. A sequence is one row; write_sequences stores rows as Parquet, in a
folder that any number of tasks write to. unpack gives every document's ids back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import blocks, text_buffers
from .packing import CAPACITY, Slots, default_tokenizer, plan, token_ids
from .scratch import Scratch

BLOCK_TOKENS = 4 << 20
SCHEMA = "sequence_id long, n_tokens int, input_ids binary, cu_seqlens binary, position_ids binary, doc_ids array<long>, starts array<long>"


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values cut at bounds, as little-endian 32-bit binaries."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(values)])


def _sequences(ids: list[np.ndarray], doc_ids: list, capacity: int, number: int):
    """Record batches of the sequences of a block, numbered from ``number``."""
    tokens = np.array([len(x) for x in ids], np.int64)
    flat, owners = np.concatenate(ids), pa.array(doc_ids, pa.int64())
    cuts = -(-tokens // capacity)
    doc = np.repeat(np.arange(len(ids)), cuts)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * capacity
    length = np.minimum(capacity, tokens[doc] - start)
    begin = (np.cumsum(tokens) - tokens)[doc] + start
    order = np.argsort(length, kind="stable")
    sizes, counts = np.unique(length, return_counts=True)
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    sequence, offset = Slots.of(plan(dict(zip(sizes.tolist(), counts.tolist())), capacity)).find(length, rank)
    by = np.lexsort((offset, sequence))
    doc, start, length, begin, offset, sequence = (x[by] for x in (doc, start, length, begin, offset, sequence))
    firsts = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1], [True]]))
    for low in range(0, len(firsts) - 1, 256):
        segments = firsts[low : low + 257]
        at = slice(segments[0], segments[-1])
        segments = segments - segments[0]
        n, of = len(segments) - 1, np.repeat(np.arange(len(segments) - 1), np.diff(segments))
        ends = np.cumsum(length[at])
        sequence_ends = np.concatenate([[0], ends])[segments]
        positions = np.arange(ends[-1]) - np.repeat(ends - length[at], length[at])
        cumulative = np.zeros(len(of) + n, "<i4")
        cumulative[np.arange(len(of)) + 1 + of] = offset[at] + length[at]
        lists = pa.array(segments, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(number + low, number + low + n)),
                pa.array(np.diff(sequence_ends), pa.int32()),
                _binary(flat[np.repeat(begin[at], length[at]) + positions].astype("<u4", copy=False), sequence_ends),
                _binary(cumulative, segments + np.arange(n + 1)),
                _binary(positions.astype("<i4"), sequence_ends),
                pa.ListArray.from_arrays(lists, owners.take(pa.array(doc[at]))),
                pa.ListArray.from_arrays(lists, pa.array(start[at])),
            ],
            names=["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "starts"],
        )


def token_sequences(docs: DataFrame, tokenizer: str | None = None, *, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each sequence of docs(doc_id, text).

    input_ids: little-endian unsigned 32-bit ids, n_tokens of them, without padding; cu_seqlens:
    where segments begin and end, 32-bit, from 0; position_ids: 32-bit, 0 at each segment's start;
    doc_ids, starts: of each segment its document and the number of its ids before it. sequence_id
    is unique, not gapless. A null or empty text is the end id alone; repeated rows are repeated.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        encode, number = token_ids(path).of, TaskContext.get().partitionId() << 40
        ids, owners, held = [], [], 0

        def flush():
            nonlocal number
            for made in _sequences(ids, owners, capacity, number):
                number += made.num_rows  # the numbers of this block were fixed when it began
                yield made

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            for low, high in blocks(offsets):
                at = offsets[low : high + 1]
                found = encode(data[at[0] : at[-1]], at - at[0])
                ids += found
                owners += names[low:high]
                held += sum(map(len, found))
                if held >= block_tokens:
                    yield from flush()
                    ids, owners, held = [], [], 0
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def write_sequences(sequences: DataFrame, path: str) -> DataFrame:
    """Stores sequences below path, compressed, and returns what is stored there."""
    sequences.write.option("compression", "zstd").parquet(path)
    return sequences.sparkSession.read.schema(sequences.schema).parquet(path)


def unpack(sequences: DataFrame) -> DataFrame:
    """(doc_id, start, input_ids): the segments of all sequences."""
    each = sequences.select("input_ids", "cu_seqlens", F.posexplode("doc_ids").alias("i", "doc_id"), "starts")

    def cut(batches):
        for batch in batches:
            rows = batch.to_pylist()
            segments = []
            for r in rows:
                at = np.frombuffer(r["cu_seqlens"], "<i4")
                segments.append(r["input_ids"][4 * at[r["i"]] : 4 * at[r["i"] + 1]])
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([r["starts"][r["i"]] for r in rows], pa.int64()), pa.array(segments, pa.binary())], names=["doc_id", "start", "input_ids"])

    return each.mapInArrow(cut, "doc_id long, start long, input_ids binary")


def op6_token_output(spark, sf_dir):
    """A row for each sequence, as it is read back from the files it was written to: sequence_id, n_tokens, segments, doc_ids, starts, and CRC-32 of the three binaries."""
    made = token_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    stored = write_sequences(made, Scratch(spark, "sequences").path("matrices"))
    crc = [F.crc32(c).alias(f"{c}_crc32") for c in ("input_ids", "cu_seqlens", "position_ids")]
    return stored.select("sequence_id", "n_tokens", F.size("doc_ids").alias("segments"), "doc_ids", "starts", *crc)
