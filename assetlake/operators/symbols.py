"""Compressibility of payloads: histograms, entropy, block costs, runs, chunks.

A payload is one row, so its histogram is made where the row is: one array a payload, without a
shuffle. What needs single symbols explodes that array of at most 256 entries, never the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

CHUNK, LOOKBACK = 1_000_000, 32_768
HISTOGRAM = "array<struct<sym:int,n:long>>"


def histograms(payloads: DataFrame, key: str, content: str) -> DataFrame:
    """(key, n_bytes, histogram): of each payload the bytes that occur, in order, and how often. Null payloads are left out."""
    kind = payloads.schema[key].dataType.simpleString()
    entry = pa.struct([("sym", pa.int32()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            blobs = batch.column(1)
            counts = np.zeros((len(blobs), 256), np.int64)
            sizes = np.zeros(len(blobs), np.int64)
            for i, blob in enumerate(blobs):
                raw = np.frombuffer(blob.as_buffer(), np.uint8)
                counts[i], sizes[i] = np.bincount(raw, minlength=256), len(raw)
            row, sym = np.nonzero(counts)
            offsets = np.searchsorted(row, np.arange(len(blobs) + 1)).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(sym.astype(np.int32)), pa.array(counts[row, sym])], fields=list(entry))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), entries)], names=[key, "n_bytes", "histogram"])

    blobs = payloads.select(key, F.col(content).cast("binary").alias("content")).filter("content IS NOT NULL")
    return blobs.mapInArrow(run, f"{key} {kind}, n_bytes long, histogram {HISTOGRAM}")


def exploded(made: DataFrame, key: str, end: int | None = None) -> DataFrame:
    """(key, sym, n, n_bytes): a row for each symbol; with ``end``, that symbol once more for each payload, also for empty ones."""
    entries = F.col("histogram") if end is None else F.concat("histogram", F.array(F.struct(F.lit(end).alias("sym"), F.lit(1).cast("long").alias("n"))))
    return made.select(key, "n_bytes", F.explode(entries).alias("e")).select(key, "e.sym", "e.n", "n_bytes")


#: Bits of each symbol of a set in which nothing has been counted.
EMPTY_LITERALS, EMPTY_DISTANCES = 0.0, 5.0


def symbol_cost(n: Column, total: Column, empty: float = EMPTY_LITERALS) -> Column:
    """Bits for a symbol that occurs n times among total; all of log2(total) if it never occurs; ``empty`` if nothing has been counted."""
    return F.when(total > 0, F.when(n > 0, F.log2(total) - F.log2(n)).otherwise(F.log2(total))).otherwise(F.lit(empty))


def block_costs(made: DataFrame, key: str) -> DataFrame:
    """(key, n_bytes, raw_bits, fixed_bits, adaptive_bits, block): bits for each form of a block, and the cheapest.

    Stored: 8 a byte and 40 for each 65,535 bytes begun. Fixed: 7 for the end, 8 a byte up to 143, 9 above;
    considered up to 1,000 bytes, and taken only if strictly less. Adaptive: entropy with an end symbol, and
    14 + 57 + 4 for each distinct symbol for the table, an estimate.
    """
    n = F.col("n_bytes")
    total = (n + 1).cast("double")
    fixed = F.lit(7).cast("long") + F.aggregate("histogram", F.lit(0).cast("long"), lambda a, e: a + e["n"] * F.when(e["sym"] <= 143, 8).otherwise(9))
    entropy = F.log2(total) + F.aggregate("histogram", F.lit(0.0), lambda a, e: a + e["n"] * (F.log2(total) - F.log2(e["n"].cast("double"))))
    rows = made.select(key, "n_bytes", (8 * n + 40 * F.ceil(n / 65535)).cast("long").alias("raw_bits"), fixed.alias("fixed_bits"), F.ceil(F.round(entropy, 3) + 71 + 4 * (F.size("histogram") + 1)).cast("long").alias("adaptive_bits"))
    best = F.least("raw_bits", "adaptive_bits")
    return rows.withColumn("block", F.when((n <= 1000) & (F.col("fixed_bits") < best), "fixed").when(F.col("adaptive_bits") < F.col("raw_bits"), "adaptive").otherwise("raw"))


def code_width(made: DataFrame, key: str) -> DataFrame:
    """(key, width): bits for the largest symbol, 2 to 8; 2 for an empty payload."""
    largest = F.coalesce(F.array_max(F.transform("histogram", lambda e: e["sym"])), F.lit(0))
    return made.select(key, F.greatest(F.lit(2), F.least(F.lit(8), F.ceil(F.log2((largest + 1).cast("double"))))).cast("int").alias("width"))


def chunk_payload(payloads: DataFrame, key: str, size: Column, chunk: int = CHUNK, lookback: int = LOOKBACK) -> DataFrame:
    """(key, chunk_no, window_start, start, end, last): ranges of a payload; window_start is how far back a chunk may look."""
    rows = payloads.select(key, size.cast("long").alias("n")).filter("n > 0")
    rows = rows.select(key, "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long"))).alias("chunk_no", "start"))
    end = F.least(F.col("start") + chunk, F.col("n"))
    return rows.select(key, "chunk_no", F.greatest(F.lit(0).cast("long"), F.col("start") - lookback).alias("window_start"), "start", end.alias("end"), (end == F.col("n")).alias("last"))


def decay_histogram(before: DataFrame, now: DataFrame, sym: str, weighted: bool = True, end: object = None) -> DataFrame:
    """(sym, n): half of before, rounded down, and now; now alone if not weighted. A symbol of one side counts 0 in the other.

    end: a symbol that closes every payload; it counts 1, whatever was counted, and is added if it is missing.
    """
    if weighted:
        joined = before.select(sym, F.col("n").alias("old")).join(now.select(sym, F.col("n").alias("new")), sym, "full_outer")
        made = joined.select(sym, (F.floor(F.coalesce("old", F.lit(0)) / 2) + F.coalesce("new", F.lit(0))).cast("long").alias("n"))
    else:
        made = now.select(sym, F.col("n").cast("long").alias("n"))
    if end is None:
        return made
    one = now.sparkSession.range(1).select(F.lit(end).cast(now.schema[sym].dataType).alias(sym), F.lit(1).cast("long").alias("n"))
    return made.filter(~F.col(sym).eqNullSafe(F.lit(end))).unionByName(one)


#: Rows of one key from which on it is dealt over slices instead of being ordered by one task.
HOT_ROWS = 1_000_000


def _hot(rows: DataFrame, by: str, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of other keys, rows of keys with at least hot_rows rows or None); keys are counted, but no row is moved for it."""
    hot = rows.groupBy(by).count().filter(F.col("count") >= hot_rows).select(F.col(by).alias("_hot"))
    hot = written(hot, "hot")
    if hot.isEmpty():
        return rows, None
    same = F.col(by).eqNullSafe(F.col("_hot"))
    return rows.join(hot, same, "left_anti"), rows.join(hot, same, "left_semi")


def _sliced(rows: DataFrame, by: str, order: list[str], columns: dict[str, Column]) -> DataFrame:
    """(by, order..., columns..., slice): rows dealt out in order and stored, so that a frequent ``by`` lies in many slices, each in order after the one before.

    Rows equal in by and order are in one slice.
    """
    spark = rows.sparkSession
    dealt = rows.select(by, *order, *(c.alias(name) for name, c in columns.items()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return written(dealt.repartitionByRange(parts, by, *order).withColumn("_slice", F.spark_partition_id()), "slices")


def _begins(value: str, w) -> Column:
    """1 for a row that begins a run: the first, and each with another value than the one before it."""
    return (F.row_number().over(w).eqNullSafe(1) | ~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("long")


def _numbered_slices(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """rows(by, order..., value) with _at (from 1) and run_no, counted in slices that are joined at their edges."""
    parts = _sliced(rows, by, [c for c in order if c != value], {value: F.col(value)}) if value not in order else _sliced(rows, by, order, {})
    w = Window.partitionBy(by, "_slice").orderBy(*order)
    inner = parts.withColumns({"_place": F.row_number().over(w), "_turn": _begins(value, w) - (F.row_number().over(w) == 1).cast("long")})
    head, tail = F.min(F.struct("_place", F.col(value).alias("v")))["v"], F.max(F.struct("_place", F.col(value).alias("v")))["v"]
    sums = inner.groupBy(by, "_slice").agg(F.count("*").alias("_rows"), F.sum("_turn").alias("_turns"), head.alias("_head"), tail.alias("_tail"))
    v = Window.partitionBy(by).orderBy("_slice")
    sums = sums.withColumn("_begins", (F.lag("_rows").over(v).isNull() | ~F.lag("_tail").over(v).eqNullSafe(F.col("_head"))).cast("int"))
    before = v.rowsBetween(Window.unboundedPreceding, -1)
    # A run_no counts the turns so far; that of a slice's first row also whether it begins a run.
    runs_before = F.coalesce(F.sum(F.col("_turns") + F.col("_begins")).over(before), F.lit(0)) + F.col("_begins")
    sums = sums.select(F.col(by).alias("_own"), F.col("_slice").alias("_own_slice"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"), runs_before.alias("_runs_before"))
    numbered = inner.join(sums, F.col(by).eqNullSafe(F.col("_own")) & (F.col("_slice") == F.col("_own_slice")))
    numbered = numbered.withColumns({"run_no": (F.col("_runs_before") + F.sum("_turn").over(w)).cast("long"), "_at": (F.col("_rows_before") + F.col("_place")).cast("long")})
    return numbered.select(*dict.fromkeys([by, *order, value]), "_at", "run_no")


def _numbered(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """rows(by, order..., value) with _at (from 1) and run_no, by a window for each key."""
    w = Window.partitionBy(by).orderBy(*order)
    began = rows.withColumns({"_at": F.row_number().over(w).cast("long"), "_began": _begins(value, w)})
    return began.withColumn("run_no", F.sum("_began").over(w).cast("long"))


def _runs_of(numbered: DataFrame, by: str, value: str) -> DataFrame:
    return numbered.groupBy(by, "run_no").agg(F.first(value).alias(value), (F.min("_at") - 1).cast("long").alias("first"), F.count("*").alias("n"))


def value_runs(rows: DataFrame, by: str, order: list[str], value: str, min_zero: int = 5, min_other: int = 7, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(by, value, run_no, first, n, good): maximal runs of equal values in order; good: long enough to code as a repeat.

    A key of hot_rows rows or more is dealt over slices of the order, whose runs are joined at their edges.
    """
    usual, hot = _hot(rows.select(*dict.fromkeys([by, *order, value])), by, hot_rows)
    runs = _runs_of(_numbered(usual, by, order, value), by, value)
    if hot is not None:
        runs = runs.unionByName(_runs_of(_numbered_slices(hot, by, order, value), by, value))
    zero = F.coalesce(F.col(value).cast("string") == "0", F.lit(False))
    return runs.withColumn("good", (F.col("n") >= min_zero) & (zero | (F.col("n") >= min_other)))


def repeats_left(rows: DataFrame, by: str, order: list[str], value: str, cap: int = 65_535, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(by, order..., value, left): how many rows with the same value follow each row without a break, ``cap`` at most."""
    names = list(dict.fromkeys([by, *order, value]))
    usual, hot = _hot(rows.select(*names), by, hot_rows)
    left = lambda end: F.least(end - F.col("_at"), F.lit(cap)).cast("int").alias("left")
    made = _numbered(usual, by, order, value).select(*names, left(F.max("_at").over(Window.partitionBy(by, "run_no"))))
    if hot is None:
        return made
    numbered = _numbered_slices(hot, by, order, value)
    ends = _runs_of(numbered, by, value).select(F.col(by).alias("_own"), F.col("run_no").alias("_own_run"), (F.col("first") + F.col("n")).alias("_end"))
    joined = numbered.join(ends, F.col(by).eqNullSafe(F.col("_own")) & (F.col("run_no") == F.col("_own_run")))
    return made.unionByName(joined.select(*names, left(F.col("_end"))))


def running_offset(rows: DataFrame, by: str, order: list[str], length: Column, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(by, order..., length, offset): the sum of the lengths before each row, null lengths being 0.

    A key of hot_rows rows or more is summed in slices of the order, and then over slices.
    """
    earlier = lambda w: F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    usual, hot = _hot(rows.select(by, *order, F.coalesce(length.cast("long"), F.lit(0)).alias("length")), by, hot_rows)
    made = usual.withColumn("offset", earlier(Window.partitionBy(by).orderBy(*order)).cast("long"))
    if hot is None:
        return made
    parts = _sliced(hot, by, order, {"length": F.col("length")})
    sums = parts.groupBy(by, "_slice").agg(F.sum("length").alias("length"))
    sums = sums.select(F.col(by).alias("_own"), F.col("_slice").alias("_own_slice"), earlier(Window.partitionBy(by).orderBy("_slice")).alias("base"))
    joined = parts.join(sums, F.col(by).eqNullSafe(F.col("_own")) & (F.col("_slice") == F.col("_own_slice")))
    inner = earlier(Window.partitionBy(by, "_slice").orderBy(*order))
    return made.unionByName(joined.withColumn("offset", (F.col("base") + inner).cast("long")).select(by, *order, "length", "offset"))


def explode_symbols(payloads: DataFrame, key: str, content: str) -> DataFrame:
    """(key, pos, sym): the bytes of each payload by position, from 0; made where the payload is, CHUNK of them at a time. Null payloads are left out.

    For what has to join or group single bytes: each costs a row, so runs of them are payload_runs' work, not value_runs' over these rows.
    """
    kind = payloads.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, blob in enumerate(batch.column(1)):
                raw = np.frombuffer(blob.as_buffer(), np.uint8)
                for low in range(0, len(raw), CHUNK):
                    piece = raw[low : low + CHUNK].astype(np.int32)
                    keys = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(piece), np.int32)), batch.column(0).slice(i, 1)).dictionary_decode()
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.arange(low, low + len(piece))), pa.array(piece)], names=[key, "pos", "sym"])

    blobs = payloads.select(key, F.col(content).cast("binary").alias("content")).filter("content IS NOT NULL")
    return blobs.mapInArrow(run, f"{key} {kind}, pos long, sym int")


def byte_runs(raw: np.ndarray, chunk: int):
    """(first, n) of the maximal runs of equal bytes, in order; as arrays of those that end in each ``chunk`` bytes."""
    begun = 0  # the run that has not ended
    for low in range(0, len(raw), chunk):
        at, high = max(low, 1), min(len(raw), low + chunk)
        turns = np.flatnonzero(raw[at:high] != raw[at - 1 : high - 1]) + at
        ends = turns if high < len(raw) else np.append(turns, high)
        first = np.append(begun, turns)[: len(ends)]
        yield first, ends - first
        begun = turns[-1] if len(turns) else begun


def payload_runs(payloads: DataFrame, key: str, content: str, min_zero: int = 5, min_other: int = 7, *, good_only: bool = False) -> DataFrame:
    """(key, sym, run_no, first, n, good): value_runs over the bytes of each payload, without a shuffle and without a row for each byte.

    good_only: runs that are not good are counted in run_no, but no rows are made of them.
    """
    kind = payloads.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            held, rows = [], 0

            def record():
                of, *columns = (pa.array(np.concatenate(c)) for c in zip(*held))
                return pa.RecordBatch.from_arrays([batch.column(0).take(of), *columns], names=[key, "sym", "run_no", "first", "n", "good"])

            for i, blob in enumerate(batch.column(1)):
                raw, number = np.frombuffer(blob.as_buffer(), np.uint8), 0
                for first, n in byte_runs(raw, CHUNK):
                    sym, numbers = raw[first].astype(np.int32), np.arange(number, number + len(first)) + 1
                    good = (n >= min_zero) & ((sym == 0) | (n >= min_other))
                    kept = np.flatnonzero(good) if good_only else slice(None)
                    held.append([c[kept] for c in (np.full(len(first), i), sym, numbers, first, n, good)])
                    number, rows = number + len(first), rows + len(held[-1][0])
                    if rows >= CHUNK:
                        yield record()
                        held, rows = [], 0
            if rows:
                yield record()

    blobs = payloads.select(key, F.col(content).cast("binary").alias("content")).filter("content IS NOT NULL")
    return blobs.mapInArrow(run, f"{key} {kind}, sym int, run_no long, first long, n long, good boolean")
