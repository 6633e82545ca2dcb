"""Adds columns computed from a text column, batch by batch, inside the scan's own tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .grams import blocks, settle, text_buffers


def annotate(df: DataFrame, added: str, compute: Callable, *, text: str = "text", carry: Iterable[str] | None = None) -> DataFrame:
    """df's columns (or those named in carry) and the columns ``added`` (DDL).

    compute(data, offsets, batch) gets the bytes and offsets of a slice's texts and the slice, and
    returns one Arrow array or list for each added column. A column of df that has the name of an
    added one is replaced. No shuffle; a slice holds a MB of text or one longer text.
    """
    new = T._parse_datatype_string(added)
    names = set(new.fieldNames())
    kept = [f for f in df.schema.fields if f.name not in names and (carry is None or f.name in carry)]
    schema = T.StructType([*kept, *new.fields])
    kinds = [to_arrow_type(f.dataType) for f in new.fields]
    kept_names = [f.name for f in kept]
    inputs = [*kept_names, *([] if text in kept_names else [text])]

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(inputs.index(text)))
            for low, high in blocks(offsets):
                piece = batch.slice(low, high - low)
                own = offsets[low : high + 1]
                found = compute(data[own[0] : own[-1]], own - own[0], piece)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(i) for i in range(len(kept_names))), *(x if isinstance(x, pa.Array) and x.type == k else pa.array(x, k) for x, k in zip(found, kinds))],
                    names=[*kept_names, *new.fieldNames()],
                )
        settle()

    return df.select(*(f"`{c}`" for c in inputs)).mapInArrow(run, schema)
