"""Containers as tables of segments: listing, inventory, and content without metadata.

One batch function lists the segments of each file; everything after it is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.headers import MIN_BYTES

#: JPEG markers without a length; those that carry metadata (APP1-APP13, APP15, COM).
BARE = frozenset([0x01, *range(0xD0, 0xDA)])
JPEG_METADATA = frozenset([*range(0xE1, 0xEE), 0xEF, 0xFE])
#: JPEG markers that are known: TEM, frames and tables, restarts, images, scans, APPn, JPGn, COM.
JPEG_KNOWN = frozenset([0x01, *range(0xC0, 0xFF)])
#: GIF application extensions that belong to the animation.
ANIMATION = (b"NETSCAPE2.0", b"ANIMEXTS1.0")

BATCH_ROWS = 64  # files whose copies a task makes at once

Segment = tuple[str, int | None, int, int, bool]  # name, label, offset, length, metadata


class Malformed(Exception):
    pass


def jpeg_parts(raw: bytes) -> Iterator[Segment]:
    """Segments in order; fill bytes between them belong to none, and what follows the image's end is one."""
    at, begun = 0, False
    while at < len(raw):
        while at + 1 < len(raw) and raw[at] == 0xFF and raw[at + 1] == 0xFF:
            at += 1
        if raw[at] != 0xFF or at + 1 >= len(raw):
            raise Malformed
        marker, stop = raw[at + 1], at + 2
        if marker not in JPEG_KNOWN or (marker == 0xD8) == begun:
            raise Malformed
        begun = True
        if marker not in BARE:
            size = int.from_bytes(raw[stop : stop + 2])
            if size < 2 or stop + size > len(raw):
                raise Malformed
            stop += size
        if marker == 0xDA:
            mark = raw.find(b"\xff", stop)
            while 0 <= mark and (mark + 1 >= len(raw) or raw[mark + 1] == 0 or 0xD0 <= raw[mark + 1] <= 0xD7):
                mark = raw.find(b"\xff", mark + 1)
            stop = mark if mark >= 0 else len(raw)
        yield "segment", marker, at, stop - at, marker in JPEG_METADATA
        at = stop
        if marker == 0xD9:
            if at < len(raw):
                yield "trailing", None, at, len(raw) - at, False
            return


def _sub_blocks(raw: bytes, at: int) -> tuple[int, bytes | None]:
    """(where sub-blocks end, the first of them)."""
    first = None
    while True:
        if at >= len(raw):
            raise Malformed
        size = raw[at]
        at += 1
        if not size:
            return at, first
        if at + size > len(raw):
            raise Malformed
        first = raw[at : at + size] if first is None else first
        at += size


def gif_parts(raw: bytes) -> Iterator[Segment]:
    """Header with colour table, images, extensions, and the trailer with all that follows it."""

    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        raise Malformed
    at = 13 + table(raw[10])
    if at > len(raw):
        raise Malformed
    yield "header", None, 0, at, False
    while at < len(raw):
        begin, block = at, raw[at]
        if block == 0x3B:
            yield "trailer", None, begin, len(raw) - begin, False
            return
        if block == 0x2C and at + 10 < len(raw):
            at, _ = _sub_blocks(raw, at + 11 + table(raw[at + 9]))
            yield "image", None, begin, at - begin, False
        elif block == 0x21 and at + 1 < len(raw):
            label = raw[at + 1]
            at, first = _sub_blocks(raw, at + 2)
            animation = label == 0xFF and first is not None and first[:11] in ANIMATION
            yield "extension", label, begin, at - begin, not (label == 0xF9 or animation or first is None)
        else:
            raise Malformed
    raise Malformed


def _listed(assets: DataFrame, kind: str, parts: Callable[[bytes], Iterator[Segment]], name: str) -> DataFrame:
    schema = f"path string, ordinal int, {name}, offset long, length long, is_metadata boolean, malformed boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, bad = [], False
                try:
                    own.extend(parts(content))
                except Malformed:
                    own, bad = [("", None, 0, len(content), False)], True
                for i, (block, label, offset, length, metadata) in enumerate(own):
                    head = [label] if kind == "jpeg" else [block, label]
                    rows.append([path, i, *head, offset, length, metadata, bad])
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=target)

    target = to_arrow_schema(_parse_datatype_string(schema))
    return assets.filter("content IS NOT NULL").select("path", "content").mapInArrow(run, schema)


def jpeg_segments(assets: DataFrame) -> DataFrame:
    """(path, ordinal, marker, offset, length, is_metadata, malformed); a malformed file is one row, kept whole."""
    return _listed(assets, "jpeg", jpeg_parts, "marker int")


def gif_blocks(assets: DataFrame) -> DataFrame:
    """(path, ordinal, block, label, offset, length, is_metadata, malformed); a malformed file is one row, kept whole."""
    return _listed(assets, "gif", gif_parts, "block string, label int")


PARTS = {"jpeg": jpeg_parts, "gif": gif_parts}
MAGIC = {"jpeg": (b"\xff\xd8\xff",), "gif": (b"GIF87a", b"GIF89a")}


def without_metadata(raw: bytes, kind: str) -> bytes | None:
    """The kept segments of a file, end to end; None unless that is smaller, of the same kind, and holds just these segments."""
    parts = PARTS[kind]
    try:
        kept = [raw[at : at + size] for _, _, at, size, metadata in parts(raw) if not metadata]
        made = b"".join(kept)
        if not MIN_BYTES < len(made) < len(raw) or not made.startswith(MAGIC[kind]):
            return None
        return made if [made[at : at + size] for _, _, at, size, _ in parts(made)] == kept else None
    except Malformed:
        return None


def strip_metadata(assets: DataFrame, kind: str) -> DataFrame:
    """assets(path, content, ...) of one kind with before, after and stripped: content without metadata, where that is smaller; else as it was.

    A file is listed and put together where it is, without a shuffle; rows of one path, or with the
    same content, are rows like any others. Malformed files and null contents stay as they are.
    """
    names = [c for c in assets.columns if c not in ("before", "after", "stripped")]
    at = names.index("content")
    schema = StructType([*(assets.schema[c] for c in names), *_parse_datatype_string("before long, after long, stripped binary").fields])

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH_ROWS):
                piece = batch.slice(low, BATCH_ROWS)
                raw = piece.column(at).to_pylist()
                made = [None if x is None else without_metadata(x, kind) or x for x in raw]
                sizes = ([None if x is None else len(x) for x in side] for side in (raw, made))
                yield pa.RecordBatch.from_arrays([*piece.columns, *(pa.array(x, pa.int64()) for x in sizes), pa.array(made, pa.binary())], names=[*names, "before", "after", "stripped"])

    return assets.select(*names).mapInArrow(run, schema)


def metadata_inventory(segments: DataFrame, label: str = "marker") -> DataFrame:
    """By marker or label: metadata segments, their bytes, the files that have them, and the bytes' share of all that is listed."""
    meta = F.col("is_metadata")
    by = segments.groupBy(label).agg(F.count_if(meta).alias("segments"), F.sum(F.when(meta, F.col("length"))).alias("bytes"), F.count_distinct(F.when(meta, F.col("path"))).alias("files"), F.sum("length").alias("listed"))
    share = F.round(F.col("bytes") / F.sum("listed").over(Window.partitionBy()), 6)  # over a row for each marker, 257 at most
    return by.withColumn("share", share).filter("segments > 0").drop("listed")


def _table_function(parts: Callable[[bytes], Iterator[Segment]], block: bool):
    class Segments:
        def eval(self, content: bytes):
            if content is None:
                return
            try:
                found, bad = list(parts(content)), False
            except Malformed:
                found, bad = [("", None, 0, len(content), False)], True
            for i, (name, label, offset, length, metadata) in enumerate(found):
                yield (i, *((name, label) if block else (label,)), offset, length, metadata, bad)

    return Segments


#: By name: rows of a content, for LATERAL joins in SQL. A null content has no rows, a malformed one a single row.
TABLE_FUNCTIONS = {
    "jpeg_segments": (jpeg_parts, False, "ordinal int, marker int, offset long, length long, is_metadata boolean, malformed boolean"),
    "gif_blocks": (gif_parts, True, "ordinal int, block string, label int, offset long, length long, is_metadata boolean, malformed boolean"),
}


def register_table_functions(spark: SparkSession) -> None:
    """Makes jpeg_segments(content) and gif_blocks(content) known to SQL, so that FROM assets, LATERAL jpeg_segments(content) lists segments."""
    for name, (parts, block, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(_table_function(parts, block), returnType=schema, useArrow=True))
