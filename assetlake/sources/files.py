"""Files in and out: binary scans, path lists, manifests, results."""

from __future__ import annotations

import os
import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .listing import EXTENSIONS, by_part, list_files, opened, packed, read_files, read_path_list  # noqa: F401
from .scratch import written

PART_BYTES = 64 << 20  # of contents that one task reads, or one larger file


def scan_assets(spark: SparkSession, roots: list[str], extensions=EXTENSIONS, *, lists: list[str] = ()) -> DataFrame:
    """(path, length, modificationTime, io, content) of the files below roots and at the paths in lists, each once (see listing).

    The listing is made at once; contents are read where they are used, from parts of about PART_BYTES, and only if the
    column is asked for by something. Use require_assets where an empty result has to be an error.
    """
    rows, parts = packed(list_files(spark, roots, extensions, lists=lists), F.col("length"), PART_BYTES, "path")
    return read_files(by_part(rows, 0, max(1, parts))).drop("part")


def require_assets(assets: DataFrame) -> DataFrame:
    if assets.select("path").isEmpty():
        raise FileNotFoundError("no files of the wanted kinds")
    return assets


def path_union(*paths: DataFrame) -> DataFrame:
    """(path): each path once."""
    made = paths[0].select("path")
    for more in paths[1:]:
        made = made.unionByName(more.select("path"))
    return made.distinct()


def smaller_only(results: DataFrame, keep_times: bool = False) -> DataFrame:
    """Of results(path, kind, before, after, ...) those worth writing; modificationTime stays if asked for."""
    kept = results.filter("after < before")
    return kept if keep_times else kept.drop("modificationTime")


def write_files(rows: DataFrame, folder: str, content: str = "content") -> DataFrame:
    """(path, length) of rows(path, content), written by the tasks to files below folder; stored. Null contents are left out.

    A file is written beside its place and then moved there, so that it is there whole or not at all.
    """

    def run(batches):
        for batch in batches:
            done = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, own = opened(f"{folder.rstrip('/')}/{path.lstrip('/')}")
                system.create_dir(os.path.dirname(own), recursive=True)
                with system.open_output_stream(f"{own}.part") as out:
                    out.write(raw)
                system.move(f"{own}.part", own)
                done.append((path, len(raw)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.string()), pa.array([r[1] for r in done], pa.int64())], names=["path", "length"])

    wanted = rows.select("path", F.col(content).cast("binary").alias("content")).filter("content IS NOT NULL")
    return written(wanted.mapInArrow(run, "path string, length long"), "files")


def manifest_lines(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(value): hash, two spaces and path of each file."""
    return df.select(F.concat(F.sha2(F.col(content).cast("binary"), 256), F.lit("  "), F.col(path)).alias("value"))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """(hash, path) of lines 'hash  path'; lines of another form are left out."""
    parts = F.split("value", "  ", 2)
    return lines.filter(F.col("value").contains("  ")).select(parts[0].alias("hash"), parts[1].alias("path"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path))


def write_manifest(df: DataFrame, out: str) -> None:
    manifest_lines(df).write.text(out)


def pending_lines(paths: DataFrame) -> DataFrame:
    """(value): paths one a line; an error when written if a path has a line break and so is no line."""
    bad = F.col("path").isNull() | F.col("path").rlike("[\\r\\n]")
    return paths.select(F.when(bad, F.raise_error(F.lit("a path is not a line of text")).cast("string")).otherwise(F.col("path")).alias("value"))


def export_name(now: float | None = None) -> str:
    """A file name with the unix time, so that exports of several runs lie side by side."""
    return f"assetlake-{int(time.time() if now is None else now)}.txt"


def write_pending(paths: DataFrame, folder: str, now: float | None = None) -> str:
    """Writes the paths below folder under an export_name, and returns where; nothing is left there if a path is no line."""
    out = f"{folder.rstrip('/')}/{export_name(now)}"
    pending_lines(paths).write.text(out)
    return out


def content_crc(content: str = "content") -> Column:
    """CRC-32 of a content, as image containers store it."""
    return F.crc32(F.col(content).cast("binary"))
