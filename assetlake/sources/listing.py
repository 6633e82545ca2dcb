"""Files as a table: tasks list the folders and read the contents, and no path goes through the driver.

Folders are listed level by level: each level's folders are rows, dealt over tasks by a hash, and
what they hold is stored before the next level is listed. Contents are read by the tasks that need them, from partitions
packed by cost, so that a large file does not share its task. What happens to a file on the way
(gone, unreadable) is a status of its row, not an error of the job.
"""

from __future__ import annotations

import os
import re
from datetime import UTC, datetime
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators.classify import READ_ERROR, VANISHED
from .scratch import Scratch

EXTENSIONS = ("gif", "jpg", "jpeg", "png")
LISTED = "path string, length long, modificationTime timestamp, io string"
LIST_ROWS = 10_000  # of a folder that a task hands on at once
BATCH_BYTES, BATCH_ROWS = 8 << 20, 64  # of contents that a task hands on at once, or one larger file


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    scheme = re.match("^([A-Za-z][A-Za-z0-9+.-]+):", path)
    if not scheme or scheme.group(1).lower() == "file":
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def _row(path: str, folder: bool, info: fs.FileInfo | None = None, io: str | None = None) -> tuple:
    return path, folder, info.size if info and not folder else None, info.mtime if info else None, io


def _children(path: str, wanted: re.Pattern):
    """What stands at a path: itself if it is a file or cannot be listed, else the folders and wanted files in it."""
    try:
        system, own = opened(path)
        info = system.get_file_info(own)
        if info.type == fs.FileType.NotFound:
            yield _row(path, False, io=VANISHED)
        elif info.type != fs.FileType.Directory:
            if wanted.search(path):
                yield _row(path, False, info)
        else:
            local = isinstance(system, fs.LocalFileSystem)
            for child in system.get_file_info(fs.FileSelector(own, recursive=False)):
                folder = child.type == fs.FileType.Directory
                if folder and local and os.path.islink(child.path):
                    continue  # links to folders may lead in circles
                if folder or wanted.search(child.base_name):
                    yield _row(f"{path.rstrip('/')}/{child.base_name}", folder, child)
    except FileNotFoundError:
        yield _row(path, False, io=VANISHED)
    except (OSError, pa.ArrowException):
        yield _row(path, False, io=READ_ERROR)


def list_files(spark: SparkSession, roots: list[str], extensions=EXTENSIONS, *, lists: list[str] = ()) -> DataFrame:
    """(path, length, modificationTime, io) of each file once that lies below a root or a path of a list, or is one; stored.

    Extensions count in any case. lists: text files of further roots, one a line; their lines stay in Spark.
    io: null, or ``vanished!`` for a root or listed path that is not there, ``read error`` for a folder that cannot be listed; such
    rows have no length and time. Files without bytes are files. Links to folders are not followed, and links that lead nowhere are no files.
    """
    wanted = re.compile(r"\.(" + "|".join(map(re.escape, extensions)) + ")$", re.IGNORECASE)
    names = ["path", "folder", "length", "modificationTime", "io"]
    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"), pa.string()]

    def look(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                children = _children(path, wanted)
                while rows := list(islice(children, LIST_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    scratch = Scratch(spark, "listing")
    level = spark.createDataFrame([(r,) for r in roots], "path string")
    if lists:
        level = level.unionByName(read_path_list(spark, list(lists)))
    levels = []
    while True:
        found = scratch.write(level.distinct().repartition("path").mapInArrow(look, "path string, folder boolean, length long, modificationTime timestamp, io string"), "level")
        levels.append(found)
        level = found.filter("folder").select("path")
        if level.isEmpty():
            break
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    own = F.min(F.struct(*(c for c in names if c not in ("path", "folder")))).alias("own")  # a root may lie below another
    listed = scratch.write(every.filter("NOT folder").groupBy("path").agg(own).select("path", "own.*"), "files")
    scratch.drop(*levels)
    return listed


def read_path_list(spark: SparkSession, lists: list[str]) -> DataFrame:
    """(path): the lines of text files, trimmed, without empty and repeated ones. An unreadable list is an error."""
    return spark.read.text(lists).select(F.trim("value").alias("path")).filter("path != ''").distinct()


def read_files(listed: DataFrame) -> DataFrame:
    """listed's columns (path, length, modificationTime, io, ...) and ``content``, read where the row is.

    io: as it was if it was set, else ``vanished!`` or ``read error`` where the file is gone or cannot be read, with a null content.
    length: bytes that were read. Rows stay in their partitions.
    """
    names = [c for c in listed.columns if c != "content"]
    schema = StructType([*(listed.schema[c] for c in names), *_parse_datatype_string("content binary").fields])
    kinds = {f.name: to_arrow_type(f.dataType) for f in schema.fields}
    kinds |= {c: pa.timestamp("us", "UTC") for c, k in kinds.items() if pa.types.is_timestamp(k) and k.tz is not None}

    def one(row: dict) -> dict:
        if row["io"] is None:
            try:
                system, own = opened(row["path"])
                with system.open_input_stream(own) as stream:
                    row["content"] = stream.read()
                row["length"] = len(row["content"])
            except FileNotFoundError:
                row["io"] = VANISHED
            except (OSError, pa.ArrowException):
                row["io"] = READ_ERROR
        return row

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(one({"content": None, **row}))
                size += len(held[-1]["content"] or b"")
                if size >= BATCH_BYTES or len(held) == BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], k) for c, k in kinds.items()], names=list(kinds))
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], k) for c, k in kinds.items()], names=list(kinds))

    return listed.select(*names).mapInArrow(run, schema)


def packed(rows: DataFrame, cost: Column, target: int, *by: str) -> tuple[DataFrame, int]:
    """(rows with ``part``, number of parts): parts of about ``target`` cost, numbered without gaps; stored.

    Within each slice of the table rows are dealt by falling cost, then by ``by``, into parts in turn: a row that
    costs ``target`` or more is alone in its part, and other parts cost less than twice that.
    """
    scratch = Scratch(rows.sparkSession, "packed")
    sliced = scratch.write(rows.withColumns({"_cost": F.coalesce(cost.cast("long"), F.lit(0)) + 1, "_slice": F.spark_partition_id()}), "sliced")
    order = Window.partitionBy("_slice").orderBy(F.desc("_cost"), *by)
    before = F.coalesce(F.sum("_cost").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = sliced.withColumn("_bin", F.floor(before / target)).withColumn("_own", F.dense_rank().over(Window.partitionBy("_slice").orderBy("_bin")) - 1)
    own = scratch.write(own, "binned")
    sizes = sorted((r["_slice"], r["n"]) for r in own.groupBy("_slice").agg((F.max("_own") + 1).alias("n")).collect())  # a row for each slice
    first, total = [], 0
    for s, n in sizes:
        first.append((s, total))
        total += n
    bases = rows.sparkSession.createDataFrame(first, "_slice int, _base int")
    made = own.join(F.broadcast(bases), "_slice").withColumn("part", (F.col("_base") + F.col("_own")).cast("int"))
    made = scratch.write(made.drop("_slice", "_cost", "_bin", "_own", "_base"), "parts")
    scratch.drop(sliced, own)
    return made, total


def by_part(rows: DataFrame, first: int, last: int) -> DataFrame:
    """The rows of parts first to last - 1, each part in a partition of its own."""
    own = rows.filter(F.col("part").between(first, last - 1))
    return own.repartitionById(last - first, F.col("part") - first)


def stamp(path: str) -> datetime:
    """When a file was last changed, as list_files gives it."""
    system, own = opened(path)
    return system.get_file_info(own).mtime.astimezone(UTC)
