"""The same job as files arrive: only what has not been processed, and each asset once, wherever a run is killed.

Files that arrive are listed by tasks and noted in a table beside the stream's progress, and the stream is one over the few
files of that table: Spark's own file source would keep every path that it has seen in the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.classify import READ_ERROR, Settings
from ..plans.optimize import OUTCOME, cost, rewritten
from ..sources.listing import EXTENSIONS, by_part, list_files, packed, read_files
from ..sources.scratch import Scratch
from ..sources.versions import Versions

OUTCOMES = "path string, kind string, status string, before long, after long"
RESULTS = f"{OUTCOMES}, encoded binary"
NOTED = "path string, length long, modificationTime timestamp"
NOTED_ROWS = 100_000  # rows in a file of the table of arrivals, if batches are not limited
PART_COST = 1 << 28  # as in plans.optimize, of which a micro-batch has less to deal out


@dataclass(frozen=True)
class Arriving:
    """Files below a folder as a source of ``incremental_run``, each of which counts once, by its path."""

    spark: SparkSession
    in_dir: str
    extensions: tuple[str, ...]
    files_per_batch: int | None

    def note(self, log: str) -> None:
        """Adds the files that are not in the table at log to it, in table files of files_per_batch rows at most. A folder that cannot be listed is an error.

        Cut short, it has added some of them, and the next run adds the others.
        """
        listed = list_files(self.spark, [self.in_dir], self.extensions)
        for bad in listed.filter(F.col("io").isNotNull() & ((F.col("io") == READ_ERROR) | (F.col("path") == self.in_dir))).take(1):
            raise FileNotFoundError(f"{bad.path}: {bad.io}")
        new = listed.filter("io IS NULL").drop("io").join(self.noted(log).select("path"), "path", "left_anti")
        scratch, size = Scratch(self.spark, "arrivals"), self.files_per_batch or NOTED_ROWS
        new = scratch.write(new.withColumn("_slice", F.spark_partition_id()), "new")
        before, bases = 0, []
        for r in sorted(new.groupBy("_slice").count().collect()):  # a row for each slice
            bases.append((r["_slice"], before))
            before += r["count"]
        if bases:
            at = F.col("_base") + F.row_number().over(Window.partitionBy("_slice").orderBy("path")) - 1
            dealt = new.join(F.broadcast(self.spark.createDataFrame(bases, "_slice int, _base long")), "_slice").withColumn("_file", F.floor(at / size).cast("int"))
            dealt.repartitionById(-(-before // size), "_file").select("path", "length", "modificationTime").write.mode("append").parquet(log)
        scratch.drop(listed, new)

    def noted(self, log: str) -> DataFrame:
        return self.spark.read.schema(NOTED).parquet(log)

    def stream(self, log: str, checkpoint: str) -> DataFrame:
        """(path, length, modificationTime) of what is in the table at log once the files there are now are noted, a table file or all of it at a time."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        system = path(log).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path(log)):
            if system.exists(path(f"{checkpoint}/offsets")):
                raise RuntimeError(f"{checkpoint} is the progress of another source")
            system.mkdirs(path(log))
        self.note(log)
        # Table files do not get too old to be read, as after a pause between two runs they would.
        reader = self.spark.readStream.schema(NOTED).option("maxFileAge", "36500d")
        return (reader if self.files_per_batch is None else reader.option("maxFilesPerTrigger", 1)).parquet(log)


def incremental_run(spark: SparkSession, source: DataFrame | Arriving, out: str, checkpoint: str, settings: Settings = Settings()) -> DataFrame:
    """Optimizes the assets that ``source``, a streaming table (path, length, content) or stream_assets' folder, has since the last run; returns all outcomes so far, with their ``version``.

    Each run takes what is there and ends; the checkpoint remembers what is done. A micro-batch is a version of ``out``
    (see sources.versions) under the name of its stream and number: killed before its commit it leaves nothing that is
    read, and killed between that and the stream's own commit it is found to be done when the stream offers it again.
    A file of a folder that is gone or cannot be read when its turn comes has that as its status, and is not tried again.
    """
    arriving = isinstance(source, Arriving)

    def process(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        versions = Versions(own, out)
        label = f"{json.loads(versions.text(f'{checkpoint}/metadata'))['id']}-{number}"
        if versions.has(label):
            return
        scratch = Scratch(own, "batch")
        if arriving:
            dealt, parts = packed(batch.withColumn("io", F.lit(None).cast("string")), cost(settings), PART_COST, "path")
            batch = read_files(by_part(dealt, 0, max(1, parts)))
        made, run = scratch.write(rewritten(batch, settings), "made"), versions.begin(label)
        smaller = made.filter("status = 'ok' AND after < before")
        run.write(smaller if settings.preserve_times else smaller.drop("modificationTime"), "results")
        run.write(made.select(*OUTCOME), "outcomes")
        run.commit()
        scratch.drop(made, *([dealt] if arriving else []))

    rows = source.stream(f"{checkpoint}/arrived", checkpoint) if arriving else source
    query = rows.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return Versions(spark, out).read("outcomes", OUTCOMES)


def incremental_results(spark: SparkSession, out: str) -> DataFrame:
    """(path, kind, status, before, after, encoded, version): the smaller contents of all committed micro-batches."""
    return Versions(spark, out).read("results", RESULTS)


def stream_assets(spark: SparkSession, in_dir: str, extensions=EXTENSIONS, *, files_per_batch: int | None = None) -> Arriving:
    """Files as they arrive below a folder, for incremental_run; a file counts once, by its path. files_per_batch: how many a micro-batch has at most."""
    return Arriving(spark, in_dir, tuple(extensions), files_per_batch)
