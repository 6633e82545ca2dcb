"""Tables that a job writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it; a folder of our own on one machine (tests), an error elsewhere."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = context.getCheckpointDir()
    return found


class Scratch:
    """The tables of one job, each written once as Parquet: later steps do not compute them anew, and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/assetlake-{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        made.scratch_path = path
        return made

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of ``write`` that nothing reads any more."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for df in tables:
            at = hadoop(df.scratch_path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet and read again."""
    return Scratch(df.sparkSession, name).write(df, name)
