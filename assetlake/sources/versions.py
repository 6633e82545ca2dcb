"""Results as versions: a run writes beside all others and counts once its marker is there.

Below a folder, ``runs/<label>-<id>`` holds the tables of a run and ``commits/<number>`` its name. A marker is written
elsewhere and renamed, last of all, so a run that was cut short is never read: it leaves a folder that
nothing refers to. Readers take the committed runs, and of each key what the last of them says.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._runs: dict[int, str] = {}  # what markers say, which does not change

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._system.listStatus(at)) if self._system.exists(at) else []

    def committed(self) -> dict[int, str]:
        """The folder of each committed run, by number."""
        for name in self._names("commits"):
            if name.isdigit() and int(name) not in self._runs:
                self._runs[int(name)] = self.text(f"{self.root}/commits/{name}")
        return dict(self._runs)

    def text(self, path: str) -> str:
        """A small file's text."""
        stream = self._system.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def begin(self, label: str | None = None) -> Run:
        """A run to write to; label: what it does, for has, if that must not be done twice."""
        number = max(self.committed(), default=0) + 1
        return Run(self, number, f"{label or f'{number:09d}'}-{uuid.uuid4().hex}")

    def has(self, label: str) -> bool:
        """Whether a run of that label is committed."""
        return any(run.rpartition("-")[0] == label for run in self.committed().values())

    def read(self, table: str, schema: str) -> DataFrame:
        """The table of all committed runs, with the number of its run in ``version``; no rows before the first commit. One scan, however many runs there are."""
        runs = {run: number for number, run in self.committed().items() if self._system.exists(self._path(f"{self.root}/runs/{run}/{table}"))}
        if not runs:
            return self.spark.createDataFrame([], f"{schema}, version int")
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/runs/{run}/{table}" for run in runs))
        rows = rows.withColumn("_run", F.regexp_extract(F.col("_metadata.file_path"), f".*/runs/([^/]+)/{table}/", 1))
        numbers = self.spark.createDataFrame(pa.table({"_run": pa.array(runs, pa.string()), "version": pa.array(runs.values(), pa.int32())}))
        return rows.join(F.broadcast(numbers), "_run").drop("_run")

    def latest(self, table: str, schema: str, key: str) -> DataFrame:
        """Of each key the row of the last committed run that has it. The rows' columns go through a shuffle."""
        rows = self.read(table, schema)
        names = [c for c in rows.columns if c != key]
        return rows.groupBy(key).agg(F.max(F.struct("version", *(c for c in names if c != "version"))).alias("own")).select(key, *(f"own.{c}" for c in names))


class Run:
    """One run's tables, and the commit that makes them count."""

    def __init__(self, versions: Versions, number: int, name: str):
        self.versions, self.number, self.name = versions, number, name

    def path(self, table: str) -> str:
        return f"{self.versions.root}/runs/{self.name}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        df.write.parquet(self.path(table))
        return df.sparkSession.read.schema(df.schema).parquet(self.path(table)).select(*df.columns)

    def commit(self) -> None:
        """Publishes the run; an error if another one took its number meanwhile."""
        v = self.versions
        made, marker = (v._path(f"{v.root}/{x}") for x in (f"runs/{self.name}/marker", f"commits/{self.number:09d}"))
        stream = v._system.create(made, True)
        try:
            stream.write(bytearray(self.name.encode()))
        finally:
            stream.close()
        v._system.mkdirs(marker.getParent())
        if v._system.exists(marker) or not v._system.rename(made, marker):
            raise RuntimeError(f"version {self.number} of {v.root} is another run's")
