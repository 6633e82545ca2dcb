"""Summaries, manifests, duplicates, and work still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_summary(outcomes: DataFrame) -> DataFrame:
    """By kind and in all (kind 'all'; files of no kind are 'none'): total, done, skipped, bytes of the done ones, and what was saved of them.

    saved_ratio: null where there is nothing to save from.
    """
    ok = F.col("status") == "ok"
    rows = outcomes.withColumn("kind", F.coalesce("kind", F.lit("none")))
    made = rows.rollup("kind").agg(
        F.grouping("kind").alias("g"),
        F.count("*").alias("total"),
        F.count_if(ok).alias("done"),
        F.count_if(~ok).alias("skipped"),
        F.coalesce(F.sum(F.when(ok, F.col("before"))), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum(F.when(ok, F.col("after"))), F.lit(0)).alias("bytes_after"),
    )
    saved = F.col("bytes_before") - F.col("bytes_after")
    return made.select(F.when(F.col("g") == 1, "all").otherwise(F.col("kind")).alias("kind"), "total", "done", "skipped", "bytes_before", "bytes_after", saved.alias("saved"), F.round(F.try_divide(saved, "bytes_before"), 4).alias("saved_ratio"))


def pending(inputs: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Inputs that have no outcome."""
    return inputs.join(outcomes.select(key), key, "left_anti")


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, verdict): match, mismatch, missing or extra."""
    e, a = (df.select("path", F.col("hash").alias(c), F.lit(True).alias(f"has_{c}")) for df, c in ((expected, "wanted"), (actual, "found")))
    verdict = F.when(F.col("has_found").isNull(), "missing").when(F.col("has_wanted").isNull(), "extra").when(F.col("wanted").eqNullSafe(F.col("found")), "match").otherwise("mismatch")
    return e.join(a, "path", "full_outer").select("path", verdict.alias("verdict"))


def duplicate_payloads(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, digest, copies, first_key): the rows whose content occurs more than once; null contents have no duplicates."""
    hashed = df.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("digest")).filter("digest IS NOT NULL")
    several = hashed.groupBy("digest").agg(F.count("*").alias("copies"), F.min(key).alias("first_key")).filter("copies > 1")
    return hashed.join(several, "digest").select(key, "digest", "copies", "first_key")


def sort_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """df in the order of path components: 'a/b' before 'a-b'."""
    return df.orderBy(F.split(path, "/"))
