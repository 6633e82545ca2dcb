"""Tables that a job writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, shared_dir, written  # noqa: F401


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        Scratch(df.sparkSession, "dropped").drop(df)


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, to choose partition counts by; a scan without a shuffle of rows."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def veiled(docs: DataFrame, needed: tuple[str, ...]):
    """(docs, unveil): docs with columns other than those needed under names that no operator uses, and what gives them their names back.

    unveil takes a DataFrame with all of these columns and returns them alone, as they were. No column is read for it.
    """
    names = [c if c in needed else f"carried {i}" for i, c in enumerate(docs.columns)]
    back = [F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns)]
    return docs.toDF(*names), lambda df: df.select(*back)
