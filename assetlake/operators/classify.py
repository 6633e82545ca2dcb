"""What becomes of each asset: kinds, sizes, limits, statuses and work levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions.jpeg import jpeg_dimensions

KINDS = ("gif", "jpeg", "png")


@dataclass(frozen=True)
class Settings:
    kinds: tuple[str, ...] = KINDS
    max_pixels: int | None = None
    rounds: int | None = None  # of re-encoding; None: by size, 0: none
    preserve_meta: bool = False
    preserve_times: bool = False

    def __post_init__(self):
        if not self.kinds or not set(self.kinds) <= set(KINDS):
            raise ValueError("at least one kind, of gif, jpeg and png, must be enabled")


def measured(assets: DataFrame) -> DataFrame:
    """assets with kind, width and height; the marker walk runs on JPEG content only."""
    kind = H.sniff_kind(F.col("content"))
    rows = assets.withColumn("kind", kind)
    walked = jpeg_dimensions(F.when(F.col("kind") == "jpeg", F.col("content")))
    rows = rows.withColumn("jpeg_size", walked)
    size = F.when(F.col("kind") == "gif", H.gif_dimensions(F.col("content"))).when(F.col("kind") == "png", H.png_dimensions(F.col("content")))
    rows = rows.withColumn("size", size)
    width, height = (F.when(F.col("kind") == "jpeg", F.col(f"jpeg_size.{x}")).otherwise(F.col(f"size.{x}")).alias(x) for x in ("width", "height"))
    return rows.withColumns({"width": width, "height": height}).drop("size", "jpeg_size")


def kind_enabled(df: DataFrame, kinds) -> DataFrame:
    return df.filter(F.col("kind").isin(*Settings(kinds=tuple(kinds)).kinds))


#: What may become of an asset, by stage: reading, looking at it, writing.
READ_ERROR, VANISHED, WRITE_ERROR = "read error", "vanished!", "write error"


def status(settings: Settings, io: Column | None = None) -> Column:
    """The first that holds, in the order of checks: what the scan says (io), empty, no kind, kind disabled, no size, too big, ok.

    Needs length, kind, width and height. io: null for an asset that could be read (see read_status).
    """
    seen = (
        F.when(F.col("length") == 0, "empty file")
        .when(F.col("kind").isNull(), "invalid format")
        .when(~F.col("kind").isin(*settings.kinds), "skipped")
        .when(F.col("width").isNull() | F.col("height").isNull(), "invalid format")
        .when(~F.coalesce(H.within_pixel_limit(F.col("width"), F.col("height"), settings.max_pixels), F.lit(False)), "too big")
        .otherwise("ok")
    )
    return seen if io is None else F.coalesce(io, seen)


def read_status(listed: DataFrame, read: DataFrame, still_there: DataFrame) -> DataFrame:
    """(path, io): of each listed path null if it was read, else vanished! if it is not there any more, else read error."""
    marked = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(True))
    rows = listed.select("path").join(marked(read, "got"), "path", "left").join(marked(still_there, "there"), "path", "left")
    return rows.select("path", F.when(F.col("got").isNull(), F.when(F.col("there").isNull(), VANISHED).otherwise(READ_ERROR)).alias("io"))


def written_status(outcomes: DataFrame, written: DataFrame) -> DataFrame:
    """outcomes(path, status, before, after, ...): those that should have been written but are not among written(path) are write errors, and saved nothing."""
    there = written.select("path").distinct().withColumn("stored", F.lit(True))
    rows = outcomes.join(there, "path", "left")
    lost = F.coalesce((F.col("status") == "ok") & (F.col("after") < F.col("before")) & F.col("stored").isNull(), F.lit(False))
    return rows.withColumns({"status": F.when(lost, WRITE_ERROR).otherwise(F.col("status")), "after": F.when(lost, F.col("before")).otherwise(F.col("after"))}).drop("stored")


def classify(assets: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """assets(path, length, content, ...) with kind, width, height and status; a column io of theirs goes before all else."""
    return measured(assets).withColumn("status", status(settings, F.col("io") if "io" in assets.columns else None))


def kind_mismatch(assets: DataFrame) -> DataFrame:
    """Assets whose name and content disagree, with name_kind and content_kind."""
    named = assets.withColumns({"name_kind": H.ext_kind(F.col("path")), "content_kind": H.sniff_kind(F.col("content"))})
    return named.filter(~F.col("name_kind").eqNullSafe(F.col("content_kind")))


#: The largest step and number of rounds.
MAX_ROUNDS = 2**31 - 1


def effort_budget(rounds: int | None = None, lzw_step: int | None = None) -> dict[str, Column]:
    """rounds from length and lzw_step from width and height; explicit values hold for all assets, and 0 switches the work off.

    Explicit rounds are held to MAX_ROUNDS; an explicit step has no other bound than its type.
    """
    pixels = F.col("width") * F.col("height")
    usual = F.when(F.col("length") < 200_000, 60).otherwise(20)
    step = F.when(pixels > 65_535, F.col("width")).when(pixels > 32_767, F.lit(2).cast("long")).otherwise(F.lit(1).cast("long"))
    if (rounds or 0) < 0 or (lzw_step or 0) < 0:
        raise ValueError("rounds and steps are 0 or more")
    return {"rounds": usual if rounds is None else F.lit(min(rounds, MAX_ROUNDS)), "lzw_step": step if lzw_step is None else F.lit(lzw_step).cast("long")}


def reportable_failures(outcomes: DataFrame, kinds=KINDS) -> DataFrame:
    """Failures worth showing: not skipped, and of a name whose kind is enabled unless all are."""
    failed = outcomes.filter(~F.col("status").isin("ok", "skipped"))
    return failed if set(kinds) == set(KINDS) else failed.filter(H.ext_kind(F.col("path")).isin(*kinds))
