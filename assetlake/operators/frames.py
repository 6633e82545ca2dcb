"""Animation frames as a long table pixels(asset_id, frame_no, pos, color); a null colour is transparent.

In arrays of colours transparent is -1. A pixel meets its predecessor by (asset, pos), so the canvas
of one large animation is dealt over many tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 256


def _compared(pixels: DataFrame) -> DataFrame:
    w = Window.partitionBy("asset_id", "pos").orderBy("frame_no")
    return pixels.withColumn("previous", F.lag("color").over(w)).withColumn("changed", (F.col("frame_no") == 0) | ~F.col("previous").eqNullSafe(F.col("color")))


def frame_delta(pixels: DataFrame) -> DataFrame:
    """pixels with changed: the colour differs from the previous frame's; true in the first frame."""
    return _compared(pixels).drop("previous")


def _disposed(pixels: DataFrame, repeats: DataFrame | None, *more) -> DataFrame:
    """(asset_id, frame_no, dispose, more...): more are aggregates of a frame's pixels. Pixels are windowed once and grouped once."""
    frames = _compared(pixels).groupBy("asset_id", "frame_no").agg(
        ((F.col("frame_no") > 0) & (F.bool_or(F.col("color").isNull() & F.col("previous").isNotNull()) | F.bool_and("changed"))).alias("resets"),
        F.bool_or(F.col("color").isNull()).alias("clear"),
        *more,
    )
    if repeats is not None:
        frames = frames.join(repeats.select("asset_id", (F.col("repeat") == 0).alias("once")), "asset_id", "left")
    else:
        frames = frames.withColumn("once", F.lit(False))
    v = Window.partitionBy("asset_id").orderBy("frame_no")
    loops = F.lead("frame_no").over(v).isNull() & (F.col("frame_no") > 0) & F.first("clear").over(v) & ~F.coalesce("once", F.lit(False))
    background = F.coalesce(F.lead("resets").over(v), F.lit(False)) | loops
    return frames.withColumn("dispose", F.when(background, "background").otherwise("keep")).drop("resets", "clear", "once")


def frame_disposal(pixels: DataFrame, repeats: DataFrame | None = None) -> DataFrame:
    """(asset_id, frame_no, dispose): background if the next frame makes a pixel transparent or keeps none, else keep.

    The last frame of an animation of several frames becomes background if the first one has
    transparency and the animation loops. repeats(asset_id, repeat), a row for each asset: how often it is repeated, 0 for
    one that plays once, null for one without end; without the table, or a row in it, an animation loops.
    """
    return _disposed(pixels, repeats)


def change_bbox(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(asset_id, frame_no, min_x, max_x, min_y, max_y): the box of what changed.

    The whole canvas for the first frame and after a frame reset to background; one pixel at the
    origin for a frame that changes nothing.
    """
    hit = lambda c: F.when(F.col("changed"), c)
    x, y = hit(F.col("pos") % width), hit(F.floor(F.col("pos") / width))
    boxes = _disposed(pixels, None, F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    v = Window.partitionBy("asset_id").orderBy("frame_no")
    boxes = boxes.withColumn("whole", (F.col("frame_no") == 0) | F.coalesce(F.lag("dispose").over(v) == "background", F.lit(False)))
    pick = lambda c, full: F.when(F.col("whole"), full).otherwise(F.coalesce(c, F.lit(0))).cast("int")
    return boxes.select("asset_id", "frame_no", pick("x0", 0).alias("min_x"), pick("x1", width - 1).alias("max_x"), pick("y0", 0).alias("min_y"), pick("y1", height - 1).alias("max_y"))


def distinct_palette(pixels: DataFrame) -> DataFrame:
    """(asset_id, frame_no, palette, valid): each frame's colours in order, transparent as -1; valid up to 256 of them."""
    colors = F.array_sort(F.collect_set(F.coalesce("color", F.lit(-1))))
    return pixels.groupBy("asset_id", "frame_no").agg(colors.alias("palette")).withColumn("valid", F.size("palette") <= LIMIT)


def palette_containment(palettes: DataFrame, shared: DataFrame) -> DataFrame:
    """(asset_id, frame_no, shared_no): of shared(asset_id, shared_no, colors) those with all colours of the frame."""
    both = palettes.join(shared, "asset_id")
    return both.filter(F.size(F.array_except("palette", "colors")) == 0).select("asset_id", "frame_no", "shared_no")


def first_free_value(palettes: DataFrame) -> DataFrame:
    """palettes with free: the smallest value of 0..255 not in use, else the smallest above that is free."""
    grey = F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(255)), "palette"))
    above = F.array_min(F.array_except(F.sequence(F.lit(256), F.lit(256) + F.size("palette")), "palette"))
    return palettes.withColumn("free", F.coalesce(grey, above))


def palette_index(pixels: DataFrame, palettes: DataFrame) -> DataFrame:
    """pixels with index: where the colour stands in its frame's palette, from 0; null if it is not there."""
    at = F.array_position("palette", F.coalesce("color", F.lit(-1)))
    return pixels.join(palettes.select("asset_id", "frame_no", "palette"), ["asset_id", "frame_no"]).withColumn("index", F.when(at > 0, (at - 1).cast("int"))).drop("palette")


def _merged(palettes: list[list[int]], limit: int) -> list[list[int]]:
    """Shared palettes of an asset's palettes, which come in order of size; see merge_palettes. Sets of colours are bits of one integer."""
    colors = sorted(set().union(*palettes))
    if not palettes or len(colors) <= limit:
        return [colors] if palettes else []
    if len(palettes) == 2:
        return []
    number = {c: i for i, c in enumerate(colors)}
    up = [sum(1 << number[c] for c in set(p)) for p in palettes]
    found: set[int] = set()
    for ordered in (up, up[::-1]):
        for i in range(len(ordered)):
            made, members = ordered[i], 1
            for p in (*ordered[i + 1 :], *ordered[:i]):
                both = made | p
                if both == made or both.bit_count() <= limit:
                    made, members = both, members + 1
            if members >= 2:
                found.add(made)
    return sorted([c for i, c in enumerate(colors) if m >> i & 1] for m in found)


def merge_palettes(palettes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(asset_id, candidates): shared palettes worth trying for an asset, from those of its frames that are within the limit.

    No such frame: none. One: its palette. Two: their union if it fits, else none. More: the union of
    all if it fits; else, from each starting place in order of size (frames of one size in their order), and
    then in the reverse order, what still fits is merged in turn, and those of two frames or more are
    candidates, distinct and in order. Frames with equal palettes are frames like any others. An
    asset's palettes are one row, each of limit colours at most; colours are numbered by asset, and sets of them are bits, so
    that a union and its size are a few machine words' work.
    """
    sized = F.array_sort(F.collect_list(F.when(F.size("palette") <= limit, F.struct(F.size("palette").alias("size"), "frame_no", "palette"))))
    lists = palettes.groupBy("asset_id").agg(F.transform(sized, lambda s: s["palette"]).alias("up"))

    def run(batches):
        for batch in batches:
            made = [_merged(up, limit) for up in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.list_(pa.int32())))], names=["asset_id", "candidates"])

    return lists.mapInArrow(run, f"asset_id {palettes.schema['asset_id'].dataType.simpleString()}, candidates array<array<int>>")


def lossless_check(before: DataFrame, after: DataFrame, key: tuple[str, str] = ("asset_id", "frame_no")) -> DataFrame:
    """(asset_id, frames, same): both sides have the same frames, equal in every other column they share."""
    asset, frame = key
    compared = [c for c in before.columns if c not in key and c in after.columns]
    left = before.select(*key, F.struct(*compared).alias("one"))
    right = after.select(*key, F.struct(*compared).alias("other"))
    joined = left.join(right, list(key), "full_outer")
    equal = F.col("one").isNotNull() & F.col("other").isNotNull() & F.col("one").eqNullSafe(F.col("other"))
    return joined.groupBy(asset).agg(F.count("*").alias("frames"), F.bool_and(equal).alias("same"))
