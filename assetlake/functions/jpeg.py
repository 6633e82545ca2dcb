"""JPEG sizes by a walk over markers, as a fold over column expressions: no Python worker takes part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of frame headers, in hex, without those of the same range that begin tables and the like.
FRAMES = tuple(f"C{x:X}" for x in range(16) if x not in (0x4, 0x8, 0xC))
FIRST_STEPS, MORE_STEPS = 32, 4096  # markers walked before it is asked whether to go on


def _number(head: Column, at: int) -> Column:
    """The unsigned 16-bit integer at byte ``at`` of a hexadecimal text; null past its end."""
    digits = F.substring(head, 2 * at + 1, 4)
    return F.when(F.length(digits) == 4, F.conv(digits, 16, 10).cast("long"))


def jpeg_dimensions(content: Column) -> Column:
    """A struct of width and height, both null if there is no valid frame header.

    The walk goes from marker to marker, each taken to have a length, to the first frame header
    outside nested images; a step that finds none leaves (place, depth, the nine bytes there) for the next. Steps are
    folded in blocks, and a block after the walk's end is skipped, so a file costs about as many steps as it has markers.
    """
    size = F.length(content)

    def state(at: Column, nested: Column, done: Column, width: Column, height: Column) -> Column:
        head = F.hex(F.substring(content, (at + 1).cast("int"), F.lit(9)))
        return F.struct(at.cast("long").alias("at"), nested.cast("int").alias("nested"), done.alias("done"), width.alias("width"), height.alias("height"), head.alias("head"))

    def step(s: Column) -> Column:
        head = s["head"]
        marker = F.substring(head, 3, 2)
        inside = (s["at"] + 4 < size) & (F.substring(head, 1, 2) == "FF")
        frame = inside & marker.isin(*FRAMES) & (s["nested"] == 0)
        height, width = _number(head, 5), _number(head, 7)
        found = frame & (s["at"] + 9 < size) & (height > 0) & (width > 0)
        nested = s["nested"] + F.when(marker == "D8", 1).when(marker == "D9", -1).otherwise(0)
        done = ~inside | frame | (nested < 0)
        moved = state(s["at"] + 2 + F.coalesce(_number(head, 2), F.lit(0)), nested, done, F.when(found, width), F.when(found, height))
        return F.when(s["done"], s).otherwise(moved)

    nothing = F.lit(None).cast("long")
    begin = state(F.lit(2), F.lit(0), F.substring(content, 1, 2) != F.unhex(F.lit("FFD8")), nothing, nothing)
    walk = lambda s, n: F.aggregate(F.sequence(F.lit(1), n), s, lambda t, _: step(t))
    blocks = F.concat(F.array(F.lit(FIRST_STEPS)), F.array_repeat(F.lit(MORE_STEPS), F.ceil(size / (2 * MORE_STEPS)).cast("int")))
    end = F.aggregate(blocks, begin, lambda s, n: F.when(s["done"], s).otherwise(walk(s, n)), lambda s: F.struct(s["width"].alias("width"), s["height"].alias("height")))
    return F.when(content.isNotNull(), end)
