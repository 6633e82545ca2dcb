"""Column expressions over file names and raw file content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading bytes by kind, in hex.
PNG_MAGIC, JPEG_MAGIC, GIF_MAGICS = "89504E470D0A1A0A", "FFD8FF", ("474946383761", "474946383961")
#: PNG colour types.
PNG_COLOR_TYPES = {0: "grey", 2: "rgb", 3: "palette", 4: "grey alpha", 6: "rgba"}
#: A file of this many bytes or fewer is no image.
MIN_BYTES = 12
U32_MAX = 4294967295


def _magic(content: Column, magic: str) -> Column:
    return F.substring(content, 1, len(magic) // 2) == F.unhex(F.lit(magic))


def uint(content: Column, *places: int) -> Column:
    """The unsigned integer whose bytes, highest first, stand at the 1-based places; null if one is missing."""
    digits = F.concat(*(F.hex(F.substring(content, p, 1)) for p in places))
    return F.when(F.length(digits) == 2 * len(places), F.conv(digits, 16, 10).cast("long"))


def ext_kind(path: Column) -> Column:
    """gif, jpeg or png by the last extension in any case; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "gif", "gif").when(ext.isin("jpg", "jpeg"), "jpeg").when(ext == "png", "png")


def sniff_kind(content: Column) -> Column:
    """gif, jpeg or png by the first bytes of a file of over 12 bytes; null for others."""
    kind = F.when(_magic(content, PNG_MAGIC), "png").when(_magic(content, JPEG_MAGIC), "jpeg").when(_magic(content, GIF_MAGICS[0]) | _magic(content, GIF_MAGICS[1]), "gif")
    return F.when(F.length(content) > MIN_BYTES, kind)


def _size(width: Column, height: Column) -> Column:
    """A struct of width and height; null unless both are over 0."""
    return F.when((width > 0) & (height > 0), F.struct(width.alias("width"), height.alias("height")))


def gif_dimensions(content: Column) -> Column:
    return F.when(sniff_kind(content) == "gif", _size(uint(content, 8, 7), uint(content, 10, 9)))


def png_dimensions(content: Column) -> Column:
    header = (F.length(content) > 24) & (F.substring(content, 13, 4) == F.unhex(F.lit("49484452")))
    return F.when((sniff_kind(content) == "png") & header, _size(uint(content, 17, 18, 19, 20), uint(content, 21, 22, 23, 24)))


def png_color_type(content: Column) -> Column:
    """The name of a PNG's colour type; null if it is no PNG or the type is unknown."""
    number, name = uint(content, 26), None
    for k, v in PNG_COLOR_TYPES.items():
        name = F.when(number == k, v) if name is None else name.when(number == k, v)
    return F.when((sniff_kind(content) == "png") & (F.substring(content, 13, 4) == F.unhex(F.lit("49484452"))), name)


def parse_pixel_limit(text: Column) -> Column:
    """A number with an optional suffix k, m or g (steps of 1,000); null if invalid, zero or over 32 bits."""
    trimmed = F.lower(F.trim(text))
    number = F.regexp_extract(trimmed, r"^([0-9]{1,10})\s*[kmg]?$", 1).try_cast("long")
    suffix = F.regexp_extract(trimmed, r"([kmg])$", 1)
    value = number * F.when(suffix == "k", 1_000).when(suffix == "m", 1_000_000).when(suffix == "g", 1_000_000_000).otherwise(1).cast("long")
    return F.when(value.between(1, U32_MAX), value)


def within_pixel_limit(width: Column, height: Column, limit: int | None) -> Column:
    """Width times height is within the limit and within 32 bits."""
    most = min(U32_MAX, limit or U32_MAX)
    return F.try_multiply(width.cast("long"), height.cast("long")).between(1, most)
