"""Trying encodings: each payload once, each setting, and the smallest that gives the payload back."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.headers import PNG_MAGIC
from ..sources.scratch import written

#: Settings of the deflate codecs, (level, strategy, memory), in the order in which they win ties.
ZLIB_SETTINGS = ((9, zlib.Z_DEFAULT_STRATEGY, 9), (9, zlib.Z_FILTERED, 9), (6, zlib.Z_RLE, 9), (6, zlib.Z_HUFFMAN_ONLY, 9))
#: These and further ones, for work that an effort budget allows: as many as the largest budget has rounds.
EFFORTS = ZLIB_SETTINGS + tuple(
    x
    for x in ((level, strategy, memory) for memory in (8, 9, 7, 6, 5, 4, 3) for level in (9, 8, 7, 6, 5) for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FILTERED))
    if x not in ZLIB_SETTINGS
)[: 60 - len(ZLIB_SETTINGS)]
#: PNG chunks that are neither image nor colour nor animation, and go unless metadata is preserved.
PNG_METADATA = frozenset([b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME", b"pHYs", b"sPLT", b"hIST"])


def candidate_grid(assets: DataFrame, settings: list[str]) -> DataFrame:
    """assets with setting_no and setting, once for each setting; no join, the settings are one literal array."""
    return assets.select("*", F.posexplode(F.array(*map(F.lit, settings))).alias("setting_no", "setting"))


def best_candidate(candidates: DataFrame, key: str, size: str, ordinal: str, *payload: str) -> DataFrame:
    """(key, size, ordinal, payload...): the smallest of each key, the first of equals; null sizes have failed."""
    tried = candidates.filter(F.col(size).isNotNull())
    best = F.min(F.struct(F.col(size), F.col(ordinal), *payload)).alias("best")
    return tried.groupBy(key).agg(best).select(key, *(f"best.{c}" for c in (size, ordinal, *payload)))


def dedup_compute(df: DataFrame, key: str, content: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, digest, what compute adds): compute gets (digest, content), each distinct content once.

    Of the keys of a digest the lowest is elected, from digests alone; the rows of the others are left out of the table where they are
    (a stored list of keys, which Spark broadcasts unless it is large, and only then are contents moved). Digests go through the join back. Keys are unique;
    rows with a null content have a null digest and nothing more.
    """
    rows = df.select(key, content, F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    named = rows.select(key, "digest").filter("digest IS NOT NULL")
    several = named.groupBy("digest").agg(F.min(key).alias("_elected"), F.count("*").alias("_n")).filter("_n > 1")
    repeats = written(named.join(several, "digest").filter(F.col(key) != F.col("_elected")).select(key), "repeats")
    once = rows.filter("digest IS NOT NULL").join(repeats, key, "left_anti").select("digest", content)
    return rows.select(key, "digest").join(compute(once), "digest", "left")


def _deflated(content: bytes, setting: int) -> bytes:
    level, strategy, memory = EFFORTS[setting]
    c = zlib.compressobj(level, zlib.DEFLATED, 15, memory, strategy)
    return c.compress(content) + c.flush()


def png_chunks(raw: bytes) -> list[tuple[bytes, bytes]]:
    """(name, data) of each chunk up to IEND; an error for what is no PNG, is cut short or has a wrong checksum."""
    magic = bytes.fromhex(PNG_MAGIC)
    if not raw.startswith(magic):
        raise ValueError("not a PNG")
    at, found = len(magic), []
    while not found or found[-1][0] != b"IEND":
        size = int.from_bytes(raw[at : at + 4])
        name, data = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + size]
        if len(data) != size or zlib.crc32(name + data).to_bytes(4) != raw[at + 8 + size : at + 12 + size]:
            raise ValueError("a chunk is damaged")
        found.append((name, data))
        at += 12 + size
    return found


@lru_cache(maxsize=1)
def _read_once(raw: bytes) -> tuple | Exception:
    try:
        chunks = png_chunks(raw)
        return chunks, *_image(chunks)
    except (ValueError, zlib.error) as wrong:
        return wrong


def _taken_apart(raw: bytes) -> tuple[list[tuple[bytes, bytes]], list[tuple[bytes, bytes]], bytes]:
    """Chunks of a PNG, and what _image makes of them, or its error; kept for the settings that are tried on it in turn."""
    found = _read_once(raw)
    if isinstance(found, Exception):
        raise found
    return found


def _image(chunks: list[tuple[bytes, bytes]]) -> tuple[list[tuple[bytes, bytes]], bytes]:
    """What has to stay equal: the other chunks, and the image's bytes before compression."""
    rest = [c for c in chunks if c[0] != b"IDAT" and c[0] not in PNG_METADATA]
    return rest, zlib.decompress(b"".join(data for name, data in chunks if name == b"IDAT"))


def png_codec(raw: bytes, setting: int) -> bytes:
    """A PNG with its image data compressed anew and without metadata chunks; the image's bytes are the same."""
    chunks, rest, image = _taken_apart(raw)
    before = [n for n, _ in chunks if n not in PNG_METADATA].index(b"IDAT")
    made = [*rest[:before], (b"IDAT", _deflated(image, setting)), *rest[before:]]
    return bytes.fromhex(PNG_MAGIC) + b"".join(len(d).to_bytes(4) + n + d + zlib.crc32(n + d).to_bytes(4) for n, d in made)


def same_png(one: bytes, other: bytes) -> bool:
    return _taken_apart(one)[1:] == _image(png_chunks(other))


def deflate_codec(content: bytes, setting: int) -> bytes:
    return _deflated(content, setting)


def smallest(raw: bytes, settings: int, encode: Callable[[bytes, int], bytes], same: Callable[[bytes, bytes], bool], *, check_all: bool = False) -> tuple[int | None, bytes | None, int]:
    """(setting, encoding, failed) of the smallest encoding that is smaller than raw and stands for it; None and None without one.

    failed: settings that raised an error or made something that ``same`` rejects; of those that would not have
    won anyway only if all are to be checked.
    """
    setting, best, failed = None, None, 0
    for s in range(settings):
        try:
            made = encode(raw, s)
            wins = len(made) < len(raw if best is None else best)
            if (wins or check_all) and not same(raw, made):
                made = None
        except Exception:  # a codec may fail in any way; the content then stays as it is
            made = None
        failed += made is None
        if made is not None and wins:
            setting, best = s, made
    return setting, best, failed


def recompress(
    df: DataFrame,
    content: str = "content",
    *,
    settings: int = len(ZLIB_SETTINGS),
    encode: Callable[[bytes, int], bytes] = deflate_codec,
    same: Callable[[bytes, bytes], bool] = lambda raw, made: zlib.decompress(made) == raw,
    rounds: Callable[[int], int] | None = None,
) -> DataFrame:
    """df with before, after, setting_no, failed and encoded: the smallest encoding of each content that stands for it.

    All settings of a content are tried where it is, so that neither it nor its encodings are
    shuffled; the first of equally small ones wins. setting_no and encoded are null and after = before where none
    is strictly smaller. failed: how many settings raised an error or made something that ``same`` rejects.
    rounds: how many of the settings a content of some size is worth. A null content has null sizes.
    Columns of df with the names of the new ones are replaced.
    """
    new = _parse_datatype_string("before long, after long, setting_no int, failed int, encoded binary").fields
    names = [c for c in df.columns if c not in {f.name for f in new}]
    at = names.index(content)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        for batch in batches:
            rows = []
            for raw in batch.column(at).to_pylist():
                if raw is None:
                    rows.append((None,) * 5)
                    continue
                setting, made, failed = smallest(raw, min(settings, rounds(len(raw)) if rounds else settings), encode, same, check_all=True)
                rows.append((len(raw), len(raw) if made is None else len(made), setting, failed, made))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=[*names, *(f.name for f in new)])

    return df.select(*names).mapInArrow(run, StructType([*(df.schema[c] for c in names), *new]))
