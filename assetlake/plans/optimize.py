"""The whole run: list, leave out what is done, read, classify, encode each payload once, commit, report.

Results and outcomes are versions (see sources.versions): a batch of files counts once it is committed,
so that a run that ends early keeps all but its last batch, and running again does only what is left. The
outcomes of committed batches are the journal by which files are left out before they are read; their results
are the store, by SHA-256 of the payload, by which a payload is encoded once, however many files and runs have it.
Contents are never shuffled: only rows of names are, before a task reads what they name.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import ext_kind
from ..operators.candidates import EFFORTS, png_codec, same_png, smallest
from ..operators.classify import READ_ERROR, VANISHED, WRITE_ERROR, Settings, classify, effort_budget
from ..operators.reports import run_summary
from ..operators.segments import BATCH_ROWS, PARTS, without_metadata
from ..sources.files import write_files
from ..sources.listing import by_part, list_files, packed, read_files
from ..sources.scratch import Scratch
from ..sources.versions import Versions

#: By kind: (encode, same). Kinds without an entry are stripped only.
CODECS = {"png": (png_codec, same_png)}
OUTCOME = ("path", "kind", "status", "before", "after")
OUTCOMES = "path string, length long, modificationTime timestamp, digest string, settings string, kind string, status string, before long, after long"
RESULTS = "digest string, settings string, kind string, before long, after long, tried int, encoded binary"
#: Files with these outcomes are done again by the next run.
AGAIN = (READ_ERROR, VANISHED, WRITE_ERROR)
PART_COST = 2 << 30  # bytes times settings tried that one task works on, or one larger file
BATCH_PARTS = 2000  # parts that are committed together, at least
BATCH_SHARE = 4  # a batch may have one part for so many that are done


def better(kind: str, raw: bytes, tries: int, settings: Settings, codecs: dict) -> bytes | None:
    """A smaller content that stands for raw, by the kind's codec or without its metadata; None without one."""
    made = None
    if kind in codecs and not settings.preserve_meta:
        _, made, _ = smallest(raw, tries, *codecs[kind])
    if made is None and kind in PARTS and not settings.preserve_meta:
        made = without_metadata(raw, kind)
    return made


def tries(settings: Settings) -> Column:
    """How many settings a file of some length is worth: its rounds, as far as there are settings."""
    return F.least(effort_budget(settings.rounds)["rounds"], F.lit(len(EFFORTS))).cast("int")


def cost(settings: Settings, codecs: dict = CODECS) -> Column:
    """Bytes that work on a file goes over: its length, times the settings tried if its name is of a kind that is encoded anew. Others are stripped at most."""
    encoded = F.lit(not settings.preserve_meta) & ext_kind(F.col("path")).isin(*codecs)
    return F.coalesce("length", F.lit(0)) * F.when(encoded, F.greatest(tries(settings), F.lit(1))).otherwise(F.lit(1))


def batches(parts: int, least: int):
    """(first, last) of each batch of parts: least of them, or more once many are done, so that batches grow in number as the logarithm of the parts only.

    A run that ends early loses no more than such a batch, a quarter of what it has committed, if that is more than least.
    """
    first = 0
    while first < parts:
        last = min(parts, first + max(least, first // BATCH_SHARE))
        yield first, last
        first = last


def rewritten(assets: DataFrame, settings: Settings = Settings(), codecs: dict = CODECS) -> DataFrame:
    """(path, kind, status, before, after, modificationTime, encoded): what becomes of each asset, and its new content if that is smaller.

    A kind with a codec is encoded anew, with as many settings as its effort budget has rounds, and JPEG and GIF files that this does not make smaller are
    stripped of metadata, unless it is to be preserved, which also leaves PNG files as they are. An asset stays in its
    task from the scan to here. Assets that are not ok keep their size.
    """
    rows = classify(assets, settings)
    if "modificationTime" not in rows.columns:
        rows = rows.withColumn("modificationTime", F.lit(None).cast("timestamp"))
    names = ["path", "kind", "status", "before", "modificationTime", "tries", "content"]
    rows = rows.withColumns({"before": F.col("length").cast("long"), "tries": tries(settings)}).select(*names)

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH_ROWS):
                piece = batch.slice(low, BATCH_ROWS)
                columns = {c: piece.column(i) for i, c in enumerate(names)}
                kinds, states, contents, worth = (columns[c].to_pylist() for c in ("kind", "status", "content", "tries"))
                encoded = [better(k, x, n, settings, codecs) if s == "ok" else None for k, s, x, n in zip(kinds, states, contents, worth)]
                after = pa.array([b if x is None else len(x) for b, x in zip(columns["before"].to_pylist(), encoded)], pa.int64())
                yield pa.RecordBatch.from_arrays([*(columns[c] for c in OUTCOME[:4]), after, columns["modificationTime"], pa.array(encoded, pa.binary())], names=[*OUTCOME, "modificationTime", "encoded"])

    return rows.mapInArrow(run, "path string, kind string, status string, before long, after long, modificationTime timestamp, encoded binary")


def _encoded(elected: DataFrame, tag: str, settings: Settings, codecs: dict) -> DataFrame:
    """RESULTS of elected(digest, kind, tries, content): a row for each payload that is still what its digest says."""
    names = ["digest", "kind", "tries", "content"]

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH_ROWS):
                rows = [r for r in batch.slice(low, BATCH_ROWS).to_pylist() if r["content"] is not None and hashlib.sha256(r["content"]).hexdigest() == r["digest"]]
                made = [better(r["kind"], r["content"], r["tries"], settings, codecs) for r in rows]
                sizes = [len(r["content"]) for r in rows]
                columns = [[r["digest"] for r in rows], [tag] * len(rows), [r["kind"] for r in rows], sizes, [n if x is None else len(x) for n, x in zip(sizes, made)], [r["tries"] for r in rows], made]
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in RESULTS.split(", ")])

    return elected.select(*names).mapInArrow(run, RESULTS)


def _tag(settings: Settings) -> str:
    """What results depend on, so that a run with other settings neither skips files nor takes over results."""
    return f"kinds={','.join(sorted(settings.kinds))} pixels={settings.max_pixels} rounds={settings.rounds} meta={settings.preserve_meta}"


def unfinished(listed: DataFrame, out: str, settings: Settings = Settings()) -> DataFrame:
    """Those of listed(path, length, modificationTime, ...) that no committed run below out has done with these settings, as they are now."""
    done = Versions(listed.sparkSession, out).read("outcomes", OUTCOMES).filter((F.col("settings") == _tag(settings)) & ~F.col("status").isin(*AGAIN))
    return listed.join(done.select("path", "length", "modificationTime").distinct(), ["path", "length", "modificationTime"], "left_anti")


def _batch(versions: Versions, files: DataFrame, first: int, last: int, settings: Settings, codecs: dict) -> None:
    """Does and commits the files of parts first to last - 1."""
    tag, run, scratch = _tag(settings), versions.begin(), Scratch(versions.spark, "batch")
    read = read_files(by_part(files, first, last).withColumn("listed", F.col("length")))
    seen = classify(read, settings).select(
        "path", F.col("listed").alias("length"), "modificationTime", "part", "kind", "status", F.coalesce("length", F.lit(0)).cast("long").alias("before"), F.sha2("content", 256).alias("digest")
    )
    seen = scratch.write(seen, "seen")
    # Of all files with a payload that is not in the store one is read again, by the task of its part.
    known = versions.read("results", RESULTS).filter(F.col("settings") == tag).select("digest", "after")
    once = seen.filter("status = 'ok'").groupBy("digest").agg(F.min(F.struct("path", "part", "kind", F.col("before").alias("length"))).alias("own")).select("digest", "own.*")
    elected = scratch.write(once.join(known, "digest", "left_anti").withColumns({"tries": tries(settings), "io": F.lit(None).cast("string")}), "elected")
    results = run.write(_encoded(read_files(by_part(elected, first, last)), tag, settings, codecs), "results")
    here = results.filter("encoded IS NULL OR octet_length(encoded) = after").select("digest", "after")
    made = results.select("digest", F.col("after").alias("made"))
    rows = seen.join(known.unionByName(here), "digest", "left").join(made, "digest", "left")
    status = F.when((F.col("status") == "ok") & F.col("after").isNull(), F.when(F.col("made").isNull(), READ_ERROR).otherwise(WRITE_ERROR)).otherwise(F.col("status"))
    rows = rows.withColumns({"status": status, "after": F.when(F.col("status") == "ok", F.coalesce("after", "before")).otherwise(F.col("before")), "settings": F.lit(tag)})
    run.write(rows.select(*(x.split()[0] for x in OUTCOMES.split(", "))), "outcomes")
    run.commit()
    scratch.drop(seen, elected)


def optimize_assets(
    spark: SparkSession, roots: list[str], out: str, settings: Settings = Settings(), *, lists: list[str] = (), codecs: dict = CODECS, part_cost: int = PART_COST, batch_parts: int = BATCH_PARTS
) -> tuple[DataFrame, DataFrame]:
    """(outcomes, summary) of the files below roots and in lists; what becomes of them is kept below out (see optimized).

    Nothing found is an error. Files that a committed run has done with the same settings, and that have the length and time they
    had, are not read again. A file that cannot be read is a read error, one that is not there vanished!, one whose
    result is not stored as made a write error; the others are done all the same, and these again by the next run.
    Work is dealt out by cost, length times settings tried. A batch that is committed has ``batch_parts`` parts, or as many as the
    cluster works on at once if that is more (fewer would leave the rest of it idle), and grows with what is done (see batches).
    """
    listed = list_files(spark, roots, settings_extensions(settings), lists=lists)
    if listed.isEmpty():
        raise FileNotFoundError("no files of the wanted kinds")
    versions = Versions(spark, out)
    files, parts = packed(unfinished(listed, out, settings), cost(settings, codecs), part_cost, "path")
    for first, last in batches(parts, max(batch_parts, spark.sparkContext.defaultParallelism)):
        _batch(versions, files, first, last, settings, codecs)
    outcomes = versions.latest("outcomes", OUTCOMES, "path").join(listed.select("path"), "path", "left_semi").select(*OUTCOME)
    return outcomes, run_summary(outcomes)


def optimized(spark: SparkSession, out: str) -> DataFrame:
    """(path, modificationTime, kind, before, after, encoded): of each file that became smaller its new content, as the last committed run has it."""
    versions = Versions(spark, out)
    last = versions.latest("outcomes", OUTCOMES, "path").filter("status = 'ok' AND after < before").select("path", "modificationTime", "kind", "before", "after", "digest", "settings")
    results = versions.read("results", RESULTS).filter("encoded IS NOT NULL").select("digest", "settings", "encoded")
    return last.join(results, ["digest", "settings"]).drop("digest", "settings")


def export_files(spark: SparkSession, out: str, folder: str, strip: str = "") -> DataFrame:
    """(path, length): the smaller contents written as files below folder, under their paths without the prefix ``strip``; never in place."""
    own = F.col("path")
    rows = optimized(spark, out)
    return write_files(rows.withColumn("path", F.when(F.startswith(own, F.lit(strip)), F.substring(own, F.lit(len(strip) + 1), F.length(own))).otherwise(own)), folder, "encoded")


def settings_extensions(settings: Settings) -> list[str]:
    return [e for k in settings.kinds for e in {"gif": ["gif"], "jpeg": ["jpg", "jpeg"], "png": ["png"]}[k]]
