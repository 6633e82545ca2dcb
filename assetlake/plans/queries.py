"""One query for each operator, over the given tables or what Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions.jpeg import jpeg_dimensions as jpeg_size
from ..operators import candidates as C
from ..operators import classify as K
from ..operators import frames as A
from ..operators import reports as R
from ..operators import segments as G
from ..operators import symbols as S
from ..sources import files
from ..sources.scratch import Scratch
from ..streaming.incremental import incremental_run as run_incrementally
from ..streaming.incremental import stream_assets
from .fixtures import assets, containers, image_files, pixels, table
from .optimize import optimize_assets as run_optimize
from .optimize import optimized as optimized_contents
from .optimize import rewritten

LIMITED = K.Settings(kinds=("gif", "png"), max_pixels=2_000_000)
MERGED = 12  # colours of a merged palette
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


# Sources and sinks


def _relative(column: str, folder: str):
    return F.substring(column, len(folder) + 2, 1 << 20)


@query
def scan_assets(spark, d):
    """Files of the asset table, written below a folder and found again."""
    folder = Scratch(spark, "scan").path("files")
    files.write_files(assets(spark, d), folder)
    found = files.scan_assets(spark, [folder, f"{folder}/assets/1"])
    return found.select(_relative("path", folder).alias("path"), "length", "io", F.sha2("content", 256).alias("digest"))


@query
def path_union(spark, d):
    one = assets(spark, d).select("path")
    other = table(spark, d, "labels").select(F.concat(F.lit("/assets/"), (F.col("doc_id") % 13).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".gif")).alias("path"))
    return files.path_union(one, other)


@query
def rewritten_assets(spark, d):
    rows = K.classify(assets(spark, d), LIMITED).filter("status = 'ok'")
    after = F.col("length") - F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.floor(F.col("length") / 10))
    return files.smaller_only(rows.select("path", "kind", F.col("length").alias("before"), after.cast("long").alias("after")))


@query
def manifest_rows(spark, d):
    rows = _docs(spark, d).withColumn("path", F.concat(F.lit("./docs/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return files.parse_manifest(files.manifest_lines(rows, content="text"))


@query
def pending_export(spark, d):
    paths = R.pending(assets(spark, d), table(spark, d, "labels"), "doc_id").select("path")
    return files.pending_lines(paths)


# Names, headers, statuses


@query
def ext_kind(spark, d):
    return assets(spark, d).select("path", H.ext_kind(F.col("path")).alias("kind"))


@query
def sniff_kind(spark, d):
    return assets(spark, d).select("doc_id", H.sniff_kind(F.col("content")).alias("kind"))


@query
def gif_dimensions(spark, d):
    return assets(spark, d).select("doc_id", H.gif_dimensions(F.col("content")).alias("s")).filter("s IS NOT NULL").select("doc_id", "s.width", "s.height")


@query
def png_dimensions(spark, d):
    return assets(spark, d).select("doc_id", H.png_dimensions(F.col("content")).alias("s")).filter("s IS NOT NULL").select("doc_id", "s.width", "s.height")


@query
def jpeg_dimensions(spark, d):
    rows = assets(spark, d).filter(H.sniff_kind(F.col("content")) == "jpeg").select("doc_id", jpeg_size(F.col("content")).alias("s"))
    return rows.select("doc_id", "s.width", "s.height").filter("width IS NOT NULL")


@query
def png_color_type(spark, d):
    return assets(spark, d).select("doc_id", H.png_color_type(F.col("content")).alias("color_type")).filter("color_type IS NOT NULL")


@query
def pixel_limit(spark, d):
    text = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, "k").when(F.col("o_orderkey") % 5 == 1, " M").when(F.col("o_orderkey") % 5 == 2, "g").when(F.col("o_orderkey") % 5 == 3, "x").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", H.parse_pixel_limit(text).alias("pixels"))


@query
def resolution_filter(spark, d):
    return K.measured(assets(spark, d)).filter(H.within_pixel_limit(F.col("width"), F.col("height"), 2_000_000)).select("doc_id", "width", "height")


@query
def kind_filter(spark, d):
    rows = assets(spark, d).select("doc_id", H.sniff_kind(F.col("content")).alias("kind"))
    return K.kind_enabled(rows, ["gif", "png"])


@query
def classify(spark, d):
    return K.classify(assets(spark, d), LIMITED).select("doc_id", "kind", "status", "length")


@query
def kind_mismatch(spark, d):
    return K.kind_mismatch(assets(spark, d)).select("path", "name_kind", "content_kind")


@query
def effort_budget(spark, d):
    rows = K.measured(assets(spark, d)).filter("width IS NOT NULL")
    return rows.withColumns(K.effort_budget()).select("doc_id", "rounds", "lzw_step")


@query
def reportable_failures(spark, d):
    return K.reportable_failures(K.classify(assets(spark, d), LIMITED), LIMITED.kinds).select("path", "status")


# Containers


@query
def jpeg_segments(spark, d):
    return G.jpeg_segments(containers(spark, d, "jpeg"))


@query
def gif_blocks(spark, d):
    return G.gif_blocks(containers(spark, d, "gif"))


@query
def strip_metadata(spark, d):
    both = [G.strip_metadata(containers(spark, d, kind), kind) for kind in ("jpeg", "gif")]
    return both[0].unionByName(both[1]).select("path", "before", "after", F.lower(F.hex("stripped")).alias("content"))


@query
def metadata_inventory(spark, d):
    jpeg = G.metadata_inventory(G.jpeg_segments(containers(spark, d, "jpeg"))).withColumnRenamed("marker", "label")
    gif = G.metadata_inventory(G.gif_blocks(containers(spark, d, "gif")), "label")
    return jpeg.select(F.lit("jpeg").alias("kind"), "*").unionByName(gif.select(F.lit("gif").alias("kind"), "*"))


@query
def segment_sizes(spark, d):
    """By kind and marker or label: segments, their bytes and files, in SQL over the table functions."""
    G.register_table_functions(spark)
    jpegs, gifs = containers(spark, d, "jpeg"), containers(spark, d, "gif")
    sql = """SELECT kind, label, count(*) AS segments, sum(length) AS bytes, count(DISTINCT path) AS files FROM (
      SELECT 'jpeg' AS kind, s.marker AS label, s.length, a.path FROM {jpegs} a, LATERAL jpeg_segments(a.content) s WHERE NOT s.malformed
      UNION ALL SELECT 'gif', s.label, s.length, a.path FROM {gifs} a, LATERAL gif_blocks(a.content) s WHERE NOT s.malformed) GROUP BY kind, label"""
    return spark.sql(sql, jpegs=jpegs, gifs=gifs)


# Symbols


@query
def byte_histogram(spark, d):
    return S.exploded(S.histograms(_docs(spark, d), "doc_id", "text"), "doc_id").select("doc_id", "sym", "n")


@query
def entropy_cost(spark, d):
    rows = S.exploded(S.histograms(_docs(spark, d), "doc_id", "text"), "doc_id")
    return rows.select("doc_id", "sym", F.round(S.symbol_cost(F.col("n").cast("double"), F.col("n_bytes").cast("double")), 3).alias("cost"))


@query
def block_cost(spark, d):
    return S.block_costs(S.histograms(_docs(spark, d), "doc_id", "text"), "doc_id")


@query
def code_width(spark, d):
    return S.code_width(S.histograms(_docs(spark, d), "doc_id", "text"), "doc_id")


@query
def chunk_payload(spark, d):
    return S.chunk_payload(_docs(spark, d), "doc_id", F.octet_length("text"), chunk=4096, lookback=1024)


@query
def decay_histogram(spark, d):
    counts = lambda when: table(spark, d, "events").filter(when).groupBy("event_type").agg(F.count("*").alias("n"))
    return S.decay_histogram(counts(F.col("ts") < F.lit("2024-01-15").cast("timestamp")), counts(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")), "event_type", end="end")


@query
def value_runs(spark, d):
    return S.value_runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", 2, 2)


@query
def repeats_left(spark, d):
    return S.repeats_left(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "left")


@query
def symbol_runs(spark, d):
    """Good runs over the bytes of each document, by position; found where the documents are, as a row for each byte would be many times the input."""
    return S.payload_runs(_docs(spark, d), "doc_id", "text", 2, 3, good_only=True).select("doc_id", "sym", "run_no", "first", "n")


@query
def payload_runs(spark, d):
    """The same, picked from all runs."""
    return S.payload_runs(_docs(spark, d), "doc_id", "text", 2, 3).filter("good").select("doc_id", "sym", "run_no", "first", "n")


@query
def running_offset(spark, d):
    rows = S.running_offset(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.octet_length("props"))
    return rows.select("event_id", "offset")


# Candidates


def _costs(spark, d) -> DataFrame:
    return S.block_costs(S.histograms(_docs(spark, d), "doc_id", "text"), "doc_id")


@query
def candidate_grid(spark, d):
    rows = C.candidate_grid(_docs(spark, d).select("doc_id"), ["raw", "fixed", "adaptive"])
    return rows.select("doc_id", "setting_no", "setting")


@query
def best_candidate(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("double").alias("size"), "l_linenumber", "l_suppkey")
    return C.best_candidate(lines, "l_orderkey", "size", "l_linenumber", "l_suppkey")


@query
def dedup_compute(spark, d):
    measure = lambda once: S.block_costs(S.histograms(once, "digest", "text"), "digest")
    return C.dedup_compute(_docs(spark, d), "doc_id", "text", measure).select("doc_id", "digest", "n_bytes", "fixed_bits")


@query
def recompress(spark, d):
    return C.recompress(assets(spark, d).select("path", "content")).select("path", "before", "after", "setting_no", "failed", F.crc32("encoded").alias("encoded_crc32"))


# Reports


@query
def run_summary(spark, d):
    rows = K.classify(assets(spark, d), LIMITED).withColumns({"before": F.col("length"), "after": F.col("length") - F.floor(F.col("length") / 10)})
    return R.run_summary(rows)


@query
def pending_assets(spark, d):
    return R.pending(_docs(spark, d).select("doc_id"), table(spark, d, "labels"), "doc_id")


@query
def verify_manifest(spark, d):
    rows = _docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "doc_id")
    altered = F.when(F.col("doc_id") % 10 == 0, F.lit("changed")).otherwise(F.col("hash"))
    return R.verify_manifest(rows, rows.filter("doc_id % 11 != 0").select("path", altered.alias("hash")))


@query
def duplicate_payloads(spark, d):
    return R.duplicate_payloads(_docs(spark, d), "doc_id", "text")


@query
def sorted_paths(spark, d):
    rows = assets(spark, d).select("path", "doc_id")
    return R.sort_paths(rows)


# Frames


@query
def frame_delta(spark, d):
    return A.frame_delta(pixels(spark, d)).select("asset_id", "frame_no", "pos", "changed")


@query
def frame_disposal(spark, d):
    shown = pixels(spark, d)
    repeats = table(spark, d, "embeddings").select(F.col("label").alias("asset_id"), F.when(F.col("label") % 3 > 0, F.col("label") % 3 - 1).alias("repeat")).distinct()
    return A.frame_disposal(shown, repeats)


@query
def change_bbox(spark, d):
    return A.change_bbox(pixels(spark, d), 8, 8)


@query
def distinct_palette(spark, d):
    rows = A.distinct_palette(pixels(spark, d))
    return rows.select("asset_id", "frame_no", F.array_join("palette", ",").alias("palette"), "valid")


@query
def palette_containment(spark, d):
    frames = A.distinct_palette(pixels(spark, d))
    shared = frames.filter("frame_no < 3").select("asset_id", F.col("frame_no").alias("shared_no"), F.col("palette").alias("colors"))
    return A.palette_containment(frames, shared)


@query
def palette_index(spark, d):
    shown = pixels(spark, d)
    return A.palette_index(shown, A.distinct_palette(shown)).select("asset_id", "frame_no", "pos", "index")


@query
def merge_palettes(spark, d):
    merged = A.merge_palettes(A.distinct_palette(pixels(spark, d)), limit=MERGED)
    return merged.select("asset_id", F.to_json("candidates").alias("candidates"))


@query
def first_free_value(spark, d):
    return A.first_free_value(A.distinct_palette(pixels(spark, d))).select("asset_id", "frame_no", "free")


@query
def lossless_check(spark, d):
    before = pixels(spark, d)
    after = before.filter("asset_id != 3 OR frame_no > 0").withColumn("color", F.when(~((F.col("asset_id") == 5) & (F.col("pos") == 9)), F.col("color")))

    def frames(shown, late: bool):
        in_order = F.array_sort(F.collect_list(F.struct("pos", "color")))
        changed = lambda asset, frame: F.lit(late) & (F.col("asset_id") == asset) & (F.col("frame_no") == frame)
        made = shown.groupBy("asset_id", "frame_no").agg(
            F.bool_or(F.col("color").isNull()).alias("transparent"),
            F.array_sort(F.collect_set(F.coalesce("color", F.lit(-1)))).alias("palette"),
            F.sha2(F.array_join(F.transform(in_order, lambda s: F.coalesce(s["color"].cast("string"), F.lit("-"))), ","), 256).alias("pixels"),
            F.struct((F.min("pos") % 8).alias("x"), F.floor(F.max("pos") / 8).alias("y")).alias("box"),
        )
        return made.withColumns({"delay": 10 * F.col("frame_no") + changed(7, 2).cast("int"), "dispose": F.when(changed(6, 1), "background").otherwise("keep"), "needs_input": F.lit(False), "interlaced": (F.col("frame_no") % 2 == 0) != changed(8, 1)})

    return A.lossless_check(frames(before, False), frames(after, True))


# Whole runs


@query
def read_status(spark, d):
    listed = assets(spark, d).select("path", "doc_id")
    return K.read_status(listed, listed.filter("doc_id % 5 != 0"), listed.filter("doc_id % 10 != 0"))


@query
def written_status(spark, d):
    outcomes = assets(spark, d).select("path", F.lit("ok").alias("status"), F.col("length").alias("before"), F.floor(F.col("length") / 2).alias("after"))
    return K.written_status(outcomes, outcomes.filter("before % 4 != 0"))


@query
def payload_crc(spark, d):
    return _docs(spark, d).select("doc_id", files.content_crc("text").alias("crc"))


@query
def asset_report(spark, d):
    """By kind and status: assets, and their bytes before and after; damaged files, and whole ones that can be made smaller."""
    whole = image_files(spark, d).withColumn("length", F.length("content").cast("long"))
    rows = rewritten(assets(spark, d).select("path", "content", "length").unionByName(whole), LIMITED)
    return rows.groupBy("kind", "status").agg(F.count("*").alias("assets"), F.sum("before").alias("bytes"), F.sum("after").alias("bytes_after"))


@query
def optimize_assets(spark, d):
    """Outcomes of a whole run over files, after a second run into the same output, which has to leave them as they are."""
    scratch = Scratch(spark, "optimize")
    folder, out = scratch.path("files"), scratch.path("out")
    files.write_files(image_files(spark, d), folder)
    for _ in range(2):
        outcomes, _ = run_optimize(spark, [folder], out)
    return outcomes.withColumn("path", _relative("path", folder))


@query
def optimized(spark, d):
    """What a reader of the whole run's output gets: the smaller contents by path."""
    scratch = Scratch(spark, "optimized")
    folder, out = scratch.path("files"), scratch.path("out")
    files.write_files(image_files(spark, d).filter("path NOT LIKE '%PNG'"), folder)
    run_optimize(spark, [folder], out, batch_parts=1, part_cost=1 << 22)
    return optimized_contents(spark, out).select(_relative("path", folder).alias("path"), "kind", "before", "after", F.lower(F.hex("encoded")).alias("content"))


@query
def incremental_run(spark, d):
    scratch = Scratch(spark, "incremental")
    source, out, checkpoint = (scratch.path(x) for x in ("arrived", "out", "progress"))
    rows = assets(spark, d).select("path", "length", "content")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(source)
    for part in (0, 1):
        rows.filter(F.pmod(F.crc32("path"), F.lit(2)) == part).write.mode("append").parquet(source)
        done = run_incrementally(spark, stream(), out, checkpoint, LIMITED)
    return done.drop("version")


@query
def incremental_files(spark, d):
    """Files that arrive in two instalments, read as a stream of binary files."""
    scratch = Scratch(spark, "arrivals")
    folder, out, checkpoint = (scratch.path(x) for x in ("arrived", "out", "progress"))
    rows = image_files(spark, d)
    for part in (0, 1):
        files.write_files(rows.filter(F.pmod(F.crc32("path"), F.lit(2)) == part), folder)
        done = run_incrementally(spark, stream_assets(spark, folder, files_per_batch=100_000), out, checkpoint)
    return done.select(F.element_at(F.split("path", "-arrived/"), -1).alias("path"), "kind", "status", "before", "after")
