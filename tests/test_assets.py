import random
import time
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from assetlake.functions import headers as H
from assetlake.functions.jpeg import jpeg_dimensions
from assetlake.operators import classify as K
from assetlake.operators import frames as A
from assetlake.operators import segments as G
from assetlake.operators import symbols as S
from assetlake.operators.candidates import best_candidate, dedup_compute, recompress
from assetlake.operators.reports import sort_paths
from assetlake.plans.queries import QUERIES
from assetlake.sources import files


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("path", "kind"), [("/assets/01.gif", "gif"), ("/assets/01.JPEG", "jpeg"), ("/assets/01.jpg", "jpeg"), ("/assets/01.PNG", "png"), ("/assets/01.gif.webp", None)])
def test_ext_kind(spark, path, kind):
    assert one(spark, path, "string", H.ext_kind) == kind


def test_sniff_kind_needs_13_bytes(spark):
    assert one(spark, bytearray(b"GIF89a" + bytes(6)), "binary", H.sniff_kind) is None
    assert one(spark, bytearray(b"GIF89a" + bytes(7)), "binary", H.sniff_kind) == "gif"


@pytest.mark.parametrize(("text", "pixels"), [("5k", 5000), ("10 M", 10_000_000), ("42", 42), ("5g", None), ("0", None), ("x", None), ("", None), (None, None)])
def test_pixel_limit(spark, text, pixels):
    assert one(spark, text, "string", H.parse_pixel_limit) == pixels


def test_statuses_in_order(spark):
    big = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (65536).to_bytes(4) * 2 + b"\x08\x02"
    rows = [("a.png", big), ("b.png", big[:20]), ("c.gif", b""), ("d.gif", b"GIF89a" + bytes(9)), ("e.txt", b"text that is no image")]
    df = spark.createDataFrame([(p, bytearray(c), len(c)) for p, c in rows], "path string, content binary, length long")
    got = {r.path: r.status for r in K.classify(df).collect()}
    assert got == {"a.png": "too big", "b.png": "invalid format", "c.gif": "empty file", "d.gif": "invalid format", "e.txt": "invalid format"}


def test_no_kind_enabled():
    with pytest.raises(ValueError):
        K.Settings(kinds=())


def _walk(raw):
    """(width, height) from the first frame header outside nested images."""
    if raw is None or raw[:2] != b"\xff\xd8":
        return None
    at, nested = 2, 0
    while at + 4 < len(raw) and raw[at] == 0xFF:
        marker = raw[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and not nested:
            height, width = int.from_bytes(raw[at + 5 : at + 7]), int.from_bytes(raw[at + 7 : at + 9])
            return (width, height) if at + 9 < len(raw) and width and height else None
        nested += (marker == 0xD8) - (marker == 0xD9)
        if nested < 0:
            return None
        at += 2 + int.from_bytes(raw[at + 2 : at + 4])
    return None


def test_jpeg_walk(spark):
    raw = bytes.fromhex("FFD8FFE00004AABBFFC0001108002000100301110002110103110100")
    rng, rows = random.Random(8), [raw, b"\xff\xd8\xff", None, b"", b"GIF89a" + bytes(9)]
    for _ in range(400):
        parts = [rng.choice(["FFE00004AABB", "FFFE0002", "FFD80002", "FFD90002", "FFC40003AA", "FFDB0000", "FFC0001108002000100301", "FFC2000B080020001003", "FFC10011080000001003", "00", "FFCF00"]) for _ in range(rng.randint(0, 8))]
        rows.append(bytes.fromhex("FFD8" + "".join(parts)) + rng.randbytes(rng.randint(0, 9)))
    rows += [bytes.fromhex("FFD8" + "FFE00002" * n + "FFC000110800200010030111") for n in (30, 31, 32, 33, 4130, 9000)] + [bytes.fromhex("FFD8") + bytes.fromhex("FF000000") * 300]
    df = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(rows)], "i int, content binary")
    walked = df.select("i", jpeg_dimensions(F.col("content")).alias("s")).select("i", "s.width", "s.height")
    assert {r.i: (r.width, r.height) for r in walked.collect()} == {i: _walk(x) or (None, None) for i, x in enumerate(rows)}
    assert sum(_walk(x) is not None for x in rows) > 100
    plan = K.classify(spark.createDataFrame([], "path string, content binary, length long"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_jpeg_parts_tile_the_file():
    raw = bytes.fromhex("FFD8FFE00004AABBFFFE0004CCDDFFDA0003007F00FF00FFD012FFD9") + b"tail"
    parts = list(G.jpeg_parts(raw))
    assert [p[1] for p in parts] == [0xD8, 0xE0, 0xFE, 0xDA, 0xD9, None]
    assert [p[4] for p in parts] == [False, False, True, False, False, False]
    assert sum(p[3] for p in parts) == len(raw)
    with pytest.raises(G.Malformed):
        list(G.jpeg_parts(raw[:2] + raw))


def test_scan_end_over_all_bytes():
    for b in range(256):
        raw = bytes.fromhex("FFD8FFDA000200") + bytes([0xFF, b]) + b"\xff\xd9"
        scan = list(_until_malformed(G.jpeg_parts(raw)))[1]
        ends = 7 if b not in (0, *range(0xD0, 0xD8)) else 9
        assert scan[2] + scan[3] == (ends if b != 0xFF else 7)


def _until_malformed(parts):
    try:
        yield from parts
    except G.Malformed:
        return


def test_strip_keeps_what_is_no_metadata(spark):
    gif = bytes.fromhex("47494638396101000100000000") + b"\x21\xfe\x03abc\x00" + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00" + bytes.fromhex("2C0000000001000100000202440100") + b"\x3b"
    df = spark.createDataFrame([("x.gif", bytearray(gif)), ("y.gif", bytearray(b"GIF89a no"))], "path string, content binary")
    got = {r.path: bytes(r.stripped) for r in G.strip_metadata(df, "gif").collect()}
    assert got["x.gif"] == gif.replace(b"\x21\xfe\x03abc\x00", b"") and got["y.gif"] == b"GIF89a no"


def test_block_costs(spark):
    df = spark.createDataFrame([(1, bytearray([143, 144])), (2, bytearray(65536)), (3, bytearray())], "id long, content binary")
    got = {r.id: r for r in S.block_costs(S.histograms(df, "id", "content"), "id").collect()}
    assert got[1].fixed_bits == 24 and got[2].raw_bits == 524368 and got[3].raw_bits == 0


def test_recompress_round_trip(spark):
    df = spark.createDataFrame([(1, bytearray(b"a" * 1000)), (2, bytearray(b"x")), (3, bytearray())], "id long, content binary")
    got = {r.id: r for r in recompress(df).collect()}
    assert got[1].after < 50 and got[2].after == 1 and got[2].setting_no is None and got[3].after == 0


def test_best_candidate_ties_and_failures(spark):
    df = spark.createDataFrame([(1, 5, 0), (1, 5, 1), (1, None, 2)], "k long, size long, no int")
    assert best_candidate(df, "k", "size", "no").collect()[0].no == 0


def test_paths_sort_by_component(spark):
    df = spark.createDataFrame([("a-b/y",), ("a/z",), ("a/b/x",)], "path string")
    assert [r.path for r in sort_paths(df).collect()] == ["a/b/x", "a/z", "a-b/y"]


def test_merge_palettes(spark):
    rows = {1: [[1, 2], [2, 3], [7, 8, 9]], 2: [[1, 2, 3], [7, 8, 9]], 3: [[1, 2], [1, 2], [7, 8, 9]], 4: [[1, 2]], 5: [[1, 2, 3, 4, 5]], 6: [[5], [5]]}
    df = spark.createDataFrame([(k, i, p) for k, ps in rows.items() for i, p in enumerate(ps)], "asset_id int, frame_no int, palette array<int>")
    got = {r.asset_id: r.candidates for r in A.merge_palettes(df, 4).collect()}
    assert [1, 2, 3] in got[1] and got[2] == []
    assert got[3] == [[1, 2]] and got[4] == [[1, 2]] and got[5] == [] and got[6] == [[5]]


def test_merge_palettes_of_many_frames(spark):
    rng = random.Random(9)
    rows = [(1, i, sorted(rng.sample(range(2000), 40))) for i in range(600)] + [(2, i, sorted(rng.sample(range(30), rng.randint(1, 6)))) for i in range(40)]
    df = spark.createDataFrame(rows, "asset_id int, frame_no int, palette array<int>")

    def plain(palettes, limit):
        palettes, found = sorted((p for p in palettes if len(p) <= limit), key=len), set()
        for ordered in (palettes, palettes[::-1]):
            for i in range(len(ordered)):
                made, members = set(), 0
                for p in ordered[i:] + ordered[:i]:
                    if len(made | set(p)) <= limit:
                        made, members = made | set(p), members + 1
                if members > 1:
                    found.add(tuple(sorted(made)))
        return [list(x) for x in sorted(found)]

    began = time.time()
    got = {r.asset_id: r.candidates for r in A.merge_palettes(df, 200).collect()}
    assert time.time() - began < 60 and all(len(c) <= 200 for c in got[1]) and len(got[1]) > 300
    small = {r.asset_id: r.candidates for r in A.merge_palettes(df.filter("asset_id = 2"), 12).collect()}
    assert small[2] == plain([p for a, _, p in rows if a == 2], 12)


def test_distinct_contents_are_computed_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "a"), (6, "")], "k int, text string")
    seen = []

    def compute(once):
        seen.append([r.text for r in once.collect()])
        return once.select("digest", F.length("text").alias("n"))

    got = {r.k: (r.digest is None, r.n) for r in dedup_compute(df, "k", "text", compute).collect()}
    assert sorted(seen[0]) == ["", "a", "b"] and got == {1: (False, 1), 2: (False, 1), 3: (False, 1), 4: (True, None), 5: (False, 1), 6: (False, 0)}
    plan = dedup_compute(df, "k", "text", lambda once: once.select("digest", F.length("text").alias("n")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [k" in plan and "first(text" not in plan


def test_scan_ignores_case_and_other_files(spark, tmp_path):
    for name in ("a.GIF", "b.jpeg", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = {r.path.rsplit("/")[-1] for r in files.scan_assets(spark, [str(tmp_path)]).select("path").collect()}
    assert got == {"a.GIF", "b.jpeg"}
    with pytest.raises(FileNotFoundError):
        files.require_assets(files.scan_assets(spark, [str(tmp_path)], ["png"]))


def test_code_width_of_an_empty_payload(spark):
    df = spark.createDataFrame([(1, bytearray()), (2, bytearray([8])), (3, bytearray([255])), (4, None)], "id long, content binary")
    assert {r.id: r.width for r in S.code_width(S.histograms(df, "id", "content"), "id").collect()} == {1: 2, 2: 4, 3: 8}


def test_strip_rows_of_one_path(spark):
    jpeg = bytes.fromhex("FFD8FFE00004AABBFFFE0004CCDDFFDA0003007F00FF00FFD012FFD9")
    df = spark.createDataFrame([("a", bytearray(jpeg), 1), ("a", bytearray(jpeg), 2), (None, None, 3)], "path string, content binary, before long")
    got = [(r.path, r.before, r.after) for r in G.strip_metadata(df, "jpeg").collect()]
    assert sorted(got[:2]) == [("a", len(jpeg), len(jpeg) - 6)] * 2 and got[2] == (None, None, None)
    assert G.without_metadata(bytes.fromhex("FFD8FFFE0004CCDDFFD9") + bytes(8), "jpeg") is None  # 12 bytes are no image


@pytest.mark.parametrize("hot_rows", [10**6, 200, 1])
def test_frequent_keys_are_split_over_slices(spark, hot_rows):
    rows = [("hot" if i % 3 else f"k{i % 5}" if i % 5 else None, i, "xy"[(i // 4) % 2] if i % 7 else None, i % 6) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at int, v string, size int")
    want, sums, left, runs = {}, {}, {}, {}
    for k in {r[0] for r in rows}:
        own, total = sorted((r for r in rows if r[0] == k), key=lambda r: r[1]), 0
        for i, r in enumerate(own):
            sums[r[1]], total = total, total + r[3]
            left[r[1]] = next((j for j, s in enumerate(own[i + 1 :]) if s[2] != r[2]), len(own) - i - 1)
            if not i or own[i - 1][2] != r[2]:
                runs.setdefault(k, []).append([r[2], i, 0])
            runs[k][-1][2] += 1
    assert {r.at: r.offset for r in S.running_offset(df, "k", ["at"], F.col("size"), hot_rows=hot_rows).collect()} == sums
    assert {r.at: r.left for r in S.repeats_left(df, "k", ["at"], "v", hot_rows=hot_rows).collect()} == left
    for r in S.value_runs(df, "k", ["at"], "v", hot_rows=hot_rows).collect():
        want.setdefault(r.k, []).append((r.run_no, [r.v, r.first, r.n]))
    assert {k: [x for _, x in sorted(v)] for k, v in want.items()} == runs
    assert all(sorted(n for n, _ in v) == list(range(1, len(v) + 1)) for v in want.values())


def test_symbols_by_position_and_their_runs(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 7)
    blobs = [(1, bytes([0] * 9 + [7] * 3 + [0] * 5 + [9] * 8)), (2, b""), (3, None), (None, bytes([1, 1, 2]))]
    df = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in blobs], "k int, content binary")
    symbols = S.explode_symbols(df, "k", "content")
    assert sorted(map(str, ((r.k, r.pos, r.sym) for r in symbols.collect()))) == sorted(str((k, i, x)) for k, b in blobs if b for i, x in enumerate(b))
    one = {tuple(r) for r in S.payload_runs(df, "k", "content").select("k", "sym", "run_no", "first", "n", "good").collect()}
    assert one == {tuple(r) for r in S.value_runs(symbols, "k", ["pos"], "sym").select("k", "sym", "run_no", "first", "n", "good").collect()}
    assert {(r[1], r[4]) for r in one if r[5]} == {(0, 9), (0, 5), (9, 8)}


def test_runs_of_bytes_make_no_row_for_each_byte(spark, monkeypatch):
    plan = QUERIES["symbol_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    monkeypatch.setattr(S, "CHUNK", 5)
    rng = random.Random(1)
    blobs = [bytes(rng.choices((0, 1, 2), (8, 2, 1), k=rng.randrange(60))) for _ in range(40)] + [bytes(23), b"\x01" * 5, b"\x01" * 6, b"\x00"]
    df = spark.createDataFrame([(str(k), bytearray(b)) for k, b in enumerate(blobs)], "k string, content binary").repartition(3)
    every = {tuple(r) for r in S.payload_runs(df, "k", "content", 2, 3).collect()}
    assert {r for r in every if r[5]} == {tuple(r) for r in S.payload_runs(df, "k", "content", 2, 3, good_only=True).collect()}
    for k, b in enumerate(blobs):
        own = sorted((r[2], r[1], r[3], r[4]) for r in every if r[0] == str(k))
        runs = [(x, len(list(g))) for x, g in groupby(b)]
        starts = [sum(n for _, n in runs[:i]) for i in range(len(runs))]
        assert own == [(i + 1, x, at, n) for i, ((x, n), at) in enumerate(zip(runs, starts))]


def test_budgets_costs_and_ends(spark):
    row = spark.createDataFrame([(100, 300, 300)], "length int, width long, height long")
    assert row.select(*(c.alias(k) for k, c in K.effort_budget(0, 0).items())).first()[:] == (0, 0)
    assert row.select(*(c.alias(k) for k, c in K.effort_budget().items())).first()[:] == (60, 300)
    one = spark.createDataFrame([(0.0, 0.0), (0.0, 32.0), (4.0, 32.0)], "n double, total double")
    assert [r[0] for r in one.select(S.symbol_cost(F.col("n"), F.col("total"), S.EMPTY_DISTANCES)).collect()] == [5.0, 5.0, 3.0]
    old, new = (spark.createDataFrame(x, "sym int, n long") for x in ([(1, 5), (256, 9)], [(1, 2)]))
    assert {r.sym: r.n for r in S.decay_histogram(old, new, "sym", end=256).collect()} == {1: 4, 256: 1}
    df = spark.createDataFrame([(1, bytearray(b"aa")), (2, bytearray())], "id long, content binary")
    assert sorted(r[:3] for r in S.exploded(S.histograms(df, "id", "content"), "id", end=256).collect()) == [(1, 97, 2), (1, 256, 1), (2, 256, 1)]


def test_an_animation_that_plays_once(spark):
    df = spark.createDataFrame([(a, f, p, None if p == 0 else 5) for a in (1, 2, 3) for f in (0, 1) for p in (0, 1)], "asset_id int, frame_no int, pos int, color int")
    repeats = spark.createDataFrame([(1, 0), (2, None)], "asset_id int, repeat int")
    got = {(r.asset_id, r.frame_no): r.dispose for r in A.frame_disposal(df, repeats).collect()}
    assert got[1, 1] == "keep" and got[2, 1] == got[3, 1] == "background"


def test_export_name():
    assert files.export_name(1700000000.9) == "assetlake-1700000000.txt"
