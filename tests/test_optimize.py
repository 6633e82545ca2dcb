"""The whole run over real files: statuses, kills, resumption, the journal and the store, and how work is dealt out."""

import os
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assetlake.operators import classify as K
from assetlake.operators.candidates import EFFORTS, ZLIB_SETTINGS, png_chunks, png_codec, same_png
from assetlake.plans import optimize as X
from assetlake.sources import files, listing
from assetlake.sources.versions import Run, Versions


def png_file(pixels=20_000, text=b"hello"):
    def chunk(name, data):
        return len(data).to_bytes(4) + name + data + zlib.crc32(name + data).to_bytes(4)

    image = zlib.compress(bytes(pixels), 0)
    header = (100).to_bytes(4) + (50).to_bytes(4) + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + b"".join(chunk(*c) for c in ((b"IHDR", header), (b"tEXt", text), (b"IDAT", image[:7000]), (b"IDAT", image[7000:]), (b"IEND", b"")))


JPEG = bytes.fromhex("FFD8FFE00004AABBFFFE0004CCDDFFC00008080010002001FFDA0003007F00FF00FFD012FFD9")


def named(rows):
    return {r.path.rsplit("/")[-1]: r for r in rows.collect()}


def counting(folder):
    """The PNG codec, leaving a file for each payload and process that it is called for."""

    def encode(raw, setting):
        if setting == 0:
            Path(folder, f"{zlib.crc32(raw)}-{os.urandom(8).hex()}").touch()
        return png_codec(raw, setting)

    return {"png": (encode, same_png)}


def test_statuses_contents_and_lists(spark, tmp_path):
    for name, content in (("a.png", png_file()), ("b.jpg", JPEG), ("c.gif", b""), ("d.PNG", png_file()[:-5]), ("e.txt", b"no")):
        (tmp_path / name).write_bytes(content)
    more = tmp_path / "more" / "and more"
    more.mkdir(parents=True)
    (more / "f.png").write_bytes(png_file(30_000))
    (tmp_path / "gone.png").symlink_to(tmp_path / "nowhere.png")
    (tmp_path / "more" / "circle").symlink_to(tmp_path)
    (tmp_path / "list.txt").write_text(f"{more}/f.png\n\n  {more}/f.png \n{tmp_path}/absent.png\nnosuch://x/y.png\n")
    out = str(tmp_path / "out")
    outcomes, summary = X.optimize_assets(spark, [str(tmp_path), str(tmp_path / "more")], out, lists=[str(tmp_path / "list.txt")])
    got = named(outcomes)
    assert outcomes.count() == len(got) and {k: v.status for k, v in got.items()} == {
        "a.png": "ok", "b.jpg": "ok", "c.gif": "empty file", "d.PNG": "ok", "f.png": "ok", "absent.png": "vanished!", "y.png": "read error",
    }
    assert got["b.jpg"].after == len(JPEG) - 6 and got["d.PNG"].after == got["d.PNG"].before and got["absent.png"].before == 0
    stored = {k: bytes(r.encoded) for k, r in named(X.optimized(spark, out)).items()}
    assert sorted(stored) == ["a.png", "b.jpg", "f.png"] and len(stored["a.png"]) == got["a.png"].after < 300
    kept = png_chunks(stored["a.png"])
    assert [n for n, _ in kept] == [b"IHDR", b"IDAT", b"IEND"] and zlib.decompress(kept[1][1]) == bytes(20_000)
    assert {r.kind: (r.total, r.done) for r in summary.collect()}["all"] == (7, 4)
    files_out = {r.path for r in X.export_files(spark, out, str(tmp_path / "export"), strip=str(tmp_path)).collect()}
    assert files_out == {"/a.png", "/b.jpg", "/more/and more/f.png"} and (tmp_path / "export" / "a.png").read_bytes() == stored["a.png"]
    with pytest.raises(FileNotFoundError):
        X.optimize_assets(spark, [str(more)], out, K.Settings(kinds=("gif",)))
    same, _ = X.optimize_assets(spark, [str(tmp_path)], out, K.Settings(preserve_meta=True))
    assert same.filter("after < before").count() == 0


def test_a_second_run_reads_and_writes_nothing(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for i in range(4):
        (src / f"{i}.png").write_bytes(png_file(1000 + i))
    first = named(X.optimize_assets(spark, [str(src)], out)[0])
    assert len(Versions(spark, out).committed()) == 1
    again = named(X.optimize_assets(spark, [str(src)], out)[0])
    assert again == first and len(Versions(spark, out).committed()) == 1 and X.optimized(spark, out).count() == 4
    (src / "1.png").write_bytes(png_file(5000))
    (src / "new.png").write_bytes(png_file(6000))
    changed = named(X.optimize_assets(spark, [str(src)], out)[0])
    assert Versions(spark, out).read("outcomes", X.OUTCOMES).filter("version = 2").count() == 2
    assert changed["1.png"].before == len(png_file(5000)) and changed["0.png"] == first["0.png"] and len(changed) == 5
    held = {k: bytes(r.encoded) for k, r in named(X.optimized(spark, out)).items()}
    assert len(held) == 5 and zlib.decompress(png_chunks(held["1.png"])[1][1]) == bytes(5000)


@pytest.mark.parametrize("where", ["before", "after"])
def test_a_kill_around_the_commit_leaves_each_asset_once(spark, tmp_path, monkeypatch, where):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for i in range(6):
        (src / f"{i}.png").write_bytes(png_file(1000 + i))
    commit, calls = Run.commit, []

    def killed(self):
        calls.append(self.number)
        if where == "after" or len(calls) < 2:
            commit(self)
        if len(calls) == 2:
            raise KeyboardInterrupt

    monkeypatch.setattr(Run, "commit", killed)
    args = dict(part_cost=60_000, batch_parts=2)  # a file a part
    with pytest.raises(KeyboardInterrupt):
        X.optimize_assets(spark, [str(src)], out, **args)
    monkeypatch.setattr(Run, "commit", commit)
    done = Versions(spark, out).read("outcomes", X.OUTCOMES)
    before = done.count()
    assert before == done.select("path").distinct().count() > 0
    left = X.unfinished(listing.list_files(spark, [str(src)]), out)
    assert left.count() == 6 - before
    outcomes, _ = X.optimize_assets(spark, [str(src)], out, **args)
    assert outcomes.count() == 6 and X.optimized(spark, out).count() == 6
    rows = Versions(spark, out).read("outcomes", X.OUTCOMES)
    assert rows.count() == 6  # what had been committed was not done again


def test_small_batches_leave_no_core_idle_and_stay_few(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for i in range(10):
        (src / f"{i}.png").write_bytes(png_file(1000 + i))
    outcomes, _ = X.optimize_assets(spark, [str(src)], out, part_cost=60_000, batch_parts=1)  # a file a part
    assert outcomes.filter("status = 'ok' AND after < before").count() == 10 and X.optimized(spark, out).count() == 10
    rows = Versions(spark, out).read("outcomes", X.OUTCOMES)
    assert {r.version: r["count"] for r in rows.groupBy("version").count().collect()} == {1: 4, 2: 4, 3: 2}
    for parts, least, most in ((1, 1, 1), (30, 6, 5), (1800, 6, 25), (5, 2000, 1)):
        made = list(X.batches(parts, least))
        assert [first for first, _ in made] == [0, *(last for _, last in made[:-1])] and made[-1][1] == parts and len(made) <= most
        assert all(last - first <= max(least, first / 4) for first, last in made)


def test_files_that_are_stripped_only_cost_their_length(spark):
    rows = spark.createDataFrame([("a.jpg", 10), ("b.GIF", 10), ("c.PNG", 10), ("d.png", 200_000), ("e.png", None)], "path string, length long")
    costs = lambda *of: [r[0] for r in rows.select(X.cost(*of)).collect()]
    assert costs(K.Settings()) == [10, 10, 600, 4_000_000, 0]
    assert costs(K.Settings(rounds=0)) == costs(K.Settings(preserve_meta=True)) == costs(K.Settings(), {}) == [10, 10, 10, 200_000, 0]


def test_versions_are_read_by_one_scan(spark, tmp_path):
    versions = Versions(spark, f"{tmp_path}/runs/x/rows/")
    for n, label in ((1, None), (2, "stream-7"), (3, None)):
        run = versions.begin(label)
        run.write(spark.range(n), "rows")
        run.commit()
    rows = Versions(spark, f"{tmp_path}/runs/x/rows").read("rows", "id long")
    assert sorted(map(tuple, rows.collect())) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1 and versions.has("stream-7") and not versions.has("stream-8")
    assert versions.read("none", "id long").count() == 0


def test_unfinished_paths_are_exported_and_taken_up_again(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for i in range(3):
        (src / f"{i}.png").write_bytes(png_file(1000 + i))
    X.optimize_assets(spark, [str(src / "0.png")], out)
    exported = files.write_pending(X.unfinished(listing.list_files(spark, [str(src)]), out).select("path"), str(tmp_path / "pending"))
    X.optimize_assets(spark, [], out, lists=[exported])
    assert sorted(named(X.optimized(spark, out))) == ["0.png", "1.png", "2.png"]


def test_a_payload_is_encoded_once_across_paths_and_runs(spark, tmp_path):
    src, out, seen = tmp_path / "in", str(tmp_path / "out"), tmp_path / "seen"
    src.mkdir()
    seen.mkdir()
    for i in range(6):
        (src / f"{i}.png").write_bytes(png_file(1000 + i % 2))
    X.optimize_assets(spark, [str(src)], out, codecs=counting(str(seen)))
    assert len(list(seen.iterdir())) == 2
    (src / "later.png").write_bytes(png_file(1001))
    outcomes, _ = X.optimize_assets(spark, [str(src)], out, codecs=counting(str(seen)))
    got = named(outcomes)
    assert len(list(seen.iterdir())) == 2 and got["later.png"].after == got["1.png"].after < got["1.png"].before
    assert len(named(X.optimized(spark, out))) == 7
    assert Versions(spark, out).read("results", X.RESULTS).count() == 2


def test_a_file_that_fails_is_done_again(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.png").write_bytes(png_file())
    wanted = [str(src), str(src / "late.png")]
    assert named(X.optimize_assets(spark, wanted, out)[0])["late.png"].status == "vanished!"
    (src / "late.png").write_bytes(png_file(900))
    assert named(X.optimize_assets(spark, wanted, out)[0])["late.png"].status == "ok"


def test_a_result_that_is_not_as_made_is_a_write_error(spark, tmp_path, monkeypatch):
    (tmp_path / "a.png").write_bytes(png_file())
    write = Run.write
    monkeypatch.setattr(Run, "write", lambda self, df, table, *p: write(self, df.withColumn("encoded", F.expr("substring(encoded, 1, 3)")) if table == "results" else df, table, *p))
    got = named(X.optimize_assets(spark, [str(tmp_path)], str(tmp_path / "out"))[0])["a.png"]
    assert (got.status, got.after) == ("write error", got.before)


def test_settings_tried_follow_the_budget(spark, tmp_path):
    assert len(EFFORTS) == len(set(EFFORTS)) == 60 and EFFORTS[:4] == ZLIB_SETTINGS
    rows = spark.createDataFrame([(10,), (199_999,), (200_000,)], "length long")
    assert [r[0] for r in rows.select(X.tries(K.Settings())).collect()] == [60, 60, 20]
    assert [r[0] for r in rows.select(X.tries(K.Settings(rounds=3))).collect()] == [3, 3, 3]
    (tmp_path / "small.png").write_bytes(png_file())
    (tmp_path / "large.png").write_bytes(png_file(300_000))
    (tmp_path / "same.jpg").write_bytes(JPEG)
    for settings, small, large in ((K.Settings(), 60, 20), (K.Settings(rounds=2), 2, 2)):
        X.optimize_assets(spark, [str(tmp_path)], str(tmp_path / "out"), settings)
        tried = {(r.kind, r.before): r.tried for r in Versions(spark, str(tmp_path / "out")).read("results", X.RESULTS).filter(F.col("settings") == X._tag(settings)).collect()}
        assert tried["png", len(png_file())] == small and tried["png", len(png_file(300_000))] == large
    off, _ = X.optimize_assets(spark, [str(tmp_path)], str(tmp_path / "off"), K.Settings(rounds=0))
    got = named(off)
    assert got["small.png"].after == got["small.png"].before and got["same.jpg"].after < got["same.jpg"].before


def test_large_files_do_not_share_a_part(spark):
    sizes = [5000, 1200, 900, 1000] + [10] * 500 + [None]
    rows = spark.createDataFrame([(f"f{i:03}", s) for i, s in enumerate(sizes)], "path string, length long").repartition(3)
    made, parts = listing.packed(rows, F.col("length"), 1000, "path")
    held = {}
    for r in made.collect():
        held.setdefault(r.part, []).append(r.length or 0)
    assert sorted(held) == list(range(parts)) and sum(map(len, held.values())) == len(sizes)
    assert all(len(v) == 1 for v in held.values() if max(v) >= 1000)
    assert all(sum(v) + len(v) < 2000 + 2 for v in held.values() if len(v) > 1)
    dealt = listing.by_part(made, 0, parts).withColumn("task", F.spark_partition_id()).select("part", "task").distinct()
    assert dealt.count() == parts and dealt.select("task").distinct().count() == parts


def test_listing_is_whole_and_each_file_is_there_once(spark, tmp_path):
    want = set()
    for i in range(60):
        at = tmp_path / f"d{i % 4}" / f"é {i % 3}" / f"{i}.Gif"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(bytes(i))
        want.add((str(at), i))
    (tmp_path / "d0" / "no.webp").write_bytes(b"x")
    got = files.scan_assets(spark, [str(tmp_path), str(tmp_path / "d1"), f"file://{tmp_path}/d2/none"])
    rows = got.collect()
    found = [(r.path, r.length) for r in rows if r.io is None]
    assert len(found) == 60 and set(found) == want and all(bytes(r.content) == bytes(r.length) for r in rows if r.io is None)
    assert [r.io for r in rows if r.io] == ["vanished!"]
    assert files.scan_assets(spark, [str(tmp_path)], ["png"]).count() == 0


def test_a_file_that_goes_between_listing_and_reading(spark, tmp_path):
    for name in ("a.gif", "b.gif", "c.gif"):
        (tmp_path / name).write_bytes(b"x" * 20)
    listed = listing.list_files(spark, [str(tmp_path)])
    (tmp_path / "a.gif").unlink()
    (tmp_path / "b.gif").unlink()
    (tmp_path / "b.gif").mkdir()
    got = named(listing.read_files(listed))
    assert {k: (v.io, v.content and len(v.content)) for k, v in got.items()} == {"a.gif": ("vanished!", None), "b.gif": ("read error", None), "c.gif": (None, 20)}


def test_two_runs_cannot_commit_the_same_version(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    one, other = versions.begin(), versions.begin()
    for run, n in ((one, 1), (other, 2)):
        run.write(spark.range(n), "rows")
    assert versions.read("rows", "id long").count() == 0
    one.commit()
    with pytest.raises(RuntimeError):
        other.commit()
    assert versions.read("rows", "id long").count() == 1
