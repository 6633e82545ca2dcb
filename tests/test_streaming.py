"""Files as they arrive: each asset once, wherever a run is killed."""

import re

import pytest
from test_optimize import JPEG, png_file

from assetlake.sources.versions import Run, Versions
from assetlake.streaming.incremental import OUTCOMES, incremental_results, incremental_run, stream_assets


@pytest.mark.parametrize("where", ["while writing", "before its commit", "between both commits"])
def test_a_killed_run_leaves_each_asset_once(spark, tmp_path, monkeypatch, where):
    src, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    src.mkdir()
    for i in range(3):
        (src / f"{i}.png").write_bytes(png_file(1000 + i))
    (src / "x.JPG").write_bytes(JPEG)
    (src / "no.txt").write_bytes(b"no")

    def run():
        return incremental_run(spark, stream_assets(spark, str(src), files_per_batch=2), out, progress)

    commit, write, calls = Run.commit, Run.write, []

    def killed_commit(self):
        calls.append(1)
        if len(calls) < 2 or where == "between both commits":
            commit(self)
        if len(calls) == 2:
            raise RuntimeError("killed")

    def killed_write(self, df, table, *p):
        made = write(self, df, table, *p)
        if table == "results" and len(calls) == 1:
            raise RuntimeError("killed")
        return made

    monkeypatch.setattr(Run, "commit", killed_commit)
    if where == "while writing":
        monkeypatch.setattr(Run, "write", killed_write)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(Run, "commit", commit)
    monkeypatch.setattr(Run, "write", write)
    assert Versions(spark, out).read("outcomes", OUTCOMES).count() == (4 if where == "between both commits" else 2)
    done = [r.path.rsplit("/")[-1] for r in run().collect()]
    assert sorted(done) == ["0.png", "1.png", "2.png", "x.JPG"]
    results = {r.path.rsplit("/")[-1]: r for r in incremental_results(spark, out).collect()}
    assert sorted(results) == sorted(done) and incremental_results(spark, out).count() == 4
    assert all(len(r.encoded) == r.after < r.before for r in results.values())
    (src / "late.png").write_bytes(png_file(2000))
    assert run().count() == 5 and run().count() == 5


def test_nothing_has_arrived(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = stream_assets(spark, str(tmp_path / "in"))
    assert incremental_run(spark, source, str(tmp_path / "out"), str(tmp_path / "progress")).count() == 0


def test_the_stream_keeps_no_path_of_a_file(spark, tmp_path):
    src, progress = tmp_path / "in", tmp_path / "progress"
    (src / "more").mkdir(parents=True)
    for i in range(9):
        (src / ("more" if i % 2 else "") / f"asset{i}.jpg").write_bytes(JPEG)
    run = lambda: incremental_run(spark, stream_assets(spark, str(src), files_per_batch=4), str(tmp_path / "out"), str(progress))
    assert sorted(r["count"] for r in run().groupBy("version").count().collect()) == [1, 4, 4]
    kept = "".join(p.read_text() for p in sorted((progress / "sources" / "0").iterdir()) if not p.name.startswith("."))
    assert "asset" not in kept and len(set(re.findall("part-[^\"]*", kept))) == 3
    (src / "asset9.jpg").write_bytes(JPEG)
    assert run().count() == 10 and run().count() == 10


def test_a_kill_between_listing_and_stream_loses_no_file(spark, tmp_path):
    src, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    src.mkdir()
    for name in ("a.jpg", "b.jpg", "c.jpg"):
        (src / name).write_bytes(JPEG)
    source = stream_assets(spark, str(src), files_per_batch=2)
    source.stream(f"{progress}/arrived", progress)  # and no more
    (src / "a.jpg").unlink()
    (src / "d.jpg").write_bytes(JPEG)
    done = {r.path.rsplit("/")[-1]: r.status for r in incremental_run(spark, source, out, progress).collect()}
    assert done == {"a.jpg": "vanished!", "b.jpg": "ok", "c.jpg": "ok", "d.jpg": "ok"}
    with pytest.raises(FileNotFoundError):
        incremental_run(spark, stream_assets(spark, str(tmp_path / "nowhere")), out, str(tmp_path / "other"))
    (tmp_path / "older" / "offsets").mkdir(parents=True)
    with pytest.raises(RuntimeError):
        incremental_run(spark, source, out, str(tmp_path / "older"))
