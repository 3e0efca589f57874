import time

import numpy as np
import pytest

from tessera import cli
from tessera.streaming import control


def put(spark, folder, frames, name):
    spark.createDataFrame([(k,) for k in frames], "frame_index long").coalesce(1).write.parquet(str(folder / name))
    part = next((folder / name).glob("part-*.parquet"))
    (folder / "in").mkdir(exist_ok=True)
    part.rename(folder / "in" / f"{name}.parquet")


def writer(rows, folder, name):
    return rows.writeStream.queryName(name).format("parquet").option("path", str(folder / name)).option("checkpointLocation", str(folder / f"{name}-state"))


def test_admission_drain_and_backlog(spark, tmp_path):
    for k in range(5):
        put(spark, tmp_path, [k], f"f{k}")
    where, state = str(tmp_path / "in"), str(tmp_path / "out-state")
    assert tuple(control.backlog(spark, where, state).first()) == (5, 0, 2, 3)
    rows = control.admitted(spark, where, "frame_index long")
    query = control.drain(writer(rows, tmp_path, "out"), 120)
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [2, 2, 1]
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(5))
    put(spark, tmp_path, [5], "f5")
    assert tuple(control.backlog(spark, where, state).first()) == (1, 5, 2, 1)
    # a further run takes up what is new, each row once
    control.drain(writer(rows, tmp_path, "out"), 120)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(6))
    with pytest.raises(ValueError, match="capacity"):
        control.admitted(spark, where, "frame_index long", 0)


def test_shutdown_raises_the_first_error_in_order(spark, tmp_path):
    for k in range(3):
        put(spark, tmp_path, [k], f"f{k}")
    rows = control.admitted(spark, str(tmp_path / "in"), "frame_index long")
    good = writer(rows, tmp_path, "good").start()
    bad = writer(control.failing(rows, "infer", 1), tmp_path, "bad").start()
    with pytest.raises(Exception, match="infer failed at frame 1"):
        control.shut_down(good, bad, finish=True)
    assert not good.isActive and not bad.isActive
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3
    # what a stopped or failed query was given is done by the next one on its checkpoint
    control.drain(writer(rows, tmp_path, "bad"), 120)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [0, 1, 2]


def test_stall_delays_without_change(spark):
    rows = spark.range(4).withColumnRenamed("id", "frame_index").coalesce(1)
    began = time.monotonic()
    assert control.stalling(rows, 2, 0.5).count() == 4 and time.monotonic() - began >= 0.5
    assert control.failing(rows, "track", 9).count() == 4


def test_progress_is_limited():
    now, seen = [0.0], []
    listener = control.Progress(seen.append, 1.0, lambda: now[0])
    for at in (0.0, 0.5, 0.999, 1.0, 1.5, 2.1):
        now[0] = at
        listener.seen({"at": at})
    assert [s["at"] for s in seen] == [0.0, 1.0, 2.1]


@pytest.mark.parametrize("argv", [[], ["--nope", "v"], ["v", "w"], ["v", "--max-frames", "0"], ["v", "--max-frames"], ["v", "--loop-for-seconds", "x"], ["v", "--max-frames", "-1"], ["--model", "m"]])
def test_wrong_arguments(argv):
    with pytest.raises(SystemExit) as e:
        cli.parse(argv)
    assert e.value.code == 2


def test_arguments(tmp_path, capsys):
    got = cli.parse(["v", "--max-frames", "3", "--track-dump", "d"])
    assert (got.video, got.model, got.max_frames, got.loop_for_seconds, got.track_dump) == ("v", cli.DEFAULT_MODEL, 3, None, "d")
    with pytest.raises(SystemExit) as e:
        cli.parse(["--max-frames", "0", "-h"])
    assert e.value.code == 0 and "<video>" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "none"), "--model", "m"]) == 1 and "video path" in capsys.readouterr().err
    assert cli.main([str(tmp_path), "--model", str(tmp_path)]) == 1 and "model path" in capsys.readouterr().err


def test_tracks_of_frames(spark):
    def still_box(tensor):
        """Stands for a model: one object in the middle of every frame."""
        out = np.zeros((1, 84, 8400), np.float32)
        out[0, :4, 0], out[0, 6, 0] = (320, 320, 100, 100), 0.9
        return out

    rows = [(s, k, True, False, 64, 64, bytes(64 * 64 * 3)) for s in ("a", "b") for k in range(4)]
    frames = spark.createDataFrame(rows, "source string, frame_index long, read_ok boolean, is_empty boolean, height int, width int, data binary")
    got = cli.tracked(frames, still_box).collect()
    assert {(r.source_name, r.source, r.frame_index, r.track_id) for r in got} == {(s, n, k, 1) for n, s in ((1, "a"), (2, "b")) for k in range(4)}
    assert {r.frame_index for r in cli.tracked(frames, still_box, 2).collect()} == {0, 1}
    looped = cli.tracked(frames, still_box, None, 250.0).collect()
    assert {r.frame_index for r in looped} == set(range(8)) and {r.state for r in looped if r.frame_index > 3} == {"confirmed"}
