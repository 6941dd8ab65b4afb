"""Many videos and rows: streams with state by group of videos, files by size and state partitions by cores; written frames."""

import glob
import os

import pandas as pd
import pytest

from rallyframe.plans import catalogue
from rallyframe.streaming import live, replay

T0 = pd.Timestamp("2024-01-01")
FOUND = "video_id long, frame_num int, event_time timestamp, x1 int, y1 int, x2 int, y2 int"


def frame(v, n, x=None):
    return (v, n, (T0 + pd.Timedelta(seconds=10 * n)).to_pydatetime(), *([x] * 4))


def stream_of(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, FOUND).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(FOUND).option("maxFilesPerTrigger", 1).parquet(path)


def test_state_is_kept_by_group_of_videos(spark, tmp_path):
    """1,200 videos, and rows without a video: as many entries of state as groups have, and each video has its own memory and late rows."""
    live.open_states(spark)
    videos = [*range(1200), None]
    batches = [[frame(v, n, None if v is None else v if n == (v % 3) else None) for n in (2, 0, 1) for v in videos], [frame(v, 9) for v in videos], [frame(5, 1, 77), frame(None, 2, 77), frame(5, 10)], [frame(7, 40)]]
    rows = live.carry_racket(stream_of(spark, str(tmp_path / "in"), batches), delay="20 seconds", idle="1 day")
    q = rows.writeStream.format("memory").queryName("grouped").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.sql("select * from grouped").collect():
        got.setdefault((r.video_id, r.frame_num), []).append((r.late, r.x1, r.last_seen_frame))
    want = {(v, n): [(False, v, v % 3) if v is not None and v % 3 <= n < 9 else (False, None, None)] for v in videos for n in (0, 1, 2, 9)}
    want[5, 1].append((True, None, None))
    want[None, 2].append((True, None, None))
    want[5, 10] = [(False, None, None)]
    assert {k: sorted(v, key=str) for k, v in got.items() if k != (7, 40)} == {k: sorted(v, key=str) for k, v in want.items()}
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 1000


@pytest.mark.parametrize("most", [250_000, 100])
def test_micro_batches_in_several_files(spark, tmp_path, monkeypatch, most):
    """Each stretch of event time is one micro-batch, however many files it has; stretches without rows too."""
    monkeypatch.setattr(replay, "FILE_ROWS", most)
    rows = [frame(v, n, v) for v in range(40) for n in range(25) if not 7 <= n < 12]
    stream = replay.as_stream(spark.createDataFrame(rows, FOUND), str(tmp_path / "t"), 4, again=lambda t: t.filter("frame_num = 3"))
    seen = []
    at = lambda batch, _: seen.append(sorted(r.frame_num for r in batch.filter(f"video_id <> {replay.TICK}").select("frame_num").distinct().collect()))
    stream.writeStream.foreachBatch(at).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [[*range(7)], [12], [*range(13, 19)], [*range(19, 25)], [3], [], []]
    files = glob.glob(str(tmp_path / "t" / "in" / "**" / "*.parquet"), recursive=True)
    assert len(files) == 7 * (1 if most == 250_000 else 2)


def test_state_partitions_follow_the_cores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "shared_folder", lambda _: f"file://{tmp_path}/r")
    rows = spark.createDataFrame([frame(v, n) for v in range(20) for n in range(10)], FOUND)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        live.open_states(spark)
        assert replay.replay(rows, live.progress).count() == 200
        assert spark.conf.get("spark.sql.shuffle.partitions") == "16"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len([d for d in os.listdir(tmp_path / "r" / "state" / "state" / "0") if d.isdigit()]) == spark.sparkContext.defaultParallelism


def test_many_videos_are_written_to_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "shared_folder", lambda _: f"file://{tmp_path}/w")
    ev = spark.createDataFrame([(v, n, T0.to_pydatetime()) for v in [*range(300), None] for n in (4, 0, 3, 1, 2)], "v long, f int, ts timestamp").repartition(7)
    got = [(r.video_id, r.frame_num, r.position) for r in catalogue.Facts(spark, "", ev).by_video().collect()]
    assert sorted(got, key=str) == sorted([(v, n, n + 1) for v in [*range(300), None] for n in range(5)], key=str)
    assert len(glob.glob(str(tmp_path / "w" / "**" / "*.parquet"), recursive=True)) <= 128
