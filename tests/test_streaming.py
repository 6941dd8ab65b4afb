"""Streams in several micro-batches give what the batch operators give."""

import time

import pandas as pd
import pytest

from rallyframe.streaming import late, live, progress, replay

def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    done = q.awaitTermination(100)
    q.stop()
    assert done


T0 = pd.Timestamp("2024-01-01")
SCHEMA = "video_id long, frame_num int, event_time timestamp, x1 int, y1 int, x2 int, y2 int"


def at(n, v=1, x=None):
    return (v, n, (T0 + pd.Timedelta(seconds=n)).to_pydatetime(), *([x] * 4))


def written(spark, path, batches, schema=SCHEMA):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_frames_that_come_out_of_order(spark, tmp_path):
    """Each batch holds frames of the one before and after it; within the delay all are taken in order, whatever the batch."""
    live.open_states(spark)
    found = {3, 9, 11, 30, 47}
    order = [n for k in range(0, 60, 10) for n in (*range(k + 5, min(k + 15, 60)), *(range(5) if not k else ()))]
    assert sorted(order) == list(range(60))
    batches = [[at(n, 1, 5 if n in found else None) for n in order[k : k + 7][::-1]] for k in range(0, 60, 7)]
    stream = written(spark, str(tmp_path / "in"), [*batches, [at(500, 2)], [at(900, 2)]])
    q = live.carry_racket(stream, delay="20 seconds", idle="2 minutes").writeStream.format("memory").queryName("ordered").trigger(availableNow=True).start()
    assert q.awaitTermination(200) is not False
    rows = {r.frame_num: r for r in spark.sql("select * from ordered where video_id = 1").collect()}
    seen = None
    for n in range(60):
        seen = n if n in found else seen
        assert not rows[n].late and rows[n].last_seen_frame == (seen if seen is not None and n - seen <= 5 else None)
    state = q.lastProgress.stateOperators[0]
    assert spark.sql("select count(*) from ordered where video_id = 1").first()[0] == 60
    assert state.numRowsTotal <= 6  # video 1 is forgotten: what is left is of video 2, whose last frame still waits


def test_late_frames_go_to_a_table_of_their_own(spark, tmp_path):
    live.open_states(spark)
    batches = [[at(n, 1, 5 if n == 2 else None) for n in range(20)], [at(100, 1)], [at(200, 1), at(2, 1, 9), at(7, 1)], [at(300, 1)], [at(400, 1)]]
    rows = live.carry_racket(written(spark, str(tmp_path / "in"), batches), delay="10 seconds", idle="1 hour")
    out = str(tmp_path / "out")
    late.write_apart(rows, out, str(tmp_path / "state")).awaitTermination()
    schema = "video_id long, frame_num int, x1 int, y1 int, x2 int, y2 int, last_seen_frame int"
    read = lambda table: sorted(r.frame_num for r in late.read_apart(spark, out, schema, table).collect())
    assert read("late") == [2, 7] and read("in_time") == [*range(20), 100, 200, 300]
    before = read("in_time"), read("late")
    # A batch that is tried again, after a failure in the middle, leaves each row there once.
    again = spark.createDataFrame([(1, 2, None, None, None, None, None, True), (1, 50, None, None, None, None, None, False)], schema + ", late boolean")
    for _ in range(3):
        late.write_batch(again, 99, out)
    assert (read("in_time"), read("late")) == (sorted([*before[0], 50]), sorted([*before[1], 2]))
    late.write_apart(rows, out, str(tmp_path / "state")).awaitTermination()  # nothing new: nothing is written
    assert (read("in_time"), read("late")) == (sorted([*before[0], 50]), sorted([*before[1], 2]))


def test_windows(spark, tmp_path):
    t = pd.Timestamp("2024-01-01")
    rows = [(1, n, (t + pd.Timedelta(seconds=n / 10)).to_pydatetime(), 5 if n == 2 else None, 5 if n == 2 else None) for n in range(60)]
    schema = "video_id long, frame_num int, event_time timestamp, x int, y int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    drain(live.progress(read()), "seconds", "complete")
    assert {r.frames for r in spark.sql("select frames from seconds").collect()} == {10}
    drain(live.checkpoints(read()), "points", "complete")
    assert spark.sql("select sum(points) from points").first()[0] == 1
    drain(live.rallies(read().filter("frame_num < 20 or frame_num > 45")), "rallies", "complete")
    assert spark.sql("select * from rallies").count() == 2


def test_progress_is_reported_as_the_stream_runs(spark, tmp_path):
    log = progress.ProgressLog()
    spark.streams.addListener(log)
    try:
        drain(progress.observed(written(spark, str(tmp_path / "in"), [[at(n) for n in range(k)] for k in (5, 8)])), "counted")
        for _ in range(50):
            if len(log.rows) == 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    got = log.table(spark).orderBy("batch").collect()
    assert [(r.frames, r.last_frame) for r in got] == [(5, 4), (8, 7)] and all(r.seconds > 0 and r.frames_per_second > 0 for r in got)


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(ValueError):
        replay.shared_folder(Cluster())


def test_stateless_labels(spark, tmp_path):
    kp = [(i * 10.0, 5.0, 0.9) for i in range(17)]
    schema = "video_id long, frame_num int, kp array<struct<x:double,y:double,conf:double>>"
    spark.createDataFrame([(1, 0, kp)], schema).write.parquet(str(tmp_path / "in"))
    drain(live.label_poses(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "labels")
    assert spark.sql("select swing_type from labels").first()[0] == "Forehand"
