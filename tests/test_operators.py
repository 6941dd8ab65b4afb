"""Edges of the rules, sequential models, and plans."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe.functions.geometry import angle, seconds
from rallyframe.operators import balls, detect, motion, pose, rackets, reports, selection, tracker, trajectory
from rallyframe.params import DEFAULT, Params
from rallyframe.sources import facts
from rallyframe.sources.schemas import KEYPOINT_NAMES, read_facts, write_by_video

DATA = "/root/testdata/sf0.001"
FRAME_BALLS = "video_id long, frame_num int, balls array<struct<det_idx:int,x:int,y:int>>"


def detections(spark, rows):
    return spark.createDataFrame(rows, "video_id long, frame_num int, det_idx int, x int, y int, radius int")


def test_angle_edges(spark):
    row = spark.range(1).select(
        angle((F.lit(0), F.lit(0)), (F.lit(0), F.lit(0)), (F.lit(1), F.lit(0))).alias("zero_arm"),
        angle((F.lit(1), F.lit(0)), (F.lit(0), F.lit(0)), (F.lit(0), F.lit(1))).alias("right"),
        angle((F.lit(None).cast("int"), F.lit(0)), (F.lit(0), F.lit(0)), (F.lit(0), F.lit(1))).alias("missing"),
    ).first()
    assert row.zero_arm == 0.0 and round(row.right, 9) == 90.0 and row.missing is None


def test_seconds(spark):
    given = ["00:00:01", "1:02", "7", "", "1:2:3:4", "x", "99:99:99", None]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, ts string").select("i", seconds(F.col("ts")).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == [1, 62, 7, 0, None, None, 99 * 3600 + 99 * 60 + 99, None]


def test_gate_is_strict_and_keeps_unrated(spark):
    k = spark.createDataFrame([(1, 0, 0, 0, 5.9, -3.7, 0.5), (1, 0, 0, 1, 5.9, -3.7, 0.51), (1, 0, 0, 2, 0.0, 0.0, None)], "video_id long, frame_num int, person_idx int, kp_idx int, x double, y double, conf double")
    assert [(r.x, r.y) for r in pose.gate(k).orderBy("kp_idx").collect()] == [(None, None), (5, -3), (0, 0)]


def posed(spark, **points):
    values = {f"{n}_{c}": None for n in KEYPOINT_NAMES for c in "xy"}
    for n, (x, y) in points.items():
        values[f"{n}_x"], values[f"{n}_y"] = x, y
    return spark.createDataFrame([tuple([1, 0, *values.values()])], "video_id long, frame_num int, " + ", ".join(f"{k} int" for k in values))


@pytest.mark.parametrize(
    ("right_x", "hand", "label"),
    [(149, "right", "Two-Handed Backhand"), (150, "right", "Backhand"), (350, "right", "Forehand"), (350, "left", "Forehand"), (149, "up", "Forehand")],
)
def test_swing_labels(spark, right_x, hand, label):
    p = posed(spark, left_wrist=(100, 0), right_wrist=(right_x, 0), left_shoulder=(200, 0), right_shoulder=(300, 0), left_elbow=(0, 0), right_elbow=(1, 1))
    assert p.select(pose.swing_type(Params(dominant_hand=hand))).first()[0] == label


def test_row_filters_include_edges(spark):
    d = detections(spark, [(1, 0, 0, 650, 410, 3), (1, 0, 1, 1420, 980, 15), (1, 0, 2, 700, 500, 2), (1, 0, 3, 700, 500, 16), (1, 0, 4, 649, 500, 5)])
    assert sorted(r.det_idx for r in balls.in_bounds(d).collect()) == [0, 1]


def test_movement_of_exactly_the_threshold_moves(spark):
    d = detections(spark, [(1, 0, 0, 0, 0, 5), (1, 1, 0, 8, 0, 5), (1, 1, 1, 7, 0, 5), (1, 3, 0, 7, 0, 5)])
    frames = spark.createDataFrame([(1, n) for n in range(4)], "video_id long, frame_num int")
    got = sorted((r.frame_num, r.det_idx) for r in balls.moving(frames, d).collect())
    assert got == [(0, 0), (1, 0), (3, 0)]


def test_moving_forms_agree(spark):
    ev = facts.event_frames(spark, DATA)
    d = balls.in_bounds(facts.ball_detections(ev))
    a, b = balls.moving(facts.frames(ev), d), balls.moving_by_join(d)
    assert sorted(a.collect()) == sorted(b.collect())


def random_video(seed, frames=400):
    r = random.Random(seed)
    out = []
    for n in range(frames):
        if (n // 25) % 3 == 2:
            out.append((n, []))
        else:
            out.append((n, [(r.randrange(0, 60), r.randrange(0, 60)) for _ in range(r.choice((0, 1, 2, 4)))]))
    return out


@pytest.mark.parametrize("p", [DEFAULT, Params(min_ball_movement=3, static_movement=9, static_frames=2)])
def test_segments_track_like_whole_videos(spark, p):
    rows, want = [], []
    for v in range(3):
        model, video, before = tracker.Tracker(p), random_video(v), []
        for n, seen in video:
            moving = [b for b in seen if not any(model.near(b, q) < p.min_ball_movement for q in before)]
            before = seen
            ball = model.step(moving)
            rows.append((v, n, [(i, x, y) for i, (x, y) in enumerate(moving)]))
            if ball:
                want.append((v, n, *ball))
    random.Random(9).shuffle(rows)
    got = tracker.active_ball(spark.createDataFrame(rows, FRAME_BALLS), p).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_five_and_six_lost_frames(spark):
    rows = [(1, n, [(0, n, n)] if n in (0, 6, 13) else []) for n in range(14)]
    moving = spark.createDataFrame(rows, FRAME_BALLS)
    assert [r.segment_id for r in tracker.segments(moving).orderBy("frame_num").collect()] == [0, 0, 1]
    lost = {r.frame_num: (r.lost_frames, r.is_lost) for r in tracker.lost_counter(moving).collect()}
    assert lost[5] == (5, False) and lost[12] == (6, True) and lost[13] == (0, False)


def test_racket_carry_equals_a_walk(spark):
    r = random.Random(4)
    frames = spark.createDataFrame([(v, n) for v in range(3) for n in range(120)], "video_id long, frame_num int")
    found = {(v, n): (n, n + 1, n + 30, n + 40) for v in range(3) for n in range(120) if r.random() < 0.15}
    ball = {(v, n): (n + r.randrange(-60, 90), 500) for v in range(3) for n in range(120) if r.random() < 0.3}
    f = spark.createDataFrame([(*k, *b, 0.9) for k, b in found.items()], "video_id long, frame_num int, x1 int, y1 int, x2 int, y2 int, confidence double")
    b = spark.createDataFrame([(*k, *xy) for k, xy in ball.items()], "video_id long, frame_num int, x int, y int")
    got = {(x.video_id, x.frame_num): (x.x1, x.state) for x in rackets.states(rackets.carried(frames, f), b).collect()}
    for v in range(3):
        box = state = seen = None
        for n in range(120):
            if seen is not None and n - seen > 5:
                box = state = seen = None
            if (v, n) in found:
                box, seen, state = found[v, n], n, "associated_to_player"
            if box and (v, n) in ball:
                (x, y), cx, cy = ball[v, n], (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
                reach = max(box[2] - box[0], box[3] - box[1]) / 2 + 10
                d = ((cx - x) ** 2 + (cy - y) ** 2) ** 0.5
                state = "IMPACT ZONE" if d < reach and 432 < cy < 756 and 432 < y < 756 else "APPROACHING BALL" if d < 5 * reach else "IDLE / OTHER"
            assert got[v, n] == (box[0] if box else None, state)


def test_racket_ties_go_to_the_lower_index(spark):
    p = posed(spark, left_wrist=(100, 100))
    box = "video_id long, frame_num int, racket_idx int, class_id int, conf double, x1 double, y1 double, x2 double, y2 double"
    d = spark.createDataFrame([(1, 0, 1, 38, 0.4, 80.0, 90.0, 100.0, 110.0), (1, 0, 0, 38, 0.5, 100.0, 90.0, 120.0, 110.0), (1, 0, 2, 38, 0.39, 99.0, 99.0, 101.0, 101.0)], box)
    assert rackets.associated(rackets.rackets(d), p).first().x1 == 100


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 41])
def test_smoothing_equals_numpy(spark, n):
    rng = np.random.default_rng(n)
    xy = rng.integers(0, 500, (n, 2))
    points = spark.createDataFrame([(1, 3 * i, int(x), int(y)) for i, (x, y) in enumerate(xy)], "video_id long, frame_num int, x int, y int")
    got = np.array([(r.x, r.y) for r in trajectory.smooth_runs(points).orderBy("frame_num").collect()])
    want = np.concatenate([trajectory.clean(xy[a : a + 40].astype(float), 1e9) for a in range(0, n, 40)])
    assert np.allclose(got, want)


def test_outliers_chain(spark):
    xs = [0] * 30 + [1000, 0] + [0] * 8
    points = spark.createDataFrame([(1, i, x, 0) for i, x in enumerate(xs)], "video_id long, frame_num int, x int, y int")
    rows = trajectory.replace_outliers(points).orderBy("frame_num").collect()
    assert [r.x for r in rows] == [0] * 40 and sum(r.replaced for r in rows) == 2


def test_cumulative_smoothing_walk(spark):
    rng = np.random.default_rng(0)
    xy = rng.integers(0, 500, (100, 2)).astype(float)
    points = spark.createDataFrame([(1, i, int(x), int(y)) for i, (x, y) in enumerate(xy)], "video_id long, frame_num int, x int, y int")
    got = np.array([(r.x, r.y) for r in trajectory.smooth_cumulatively(points).orderBy("frame_num").collect()])
    held, done = [], []
    for i, b in enumerate(xy):  # a list cut to its last 40, cleaned at each checkpoint
        held.append(b)
        if len(held) > 40:
            done.append(held.pop(0))
        if i % 30 == 0:
            held = list(trajectory.clean(np.array(held), 3.0))
    assert np.allclose(got, np.array(done + held))


def test_player_ids_follow_boxes(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 0, 0, 10, 10), (1, 1, 1, 1, 1, 11, 11), (1, 1, 0, 50, 50, 60, 60), (1, 3, 0, 0, 0, 10, 10)], "video_id long, frame_num int, person_idx int, x1 int, y1 int, x2 int, y2 int")
    ids = {(r.frame_num, r.person_idx): r.player_id for r in motion.player_ids(boxes).collect()}
    assert ids[0, 0] == ids[1, 1] != ids[1, 0] and ids[3, 0] not in (ids[1, 1], ids[1, 0])


def test_player_ids_equal_brute_force_over_permutations(spark):
    """People whose boxes cross: each frame pair takes the assignment of greatest total overlap."""
    rng = random.Random(4)
    rows = []
    for v in (1, 2):
        for f in range(60):
            for person in range(rng.choice([0, 1, 2, 3])):
                x = rng.choice([0, 2, 4, 6, 9, 30, 34])
                rows.append((v, f, person, x, 0, x + 10, 10))
    boxes = spark.createDataFrame(rows, "video_id long, frame_num int, person_idx int, x1 int, y1 int, x2 int, y2 int")
    want = {}
    for v in (1, 2):
        before, new = {}, 0
        for f in range(60):
            here = {r[2]: r[3] for r in rows if r[:2] == (v, f)}
            share = lambda a, b: max(0, 10 - abs(a - b)) / (20 - max(0, 10 - abs(a - b)))
            gain = lambda i, q: int(share(here[i], before[q][0]) * 10**9) if q is not None and share(here[i], before[q][0]) >= 0.3 else 0  # noqa: B023, E731
            people, slots = sorted(here), [*sorted(before), *[None] * len(here)]
            order = lambda pick: [99 if q is None or not gain(i, q) else q for i, q in zip(people, pick, strict=True)]  # noqa: B023, E731
            best = min(itertools.permutations(slots, len(people)), key=lambda pick: (-sum(gain(i, q) for i, q in zip(people, pick, strict=True)), order(pick)))  # noqa: B023
            now = {}
            for i, q in zip(people, best, strict=True):
                if gain(i, q):
                    now[i] = (here[i], before[q][1])
                else:
                    now[i], new = (here[i], new), new + 1
                want[v, f, i] = now[i][1]
            before = now
    got = {(r.video_id, r.frame_num, r.person_idx): r.player_id for r in motion.player_ids(boxes).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_best_assignment_equals_brute_force(seed):
    rng = random.Random(seed)
    weight = {(a, b): rng.randrange(1, 6) for a in range(5) for b in range(4) if rng.random() < 0.7}
    got = motion.best_assignment(weight)
    assert len(set(got.values())) == len(got)
    full = [dict(zip(range(5), pick, strict=True)) for pick in itertools.permutations([0, 1, 2, 3, *[None] * 5], 5)]
    total = lambda m: sum(weight.get((a, b), 0) for a, b in m.items())
    assert total(got) == max(map(total, full))


def test_crowded_frames_by_grid(spark):
    r = random.Random(2)
    rows = [(1, n, i, r.randrange(400), r.randrange(400), 5) for n in range(3) for i in range(700)] + [(1, 1, 5000 + i, 8 * i, 0, 5) for i in range(3)]
    d = detections(spark, rows)
    p = Params(min_ball_movement=8.0)
    assert sorted(balls.moving_by_grid(d, p).collect()) == sorted(balls.moving_by_join(d, p).collect())
    big = spark.range(20_000).selectExpr("1L as video_id", "cast(id % 2 as int) as frame_num", "cast(id as int) as det_idx", "cast((id * 7919) % 30000 as int) as x", "cast((id * 104729) % 30000 as int) as y", "5 as radius")
    start = time.time()
    assert 0 < balls.moving_by_grid(big).count() <= 20_000  # 10,000 a frame: 10^8 pairs without the grid
    assert time.time() - start < 60


def test_cumulative_smoothing_against_polynomials(spark):
    """Many videos, gaps, several batches a video: against numpy's polynomial fit, a list cut to its last 40 and plain loops."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for v in (1, 2, 3):
        frames = np.cumsum(rng.choice([1, 1, 1, 2, 7, 45], 260 if v == 2 else 30 * v))
        held, seen, newest = [], 0, int(frames[-1])
        xy = rng.integers(0, 90, (len(frames), 2))
        xy[10::23] += 900
        rows += [(v, int(f), int(x), int(y)) for f, (x, y) in zip(frames, xy, strict=True)]
        for n in range(newest + 1):
            if seen < len(frames) and frames[seen] == n:
                held = [*held, [n, *map(float, xy[seen])]][-40:]
                want[v, n] = held[-1]
                seen += 1
            if n % 30 == 0 and len(held) > 2:
                steps = [((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 for a, b in zip(held, held[1:], strict=False)]
                mean = sum(steps) / len(steps)
                limit = mean + 3 * (sum((s - mean) ** 2 for s in steps) / len(steps)) ** 0.5
                for k, s in enumerate(steps, 1):
                    if s > limit:
                        held[k][1:] = held[k - 1][1:]
                m = len(held)
                width = 7 if m >= 9 else 5 if m >= 7 else 0
                if width:
                    old = [list(b) for b in held]
                    for k in range(m):
                        lo = min(max(k - width // 2, 0), m - width)
                        for c in (1, 2):
                            held[k][c] = float(np.polyval(np.polyfit(range(width), [b[c] for b in old[lo : lo + width]], 2), k - lo))
    points = spark.createDataFrame(rows, "video_id long, frame_num int, x int, y int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    got = {(r.video_id, r.frame_num): (r.x, r.y) for r in trajectory.smooth_cumulatively(points).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want) and all(np.allclose(got[k], want[k][1:], atol=1e-6) for k in want)


def test_smoother_holds_no_more_than_the_history():
    s = trajectory.Smoother()
    for k in range(0, 20_000, 500):
        s.take(np.arange(k, k + 500), np.zeros((500, 2)))
        assert len(s.frames) <= 40


def test_a_detector_that_fails_for_one_video(spark, tmp_path):
    import pandas as pd

    frames = spark.createDataFrame([(v, n) for v in (1, 2, 3) for n in range(40)], "video_id long, frame_num int").repartition(2)

    def load():
        def model(f):
            if ((f["video_id"] == 2) & (f["frame_num"] > 5)).any():
                raise RuntimeError("broken picture")
            return pd.DataFrame({"video_id": f["video_id"], "frame_num": f["frame_num"], "det_idx": 0, "x": 1, "y": 2, "radius": 3})

        return model

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows, rejects = detect.detect_apart(frames, load, "ball_detections", str(tmp_path / "made"))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.video_id, r["count"]) for r in rows.groupBy("video_id").count().collect()} == {(1, 40), (3, 40)}
    assert [tuple(r) for r in rejects.collect()] == [(2, "RuntimeError: broken picture")]


def test_one_level_listing_and_new_videos(spark, tmp_path):
    top = tmp_path / "v"
    (top / "deep").mkdir(parents=True)
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(selection.list_videos(spark, str(top), recursive=False)) == []
    for f in ("a.mp4", "B.MOV", "b.txt", "deep/c.MKV"):
        (top / f).write_bytes(b"x")
    (top / "deep").chmod(0)  # a listing that goes down would show its file
    try:
        assert names(selection.list_videos(spark, str(top), recursive=False)) == ["B.MOV", "a.mp4"]
    finally:
        (top / "deep").chmod(0o755)
    take = lambda: selection.take_new_videos(spark, str(top), str(tmp_path / "taken"), str(tmp_path / "state"))
    assert names(take()) == ["B.MOV", "a.mp4", "c.MKV"] and take().count() == 0
    (top / "deep" / "d.avi").write_bytes(b"x")
    assert names(take()) == ["d.avi"]


def test_written_frames_stand_in_order(spark, tmp_path):
    frames = spark.createDataFrame([(v, n) for v in (1, 2) for n in random.Random(1).sample(range(50), 50)], "video_id long, frame_num int").repartition(4)
    write_by_video(frames, str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).selectExpr("video_id", "frame_num", "_metadata.row_index as at").collect()
    assert len(rows) == 100 and all(r["at"] == r.frame_num for r in rows)


def test_run_is_summarised_by_the_pass_that_writes(spark, tmp_path):
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("run", "run")
    rows = spark.range(0, 1000, 1, 4).selectExpr("id % 3 as video_id", "cast(id as int) as frame_num")
    before = time.time()
    summary = reports.write_and_summarise(rows, str(tmp_path / "out"))
    n_jobs = len(jobs.getJobIdsForGroup("run"))
    spark.sparkContext._jsc.clearJobGroup()
    got = summary.first()
    assert (got.frames, got.last_frame, n_jobs) == (1000, 999, 1) and got.seconds >= 0
    table = spark.read.parquet(str(tmp_path / "out"))
    first, last = table.selectExpr("min(unix_millis(processed_at)) / 1000", "max(unix_millis(processed_at)) / 1000").first()
    assert before - 1 <= first <= last <= time.time() + 1 and abs(got.seconds - (last - first)) < 1e-6
    assert {r.frames for r in reports.run_summary(table).collect()} == {333, 334}


def test_requests_too_long_to_broadcast(spark, monkeypatch):
    from rallyframe.functions import sized

    asked = spark.range(3).selectExpr("cast(id as int) as frame_id")
    assert "broadcast" in sized.broadcast_if_small(asked)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in sized.broadcast_if_small(asked, 10)._jdf.queryExecution().analyzed().toString()


def test_metadata_fallbacks(spark):
    v = spark.createDataFrame([(1, "/a/b.MP4", 1, 1, 29.97, 0), (2, "/a/c.avi", 1, 1, 0.0, 0), (3, None, 1, 1, 25.0, 50)], "video_id long, path string, width int, height int, fps double, total_frames int")
    m = {r.video_id: r for r in selection.metadata(v).collect()}
    assert (m[1].fps_int, m[1].batch_frames, m[1].extract_frames) == (29, 29 * 3600, int(29.97 * 3600))
    assert (m[2].writer_fps, m[2].batch_frames, m[2].extract_frames, m[2].duration) == (25, -1, 100000, 0.0)
    good, bad = selection.split_valid(v)
    assert good.count() == 2 and bad.first().reject_reason == "no path"
    assert selection.parse_ids(spark.createDataFrame([("21, 37,x",)], "s string"), "s").collect() == [(21,), (37,), (None,)]


def test_listing_and_tables(spark, tmp_path):
    (tmp_path / "v" / "deep").mkdir(parents=True)
    for f in ("a.mp4", "b.txt", "deep/c.MKV"):
        (tmp_path / "v" / f).write_bytes(b"x")
    assert selection.list_videos(spark, str(tmp_path / "v")).count() == 2
    assert selection.list_videos(spark, str(tmp_path / "v"), recursive=False).count() == 1
    frames = spark.createDataFrame([(v, n) for v in (1, 2) for n in (2, 0, 1)], "video_id long, frame_num int")
    write_by_video(frames, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    (tmp_path / "r.json").write_text('{"frame_id": 3}\n{"frame_id": \n')
    rows = read_facts(spark, "frame_requests", str(tmp_path / "r.json"), "json").collect()
    assert sorted(r._corrupt is not None for r in rows) == [False, True]


def test_detector_contract(spark):
    import pandas as pd

    frames = spark.createDataFrame([(1, 0), (1, 1)], "video_id long, frame_num int")

    def load():
        return lambda f: pd.DataFrame({"video_id": f["video_id"], "frame_num": f["frame_num"], "det_idx": 0, "x": 1, "y": 2, "radius": 3})

    assert detect.detect(frames, load, "ball_detections").count() == 2


def test_native_operators_run_no_python(spark):
    ev = facts.event_frames(spark, DATA)
    x = pose.swing_metrics(pose.primary_pose(facts.keypoints(ev)), balls.first_ball(balls.moving(facts.frames(ev), balls.in_bounds(facts.ball_detections(ev)))))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_empty_tables(spark):
    d = detections(spark, [])
    frames = spark.createDataFrame([], "video_id long, frame_num int")
    moving = balls.moving_by_frame(frames, d)
    assert tracker.active_ball(moving).count() == 0 and balls.first_ball(d).count() == 0
