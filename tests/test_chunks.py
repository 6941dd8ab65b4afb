"""Long videos: chunks, halos, two-level scans, pruning and plans."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe.operators import balls, chunks, pose, rackets, reports, tracker, trajectory
from rallyframe.params import DEFAULT, Params
from rallyframe.plans import catalogue
from rallyframe.session import co_partition, ship
from rallyframe.sources import facts
from rallyframe.sources.schemas import write_facts

DATA = "/root/testdata/sf0.001"
SHORT = Params(chunk_frames=40, halo_frames=11)
FRAME_BALLS = "video_id long, frame_num int, balls array<struct<det_idx:int,x:int,y:int>>"


def one_long_video(spark):
    """All frames of the folder as one video of about a thousand frames."""
    w = "row_number() over (partition by 1 order by v, f) - 1"
    return facts.event_frames(spark, DATA).selectExpr("7L as v", f"cast({w} as int) as f", "e", "ts", "kind")


def steps(ev, p, spread):
    frames, kp = spread(facts.frames(ev)), spread(facts.keypoints(ev))
    poses = pose.primary_pose(kp, p)
    first = balls.first_ball(balls.moving_by_grid(spread(balls.in_bounds(facts.ball_detections(ev), p)), p))
    carried = rackets.carried(frames, rackets.associated(rackets.rackets(spread(facts.racket_detections(ev)), p), poses), p)
    return frames, poses, first, carried, rackets.states(carried, first, p)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_assembly_in_chunks_equals_whole_videos(spark):
    ev = one_long_video(spark)
    frames, poses, first, carried, states = steps(ev, DEFAULT, lambda t: t)
    frames_c, poses_c, first_c, carried_c, states_c = steps(ev, SHORT, lambda t: chunks.spread(t, SHORT))
    assert rows(carried) == rows(chunks.own(carried_c, SHORT)) and rows(states) == rows(chunks.own(states_c, SHORT))
    whole = reports.frame_assembly(frames, poses, first, states)
    assert rows(whole) == rows(chunks.own(reports.frame_assembly(frames_c, poses_c, first_c, states_c, SHORT), SHORT))


def test_halo_must_cover_what_a_frame_depends_on():
    with pytest.raises(ValueError):
        Params(halo_frames=10)
    with pytest.raises(ValueError):
        Params(chunk_frames=16)


@pytest.mark.parametrize("size", [12, 40, 10_000])
def test_two_level_scans_equal_a_walk(spark, size):
    p, r = Params(chunk_frames=size, halo_frames=11), random.Random(size)
    seen = {n for n in range(1500) if (n // 30) % 4 and r.random() < 0.3}
    moving = spark.createDataFrame([(v, n, [(0, n * 7 % 50, n * 3 % 70)] if n in seen else []) for v in (1, 2) for n in range(5, 1500)], FRAME_BALLS).repartition(5)
    lost = {x.frame_num: (x.lost_frames, x.is_lost) for x in tracker.lost_counter(moving, p).filter("video_id = 1").collect()}
    segment = {x.frame_num: x.segment_id for x in tracker.segments(moving, p).filter("video_id = 2").collect()}
    points = moving.filter("size(balls) > 0").selectExpr("video_id", "frame_num", "balls[0].x as x", "balls[0].y as y")
    step = {x.frame_num: x.step for x in trajectory.step_distance(points, p).filter("video_id = 1").collect()}
    last, part, xy = -1, 0, None
    for n in range(5, 1500):
        if n in seen:
            part += last >= 0 and n - last > 6
            assert segment.pop(n) == part
            new = n * 7 % 50, n * 3 % 70
            d = step.pop(n)
            assert d is None if xy is None else abs(d - np.hypot(new[0] - xy[0], new[1] - xy[1])) < 1e-9
            last, xy = n, new
        assert lost.pop(n) == (n - last, n - last > 5)
    assert not lost and not segment and not step


@pytest.fixture
def plain_plans(spark):
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k in held:
        spark.conf.unset(k)
    ship(spark)


def test_one_long_video_is_many_tasks(spark, plain_plans):
    """Windows over frames are by (video, chunk): the largest task holds about the mean, not the video."""
    frames = spark.range(4000).selectExpr("1L as video_id", "cast(id as int) as frame_num")
    found = frames.filter("frame_num % 9 = 0").selectExpr("*", "1 as x1", "1 as y1", "9 as x2", "9 as y2", "0.5D as confidence")
    p = Params(chunk_frames=50, halo_frames=11)
    out = rackets.carried(chunks.spread(frames, p), chunks.spread(found, p), p)
    sizes = [x["count"] for x in out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * sum(sizes) / 4
    for query in ("racket_carry", "lost_counter", "track_segments", "step_distance"):
        plan = plan_of(spark, catalogue.queries()[query](spark, DATA))
        over = re.findall(r"Window \[(.*?)\], \[([^\]]*)\], \[([^\]]*)\]", plan)
        # Windows by video alone go over rows of chunks only; the first numbers the frames of the made-up facts.
        assert all("chunk" in by or "chunk" in order or by.startswith("v#") for _, by, order in over), over


def plan_of(spark, df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("query", "most"), [("frame_assembly", 6), ("racket_state", 6), ("tracked_frames", 6), ("keyframe_card", 12)])
def test_shuffles_of_the_flagship(spark, plain_plans, query, most):
    plan = plan_of(spark, catalogue.queries()[query](spark, DATA))
    lines = [x for x in plan.splitlines() if re.search(r"\bExchange\b", x) and "ReusedExchange" not in x]
    assert len(lines) <= most, "\n".join(lines)


def test_no_shuffle_on_bucketed_facts(spark, plain_plans):
    ev = facts.event_frames(spark, DATA)
    made = {"frames": facts.frames(ev), "keypoints": facts.keypoints(ev), "rackets": facts.racket_detections(ev), "balls": balls.in_bounds(facts.ball_detections(ev))}
    for name, table in made.items():
        spark.sql(f"drop table if exists chunked_{name}")
        write_facts(table, f"chunked_{name}", buckets=4)
    frames, kp, rk, bl = (spark.table(f"chunked_{n}") for n in made)
    co_partition(spark)
    poses = pose.primary_pose(kp)
    first = balls.first_ball(balls.moving_by_grid(bl))
    states = rackets.states(rackets.carried(frames, rackets.associated(rackets.rackets(rk), poses)), first)
    out = chunks.own(reports.frame_assembly(frames, poses, first, states))
    assert "Exchange" not in plan_of(spark, out) and "Exchange" not in plan_of(spark, chunks.own(states))
    assert rows(catalogue.rounded(out)) == rows(catalogue.queries()["frame_assembly"](spark, DATA))
    for name in made:
        spark.sql(f"drop table chunked_{name}")


def test_cards_see_only_requested_frames_and_their_halo(spark):
    ev = one_long_video(spark)
    asked = spark.createDataFrame([(300,), (303,), (300,), (-1,), (10**6,), (None,)], "frame_id int")
    assert [r.frame_num for r in reports.needed_frames(asked).filter("frame_num < 1000").orderBy("frame_num").collect()] == list(range(289, 304))
    frames, kp = facts.frames(ev), facts.keypoints(ev)
    # What stands behind the cut counts the rows that pass it.
    near = reports.needed_frames(asked)
    passed = kp.join(F.broadcast(near), "frame_num", "left_semi").count()
    assert passed == kp.filter("frame_num between 289 and 303").count()
    got = reports.keyframe_card(asked, frames, kp, facts.racket_detections(ev), balls.in_bounds(facts.ball_detections(ev)), facts.videos(ev))
    whole_frames, poses, first, carried, states = steps(ev, DEFAULT, lambda t: t)
    want = {r.frame_num: (r.swing_type, r.state or "NO RACKET/BALL", r.stance_width) for r in reports.frame_assembly(whole_frames, poses, first, states).filter("frame_num in (300, 303)").collect()}
    assert {r.frame_num: (r.swing_type, r.system_status, r.stance_width) for r in got.collect()} == want
    plan = plan_of(spark, got)
    assert plan.count("LeftSemi") >= 5  # four facts and the frames that are put out
