"""Frame assembly, key-frame cards, run summary and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from rallyframe.functions.geometry import angle, point
from rallyframe.functions.sized import broadcast_if_small
from rallyframe.operators.balls import first_ball, moving_by_grid
from rallyframe.operators.chunks import by_frame
from rallyframe.operators.pose import metric_columns, primary_pose, swing_type
from rallyframe.operators.rackets import associated, carried, rackets, states
from rallyframe.params import DEFAULT, Params

BY_FRAME = ["video_id", "frame_num"]
RACKET = ("x1", "y1", "x2", "y2")


def assembled(frames: DataFrame, poses: DataFrame, balls: DataFrame, states_: DataFrame, p: Params, no_person: str) -> DataFrame:
    """Every frame with its pose, ball and racket columns and ``swing_type``: one join for each table, all on the frame's key."""
    key = by_frame(frames)
    ball = balls.select(*key, F.col("x").alias("ball_x"), F.col("y").alias("ball_y"))
    racket = states_.select(*key, *[F.col(c).alias(f"racket_{c}") for c in RACKET], "state")
    rows = frames.select(*key).join(poses.withColumn("has_pose", F.lit(True)), key, "left").join(ball, key, "left").join(racket, key, "left")
    return rows.withColumn("swing_type", F.when(F.col("has_pose"), swing_type(p)).otherwise(no_person))


def frame_assembly(frames: DataFrame, poses: DataFrame, balls: DataFrame, states_: DataFrame, p: Params = DEFAULT, no_person: str = "No Swing") -> DataFrame:
    """Every frame with its label, metrics, active ball and racket, each null where there is none."""
    rows = assembled(frames, poses, balls, states_, p, no_person)
    metrics = [c.alias(n) for n, c in metric_columns(p).items()]
    return rows.select(*by_frame(frames), "swing_type", *metrics, "ball_x", "ball_y", *[f"racket_{c}" for c in RACKET], "state")


def needed_frames(requests: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(frame_num) of the requested frames and of those before them that they depend on."""
    ids = requests.filter("frame_id >= 0").select("frame_id").distinct()
    return ids.select(F.explode(F.sequence(F.greatest(F.lit(0), F.col("frame_id") - p.look_back), F.col("frame_id"))).alias("frame_num")).distinct()


def keyframe_card(requests: DataFrame, frames: DataFrame, keypoints: DataFrame, racket_detections: DataFrame, candidates: DataFrame, videos: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The card of each requested frame that exists; ``NO RACKET/BALL`` where there is no state.

    The facts are cut down to the requested frames and the ``look_back`` frames before each, ahead of all pivots, windows and joins.
    """
    dom, other = ("right", "left") if p.dominant_hand == "right" else ("left", "right")
    near = broadcast_if_small(needed_frames(requests, p))
    frames, keypoints, racket_detections, candidates = (t.join(near, "frame_num", "left_semi") for t in (frames, keypoints, racket_detections, candidates))
    poses, balls = primary_pose(keypoints, p), first_ball(moving_by_grid(candidates, p))
    state = states(carried(frames, associated(rackets(racket_detections, p), poses), p), balls, p)
    asked = frames.join(broadcast_if_small(requests.select(F.col("frame_id").alias("frame_num")).distinct()), "frame_num", "left_semi")
    rows = assembled(asked, poses, balls, state, p, "No Swing").join(videos.select("video_id", "fps"), "video_id", "left")
    m = metric_columns(p)
    elbow = {s: angle(point(f"{s}_shoulder"), point(f"{s}_elbow"), point(f"{s}_wrist")) for s in (dom, other)}
    return rows.select(
        *BY_FRAME, F.when(F.col("fps") > 0, F.col("frame_num") / F.col("fps")).alias("timestamp"), "swing_type", m["shoulder_turn"].alias("shoulder_turn"),
        elbow[other].alias("nondom_arm_elbow"), elbow[dom].alias("dom_arm_elbow"), F.coalesce("state", F.lit("NO RACKET/BALL")).alias("system_status"),
        *[m[c].alias(c) for c in ("stance_width", "stance_type", "left_knee_angle", "right_knee_angle")],
    )


def micros(c: str):
    return F.unix_micros(c)


def run_summary(frames: DataFrame) -> DataFrame:
    """Frames, seconds from the first to the last, and frames a second (0 without time) of each video."""
    rows = frames.groupBy("video_id").agg(F.count("*").alias("frames"), ((F.max(micros("processed_at")) - F.min(micros("processed_at"))) / 1e6).alias("seconds"))
    return rows.withColumn("average_fps", F.when(F.col("seconds") > 0, F.col("frames") / F.col("seconds")).otherwise(0.0))


def write_and_summarise(rows: DataFrame, path: str) -> DataFrame:
    """Writes ``rows`` (video_id, frame_num, ...) with ``processed_at``, the clock as each row passes, and gives the run's summary from that same pass.

    One row: frames, last_frame, seconds from the first to the last frame, and average_fps (0 without time). The table at ``path`` has what
    ``run_summary`` and ``progress`` need for each video.
    """
    seen = Observation("run")
    clock = F.timestamp_millis(F.java_method(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("long"))
    timed = rows.withColumn("processed_at", clock)
    at = F.unix_millis("processed_at")
    timed.observe(seen, F.count(F.lit(1)).alias("frames"), F.max("frame_num").alias("last_frame"), F.min(at).alias("first"), F.max(at).alias("last")).write.parquet(path)
    got = seen.get
    seconds = ((got["last"] or 0) - (got["first"] or 0)) / 1000
    return rows.sparkSession.createDataFrame([(got["frames"], got["last_frame"], seconds, got["frames"] / seconds if seconds else 0.0)], "frames long, last_frame int, seconds double, average_fps double")


def progress(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """A row for each second of video (30 frames where fps is 0): percent done, time for the batch, time left at the pace so far."""
    w = Window.partitionBy("video_id").orderBy("frame_num")
    every = F.when(F.col("fps").cast("int") > 0, F.col("fps").cast("int")).otherwise(30)
    start = F.min(micros("processed_at")).over(Window.partitionBy("video_id"))
    rows = frames.withColumn("start", start).join(videos.select("video_id", "fps", "total_frames"), "video_id").filter((F.col("frame_num") > 0) & (F.col("frame_num") % every == 0))
    now = micros("processed_at")
    batch = (now - F.coalesce(F.lag(now).over(w), F.col("start"))) / 1e6
    left = (F.col("total_frames") - F.col("frame_num")) * ((now - F.col("start")) / 1e6) / F.col("frame_num")
    return rows.select(*BY_FRAME, (F.col("frame_num") * 100.0 / F.col("total_frames")).alias("percent"), batch.alias("batch_seconds"), left.alias("seconds_left"))
