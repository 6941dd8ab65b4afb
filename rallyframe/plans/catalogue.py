"""All queries over the facts that Spark derives from ``events``, each over all its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.operators import balls, chunks, detect, motion, pose, rackets, reports, selection, tracker, trajectory
from rallyframe.params import DEFAULT, Params
from rallyframe.plans import oracle
from rallyframe.session import co_partition
from rallyframe.sources import facts
from rallyframe.sources.schemas import SCHEMAS, read_facts, write_by_video
from rallyframe.streaming import late, live
from rallyframe.streaming.replay import TICK, as_stream, replay, shared_folder, state_partitions

BY_FRAME = ["video_id", "frame_num"]
FOLDERS = 128  #: of frames written by video

IDS = [21, 37, 62, 87, -1, 21, 99999]
TIMES = ["00:00:01", "00:02", "2", "", "1:2:3:4", "16:04:13"]


class Facts:
    """The fact tables of one data folder and the steps that several queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str, ev: DataFrame | None = None, p: Params = DEFAULT):
        self.spark, self.p, self.ev = spark, p, facts.event_frames(spark, sf_dir) if ev is None else ev

    frames = property(lambda s: facts.frames(s.ev))
    videos = property(lambda s: facts.videos(s.ev))
    keypoints = property(lambda s: facts.keypoints(s.ev))
    detections = property(lambda s: facts.ball_detections(s.ev))
    racket_detections = property(lambda s: facts.racket_detections(s.ev))
    poses = property(lambda s: pose.primary_pose(s.keypoints))
    boxes = property(lambda s: pose.player_box(pose.gate(s.keypoints)))
    people = property(lambda s: pose.person_boxes(pose.gate(s.keypoints)))
    candidates = property(lambda s: balls.in_bounds(s.detections))
    moving = property(lambda s: balls.moving_by_frame(s.frames, s.candidates))
    active = property(lambda s: tracker.active_ball(s.moving, s.p))
    found = property(lambda s: rackets.associated(rackets.rackets(s.racket_detections), s.poses))
    carried = property(lambda s: chunks.own(s.carried_c, s.p))
    # The same in chunks with a halo, so that a long video is worked on in many tasks.
    frames_c = property(lambda s: chunks.spread(s.frames, s.p))
    poses_c = property(lambda s: pose.primary_pose(chunks.spread(s.keypoints, s.p)))
    first_c = property(lambda s: balls.first_ball(balls.moving_by_grid(chunks.spread(s.candidates, s.p))))
    carried_c = property(lambda s: rackets.carried(s.frames_c, rackets.associated(chunks.spread(rackets.rackets(s.racket_detections), s.p), s.poses_c)))
    ids = property(lambda s: s.spark.createDataFrame([(i,) for i in IDS], "frame_id int"))
    times = property(lambda s: s.spark.createDataFrame([(t,) for t in TIMES], "ts string"))

    @property
    def pose_arrays(self) -> DataFrame:
        """First persons' keypoints as one array of 17 for each frame, as a stream of poses brings them."""
        kp = F.transform(F.array_sort(F.collect_list(F.struct("kp_idx", "x", "y", "conf"))), lambda k: F.struct(k["x"].alias("x"), k["y"].alias("y"), k["conf"].alias("conf")))
        return self.timed(pose.primary(self.keypoints).groupBy(*BY_FRAME).agg(kp.alias("kp")))

    @property
    def first(self) -> DataFrame:
        """The first moving ball of each frame: the simple track, which SQL can express."""
        return balls.first_ball(balls.moving_by_grid(self.candidates))

    @property
    def states(self) -> DataFrame:
        return chunks.own(rackets.states(self.carried_c, self.first_c), self.p)

    def assembled(self, track: DataFrame) -> DataFrame:
        return chunks.own(reports.frame_assembly(self.frames_c, self.poses_c, track, rackets.states(self.carried_c, track)), self.p)


    def timed(self, rows: DataFrame) -> DataFrame:
        """Rows by frame as a stream brings them, with the frame's time."""
        return self.frames.select(*BY_FRAME, "event_time").join(rows, BY_FRAME)

    @property
    def racket_frames(self) -> DataFrame:
        boxes = self.found.select(*BY_FRAME, "x1", "y1", "x2", "y2")
        return self.frames.select(*BY_FRAME, "event_time").join(boxes, BY_FRAME, "left")

    @property
    def point_frames(self) -> DataFrame:
        return self.frames.select(*BY_FRAME, "event_time").join(self.first, BY_FRAME, "left")

    def replayed(self, operator: Callable[..., DataFrame], *tables: DataFrame, ticks: int = 2) -> DataFrame:
        live.open_states(self.spark)
        return replay(tables, operator, ticks=ticks)

    def apart(self, table: str) -> DataFrame:
        """The racket carry as a stream in which frames divisible by 17 of the first quarter come once more at the end, too late."""
        live.open_states(self.spark)
        at = shared_folder(self.spark)

        def again(rows: DataFrame) -> DataFrame:
            lo, hi = rows.agg(F.min(F.unix_micros("event_time")), F.max(F.unix_micros("event_time"))).first()
            return rows.filter((F.col("frame_num") % 17 == 0) & ((F.unix_micros("event_time") - F.lit(lo)) * 4 < F.lit(hi) - F.lit(lo)))

        out = live.carry_racket(as_stream(self.racket_frames, at, 4, again=again), delay="1 hour", idle="60 days")
        with state_partitions(self.spark):
            query = late.write_apart(out, f"{at}/out", f"{at}/state")
        query.awaitTermination()
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema if f.name != "late")
        return late.read_apart(self.spark, f"{at}/out", schema, table).filter(F.col("video_id") != TICK)

    def written(self, kind: str) -> DataFrame:
        at = shared_folder(self.spark)
        self.detections.write.format(kind).save(at)
        return read_facts(self.spark, "ball_detections", at, kind)

    def by_video(self) -> DataFrame:
        """Frames written by video and read back, with their place in the video's part of its file."""
        at = shared_folder(self.spark)
        write_by_video(self.frames, at, folders=FOLDERS)
        rows = self.spark.read.schema(SCHEMAS["frames"]).parquet(at).select(*BY_FRAME, F.col("_metadata.row_index").alias("at"))
        first = rows.groupBy(F.col("video_id").alias("v")).agg(F.min("at").alias("first"))  # a video is whole in one file
        return rows.join(first, F.col("video_id").eqNullSafe(F.col("v"))).select(*BY_FRAME, (F.col("at") - F.col("first") + 1).alias("position"))


def test_detector():
    """A made-up model: one ball a frame; it can't read videos of which each seventh is."""

    def model(frames):
        if (frames["video_id"] % 7 == 3).any():
            raise ValueError("no picture")
        v, f = frames["video_id"], frames["frame_num"]
        return frames.assign(det_idx=0, x=660 + (f * 17 + v * 5) % 740, y=420 + (f * 11) % 540, radius=5)

    return model


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to four places, for comparison across engines."""
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


QUERIES: dict[str, Callable[[Facts], DataFrame]] = {
    "pose_gate": lambda x: pose.gate(x.keypoints),
    "pose_wide": lambda x: pose.wide(pose.gate(x.keypoints)),
    "primary_person": lambda x: pose.primary(pose.wide(pose.gate(x.keypoints))).select("video_id", "frame_num", "person_idx"),
    "swing_label": lambda x: pose.label_frames(x.frames, x.poses),
    "elbow_angles": lambda x: pose.elbow_angles(x.poses),
    "torso_angle": lambda x: pose.torso_angle(x.poses),
    "swing_metrics": lambda x: pose.swing_metrics(x.poses, x.first),
    "metrics_long": lambda x: pose.metrics_long(pose.swing_metrics(x.poses, x.first)),
    "player_box": lambda x: x.boxes,
    "ball_rescale": lambda x: balls.rescale(x.detections.withColumns({"x": F.expr("x % 640"), "y": F.expr("y % 360")})),
    "ball_in_bounds": lambda x: x.candidates,
    "ball_moving": lambda x: balls.moving(x.frames, x.candidates),
    "first_ball": lambda x: balls.first_ball(x.detections),
    "racket_filter": lambda x: rackets.rackets(x.racket_detections),
    "racket_assoc": lambda x: x.found,
    "racket_carry": lambda x: x.carried,
    "racket_state": lambda x: x.states,
    "lost_counter": lambda x: tracker.lost_counter(x.moving, x.p),
    "track_segments": lambda x: tracker.segments(x.moving, x.p).select("video_id", "frame_num", "segment_id"),
    "active_ball": lambda x: x.active,
    "step_distance": lambda x: trajectory.step_distance(x.first, x.p),
    "step_statistics": lambda x: trajectory.step_statistics(x.first),
    "outlier_replace": lambda x: trajectory.replace_outliers(x.first),
    "savgol_segment": lambda x: trajectory.smooth_runs(x.first, x.p),
    "smooth_cumulative": lambda x: trajectory.smooth_cumulatively(x.active),
    "trail8": lambda x: chunks.own(trajectory.trail(x.frames_c, x.first_c), x.p),
    "history40": lambda x: trajectory.history(x.first),
    "track_lines": lambda x: trajectory.lines(x.first),
    "stationary_runs": lambda x: trajectory.still_runs(x.detections.select("video_id", "det_idx", "frame_num", "x", "y"), by=("video_id", "det_idx")),
    "frame_assembly": lambda x: x.assembled(x.first_c),
    "tracked_frames": lambda x: x.assembled(chunks.spread(x.active, x.p)),
    "video_catalogue": lambda x: selection.names(selection.catalogue(x.videos)).select("video_id", "path", "video_name", "annotated_path", "frames_dir", "named_frames_dir"),
    "video_meta": lambda x: selection.metadata(x.videos),
    "videos_rejected": lambda x: selection.split_valid(x.videos)[1].select("video_id", "path", "reject_reason"),
    "frames_by_id": lambda x: selection.frames_by_id(x.videos, x.frames, x.ids),
    "frames_by_time": lambda x: selection.frames_by_time(x.videos, x.frames, x.times),
    "requests_rejected": lambda x: selection.rejected(x.videos, x.frames, x.ids, x.times),
    "extract_union": lambda x: selection.extracted(x.videos, x.frames, x.ids, x.times),
    "extract_summary": lambda x: selection.extract_summary(selection.extracted(x.videos, x.frames, x.ids, x.times)),
    "keyframe_card": lambda x: reports.keyframe_card(x.ids, x.frames, x.keypoints, x.racket_detections, x.candidates, x.videos),
    "frames_in_order": lambda x: selection.in_order(selection.extracted(x.videos, x.frames, x.ids, x.times)).select("video_id", "frame_num", "source", "requested", "position"),
    "request_lists": lambda x: selection.parse_ids(x.videos.select(F.format_string("%d, %d,x%d", F.col("video_id") % 90, "total_frames", "video_id").alias("asked")), "asked"),
    "boundary_corners": lambda x: rackets.rackets(x.racket_detections).select("video_id", "frame_num", "racket_idx", *[c.alias(n) for c, n in zip(balls.bounds(F.col("x2"), F.col("y1"), F.col("x1"), F.col("y2")), ("x1", "y1", "x2", "y2"), strict=True)]),
    "metric_display": lambda x: pose.metric_display(pose.swing_metrics(x.poses, x.first)),
    "live_labels": lambda x: replay(x.pose_arrays, live.label_poses).select("video_id", "frame_num", "swing_type"),
    "live_tracking": lambda x: x.replayed(lambda s: live.track(s, delay="1 hour", idle="1 day"), x.frames.join(balls.per_frame(x.candidates), BY_FRAME, "left").select(*BY_FRAME, "event_time", "balls")),
    "live_racket_carry": lambda x: x.replayed(lambda s: live.carry_racket(s, delay="1 hour", idle="1 day"), x.racket_frames),
    "live_checkpoints": lambda x: x.replayed(lambda s: live.checkpoints(s, gap="8 days"), x.point_frames),
    "live_progress": lambda x: x.replayed(live.progress, x.frames).select("video_id", F.unix_seconds("second").alias("second"), "frames"),
    "live_rallies": lambda x: x.replayed(lambda s: live.rallies(s, gap="1 hour"), x.frames.join(x.first, BY_FRAME)).select("video_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "frames"),
    "live_assembly": lambda x: x.replayed(lambda *s: live.assemble(*s, delay="1 hour"), x.frames, x.pose_arrays, x.timed(x.found), x.timed(x.first), ticks=3).drop("event_time"),
    "live_in_time": lambda x: x.apart("in_time"),
    "live_late": lambda x: x.apart("late"),
    "detect_apart": lambda x: detect.detect_apart(x.frames, test_detector, "ball_detections", shared_folder(x.spark))[0],
    "detect_rejects": lambda x: detect.detect_apart(x.frames, test_detector, "ball_detections", shared_folder(x.spark))[1],
    "facts_read": lambda x: x.written("json").drop("_corrupt"),
    "frames_by_video": lambda x: x.by_video(),
    "run_observed": lambda x: reports.write_and_summarise(x.frames.drop("processed_at"), shared_folder(x.spark)).select("frames", "last_frame"),
    "run_summary": lambda x: reports.run_summary(x.frames),
    "progress": lambda x: reports.progress(x.frames, x.videos),
    "ball_speed": lambda x: motion.ball_speed(x.first, x.videos),
    "racket_motion": lambda x: motion.racket_motion(x.found),
    "ball_direction": lambda x: motion.ball_direction(x.first, x.boxes),
    "swing_phase": lambda x: chunks.own(motion.swing_phase(rackets.states(x.carried_c, x.first_c)), x.p),
    "every_nth": lambda x: motion.every_nth(x.frames, 5).select("video_id", "frame_num"),
    "wrist_path": lambda x: motion.wrist_path(x.poses),
    "player_overlap": lambda x: motion.box_overlaps(x.people),
    "player_ids": lambda x: motion.player_ids(x.people),
}


#: Queries that run on the longer videos of ``lineitem`` too, as ``long_*``, in chunks of 150 frames.
LONG = ("trail8", "swing_phase", "savgol_segment", "ball_moving", "racket_carry", "racket_state", "lost_counter", "track_segments", "step_distance", "frame_assembly")
LONG_CHUNKS = Params(chunk_frames=150)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def make(f, long=False):
        def run(spark, sf_dir):
            co_partition(spark)
            return rounded(f(Facts(spark, sf_dir, facts.line_frames(spark, sf_dir), LONG_CHUNKS) if long else Facts(spark, sf_dir)))

        return run

    return {name: make(f) for name, f in QUERIES.items()} | {f"long_{name}": make(QUERIES[name], True) for name in LONG}


def oracle_sql() -> dict[str, str]:
    return {name: oracle.statement(name) for name in QUERIES if name in oracle.SELECT} | {f"long_{name}": oracle.statement(name, long=True) for name in LONG}
