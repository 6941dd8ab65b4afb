"""Poses: confidence gate, pivot, swing labels and body metrics of the primary person."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.functions.geometry import angle, distance, midpoint, point, present, vector_angle
from rallyframe.operators.chunks import by_frame
from rallyframe.params import DEFAULT, Params
from rallyframe.sources.schemas import KEYPOINT_NAMES


def gate(keypoints: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Coordinates as whole numbers (cut toward zero) where confidence is above the threshold or not given, else null."""
    ok = F.col("conf").isNull() | (F.col("conf") > p.pose_confidence)
    return keypoints.withColumns({c: F.when(ok, F.col(c).cast("int")) for c in ("x", "y")})


def wide(gated: DataFrame) -> DataFrame:
    """One row for each person and frame, two columns for each keypoint."""
    one = lambda i, c: F.max(F.when(F.col("kp_idx") == i, F.col(c)))
    return gated.groupBy(*by_frame(gated), "person_idx").agg(*[one(i, c).alias(f"{n}_{c}") for i, n in enumerate(KEYPOINT_NAMES) for c in ("x", "y")])


def primary(rows: DataFrame) -> DataFrame:
    """The rows (poses, or keypoints) of the first person of each frame, whatever its index."""
    first = F.min("person_idx").over(Window.partitionBy(*by_frame(rows)))
    names = [f"_c{i}" for i in range(len(rows.columns))]
    marked = rows.select(*[F.col(c).alias(n) for c, n in zip(rows.columns, names, strict=True)], (F.col("person_idx") == first).alias("_first"))
    return marked.filter("_first").select(*names).toDF(*rows.columns)


def primary_pose(keypoints: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The wide pose of each frame's first person: all are pivoted, then the one of least index is taken, by the same key."""
    poses = wide(gate(keypoints, p))
    key = by_frame(poses)
    names = [c for c in poses.columns if c not in (*key, "person_idx")]
    return poses.groupBy(*key).agg(F.min_by(F.struct(*names), "person_idx").alias("p")).select(*key, "p.*")


def swing_type(p: Params = DEFAULT):
    """Label of a pose row; ``Incomplete Pose`` if a wrist, shoulder or elbow is missing."""
    limb = lambda side: tuple(point(f"{side}_{n}") for n in ("wrist", "shoulder", "elbow"))
    (lw, ls, le), (rw, rs, re_) = limb("left"), limb("right")
    wrist, shoulder = (rw, rs) if p.dominant_hand == "right" else (lw, ls)
    across = midpoint(lw, rw)[0], midpoint(ls, rs)[0]
    none = F.lit(False)
    over = lambda a, b: a < b if p.dominant_hand == "right" else a > b if p.dominant_hand == "left" else none
    return (
        F.when(~present(lw, rw, ls, rs, le, re_), "Incomplete Pose")
        .when((distance(lw, rw) < p.two_hand_wrist_px) & over(*across), "Two-Handed Backhand")
        .when(over(wrist[0], shoulder[0]), "Backhand")
        .otherwise("Forehand")
    )


def label_frames(frames: DataFrame, poses: DataFrame, p: Params = DEFAULT, no_person: str = "No Swing") -> DataFrame:
    key = by_frame(frames)
    labels = poses.select(*key, swing_type(p).alias("swing_type"))
    return frames.select(*key).join(labels, key, "left").withColumn("swing_type", F.coalesce("swing_type", F.lit(no_person)))


def elbow_angles(poses: DataFrame) -> DataFrame:
    side = lambda s: angle(point(f"{s}_shoulder"), point(f"{s}_elbow"), point(f"{s}_wrist"))
    return poses.select(*by_frame(poses), side("left").alias("left_elbow_angle"), side("right").alias("right_elbow_angle"))


def shoulder_line():
    l, r = point("left_shoulder"), point("right_shoulder")
    return l, r, (r[0] - l[0], r[1] - l[1])


def torso_angle(poses: DataFrame) -> DataFrame:
    """Shoulder line against the vertical, null for a line of no length, with its label's anchor."""
    l, r, line = shoulder_line()
    value = vector_angle(line, (F.lit(0), F.lit(1)), zero=F.lit(None).cast("double"))
    anchor = lambda i: F.floor((l[i] + r[i]) / 2).cast("int")
    return poses.filter(present(l, r)).select("video_id", "frame_num", value.alias("torso_angle"), anchor(0).alias("anchor_x"), (anchor(1) - 20).alias("anchor_y"))


METRICS = {
    "preparation": ["shoulder_turn", "non_dominant_arm_extension"],
    "swing_motion": ["contact_point_position", "contact_height", "arm_extension"],
    "footwork": ["stance_width", "stance_type", "left_knee_angle", "right_knee_angle"],
    "power_indicators": ["hip_shoulder_separation"],
}


def metric_columns(p: Params = DEFAULT) -> dict:
    """Columns of the swing analysis, for rows with pose columns and ``ball_x``, ``ball_y``."""
    dom, other = ("right", "left") if p.dominant_hand == "right" else ("left", "right")
    arm = lambda s: angle(point(f"{s}_shoulder"), point(f"{s}_elbow"), point(f"{s}_wrist"))
    ls, rs, line = shoulder_line()
    lh, rh, la, ra = (point(n) for n in ("left_hip", "right_hip", "left_ankle", "right_ankle"))
    wrist, ball = point(f"{dom}_wrist"), point("ball")
    dx, dy = ball[0] - wrist[0], ball[1] - wrist[1]
    hit = present(wrist, ball)
    knee = lambda s: angle(point(f"{s}_hip"), point(f"{s}_knee"), point(f"{s}_ankle"))
    return {
        "shoulder_turn": F.when(present(ls, rs), vector_angle(line, (F.lit(0), F.lit(1)))),
        "non_dominant_arm_extension": arm(other),
        "contact_point_position": F.when(hit, F.when(F.abs(dx) < 50, "Front").when(dx < 0, "Side").otherwise("Late")),
        "contact_height": F.when(hit, F.when(dy > 50, "Low").when(F.abs(dy) <= 50, "Mid").otherwise("High")),
        "arm_extension": arm(dom),
        "stance_width": F.when(present(la, ra), distance(la, ra)),
        "stance_type": F.when(present(la, ra, lh, rh), F.when(F.abs(midpoint(lh, rh)[0] - midpoint(la, ra)[0]) > 30, "Open").otherwise("Neutral")),
        "left_knee_angle": knee("left"),
        "right_knee_angle": knee("right"),
        "hip_shoulder_separation": F.when(present(lh, rh, ls, rs), vector_angle((rh[0] - lh[0], rh[1] - lh[1]), line)),
    }


def swing_metrics(poses: DataFrame, balls: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """All body metrics of each pose; ``balls`` (video_id, frame_num, x, y) gives the contact columns."""
    key = by_frame(poses)
    if balls is None:
        rows = poses.withColumns({"ball_x": F.lit(None).cast("int"), "ball_y": F.lit(None).cast("int")})
    else:
        rows = poses.join(balls.select(*key, F.col("x").alias("ball_x"), F.col("y").alias("ball_y")), key, "left")
    return rows.select(*key, swing_type(p).alias("swing_type"), *[c.alias(n) for n, c in metric_columns(p).items()])


def metrics_long(metrics: DataFrame) -> DataFrame:
    """(category, metric, value) rows of the metrics that have a value; numbers with one decimal."""
    names = [(c, m) for c, ms in METRICS.items() for m in ms]
    text = lambda m: F.col(m) if m in ("contact_point_position", "contact_height", "stance_type") else F.format_string("%.1f", F.col(m))
    parts = [F.struct(F.lit(c).alias("category"), F.initcap(F.lit(m.replace("_", " "))).alias("metric"), F.when(F.col(m).isNotNull(), text(m)).alias("value")) for c, m in names]
    return metrics.select("video_id", "frame_num", F.explode(F.array(*parts)).alias("m")).select("video_id", "frame_num", "m.*").filter("value is not null")


def person_boxes(gated: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(video_id, frame_num, person_idx, x1, y1, x2, y2): box round each person's visible keypoints but the head's, padded and held in the frame."""
    low = lambda c: F.greatest(F.lit(0), F.min(c) - p.box_pad)
    high = lambda c, top: F.least(F.lit(top), F.max(c) + p.box_pad)
    seen = gated.filter("kp_idx >= 5 and x is not null")
    return seen.groupBy(*by_frame(gated), "person_idx").agg(low("x").alias("x1"), low("y").alias("y1"), high("x", p.width).alias("x2"), high("y", p.height).alias("y2"))


def player_box(gated: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The box of the primary person; no row where nothing of it is visible."""
    return person_boxes(primary(gated), p).drop("person_idx")


def metric_display(metrics: DataFrame) -> DataFrame:
    """Display strings with units: angles in degrees, the stance in pixels, one decimal; null where there is no value."""
    unit = {"shoulder_turn": "°", "non_dominant_arm_extension": "°", "arm_extension": "°", "left_knee_angle": "°", "right_knee_angle": "°", "hip_shoulder_separation": "°", "stance_width": "px"}
    return metrics.select("video_id", "frame_num", *[F.when(F.col(c).isNotNull(), F.format_string(f"%.1f{u}", F.col(c))).alias(c) for c, u in unit.items()])
