"""Rackets: filter, association with the primary player's hands, carry over short gaps, state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.operators.chunks import by_frame, frame_order
from rallyframe.params import DEFAULT, Params


def rackets(d: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Detections of the racket class with enough confidence, box cut to whole numbers."""
    return d.filter((F.col("class_id") == p.racket_class) & (F.col("conf") >= p.racket_confidence)).withColumns({c: F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")})


def associated(rackets_: DataFrame, poses: DataFrame) -> DataFrame:
    """The racket nearest to a visible wrist within 0.75 * (width + height); equal distances: lower racket, then left wrist."""
    key = by_frame(poses)
    hand = lambda i, side: F.struct(F.lit(i).alias("hand"), F.col(f"{side}_wrist_x").alias("hx"), F.col(f"{side}_wrist_y").alias("hy"))
    hands = poses.select(*key, F.explode(F.array(hand(0, "left"), hand(1, "right"))).alias("h")).select(*key, "h.*").filter("hx is not null")
    dx, dy = (F.col("x1") + F.col("x2")) / 2 - F.col("hx"), (F.col("y1") + F.col("y2")) / 2 - F.col("hy")
    pairs = rackets_.join(hands, key).withColumn("dist", F.sqrt(dx * dx + dy * dy))
    near = pairs.filter(F.col("dist") < (F.col("x2") - F.col("x1") + F.col("y2") - F.col("y1")) * 0.75)
    best = near.groupBy(*key).agg(F.min_by(F.struct("x1", "y1", "x2", "y2", F.col("conf").alias("confidence")), F.struct("dist", "racket_idx", "hand")).alias("r"))
    return best.select(*key, "r.*")


def recent(rows: DataFrame, p: Params):
    return frame_order(rows).rangeBetween(-p.racket_lost_frames, 0)


def carried(frames: DataFrame, found: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The player's racket in each frame: found there, or at most ``racket_lost_frames`` frames ago."""
    box = F.when(F.col("x1").isNotNull(), F.struct("x1", "y1", "x2", "y2", "confidence", F.col("frame_num").alias("last_seen_frame")))
    key = by_frame(frames)
    rows = frames.select(*key).join(found, key, "left")
    return rows.select(*key, F.col("x1").isNotNull().alias("found"), F.last(box, ignorenulls=True).over(recent(rows, p)).alias("r")).select(*key, "found", "r.*")


def computed_state(p: Params = DEFAULT):
    """State of a racket box (x1..y2) and a ball (ball_x, ball_y)."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    reach = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / 2 + p.ball_radius_px
    dx, dy = cx - F.col("ball_x"), cy - F.col("ball_y")
    d = F.sqrt(dx * dx + dy * dy)
    zone = lambda y: (y > 0.4 * p.height) & (y < 0.7 * p.height)
    return F.when((d < reach) & zone(cy) & zone(F.col("ball_y")), "IMPACT ZONE").when(d < 5 * reach, "APPROACHING BALL").otherwise("IDLE / OTHER")


def states(carried_: DataFrame, balls: DataFrame, p: Params = DEFAULT, no_ball: str = "carry") -> DataFrame:
    """State of the carried racket: computed where a ball is active, else that of its last event.

    ``no_ball='idle'`` gives ``IDLE / NO BALL`` where there is a racket but no ball.
    """
    key = by_frame(carried_)
    rows = carried_.join(balls.select(*key, F.col("x").alias("ball_x"), F.col("y").alias("ball_y")), key, "left")
    has = F.col("x1").isNotNull()
    event = F.when(has & F.col("ball_x").isNotNull(), computed_state(p))
    if no_ball == "idle":
        event = event.when(has, F.lit("IDLE / NO BALL"))
    else:
        event = event.when(F.col("found"), F.lit("associated_to_player"))
    rows = rows.withColumn("event", event)
    state = F.when(has, F.last("event", ignorenulls=True).over(recent(rows, p)))
    return rows.withColumn("state", state).select(*key, "x1", "y1", "x2", "y2", "confidence", "last_seen_frame", "state")
