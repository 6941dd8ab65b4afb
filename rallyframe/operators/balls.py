"""Ball candidates: row filters and the filter of balls that stand still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.operators.chunks import by_frame
from rallyframe.params import DEFAULT, Params


def rescale(d: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """From the detector's picture size to the frame's, cut toward zero; the radius goes by the width."""
    sx, sy = p.width / p.detector_width, p.height / p.detector_height
    return d.withColumns({"x": (F.col("x") * sx).cast("int"), "y": (F.col("y") * sy).cast("int"), "radius": (F.col("radius") * sx).cast("int")})


def bounds(xa, ya, xb, yb) -> tuple:
    """x1, y1, x2, y2 of the rectangle with two opposite corners in any order."""
    return F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb)


def in_bounds(d: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Candidates of a fitting radius inside the boundary, edges included."""
    return d.filter(F.col("radius").between(p.min_ball_radius, p.max_ball_radius) & F.col("x").between(p.x1, p.x2) & F.col("y").between(p.y1, p.y2))


def in_video_bounds(d: DataFrame, limits: DataFrame) -> DataFrame:
    """The same with a boundary for each video: (video_id, x1, y1, x2, y2); videos without one keep all."""
    j = d.join(limits, "video_id", "left")
    ok = F.col("x1").isNull() | (F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2")))
    return j.filter(ok).select(*d.columns)


def first_ball(d: DataFrame) -> DataFrame:
    """The candidate of least index in each frame."""
    key = by_frame(d)
    return d.groupBy(*key).agg(F.min_by(F.struct("x", "y"), "det_idx").alias("b")).select(*key, "b.x", "b.y")


def per_frame(d: DataFrame) -> DataFrame:
    """(video_id, frame_num, balls): the frame's candidates in order of index."""
    return d.groupBy(*by_frame(d)).agg(F.sort_array(F.collect_list(F.struct("det_idx", "x", "y"))).alias("balls"))


def moving_by_grid(d: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(video_id, frame_num, det_idx, x, y) of the candidates that no ball of the frame before (frame_num - 1) is nearer to than ``min_ball_movement``.

    A grid join: each different place of a frame's balls is put into the cells, twice that wide, that its surroundings touch, four at most; a
    ball is held against those of its own cell in the frame before. Whole-number places bound what stands in a cell, so crowded frames take time by their balls.
    """
    key, wide = by_frame(d), 2 * p.min_ball_movement
    cell = lambda c: F.floor(c / wide)
    cells = lambda c: F.sequence(cell(F.col(c) - p.min_ball_movement), cell(F.col(c) + p.min_ball_movement))
    before = d.withColumn("frame_num", F.col("frame_num") + 1).select(*key, F.col("x").alias("qx"), F.col("y").alias("qy")).distinct()
    before = before.select("*", F.explode(cells("qx")).alias("cx")).select("*", F.explode(cells("qy")).alias("cy"))
    a, b = d.select(*key, "det_idx", "x", "y", cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy")).alias("a"), before.alias("b")
    dx, dy = F.col("a.x") - F.col("b.qx"), F.col("a.y") - F.col("b.qy")
    on = (dx * dx + dy * dy).cast("double") < p.min_ball_movement**2
    for c in (*key, "cx", "cy"):
        on &= F.col(f"a.{c}") == F.col(f"b.{c}")
    return a.join(b, on, "left_anti").select(*key, "det_idx", "x", "y")


def moving_by_frame(frames: DataFrame, d: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(video_id, frame_num, balls) of every frame: its moving candidates in order of index, an empty array where there is none."""
    key = by_frame(frames)
    none = F.array().cast("array<struct<det_idx:int,x:int,y:int>>")
    return frames.select(*key).join(per_frame(moving_by_grid(d, p)), key, "left").withColumn("balls", F.coalesce("balls", none))


def moving(frames: DataFrame, d: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Rows of the candidates that move, in the frames of ``frames``."""
    key = by_frame(frames)
    return moving_by_grid(d, p).join(frames.select(*key), key, "left_semi")


def moving_by_join(d: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The same as an anti join of all pairs of neighbouring frames; for tests."""
    q = d.select("video_id", (F.col("frame_num") + 1).alias("frame_num"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    near = (dx * dx + dy * dy).cast("double") < p.min_ball_movement**2
    a, b = d.alias("a"), q.alias("b")
    on = (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a.frame_num") == F.col("b.frame_num")) & near
    return a.join(b, on, "left_anti").select("video_id", "frame_num", "det_idx", "x", "y")
