"""The one active ball of each frame.

Tracking is a walk over the frames of a video. After more than ``max_lost_frames`` frames
without a moving ball nothing of the state is left, so a video falls into segments that
are tracked apart from each other: a long video is many small groups.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.operators.chunks import cut, frame_order, left_by_earlier
from rallyframe.params import DEFAULT, Params

Ball = tuple[int, int]
OUT = pa.schema([("video_id", pa.int64()), ("frame_num", pa.int32()), ("x", pa.int32()), ("y", pa.int32())])


class Tracker:
    """State between frames: last ball, frames since a ball moved, static candidates in order."""

    def __init__(self, p: Params = DEFAULT):
        self.p, self.last, self.lost, self.candidates = p, None, 0, []

    @staticmethod
    def near(a: Ball, b: Ball) -> float:
        return ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5

    def step(self, balls: list[Ball]) -> Ball | None:
        """The active ball among the moving balls of the next frame."""
        p, free, kept, possible = self.p, list(balls), [], []
        for place, still in self.candidates:
            reach = [(self.near(place, b), i) for i, b in enumerate(free)]
            reach = [x for x in reach if x[0] < p.match_distance / 2]
            if not reach:
                continue  # a candidate without a ball is gone
            d, i = min(reach)
            ball = free.pop(i)
            if d < p.static_movement:
                kept.append((ball, still + 1))
            else:
                possible.append(ball)
        possible += free
        kept += [(b, 0) for b in free]
        self.candidates = kept
        fixed = [place for place, still in kept if still >= p.static_frames]
        possible = [b for b in possible if not any(self.near(b, f) < p.static_movement for f in fixed)]
        chosen = None
        if possible:
            chosen = possible[0]
            if len(possible) > 1 and self.last is not None:
                d, i = min((self.near(self.last, b), i) for i, b in enumerate(possible))
                chosen = possible[i] if d < p.match_distance else chosen
            self.last, self.lost = chosen, 0
        else:
            self.lost += 1
            if self.lost > p.max_lost_frames:
                self.last = None
        return chosen


def lost_counter(moving: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Frames since a ball last moved, and whether the track is lost; before the first one, frames from the start on."""
    here = F.when(F.size("balls") > 0, F.col("frame_num"))
    rows = left_by_earlier(cut(moving.select("video_id", "frame_num", "balls"), p), here, "earlier")
    seen = F.last(here, ignorenulls=True).over(frame_order(rows).rowsBetween(Window.unboundedPreceding, 0))
    lost = F.col("frame_num") - F.coalesce(seen, F.col("earlier"), F.lit(-1))
    return rows.select("video_id", "frame_num", lost.alias("lost_frames"), (lost > p.max_lost_frames).alias("is_lost"))


def segments(moving: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(video_id, frame_num, segment_id, balls) of frames with a moving ball; a gap of more than ``max_lost_frames`` empty frames starts a segment.

    A chunk counts the gaps inside it; a row for each chunk, with its first and last such frame, tells the gaps between and before.
    """
    rows = cut(moving.filter(F.size("balls") > 0).select("video_id", "frame_num", "balls"), p)
    w = frame_order(rows)
    wide = lambda a, b: F.coalesce((a - b > p.max_lost_frames + 1).cast("int"), F.lit(0))
    rows = rows.withColumn("gap", wide(F.col("frame_num"), F.lag("frame_num").over(w)))
    chunks = rows.groupBy("video_id", "chunk").agg(F.min("frame_num").alias("first"), F.max("frame_num").alias("last"), F.sum("gap").alias("inside"))
    v = Window.partitionBy("video_id").orderBy("chunk")
    chunks = chunks.withColumn("before", wide(F.col("first"), F.lag("last").over(v)))
    chunks = chunks.select("video_id", "chunk", (F.sum(F.col("before") + F.col("inside")).over(v) - F.col("inside")).alias("base"))
    number = F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("base")
    return rows.join(chunks, ["video_id", "chunk"]).select("video_id", "frame_num", number.cast("int").alias("segment_id"), "balls")


def active_ball(moving: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(video_id, frame_num, x, y) of frames that have an active ball; ``moving`` as balls.moving_by_frame makes it.

    Segments are dealt out by hash and stand in order in their partition, so a task walks through many of them
    and through batches of a long one with the state of one tracker in memory.
    """

    def track(batches):
        tracker, key, at = None, None, 0
        for b in batches:
            found = []
            for v, s, n, balls in zip(*(b[c].to_pylist() for c in ("video_id", "segment_id", "frame_num", "balls")), strict=True):
                if (v, s) != key:
                    tracker, key, at = Tracker(p), (v, s), n - 1
                for _ in range(n - at - 1):  # frames missing between two are empty ones
                    tracker.step([])
                at = n
                if (ball := tracker.step([(x["x"], x["y"]) for x in balls])) is not None:
                    found.append((v, n, *ball))
            yield pa.RecordBatch.from_pylist([dict(zip(OUT.names, r, strict=True)) for r in found], schema=OUT)

    dealt = segments(moving, p).repartition("video_id", "segment_id").sortWithinPartitions("video_id", "segment_id", "frame_num")
    return dealt.mapInArrow(track, "video_id long, frame_num int, x int, y int")
