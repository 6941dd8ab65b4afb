"""Live frames: the batch operators where rows need no state, keyed state where they do.

A stream holds one row for each frame, empty ones too: an absent row is not an empty frame.
Rows of a video are taken in order of event time once the watermark has passed them; a row at or before
the last frame taken is late and is marked so rather than tracked (``late.write_apart`` puts those into a table of their own).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rallyframe.operators.pose import metric_columns, swing_type
from rallyframe.operators.tracker import Tracker
from rallyframe.params import DEFAULT, Params
from rallyframe.sources.schemas import KEYPOINT_NAMES

BALLS = "array<struct<det_idx:int,x:int,y:int>>"
#: Groups of videos whose state is kept together; part of the state, so a stream that goes on from its checkpoint can't have another number.
GROUPS, NO_VIDEO = 256, -1
FRAMES = f"video_id long, frame_num int, event_time timestamp, balls {BALLS}"


def label_poses(poses: DataFrame, p: Params = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Labels and metrics of a stream of poses ``(video_id, frame_num, kp)``, kp an array of 17 (x, y, conf); no state. Columns to ``keep`` go on."""
    point = lambda i, c: F.when(F.col("kp")[i]["conf"].isNull() | (F.col("kp")[i]["conf"] > p.pose_confidence), F.col("kp")[i][c].cast("int"))
    wide = poses.select("*", *[point(i, c).alias(f"{n}_{c}") for i, n in enumerate(KEYPOINT_NAMES) for c in ("x", "y")], F.lit(None).cast("int").alias("ball_x"), F.lit(None).cast("int").alias("ball_y"))
    return wide.select("video_id", "frame_num", *keep, swing_type(p).alias("swing_type"), *[c.alias(n) for n, c in metric_columns(p).items()])


def open_states(spark: SparkSession) -> None:
    """State of ``track`` and ``carry_racket`` needs this store; to be set before such a stream starts. Batches store what they change, and joins have one store a partition, not four."""
    states = "spark.sql.streaming.stateStore"
    spark.conf.set(f"{states}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(f"{states}.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")


def near(a, b, p: Params) -> bool:
    return (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 < p.min_ball_movement**2


class InOrder(StatefulProcessor):
    """Takes each video's frames in order of event time, whatever order they come in.

    State is kept by group of videos, so that its calls are by group and not by video. A frame waits in list state until the watermark
    has passed its event time; an event-time timer stands at the group's first frame that waits. A frame at or before the last
    one taken of its video is late: it comes out at once, marked. A video is forgotten ``idle`` after its last frame, by a timer too.
    """

    #: Fields of a video's memory between frames, and of the result.
    memory, result = "", []

    def __init__(self, p: Params, idle: str):
        self.p, self.idle = p, int(pd.Timedelta(idle).total_seconds() * 1000)

    def start(self, memory: tuple | None) -> None:
        raise NotImplementedError

    def step(self, n: int, flat: list[int]) -> list:
        raise NotImplementedError

    def remember(self) -> tuple:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "frames binary, sizes binary, flat binary")  # blocks of (video, time, frame) and their values
        self.videos = handle.getListState("videos", f"video_id long, taken int, newest long, {self.memory}")
        self.timer = handle.getValueState("timer", "at long")

    def rows(self, key, made: list[tuple]) -> Iterator[pd.DataFrame]:
        if made:
            out = pd.DataFrame([(None if key[0] == NO_VIDEO else v, n, *values, late) for v, n, values, late in made], columns=["video_id", "frame_num", *self.result, "late"])
            yield out.astype({"video_id": "Int64", "frame_num": "Int32"} | dict.fromkeys(self.result, "Int32"))

    def known(self) -> dict[int, tuple]:
        return {v: tuple(of) for v, *of in self.videos.get()} if self.videos.exists() else {}

    def wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        taken, late, blocks = {v: of[0] for v, of in self.known().items()}, [], []
        for b in rows:
            frames = b[["video_id", "at", "frame_num"]].astype("int64")
            passed = (frames["frame_num"] <= frames["video_id"].map(taken)).to_numpy()
            late += [(v, n, [None] * len(self.result), True) for v, n in frames.loc[passed, ["video_id", "frame_num"]].itertuples(index=False)]
            if not passed.all():
                flat = [f for f, p in zip(b["flat"], passed, strict=True) if not p]
                blocks.append((frames[~passed].to_numpy(), np.array([len(f) for f in flat]), pd.Series(np.concatenate(flat)).astype("int64").to_numpy()))
        if blocks:
            held = [np.concatenate(x) for x in zip(*blocks, strict=True)]
            self.waiting.appendList([tuple(x.astype("int64").tobytes() for x in held)])
            first, timer = int(held[0][:, 1].min()), self.timer.get()[0] if self.timer.exists() else None
            if timer is None or first < timer:
                self.wake(first)
        yield from self.rows(key, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.timer.exists() or expiredTimerInfo.getExpiryTimeInMs() != self.timer.get()[0]:
            return  # an older timer: an earlier frame had set a new one
        passed, videos, made = timerValues.getCurrentWatermarkInMs(), self.known(), []
        blocks = [[np.frombuffer(bytes(x), "int64") for x in block] for block in self.waiting.get()] if self.waiting.exists() else []
        frames, sizes, flat = [np.concatenate(x) for x in zip(*blocks, strict=True)] if blocks else [np.zeros(0, "int64")] * 3
        frames, ends = frames.reshape(-1, 3), np.cumsum(sizes)
        ready = frames[:, 1] <= passed
        order = np.lexsort((frames[:, 1], frames[:, 2], frames[:, 0]))
        order = order[ready[order]]
        values = zip(*frames[order].T.tolist(), (ends - sizes)[order].tolist(), ends[order].tolist(), strict=True)
        for v, own in groupby(values, key=lambda f: f[0]):
            taken, newest, *memory = videos.get(v, (None, None))
            self.start(tuple(memory) if memory else None)
            for _, at, n, lo, hi in own:
                newest = at if newest is None else max(newest, at)
                late = taken is not None and n <= taken
                made.append((v, n, [None] * len(self.result) if late else self.step(n, flat[lo:hi].tolist()), late))
                taken = taken if late else n
            videos[v] = (taken, newest, *self.remember())
        rest = frames[~ready]
        waits = set(rest[:, 0].tolist())
        videos = {v: of for v, of in videos.items() if v in waits or of[1] + self.idle > passed}
        self.videos.put([(v, *of) for v, of in videos.items()]) if videos else self.videos.clear()
        if ready.any():
            left = np.repeat(~ready, sizes)
            self.waiting.put([tuple(x.tobytes() for x in (rest, sizes[~ready], flat[left]))]) if len(rest) else self.waiting.clear()
        ahead = [*rest[:, 1].tolist(), *(of[1] + self.idle for v, of in videos.items() if v not in waits)]
        self.wake(min(ahead)) if ahead else self.timer.clear()
        yield from self.rows(key, made)

    def close(self) -> None:
        pass


class TrackInOrder(InOrder):
    memory, result = "before array<int>, last array<int>, lost int, candidates array<int>, at int", ["x", "y"]

    def start(self, memory):
        self.tracker, self.before, self.at = Tracker(self.p), [], None
        if memory:
            before, last, lost, held, self.at = memory
            self.before = [(before[i], before[i + 1]) for i in range(0, len(before), 2)]
            self.tracker.last, self.tracker.lost = tuple(last) if len(last) else None, lost
            self.tracker.candidates = [((held[i], held[i + 1]), held[i + 2]) for i in range(0, len(held), 3)]

    def step(self, n, flat):
        for _ in range(0 if self.at is None else n - self.at - 1):  # frames missing between two are empty ones
            self.tracker.step([])
            self.before = []
        own = [(x, y) for _, x, y in sorted(zip(flat[::3], flat[1::3], flat[2::3], strict=True))]
        ball = self.tracker.step([b for b in own if not any(near(b, q, self.p) for q in self.before)])
        self.at, self.before = n, own
        return list(ball or (None, None))

    def remember(self):
        t = self.tracker
        return [c for b in self.before for c in b], list(t.last or ()), t.lost, [c for (x, y), s in t.candidates for c in (x, y, s)], self.at


class CarryInOrder(InOrder):
    memory, result = "seen int, box array<int>", ["x1", "y1", "x2", "y2", "last_seen_frame"]

    def start(self, memory):
        self.seen, self.box = (memory[0], list(memory[1])) if memory else (None, [])

    def step(self, n, flat):
        if flat:
            self.seen, self.box = n, flat
        if self.seen is not None and n - self.seen > self.p.racket_lost_frames:
            self.seen, self.box = None, []
        return [*(self.box or [None] * 4), self.seen]

    def remember(self):
        return self.seen, self.box


def taken_in_order(frames: DataFrame, flat: Column, delay: str, processor: InOrder) -> DataFrame:
    """``frames`` (video_id, frame_num, event_time, ...) through a processor. The event time goes on as a number, so that late rows reach it."""
    group = F.when(F.col("video_id").isNull(), NO_VIDEO).otherwise(F.pmod(F.xxhash64("video_id"), F.lit(GROUPS))).cast("int").alias("group")
    flat = F.coalesce(flat, F.array().cast("array<int>")).alias("flat")
    rows = frames.withWatermark("event_time", delay).select(group, F.coalesce("video_id", F.lit(0)).alias("video_id"), "frame_num", F.unix_millis("event_time").alias("at"), flat)
    schema = "video_id long, frame_num int, " + ", ".join(f"{c} int" for c in processor.result) + ", late boolean"
    return rows.groupBy("group").transformWithStateInPandas(processor, schema, "append", "eventTime")


def track(frames: DataFrame, p: Params = DEFAULT, delay: str = "10 seconds", idle: str = "10 minutes") -> DataFrame:
    """(video_id, frame_num, x, y, late): the active ball of each frame of a stream of FRAMES rows (candidates after the row filters).

    Frames may come in any order within ``delay`` of event time: they give what the batch gives. State: the frames that wait, the last
    frame's candidates, the tracker's ball, counter and static candidates.
    """
    flat = F.flatten(F.transform("balls", lambda b: F.array(b["det_idx"], b["x"], b["y"])))
    return taken_in_order(frames, flat, delay, TrackInOrder(p, idle))


def carry_racket(found: DataFrame, p: Params = DEFAULT, delay: str = "10 seconds", idle: str = "10 minutes") -> DataFrame:
    """The player's racket in each frame of a stream (video_id, frame_num, event_time, x1, y1, x2, y2; null without one), kept for ``racket_lost_frames``.

    In order as ``track``; late frames come out with ``late`` set and no racket.
    """
    flat = F.when(F.col("x1").isNotNull(), F.array("x1", "y1", "x2", "y2"))
    return taken_in_order(found, flat, delay, CarryInOrder(p, idle))


def assemble(frames: DataFrame, poses: DataFrame, rackets: DataFrame, balls: DataFrame, p: Params = DEFAULT, delay: str = "10 seconds", apart: str = "1 second", no_person: str = "No Swing") -> DataFrame:
    """Frames of four streams brought together: (video_id, frame_num, event_time, swing_type, racket_x1 .. racket_y2, ball_x, ball_y).

    Each stream has video_id, frame_num and its own event_time: ``frames``; ``poses`` with ``kp``, an array of 17 (x, y, conf); ``rackets`` with
    x1 .. y2; ``balls`` with x, y. Left outer joins within ``apart`` of event time; a frame whose partner never came is
    put out once the watermark has passed it. State holds what the watermark hasn't passed.
    """
    rows = frames.select("video_id", "frame_num", "event_time").withWatermark("event_time", delay)
    labels = label_poses(poses.select("*"), p, keep=("event_time",)).select("video_id", "frame_num", "event_time", "swing_type")
    sides = (labels, rackets.select("video_id", "frame_num", "event_time", *[F.col(c).alias(f"racket_{c}") for c in ("x1", "y1", "x2", "y2")]), balls.select("video_id", "frame_num", "event_time", F.col("x").alias("ball_x"), F.col("y").alias("ball_y")))
    for k, side in enumerate(sides):
        more = [c for c in side.columns if c not in ("video_id", "frame_num", "event_time")]
        side = side.select(F.col("video_id").alias(f"v{k}"), F.col("frame_num").alias(f"f{k}"), F.col("event_time").alias(f"t{k}"), *more).withWatermark(f"t{k}", delay)
        on = f"video_id = v{k} and frame_num = f{k} and t{k} >= event_time - interval {apart} and t{k} <= event_time + interval {apart}"
        kept = [c for c in rows.columns]
        rows = rows.join(side, F.expr(on), "left").select(*kept, *more)
    return rows.withColumn("swing_type", F.coalesce("swing_type", F.lit(no_person)))


def checkpoints(points: DataFrame, p: Params = DEFAULT, delay: str = "1 minute", gap: str = "1 hour") -> DataFrame:
    """Points and centre of each tumbling run of ``checkpoint_frames`` frames of a stream (video_id, frame_num, event_time, x, y)."""
    run = F.floor(F.col("frame_num") / p.checkpoint_frames).cast("int").alias("checkpoint")
    w = F.session_window("event_time", gap)  # a run is done, and its state goes, once nothing came for ``gap``
    return points.withWatermark("event_time", delay).groupBy("video_id", run, w).agg(F.count("x").alias("points"), F.avg("x").alias("x"), F.avg("y").alias("y")).drop("session_window")


def progress(frames: DataFrame, delay: str = "10 seconds", every: str = "1 second") -> DataFrame:
    """Frames of each video and second of event time; rows later than ``delay`` don't count."""
    per = frames.withWatermark("event_time", delay).groupBy(F.window("event_time", every), "video_id").agg(F.count("*").alias("frames"))
    return per.select("video_id", F.col("window.start").alias("second"), "frames")


def rallies(moving: DataFrame, gap: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Sessions of a moving ball: a ball lost for ``gap`` ends one."""
    s = moving.withWatermark("event_time", delay).groupBy(F.session_window("event_time", gap), "video_id").agg(F.count("*").alias("frames"))
    return s.select("video_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "frames")
