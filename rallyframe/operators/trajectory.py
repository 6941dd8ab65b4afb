"""Points of a track over time: steps, outliers, smoothing, trails, still runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.operators.chunks import by_frame, frame_order, numbered, with_before
from rallyframe.params import DEFAULT, Params


def in_order():
    return Window.partitionBy("video_id").orderBy("frame_num")


def step(x="x", y="y", w=None):
    w = w or in_order()
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def with_point_before(points: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """``points`` with ``before``, the (frame_num, x, y) of the point before, from the chunk or the last of the chunks before it."""
    return with_before(points.select("video_id", "frame_num", "x", "y"), F.struct("frame_num", "x", "y"), "before", p)


def step_distance(points: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Distance to the point before in the track, whatever frames lie between; null for the first."""
    dx, dy = F.col("x") - F.col("before.x"), F.col("y") - F.col("before.y")
    return with_point_before(points, p).select("video_id", "frame_num", F.sqrt((dx * dx + dy * dy).cast("double")).alias("step"))


def step_statistics(points: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Mean and population deviation of the steps of each video."""
    return step_distance(points, p).groupBy("video_id").agg(F.count("step").alias("n_steps"), F.avg("step").alias("mean_step"), F.stddev_pop("step").alias("std_step"))


def chunked(points: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """``chunk`` and ``n``: runs of ``history`` points and the length of each."""
    rows = numbered(points, "at", p).withColumn("chunk", F.floor(F.col("at") / p.history).cast("int")).drop("at")
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("video_id", "chunk")).cast("int"))


def replace_outliers(points: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """In runs of ``history`` points: a point whose step is over mean + sigma * deviation becomes the one before it, itself after replacement."""
    whole = Window.partitionBy("video_id", "chunk")
    w = whole.orderBy("frame_num")
    rows = chunked(points, p).withColumn("step", step(w=w))
    over = F.col("step") > F.avg("step").over(whole) + p.outlier_sigma * F.stddev_pop("step").over(whole)
    rows = rows.withColumn("bad", F.coalesce((F.col("n") >= 3) & over, F.lit(False)))
    kept = F.last(F.when(~F.col("bad"), F.struct("x", "y")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("k", kept).select("video_id", "frame_num", F.col("k.x").alias("x"), F.col("k.y").alias("y"), F.col("bad").alias("replaced"))


def smoothing_window(n: int) -> int:
    """Points of the quadratic fit for a track of n points; under 3: no smoothing."""
    if n <= 3:
        return 0
    w = min(7, n - 2)
    return w - (w % 2 == 0)


def fit_matrix(w: int) -> np.ndarray:
    """Row r: weights that give the least-squares quadratic through w points at point r."""
    x = np.arange(w) - w // 2
    a = np.stack([np.ones(w), x, x * x], 1)
    return a @ np.linalg.inv(a.T @ a) @ a.T


def smooth_runs(points: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Quadratic smoothing in runs of ``history`` points; the first and last points use the fit of the first and last window."""
    w = Window.partitionBy("video_id", "chunk")
    rows = chunked(points, p)
    around = w.orderBy("frame_num").rowsBetween(-6, 6)
    place = F.row_number().over(w.orderBy("frame_num")) - 1
    width = F.when(F.col("n") >= 9, 7).when(F.col("n") >= 7, 5).otherwise(0)
    rows = rows.withColumns({"p": place, "w": width, "xs": F.collect_list(F.col("x").cast("double")).over(around), "ys": F.collect_list(F.col("y").cast("double")).over(around)})
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.floor(F.col("w") / 2).cast("int"), F.col("n") - F.col("w")))
    rows = rows.withColumns({"s": start, "lead": F.greatest(F.lit(0), F.col("p") - 6)})

    def fitted(c, values):
        out = F.col(c).cast("double")
        for size in (5, 7):
            scale = {5: 35, 7: 42}[size]
            table = F.array(*[F.array(*[F.lit(int(round(v * scale))) for v in row]) for row in fit_matrix(size)])
            part = F.slice(values, F.col("s") - F.col("lead") + 1, size)
            total = F.aggregate(F.zip_with(part, F.element_at(table, F.col("p") - F.col("s") + 1), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            out = F.when(F.col("w") == size, total / scale).otherwise(out)
        return out

    return rows.select("video_id", "frame_num", fitted("x", F.col("xs")).alias("x"), fitted("y", F.col("ys")).alias("y"))


def clean(x: np.ndarray, sigma: float) -> np.ndarray:
    """Outlier replacement, then smoothing, of an (n, 2) track."""
    if len(x) >= 3:
        d = np.sqrt((np.diff(x, axis=0) ** 2).sum(1))
        bad = np.r_[False, d > d.mean() + sigma * d.std()]
        x = x[np.maximum.accumulate(np.where(bad, 0, np.arange(len(x))))]
    w = smoothing_window(len(x))
    if w < 3:
        return x
    m, n = fit_matrix(w), len(x)
    s = np.clip(np.arange(n) - w // 2, 0, n - w)
    return np.einsum("nw,nwk->nk", m[np.arange(n) - s], x[s[:, None] + np.arange(w)])


class Smoother:
    """Clean-up of one video's points as they come in order of frame: holds those that a later clean-up can still change, ``history`` at most after each call."""

    def __init__(self, p: Params = DEFAULT):
        self.p, self.frames, self.xy, self.next = p, np.zeros(0, np.int64), np.zeros((0, 2)), 0

    def take(self, frames: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes the next points and gives back those that are done."""
        out = []
        for k in range(0, len(frames), self.p.history):
            self.frames, self.xy = np.r_[self.frames, frames[k : k + self.p.history]], np.r_[self.xy, xy[k : k + self.p.history]]
            newest = int(self.frames[-1])
            while self.next <= newest:
                end = int(np.searchsorted(self.frames, self.next, "right"))
                start = max(0, end - self.p.history)
                if end > start:
                    self.xy[start:end] = clean(self.xy[start:end], self.p.outlier_sigma)
                self.next += self.p.checkpoint_frames
            done = max(0, len(self.frames) - self.p.history)
            out.append((self.frames[:done], self.xy[:done]))
            self.frames, self.xy = self.frames[done:], self.xy[done:]
        return (np.concatenate([f for f, _ in out]), np.concatenate([x for _, x in out])) if out else (frames, xy)


def smooth_cumulatively(points: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Clean-up at each frame divisible by ``checkpoint_frames`` over the last ``history`` points, as earlier clean-ups left them.

    The recursion has no end in a video, so a video is walked by one task, in batches: only ``history`` points of one
    video are held from batch to batch, and a point is put out once so many came after it.
    """

    def run(batches):
        video, smoother = None, None
        for b in batches:
            v, f = b["video_id"].to_numpy(), b["frame_num"].to_numpy()
            xy = np.stack([b["x"].to_numpy(), b["y"].to_numpy()], 1).astype(float)
            starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
            made = []
            for x, z in zip(starts.tolist(), [*starts[1:].tolist(), len(v)], strict=True):
                if v[x] != video:
                    if smoother is not None:
                        made.append((video, smoother.frames, smoother.xy))
                    video, smoother = v[x], Smoother(p)
                made.append((video, *smoother.take(f[x:z], xy[x:z])))
            if made:
                yield rows(made)
        if smoother is not None:
            yield rows([(video, smoother.frames, smoother.xy)])

    def rows(made):
        v, f, xy = np.concatenate([np.full(len(f), v) for v, f, _ in made]), np.concatenate([f for _, f, _ in made]), np.concatenate([x for *_, x in made])
        return pa.record_batch([pa.array(v, pa.int64()), pa.array(f, pa.int32()), pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["video_id", "frame_num", "x", "y"])

    dealt = points.select("video_id", "frame_num", "x", "y").repartition("video_id").sortWithinPartitions("video_id", "frame_num")
    return dealt.mapInArrow(run, "video_id long, frame_num int, x double, y double")


def trail(frames: DataFrame, points: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Ball of the last ``trail`` frames of each frame, newest first, with marker size; one row for each mark."""
    key = by_frame(frames)
    ball = F.struct("frame_num", F.col("x"), F.col("y"))
    rows = frames.select(*key).join(points, key, "left")
    rows = rows.withColumn("t", F.reverse(F.collect_list(ball).over(frame_order(rows).rowsBetween(-(p.trail - 1), 0))))
    marks = rows.select(*key, F.posexplode("t").alias("i", "m")).filter("m.x is not null")
    return marks.select(*key, F.col("i").alias("age"), F.col("m.x").alias("x"), F.col("m.y").alias("y"), (2 + (p.trail - F.col("i")) * 0.5).alias("size"))


def history(points: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The last ``history`` points of each video."""
    last = Window.partitionBy("video_id").orderBy(F.col("frame_num").desc())
    return points.withColumn("r", F.row_number().over(last)).filter(F.col("r") <= p.history).drop("r")


def lines(points: DataFrame, p: Params = DEFAULT, first: int = 30) -> DataFrame:
    """Line pieces between neighbours of the first ``first`` points of the history."""
    w = in_order()
    rows = history(points, p).withColumns({"i": F.row_number().over(w), "from_x": F.lag("x").over(w), "from_y": F.lag("y").over(w)})
    return rows.filter((F.col("i") > 1) & (F.col("i") <= first)).select("video_id", (F.col("i") - 1).alias("piece"), "from_x", "from_y", F.col("x").alias("to_x"), F.col("y").alias("to_y"))


def still_runs(points: DataFrame, p: Params = DEFAULT, by: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Runs of ``static_frames`` steps or more, each under ``static_movement``: first and last frame and number of steps, for each track ``by``."""
    w = Window.partitionBy(*by).orderBy("frame_num")
    rows = points.withColumn("still", F.coalesce(step(w=w) < p.static_movement, F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("still"), 0).otherwise(1)).over(w))
    runs = rows.groupBy(*by, "run").agg(F.min("frame_num").alias("first_frame"), F.max("frame_num").alias("last_frame"), F.sum(F.col("still").cast("int")).alias("steps"))
    return runs.filter(F.col("steps") >= p.static_frames).select(*by, "first_frame", "last_frame", "steps")
