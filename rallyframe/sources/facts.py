"""Fact tables that Spark derives from ``events``: a user is a video, an event is a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyframe.sources.schemas import KEYPOINT_NAMES


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, f, e, ts, kind): frames of each video in time order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("v"), F.col("event_id").alias("e"), "ts", F.col("event_type").alias("kind"))
    w = Window.partitionBy("v").orderBy("ts", "e")
    return events.select("v", (F.row_number().over(w) - 1).alias("f"), "e", "ts", "kind")


KINDS = ("view", "click", "purchase", "signup", "error")


def line_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from ``lineitem``: a supplier is a video, of several hundred frames, and a line is a frame."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("e") % 5 + 1).cast("int"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("v"), (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("e"))
    f = F.row_number().over(Window.partitionBy("v").orderBy("e")) - 1  # lines of equal number are alike in all that is used
    return lines.select("v", f.alias("f"), "e", F.timestamp_seconds(f).alias("ts"), kind.alias("kind"))


def frames(ev: DataFrame) -> DataFrame:
    return ev.select(F.col("v").alias("video_id"), F.col("f").alias("frame_num"), F.col("ts").cast("timestamp").alias("event_time"), F.col("ts").cast("timestamp").alias("processed_at"))


def videos(ev: DataFrame) -> DataFrame:
    n = ev.groupBy(F.col("v").alias("video_id")).agg(F.count("*").cast("int").alias("total_frames"))
    ext = F.element_at(F.array(*map(F.lit, (".mp4", ".MP4", ".avi", ".txt", ".mkv"))), (F.col("video_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/videos/court"), (F.col("video_id") % 7).cast("string"), F.lit("/match_"), F.col("video_id").cast("string"), ext)
    return n.select("video_id", path.alias("path"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), (F.lit(25) + F.col("video_id") % 6).cast("double").alias("fps"), "total_frames")


def ball_detections(ev: DataFrame) -> DataFrame:
    det = lambda k, x, y, when: F.when(when, F.struct(F.lit(k).alias("det_idx"), F.expr(x).cast("int").alias("x"), F.expr(y).cast("int").alias("y")))
    each = F.array(
        det(0, "660 + (f * 17 + v * 5) % 740", "420 + (f * 11) % 540", ~F.col("kind").isin("error", "signup")),
        det(1, "900 + v % 50 + e % 3", "600 + e % 2", F.col("kind") != "signup"),
        det(2, "500 + (e * 37) % 1100", "300 + (e * 53) % 800", F.col("e") % 3 == 0),
    )
    d = ev.filter("f % 40 not between 30 and 37").select("v", "f", "e", F.explode(each).alias("d")).filter("d is not null")
    return d.select(F.col("v").alias("video_id"), F.col("f").alias("frame_num"), "d.*", (F.lit(2) + (F.col("e") + F.col("d.det_idx")) % 16).cast("int").alias("radius"))


def keypoints(ev: DataFrame) -> DataFrame:
    people = ev.select("v", "f", "e", F.explode(F.expr("sequence(0, case when e % 5 = 0 then 1 else 0 end)")).alias("p")).filter("p = 1 or e % 11 <> 0")
    k = people.select("v", "f", "e", "p", F.explode(F.sequence(F.lit(0), F.lit(len(KEYPOINT_NAMES) - 1))).alias("i"))
    return k.selectExpr(
        "v as video_id", "f as frame_num", "p as person_idx", "i as kp_idx",
        "cast(900 + (e * (7 + 2 * i) + i * 31 + p * 137) % 200 as double) as x",
        "cast(450 + i * 20 + (e * (3 + i) + p * 9) % 60 as double) as y",
        "cast(55 + (e * (2 * i + 3) + 7 * i + p * 41) % 100 as double) / 154D as conf",
    )


def racket_detections(ev: DataFrame) -> DataFrame:
    r = ev.filter("e % 3 > 0").select("v", "f", "e", F.explode(F.expr("sequence(0, cast(e % 3 as int) - 1)")).alias("r"))
    return r.selectExpr(
        "v as video_id", "f as frame_num", "r as racket_idx", "case when e % 7 = 0 then 0 else 38 end as class_id",
        "cast((e * 17 + r * 29) % 100 as double) / 100D as conf",
        "cast(880 + (e * 19 + r * 83) % 200 as double) as x1", "cast(580 + (e * 23 + r * 41) % 150 as double) as y1",
        "cast(880 + (e * 19 + r * 83) % 200 + 30 + e % 50 as double) as x2", "cast(580 + (e * 23 + r * 41) % 150 + 40 + e % 60 as double) as y2",
    )
