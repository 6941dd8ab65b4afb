"""Fixed schemas of the fact tables and readers that never infer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rallyframe.operators.chunks import spread
from rallyframe.params import DEFAULT, Params

KEYPOINT_NAMES = (
    "nose left_eye right_eye left_ear right_ear left_shoulder right_shoulder left_elbow right_elbow "
    "left_wrist right_wrist left_hip right_hip left_knee right_knee left_ankle right_ankle"
).split()

SCHEMAS = {
    "videos": "video_id long, path string, width int, height int, fps double, total_frames int",
    "frames": "video_id long, frame_num int, event_time timestamp, processed_at timestamp",
    "keypoints": "video_id long, frame_num int, person_idx int, kp_idx int, x double, y double, conf double",
    "racket_detections": "video_id long, frame_num int, racket_idx int, class_id int, conf double, x1 double, y1 double, x2 double, y2 double",
    "ball_detections": "video_id long, frame_num int, det_idx int, x int, y int, radius int",
    "frame_requests": "frame_id int",
    "time_requests": "ts string",
}


def read_facts(spark: SparkSession, table: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A fact table from Parquet, ORC, JSON or CSV, by its fixed schema; unreadable JSON and CSV rows go to ``_corrupt``."""
    if fmt in ("json", "csv"):
        reader = spark.read.schema(SCHEMAS[table] + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)
    return spark.read.schema(SCHEMAS[table]).format(fmt).load(path)


def write_by_video(frames: DataFrame, path: str, buckets: int = 1, folders: int | None = None) -> None:
    """One folder for each video, frames in order in each file; ``buckets`` > 1 splits long videos by ranges of frames.

    For many short videos, whose files would cost more than their frames, ``folders`` is a number of folders: videos are dealt out to them
    by hash and stand in their files one after the other, each whole and in order.
    """
    from pyspark.sql import functions as F

    part = F.lit(0) if buckets == 1 else F.floor(F.col("frame_num") / F.lit(100_000)) % buckets
    by = "video_id" if folders is None else "folder"
    rows = frames if folders is None else frames.withColumn(by, F.pmod(F.xxhash64("video_id"), F.lit(folders)))
    rows = rows.withColumn("_part", part).repartition(by, "_part").drop("_part").sortWithinPartitions(*dict.fromkeys((by, "video_id", "frame_num")))
    rows.write.mode("errorifexists").partitionBy(by).parquet(path)


def write_facts(rows: DataFrame, name: str, buckets: int = 200, p: Params = DEFAULT) -> DataFrame:
    """Saves a fact table bucketed by video and chunk of frames and sorted in each bucket; reads it back.

    Rows are dealt out and sorted once, here: tables saved so join, group and window by frame without another shuffle
    (``session.co_partition``). Halo rows are saved too (``chunks.spread``), and ``chunks.own`` drops them from results.
    """
    rows = spread(rows, p).repartition(buckets, "video_id", "chunk")
    rows.write.bucketBy(buckets, "video_id", "chunk").sortBy("video_id", "chunk", "frame_num").mode("errorifexists").saveAsTable(name)
    return rows.sparkSession.table(name)
