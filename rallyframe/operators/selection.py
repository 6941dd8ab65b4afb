"""Video catalogue, frame requests by id or timestamp, rejects and summaries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyframe.functions.geometry import seconds
from rallyframe.functions.sized import broadcast_if_small

#: The kinds of video files.
KINDS = ("mp4", "avi", "mov", "mkv")
VIDEO = rf"(?i)\.({'|'.join(KINDS)})$"


def list_videos(spark: SparkSession, folder: str, recursive: bool = True, exclude: str | None = None) -> DataFrame:
    """(path, length, modificationTime) of the video files under a folder; their content isn't read.

    Not ``recursive``: the folder alone is listed, by a pattern for each kind of file, and no folder in it.
    """
    files = spark.read.format("binaryFile")
    if recursive:
        found = files.option("recursiveFileLookup", True).load(folder)
    else:
        either = lambda kind: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in kind)
        try:
            found = files.load(f"{folder.rstrip('/')}/*.{{{','.join(map(either, KINDS))}}}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    return catalogue(found.select("path", "length", "modificationTime"), exclude)


def take_new_videos(spark: SparkSession, folder: str, out: str, checkpoint: str, exclude: str | None = None) -> DataFrame:
    """Adds the video files that came since the last call to the table at ``out`` and gives them: a file stream that keeps what it took in ``checkpoint``.

    ``taken`` in the table is the number of the call's batch, so a call that is repeated after a failure adds nothing twice.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    found = catalogue(files.select("path", "length", "modificationTime"), exclude)
    batches = []

    def add(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/taken={batch}")
        batches.append(batch)

    found.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    schema = "path string, length long, modificationTime timestamp, taken int"
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out).filter(F.col("taken").isin(batches))


def catalogue(paths: DataFrame, exclude: str | None = None) -> DataFrame:
    """Rows whose ``path`` is a video's, whatever its case, and doesn't match ``exclude``."""
    out = paths.filter(F.col("path").rlike(VIDEO))
    return out.filter(~F.col("path").rlike(exclude)) if exclude else out


def names(videos: DataFrame) -> DataFrame:
    """Stem, folder and the output paths of each video."""
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    file = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    return videos.withColumns({"video_name": stem, "annotated_path": F.concat_ws("/", folder, F.lit("out"), file), "frames_dir": F.concat_ws("/", folder, F.lit("frames")), "named_frames_dir": F.concat_ws("/", folder, F.lit("frames"), stem)})


def metadata(videos: DataFrame) -> DataFrame:
    """Frame rates and lengths as the batch and the extractor take them."""
    whole = F.col("fps").cast("int")
    known = F.col("total_frames") > 0
    total = F.when(known, F.col("total_frames")).when(F.col("fps") > 0, (F.col("fps") * 3600).cast("int")).otherwise(100_000)
    return videos.select(
        "video_id", whole.alias("fps_int"), F.when(whole == 0, 25).otherwise(whole).alias("writer_fps"),
        F.when(known, F.col("total_frames")).when(whole > 0, whole * 3600).otherwise(-1).alias("batch_frames"),
        total.alias("extract_frames"), F.when(F.col("fps") > 0, total / F.col("fps")).otherwise(0.0).alias("duration"),
    )


def split_valid(videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Videos that can be worked on, and the others with a ``reject_reason``."""
    reason = (
        F.when(F.col("path").isNull() | (F.col("path") == ""), "no path")
        .when(~F.col("path").rlike(VIDEO), "not a video")
        .when(F.coalesce(F.col("width"), F.lit(0)) * F.coalesce(F.col("height"), F.lit(0)) <= 0, "no picture size")
        .when(F.col("fps").isNull() | (F.col("fps") < 0), "no frame rate")
    )
    rows = videos.withColumn("reject_reason", reason)
    return rows.filter("reject_reason is null").drop("reject_reason"), rows.filter("reject_reason is not null")


def parse_list(lists: DataFrame, column: str) -> DataFrame:
    """Trimmed items of comma-separated lists."""
    return lists.select(F.explode(F.split(column, ",")).alias("item")).select(F.trim("item").alias("item"))


def parse_ids(lists: DataFrame, column: str) -> DataFrame:
    """Frame ids; items that are no whole numbers become null."""
    return parse_list(lists, column).select(F.expr("try_cast(item as int)").alias("frame_id"))


def videos_with(videos: DataFrame) -> DataFrame:
    m = metadata(videos)
    return names(videos).join(m, "video_id").select("video_id", "video_name", "fps", F.col("extract_frames").alias("n_frames"), "duration")


def requests_by_id(videos: DataFrame, requests: DataFrame) -> DataFrame:
    """Every distinct request for every video, with why it can't be met or null."""
    pairs = videos_with(videos).join(broadcast_if_small(requests.distinct()))  # each pair is a row of the result
    ok = (F.col("frame_id") >= 0) & (F.col("frame_id") < F.col("n_frames"))
    return pairs.withColumn("reason", F.when(F.col("frame_id").isNull() | ~ok, "invalid id"))


def frames_by_id(videos: DataFrame, frames: DataFrame, requests: DataFrame) -> DataFrame:
    """The requested frames that exist: frames are joined with requests by number, then with their videos."""
    asked = broadcast_if_small(requests.filter("frame_id >= 0").select(F.col("frame_id").alias("frame_num")).distinct())
    got = frames.select("video_id", "frame_num").join(asked, "frame_num").join(videos_with(videos), "video_id").filter(F.col("frame_num") < F.col("n_frames"))
    return got.select("video_id", "video_name", "frame_num", F.lit("id").alias("source"), F.col("frame_num").cast("string").alias("requested"), F.format_string("%s_frame_%04d.png", "video_name", "frame_num").alias("file_name"))


def requests_by_time(videos: DataFrame, requests: DataFrame) -> DataFrame:
    pairs = videos_with(videos).join(broadcast_if_small(requests.distinct())).withColumn("seconds", seconds(F.col("ts")))
    reason = F.when(F.col("seconds").isNull(), "bad format").when(F.col("seconds") > F.col("duration"), "beyond duration")
    return pairs.withColumns({"reason": reason, "frame_num": (F.col("seconds") * F.col("fps")).cast("int")})


def frames_by_time(videos: DataFrame, frames: DataFrame, requests: DataFrame) -> DataFrame:
    got = requests_by_time(videos, requests).filter("reason is null").join(frames.select("video_id", "frame_num"), ["video_id", "frame_num"])
    name = F.format_string("%s_time_%s_frame_%04d.png", F.col("video_name"), F.replace(F.col("ts"), F.lit(":"), F.lit("_")), F.col("frame_num"))
    return got.select("video_id", "video_name", "frame_num", F.lit("time").alias("source"), F.col("ts").alias("requested"), name.alias("file_name"))


def extracted(videos: DataFrame, frames: DataFrame, ids: DataFrame, times: DataFrame) -> DataFrame:
    """Frames by id and by time; one asked for both ways counts twice."""
    return frames_by_id(videos, frames, ids).unionByName(frames_by_time(videos, frames, times))


def rejected(videos: DataFrame, frames: DataFrame, ids: DataFrame, times: DataFrame) -> DataFrame:
    """(video_id, source, requested, reason) of all requests that gave no frame."""
    cols = ["video_id", "source", "requested", "frame_num", "reason"]
    a = requests_by_id(videos, ids).select("video_id", F.lit("id").alias("source"), F.col("frame_id").cast("string").alias("requested"), F.col("frame_id").alias("frame_num"), "reason")
    b = requests_by_time(videos, times).select("video_id", F.lit("time").alias("source"), F.col("ts").alias("requested"), "frame_num", "reason")
    every = a.select(*cols).unionByName(b.select(*cols))
    there = frames.select("video_id", "frame_num", F.lit(True).alias("there"))
    rows = every.join(there, ["video_id", "frame_num"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("there").isNull(), "frame missing")))
    return rows.filter("reason is not null").select("video_id", "source", "requested", "reason")


def in_order(selected: DataFrame) -> DataFrame:
    """Selected frames with their ``position`` in the video's ascending order, dealt out by video and sorted so for writing."""
    w = Window.partitionBy("video_id").orderBy("frame_num", "source", "requested")
    return selected.withColumn("position", F.row_number().over(w)).sortWithinPartitions("video_id", "position")


def extract_summary(extracted_: DataFrame) -> DataFrame:
    per = extracted_.groupBy("video_id").count()
    return per.agg(F.count("*").alias("videos"), F.coalesce(F.sum("count"), F.lit(0)).alias("frames"))
