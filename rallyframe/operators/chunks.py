"""Long videos in chunks of frames, so that no step needs a whole video in one task.

Steps that look back a bounded number of frames run inside a chunk: ``spread`` copies the last ``halo_frames`` of a
chunk into the next, and ``own`` drops the copies once the steps are done. Operators take a ``chunk`` column as
part of the key where their tables have one. Steps that look back without bound are two-level scans: a
row for each chunk says what the chunk leaves behind, a window over these few rows makes what each chunk takes in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rallyframe.params import DEFAULT, Params


def keys(rows: DataFrame) -> list[str]:
    return ["video_id", "chunk"] if "chunk" in rows.columns else ["video_id"]


def by_frame(rows: DataFrame) -> list[str]:
    return [*keys(rows), "frame_num"]


def frame_order(rows: DataFrame) -> WindowSpec:
    return Window.partitionBy(*keys(rows)).orderBy("frame_num")


def number(p: Params = DEFAULT) -> Column:
    return F.floor(F.col("frame_num") / p.chunk_frames).cast("int")


def cut(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Each row with the ``chunk`` of its frame."""
    return rows.withColumn("chunk", number(p))


def spread(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The same, and copies of each chunk's last ``halo_frames`` frames in the chunk after it."""
    late = F.col("frame_num") % p.chunk_frames >= p.chunk_frames - p.halo_frames
    return rows.withColumn("chunk", F.explode(F.when(late, F.array(number(p), number(p) + 1)).otherwise(F.array(number(p)))))


def own(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Rows of ``spread`` tables without the copies and without ``chunk``."""
    return rows.filter(F.col("chunk") == number(p)).drop("chunk")


def left_by_earlier(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` of ``cut`` with the last value that is not null in earlier chunks of the video."""
    last = F.max_by(value, F.when(value.isNotNull(), F.col("frame_num")))
    before = Window.partitionBy("video_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    leaves = rows.groupBy("video_id", "chunk").agg(last.alias("left"))  # a row for each chunk
    return rows.join(leaves.select("video_id", "chunk", F.last("left", ignorenulls=True).over(before).alias(name)), ["video_id", "chunk"], "left")


def with_before(rows: DataFrame, value: Column, name: str, p: Params = DEFAULT) -> DataFrame:
    """``rows`` with ``value`` of the row before in the video, from the chunk or the last of the chunks before it; null for the first.

    ``value`` must not be null, a struct where its parts may be.
    """
    marked = left_by_earlier(cut(rows, p), value, "earlier")
    return marked.withColumn(name, F.coalesce(F.lag(value).over(frame_order(marked)), "earlier")).drop("chunk", "earlier")


def numbered(rows: DataFrame, name: str, p: Params = DEFAULT) -> DataFrame:
    """``rows`` with their place in the video, from 0 on: the place in the chunk and the rows of the chunks before."""
    marked = cut(rows, p)
    before = Window.partitionBy("video_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy("video_id", "chunk").agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.select("video_id", "chunk", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(frame_order(marked)) - 1
    return marked.withColumn("place", place).join(counts, ["video_id", "chunk"]).withColumn(name, F.col("place") + F.col("base")).drop("chunk", "place", "base")
