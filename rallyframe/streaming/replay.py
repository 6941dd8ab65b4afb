"""Runs a streaming operator over whole tables, as streams of files in several micro-batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target


TICK, DAY = -(2**63), 86_400_000_000
#: Rows of a micro-batch that go to one file.
FILE_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one only where Spark itself is local."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-rallyframe-")
    return f"{top.rstrip('/')}/rallyframe-replay-{uuid.uuid4().hex}"


def as_stream(table: DataFrame, path: str, files: int, again: Callable[[DataFrame], DataFrame] | None = None, ticks: int = 2) -> DataFrame:
    """``table`` as a stream of ``files`` micro-batches, each with the rows of a stretch of event time in no order, in as many files as its size asks for.

    ``again`` picks rows that come once more after them, given the stored table. Last rows of no video (``TICK``), ``ticks`` of them 60 days apart after the last event, move the watermark
    past all others; each is a batch that sees the watermark of the one before.
    """
    spark = table.sparkSession
    table.write.parquet(f"{path}/all")
    rows = spark.read.schema(table.schema).parquet(f"{path}/all")
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min(F.unix_micros("event_time")), F.max(F.unix_micros("event_time"))).first()
    lo, hi, each = lo or 0, hi or 0, max(1, -(-n // (files * FILE_ROWS)))
    span = max(1, hi - lo + 1)
    part = F.floor((F.unix_micros("event_time") - F.lit(lo)) * files / span)
    batches = [(lo + k * span // files, rows.filter(part == k)) for k in range(files)] + ([] if again is None else [(hi, again(rows))])
    batches += [(hi + 60 * (k + 1) * DAY, None) for k in range(ticks)]
    for k, (at, own) in enumerate(batches):
        # A row of no video in each file, as a batch is ``each`` files and a file without rows is not written; no nulls: joins drop those before the watermark sees them.
        of = {"event_time": F.timestamp_micros(F.lit(at)), "video_id": F.lit(TICK), "frame_num": F.lit(k * each) + F.col("id")}
        marks = spark.range(0, each, 1, 1).select(*[of.get(c, F.lit(None)).cast(t).alias(c) for c, t in table.dtypes], F.col("id").alias("file"))
        dealt = marks if own is None else own.withColumn("file", F.pmod(F.xxhash64("video_id", "frame_num"), F.lit(each))).unionByName(marks)
        dealt = dealt.coalesce(1) if each == 1 else dealt.repartition(each, "file")  # one task for all rows of a file
        dealt.sortWithinPartitions("file", F.xxhash64("frame_num", "video_id")).write.mode("append").partitionBy("file").parquet(f"{path}/in")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", each).parquet(f"{path}/in").select(*table.columns)


@contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams that start here get as many state partitions as there are cores, or as the session's shuffles have if that is less.

    Each partition has its own store for each stateful operator, opened and committed in every micro-batch; a stream keeps the number it started with.
    """
    key = "spark.sql.shuffle.partitions"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(int(was), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def replay(tables: DataFrame | tuple[DataFrame, ...], operator: Callable[..., DataFrame], files: int = 4, ticks: int = 2) -> DataFrame:
    """What ``operator`` gives for streams that hold all rows of ``tables``, which have an ``event_time``; read and written in the shared folder."""
    tables = tables if isinstance(tables, tuple) else (tables,)
    spark = tables[0].sparkSession
    at = shared_folder(spark)
    made = inheritable_thread_target(spark)(lambda k: as_stream(tables[k], f"{at}/{k}", files, ticks=ticks))
    with ThreadPoolExecutor(len(tables)) as side_by_side:
        out = operator(*side_by_side.map(made, range(len(tables))))
    with state_partitions(spark):
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out").filter(F.col("video_id") != TICK)
