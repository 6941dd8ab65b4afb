"""Progress of streams while they run, from what Spark reports after each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "progress"


def observed(rows: DataFrame) -> DataFrame:
    """``rows`` (video_id, frame_num, ...) whose micro-batches also report frames and the highest frame number."""
    return rows.observe(METRICS, F.count(F.lit(1)).alias("frames"), F.max("frame_num").alias("last_frame"))


class ProgressLog(StreamingQueryListener):
    """Keeps (query, batch, frames, last_frame, seconds, frames_per_second) of each micro-batch that had rows; numbers only, one row a batch.

    ``spark.streams.addListener(log)`` starts it. It takes the figures of ``observed`` streams, of others the number of input rows.
    """

    SCHEMA = "query string, batch long, frames long, last_frame int, seconds double, frames_per_second double"

    def __init__(self, keep: int = 10_000):
        self.keep, self.rows = keep, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(METRICS)
        frames, last = (seen["frames"], seen["last_frame"]) if seen is not None else (p.numInputRows, None)
        if frames:
            seconds = p.batchDuration / 1000
            self.rows = [*self.rows, (str(p.id), p.batchId, frames, last, seconds, frames / seconds if seconds else 0.0)][-self.keep :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.SCHEMA)
