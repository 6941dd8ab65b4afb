"""Late frames beside the others: two tables from one stream, each micro-batch written once however often it is tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def write_apart(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream that writes rows with ``late`` to ``path``/late and the others to ``path``/in_time.

    Both tables are in folders by micro-batch. A batch that is tried again, after a failure between the two writes or before it was
    committed, overwrites its own folders, so no row is there twice.
    """
    return rows.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def write_batch(rows: DataFrame, number: int, path: str) -> None:
    rows = rows.persist()
    try:
        for table, part in (("in_time", "not late"), ("late", "late")):
            rows.filter(part).drop("late").write.mode("overwrite").parquet(f"{path}/{table}/micro_batch={number}")
    finally:
        rows.unpersist()


def read_apart(spark: SparkSession, path: str, schema: str, table: str) -> DataFrame:
    """A table that ``write_apart`` wrote, ``in_time`` or ``late``; ``schema`` without ``late``."""
    return spark.read.schema(f"{schema}, micro_batch int").parquet(f"{path}/{table}").drop("micro_batch")
