"""Makes the package importable on executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch that goes to a Python worker: whole texts may be long, and each worker holds a few batches.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits to ours; limits that are lower already stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").lower().rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


#: Whether joins on (video, frame) take tables that are dealt out by video alone as they are, without a shuffle.
FINE_JOINS = "spark.sql.requireAllClusterKeysForCoPartition"
_fine_joins: dict[str, str | None] = {}


def co_partition(spark: SparkSession) -> None:
    """Lets the session's joins use tables that are dealt out by a part of the join's keys, until the next ``ship``."""
    _fine_joins.setdefault(spark.sparkContext.applicationId, spark.conf.get(FINE_JOINS, None))
    spark.conf.set(FINE_JOINS, "false")


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors of the session's application, once, and bounds Arrow batches."""
    bound_batches(spark)
    sc = spark.sparkContext
    if sc.applicationId in _fine_joins:
        was = _fine_joins.pop(sc.applicationId)
        spark.conf.unset(FINE_JOINS) if was is None else spark.conf.set(FINE_JOINS, was)
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="spark-rallyframe-")
    path = os.path.join(folder, "rallyframe.zip")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
