"""Tables in the folder that driver and executors share, and small helpers on frames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_BYTES = 32 << 20
_kept: list[Callable] = []


def kept_by_worker(make: Callable) -> Callable:
    """``make`` with its results kept until ``let_go``: tokenizers with the tables that they fill."""
    held = cache(make)
    _kept.append(held)
    return held


def let_go() -> None:
    """Drops them. Spark hands Python workers on from stage to stage and query to query; tasks that need no tokenizer call this as they begin."""
    for held in _kept:
        held.cache_clear()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset and Spark is local (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="spark-rallyframe-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rallyframe-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_small(df: DataFrame, name: str) -> DataFrame:
    """``stored`` in files of the session's advisory size: for few rows that many tasks make. Each file costs its task a new process where the folder is local."""
    return stored(df.hint("rebalance"), name)


def stored_in_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """The same in buckets of ``key``, as many as the session's shuffle partitions: grouping and joining by ``key`` reads them without a shuffle.

    No shuffle deals the rows out: a task writes a file for each bucket that it has rows of.
    """
    spark = df.sparkSession
    path, table = fresh_path(spark, name), f"rallyframe_{name}_{uuid.uuid4().hex}"
    df.write.option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).saveAsTable(table)
    out = spark.table(table)
    out._stored_at, out._table = path, table
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes tables that ``stored`` and ``stored_in_buckets`` wrote; nothing that is still to be read may depend on them."""
    for df in frames:
        if table := getattr(df, "_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        if path := getattr(df, "_stored_at", None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_if_small(keys: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """``keys`` (one column) marked for a broadcast if they take at most ``most`` bytes; as they are otherwise, for a shuffled join."""
    (name,) = keys.columns
    size = keys.agg((F.count("*") * 16 + F.coalesce(F.sum(F.octet_length(F.col(name).cast("string").cast("binary"))), F.lit(0))).alias("n")).first()["n"]
    return F.broadcast(keys) if size <= most else keys


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of an id written as text, modulo ``n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def row_key(id_name: str, text_name: str) -> Column:
    """Sixteen bytes that stand for (id, text): rows equal in both share a key, others do not."""
    piece = lambda c: F.coalesce(F.concat(F.lit("v"), c), F.lit("n"))
    return F.unhex(F.md5(F.concat_ws("\x00", piece(F.col(id_name).cast("string")), piece(F.col(text_name))).cast("binary")))


def sample_by_hash(texts: DataFrame, n: int) -> list[str]:
    """At most ``n`` different texts of a one-column frame, those of least hash: the hashes are gathered first, then just these texts."""
    (name,) = texts.columns
    rows = texts.filter(F.col(name).isNotNull()).select(F.col(name).alias("t"), F.xxhash64(name).alias("h"))
    least = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(n).collect()]  # eight bytes each
    if not least:
        return []
    wanted = F.broadcast(texts.sparkSession.createDataFrame([(h,) for h in least], "h long"))
    found = rows.join(wanted, "h").groupBy("h").agg(F.first("t").alias("t")).collect()  # n rows at most
    return [r["t"] for r in sorted(found, key=lambda r: r["h"])]
