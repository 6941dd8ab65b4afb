"""Exact top-k search by distributed histogram selection.

Queries come in blocks of bounded size; each block is held against all candidates. Every
task scores its candidates against the block with one matrix product and counts scores
in ``BINS`` equal bins of a range that is still open for each query. The merged
histograms tell which bin holds the k-th score; the range shrinks to that bin until it is
one score wide. A last pass keeps what is above the k-th score and, among equals, the
``k`` least ids of each task; a final ranking breaks ties by id. Nothing is approximate
and no score list is gathered whole.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows
with a null id, nor vectors so long (square norm of the scaled vector 2^62 or more) that a score could pass 64 bits. A query is held against the vectors of its own length only.
Repeated ids: a query is searched once (its least vector), each candidate row counts, and
a query's own rows are all left out. Fewer than k candidates: all of them. Empty tables
give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.shared import fresh_path, stored

BINS = 256
BLOCK = 4096
EXACT, LARGEST = 1 << 53, 1 << 62


def whole_vectors(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): components as floor(scale * x), of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fit = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * F.lit(float(scale)) + 1, F.lit(2.0)))
    fit &= F.coalesce(norm < float(LARGEST), F.lit(False))
    return vectors.filter(fit).select(F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))


def matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of this width as int64, and which rows those are."""
    lens = np.asarray(column.value_lengths().fill_null(-1))
    ok = np.flatnonzero(lens == width)
    flat = column.take(pa.array(ok)).flatten()
    return np.asarray(flat, np.int64).reshape(len(ok), width), ok


def scores(candidates: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products, candidates by queries; through doubles where those are exact."""
    top = float(np.abs(candidates).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, candidates.shape[1])
    if top < EXACT:
        return (candidates.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)
    return candidates @ queries.T


def search_block(candidates: DataFrame, ids: np.ndarray, vectors: np.ndarray, bound: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for one block of queries against all candidates."""
    spark, width, n = candidates.sparkSession, vectors.shape[1], len(ids)
    block = spark.sparkContext.broadcast((ids, vectors))

    def scored(batches):
        ids_, q = block.value
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                m, ok = matrix(part["v"], width)
                if len(ok):
                    own = np.asarray(part["id"], np.int64)[ok]
                    yield own, scores(m, q), own[:, None] != ids_[None, :]

    low, high = np.full(n, -bound, np.int64), np.full(n, bound + 1, np.int64)
    step = np.full(n, -(-(2 * bound + 1) // BINS), np.int64)
    above = np.zeros(n, np.int64)  #: candidates over the open range
    open_ = np.ones(n, bool)
    while open_.any():
        state = spark.sparkContext.broadcast((low, high, step))

        def count(batches):
            lo, hi, st = state.value
            total = np.zeros((n, BINS), np.int64)
            for _, s, other in scored(batches):
                cell = (s - lo) // st
                at = other & (s >= lo) & (s < hi)
                total += np.bincount((np.arange(n) * BINS + cell)[at], minlength=n * BINS).reshape(n, BINS)
            full = np.flatnonzero(total.any(1))
            yield pa.record_batch([pa.array(full, pa.int64()), pa.array([total[i].tobytes() for i in full], pa.binary())], names=["q", "bins"])

        def merge(table: pa.Table) -> pa.Table:
            return pa.table({"q": table["q"][:1], "bins": pa.array([sum(np.frombuffer(x.as_buffer(), np.int64) for x in table["bins"]).tobytes()], pa.binary())})

        hist = np.zeros((n, BINS), np.int64)
        for r in candidates.mapInArrow(count, "q long, bins binary").groupBy("q").applyInArrow(merge, "q long, bins binary").toLocalIterator():
            hist[r["q"]] = np.frombuffer(r["bins"], np.int64)
        least = above[:, None] + hist[:, ::-1].cumsum(1)  # with score in this bin or above, from the top bin down
        reached = least >= k
        down = np.where(reached.any(1), reached.argmax(1), BINS - 1)
        bin_ = BINS - 1 - down
        above = np.where(open_, np.where(down > 0, np.take_along_axis(least, np.maximum(down - 1, 0)[:, None], 1)[:, 0], above), above)
        low = np.where(open_, low + bin_ * step, low)
        high = np.where(open_, np.minimum(high, low + step), high)
        open_ &= step > 1
        step = np.where(open_, -(-step // BINS), 1)
    kth = spark.sparkContext.broadcast(low)

    def keep(batches):
        """Of each task: all above the k-th score, and of those equal to it the k least ids."""
        cut = kth.value
        q, v, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for own, sc, other in scored(batches):
            c, j = np.nonzero(other & (sc >= cut))
            q, v, s = np.r_[q, j], np.r_[v, own[c]], np.r_[s, sc[c, j]]
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
            place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
            q, v, s = q[place < k], v[place < k], s[place < k]
        yield pa.record_batch([pa.array(block.value[0][q], pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(keep, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 20, query_mod: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k best candidates: query_id, rank from 1, vec_id, score. Queries: ids divisible by ``query_mod``."""
    from pyspark.sql import Window

    all_ = stored(whole_vectors(vectors, scale, id_col, vec_col), "vectors")
    queries = all_.filter(F.col("id") % query_mod == 0).groupBy("id").agg(F.min("v").alias("v"))
    size = all_.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("norm"), F.count(F.when(F.col("id") % query_mod == 0, 1)).alias("n")).first()
    blocks = -(-size["n"] // BLOCK) if size["n"] else 0
    bound = int(size["norm"] or 0) + 1  # no inner product exceeds the largest square norm
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    schema = "query_id long, rank int, vec_id long, score long"
    path = fresh_path(vectors.sparkSession, "top")  # each block's result is stored, so the plan doesn't grow with the blocks
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        for width in sorted({len(r["v"]) for r in rows}):
            mine = [r for r in rows if len(r["v"]) == width]
            kept = search_block(all_, np.array([r["id"] for r in mine], np.int64), np.array([r["v"] for r in mine], np.int64).reshape(len(mine), width), bound, k)
            ranked = kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    if not blocks:
        return all_.filter("false").select(F.col("id").cast("long").alias("query_id"), F.lit(1).alias("rank"), F.col("id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    return vectors.sparkSession.read.schema(schema).parquet(path)
