"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits in lower case A-Z. Runs of ``min_match`` tokens of
the benchmark items are seeds; a document and an item that share seeds are tiled: from the
places where runs of seeds start, found by their Karp-Rabin hashes, tokens are compared one by one,
and the longest common run of free tokens is marked, again and again until none of ``min_match``
tokens is left. Only the starts of runs are kept, so repetitive texts take memory by their length. Marked runs never overlap in either text and may come in any order, so
reordered passages count. A pair is reported if its tiles cover ``percent`` of the item.

The benchmark goes out in blocks of at most about ``BLOCK_BYTES`` (the size of each
broadcast); documents are not shuffled. Items with fewer tokens than ``min_match`` are
matched as a whole. Null or empty items and texts match nothing. Rows that share an id are
rows of their own. Empty tables give an empty result. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.text import NOT_ALNUM, U, blocks, grams

BLOCK_BYTES = 16 << 20


def run_length(doc: np.ndarray, item: np.ndarray, d: int, i: int) -> int:
    m, n = min(len(doc) - d, len(item) - i), 0
    while n < m:  # in growing steps, so a short run costs little
        step = min(m, 2 * n + 16)
        other = np.flatnonzero(doc[d + n : d + step] != item[i + n : i + step])
        if len(other):
            return n + int(other[0])
        n = step
    return m


def tile(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, length), longest first; seeds hold the start of each longest common run of ``least`` tokens or more.

    Runs are kept as stretches of diagonals; a tile cuts what it covers out of the others.
    """
    at = np.array(seeds, np.int64).reshape(-1, 2)
    d, i = at[:, 0], at[:, 1]
    n = np.array([run_length(doc, item, *x) for x in at.tolist()], np.int64)
    tiles = []
    while True:
        ok = n >= least
        d, i, n = d[ok], i[ok], n[ok]
        if not len(n):
            return tiles
        k = np.lexsort((i, d, -n))[0]
        x, y, size = int(d[k]), int(i[k]), int(n[k])
        tiles.append((x, y, size))
        for side, lo in ((0, x), (1, y)):  # cut [lo, lo + size) out on the document's side, then on the item's
            start = (d, i)[side]
            left, skip = np.clip(lo - start, 0, n), np.clip(lo + size - start, 0, n)
            d, i, n = np.r_[d, d + skip], np.r_[i, i + skip], np.r_[left, n - skip]
            ok = n >= least
            d, i, n = d[ok], i[ok], n[ok]


PAIRS_AT_ONCE = 1 << 20


class Items:
    """A block of benchmark items with the table of their seeds."""

    def __init__(self, texts: list[str | None], min_match: int):
        self.tokens: list[np.ndarray] = []
        for _, _, words in blocks(pa.array(texts, pa.string()), NOT_ALNUM):
            h = words.hashes(seed=7, lower=True)
            self.tokens += np.split(h, words.first[1:-1])
        by_length: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, t in enumerate(self.tokens):
            if n := min(min_match, len(t)):
                g, at = grams(t, np.array([0, len(t)]), n)
                by_length.setdefault(n, []).append((g, np.full(len(g), k), at, np.r_[U(0), g[:-1]]))
        self.seeds = {}  #: by length: sorted hashes, item, place and hash of the place before (0 at the first)
        for n, parts in by_length.items():
            g, k, q, before = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(g, kind="stable")
            self.seeds[n] = g[order], k[order], q[order], before[order]

    def shared(self, h: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(document, item) -> places (in document, in item) where shared runs of seeds start."""
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for n, (keys, item, place, before) in self.seeds.items():
            g, at = grams(h, first, n)
            own = np.searchsorted(first, at, "right") - 1
            lo, hi = np.searchsorted(keys, g), np.searchsorted(keys, g, "right")
            hit = np.flatnonzero(hi > lo)
            last = np.where(at[hit] > first[own[hit]], g[np.maximum(hit - 1, 0)], U(0))  # the seed one place before, in the same document
            size = (hi - lo)[hit]
            cuts, total = [0], np.cumsum(size)
            while cuts[-1] < len(hit):  # a bounded number of pairs at once
                base = total[cuts[-1] - 1] if cuts[-1] else 0
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, base + PAIRS_AT_ONCE, "right"))))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                m = size[a:z]
                entry = np.repeat(lo[hit[a:z]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                begins = (before[entry] != np.repeat(last[a:z], m)) | (before[entry] == 0)
                entry, src = entry[begins], np.repeat(hit[a:z], m)[begins]
                d = own[src]
                for x, k, p, q in zip(d.tolist(), item[entry].tolist(), (at[src] - first[d]).tolist(), place[entry].tolist(), strict=True):
                    out.setdefault((x, k), []).append((p, q))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, n_tiles) of each document and item with enough coverage."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").alias("i"), F.col("text").alias("t"))
    n_bytes = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = -(-n_bytes // BLOCK_BYTES) or 1
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    id_type, item_type = rows.schema["d"].dataType.simpleString(), items.schema["i"].dataType.simpleString()
    found = None
    for b in range(n_blocks):
        mine = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b).orderBy("i", "t").collect()
        block = spark.sparkContext.broadcast(([r["i"] for r in mine], Items([r["t"] for r in mine], min_match)))

        def run(batches, block=block):
            names, table = block.value
            for batch in batches:
                doc, item, size, cover, tiles = [], [], [], [], []
                for a, _, words in blocks(batch["t"], NOT_ALNUM):
                    h = words.hashes(seed=7, lower=True)
                    for (d, k), seeds in table.shared(h, words.first).items():
                        tokens = table.tokens[k]
                        got = tile(h[words.first[d] : words.first[d + 1]], tokens, seeds, min(min_match, len(tokens)))
                        covered = sum(n for _, _, n in got)
                        if 100 * covered >= percent * len(tokens):
                            doc.append(a + d)
                            item.append(names[k])
                            size.append(len(tokens))
                            cover.append(covered)
                            tiles.append(len(got))
                ids = batch["d"].take(pa.array(doc, pa.int64()))
                yield pa.record_batch([ids, pa.array(item, batch_type), pa.array(size, pa.int64()), pa.array(cover, pa.int64()), pa.array(tiles, pa.int64())], names=["doc_id", "item_id", "item_words", "covered_words", "n_tiles"])

        batch_type = pa.int64() if item_type == "bigint" else pa.int32() if item_type == "int" else pa.string()
        part = rows.mapInArrow(run, f"doc_id {id_type}, item_id {item_type}, item_words long, covered_words long, n_tiles long")
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, without the rows whose text contains an item. Rows are told apart by id and text."""
    from rallyframe.llm.shared import row_key

    names = [f"_c{i}" for i in range(len(docs.columns))]
    safe = docs.select(*[F.col(c).alias(x) for c, x in zip(docs.columns, names, strict=True)], row_key("doc_id", "text").alias("_k"))
    keyed = docs.select(row_key("doc_id", "text").alias("k"), "text")
    bad = contaminated(keyed, benchmark, min_match, percent, id_col="k").select(F.col("doc_id").alias("_bad")).distinct()
    return safe.join(bad, F.col("_k") == F.col("_bad"), "left_anti").select(*names).toDF(*docs.columns)
