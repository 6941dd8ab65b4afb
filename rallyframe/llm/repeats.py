"""Substring dedup with a count-min prefilter.

Every window of ``width`` consecutive words has an anchor: its ``ANCHOR``-word run of least
hash, the leftmost of equals. Equal windows have equal anchors at equal distances, so the
count of an anchor's places is never below the count of the window. Neighbouring windows
mostly share one anchor, so a count-min sketch of anchors has about a fourteenth of the
entries that one of windows would have. Counters stop at two. Each task sketches its own
rows; the partial sketches are merged slice by slice. A window can only be repeated if the
cells of its anchor are, in all rows of the sketch. A second pass hashes just those windows
to 96 bits and groups them exactly: nothing repeated is lost and nothing unique stays.
Windows repeated inside one chunk of a task are settled there, and a chunk sends each of
its windows once, so a passage that fills a third of all documents costs one entry for
each chunk. Windows of one anchor go to one bucket and come back as one row. Marks go back to their rows by a row key and the covered words are cut.

The sketch grows with the text up to ``max_cells`` bits (32 MB), the proven bound of the
broadcast; beyond that it filters less and the exact pass does more, with equal results.

Null or empty texts have no words. Rows equal in id and text are separate occurrences, so
their windows count as repeated. Documents shorter than a window lose nothing. Null ids are
kept. Only the named columns matter for marking; ``cut_repeats`` keeps all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.shared import row_key
from rallyframe.llm.text import U, Words, blocks, grams, mix

WIDTH = 35
MAX_CELLS = 1 << 28
SLICE_BITS = 17
ROWS = 2  #: of the sketch
ANCHOR = 8
PLACE_BITS = 31  #: a text of at most 2 GB has fewer words
CHUNK_WINDOWS = 1 << 20


def cells_for(n_bytes: int, max_cells: int = MAX_CELLS) -> int:
    """Bits of the sketch for a text of so many bytes: about two for each byte, a power of two."""
    return int(min(max_cells, max(1 << 20, 1 << (max(1, 2 * n_bytes) - 1).bit_length())))


def buckets_for(n_bytes: int) -> int:
    """Groups of the exact pass: one for each 4 MB of text, at least 64."""
    return int(min(1 << 20, max(64, n_bytes >> 22)))


def window_hashes(words: Words, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    return grams(words.hashes(seed=seed), words.first, width, salt=width)


def anchors(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start words of all windows; hashes of the distinct anchors; which of these each window has."""
    h = words.hashes(seed=3)
    k = min(ANCHOR, width)
    m = len(h) - k + 1
    none = np.zeros(0, np.int64)
    _, at = grams(h, words.first, width)
    if not len(at):
        return none, np.zeros(0, U), none
    g = h[:m].copy()
    for j in range(1, k):
        g = g * U(0x9E3779B97F4A7C15) + h[j : j + m]
    g = mix(g)
    low = (g >> U(PLACE_BITS) << U(PLACE_BITS)) | np.arange(m, dtype=U)
    reach, span = 1, width - k + 1
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    place = (low[at] & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = np.r_[True, place[1:] != place[:-1]]
    return at, g[place[new]], np.cumsum(new) - 1


def cells_of(h: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of the sketch; rows share the bits evenly."""
    half = cells // ROWS
    return [(h & U(half - 1)) + U(0), (h >> U(32) & U(half - 1)) + U(half)]


def gaps(sorted_: np.ndarray) -> bytes:
    """Sorted distinct numbers as gaps, a byte each; 255 stands for a gap still open."""
    g = np.diff(sorted_.astype(np.int64), prepend=-1) - 1
    more = g // 255
    out = np.full(len(g) + more.sum(), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = g % 255
    return out.tobytes()


def from_gaps(data: np.ndarray) -> np.ndarray:
    ends = data != 255
    return (np.cumsum(data.astype(np.int64) + ends)[ends]) - 1


def sketch(docs: DataFrame, width: int, cells: int) -> np.ndarray:
    """Bit map of the cells that hold two windows or more, merged from the sketches of all tasks."""
    spare = U((1 << SLICE_BITS) - 1)

    def partial(batches):
        once, twice, room = [], [], 0

        def folded():
            all_, n = np.unique(np.concatenate(once), return_counts=True) if once else (np.zeros(0, U), np.zeros(0, int))
            more = np.unique(np.concatenate([*twice, all_[n > 1]])) if twice or len(all_) else np.zeros(0, U)
            return all_, more

        for b in batches:
            for _, _, words in blocks(b["t"]):
                for c in cells_of(anchors(words, width)[1], cells):
                    once.append(c)
                    room += len(c)
                if room > 1 << 23:
                    one, more = folded()
                    once, twice, room = [one], [more], 0
        one, more = folded()
        for cut, flag in ((one, 0), (more, 1)):
            ids = cut >> U(SLICE_BITS)
            at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, int)
            if len(at):
                parts = np.split(cut & spare, at[1:])
                yield pa.record_batch([pa.array(ids[at].astype(np.int64)), pa.array([flag] * len(at), pa.int8()), pa.array([gaps(x) for x in parts], pa.binary())], names=["slice", "more", "cells"])

    def merge(table: pa.Table) -> pa.Table:
        n = np.zeros(1 << SLICE_BITS, np.uint8)
        for more, cut in zip(table["more"].to_pylist(), table["cells"], strict=True):
            at = from_gaps(np.frombuffer(cut.as_buffer(), np.uint8))
            n[at] = 2 if more else np.minimum(n[at] + 1, 2)
        return pa.table({"slice": table["slice"][:1], "bits": pa.array([np.packbits(n > 1).tobytes()], pa.binary())})

    parts = docs.select(F.col("_t").alias("t")).mapInArrow(partial, "slice long, more tinyint, cells binary")
    merged = parts.groupBy("slice").applyInArrow(merge, "slice long, bits binary")
    bits = np.zeros((-(-cells >> SLICE_BITS), 1 << (SLICE_BITS - 3)), np.uint8)
    for r in merged.toLocalIterator():
        bits[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(-1)


def repeated_starts(docs: DataFrame, width: int, bits: np.ndarray, cells: int, buckets: int) -> DataFrame:
    """(key, starts): the packed start words of repeated windows, in one row or several for each key."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def split_by(x: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.diff(x)) + 1

    def packed(keys, owner, at):
        """Key bytes and start lists of windows, by owner."""
        order = np.lexsort((at, owner))
        owner, at = owner[order], at[order]
        cuts = split_by(owner)
        firsts = owner[np.r_[0, cuts]]
        return [keys[i] for i in firsts], [x.astype("<i4").tobytes() for x in np.split(at, cuts)]

    def send(held):
        """Rows for the buckets: ``h`` holds hashes of windows (``n`` of them with their places); settled windows have no hash."""
        keys, owner, at, anchor, h1, h2 = held[0], *(np.concatenate(x) for x in held[1:])
        order = np.lexsort((h2, h1))
        owner, at, anchor, h1, h2 = owner[order], at[order], anchor[order], h1[order], h2[order]
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        rows = {"bucket": [], "h": [], "n": [], "key": [], "starts": []}
        if many.any():
            k, lists = packed(keys, owner[many], at[many])
            rows["bucket"] += [i % buckets for i in range(len(k))]
            rows["h"] += [b""] * len(k)
            rows["n"] += [-1] * len(k)
            rows["key"] += k
            rows["starts"] += lists
        first = np.flatnonzero(new)
        bucket = (anchor[first] >> U(32)) * U(buckets) >> U(32)  # equal windows have equal anchors
        order = np.lexsort((at[first], owner[first], many[first], bucket))
        first, bucket = first[order], bucket[order]
        for f in np.split(first, split_by(bucket)):
            one = f[~many[f]]  # seen once in this chunk, these come first: only they have a place to give back
            used, short = np.unique(owner[one], return_inverse=True)
            rows["bucket"].append(int((anchor[f[0]] >> U(32)) * U(buckets) >> U(32)))
            rows["h"].append(h1[f].tobytes() + h2[f].astype("<u4").tobytes())
            rows["n"].append(len(one))
            rows["key"].append(b"".join(keys[u] for u in used))
            rows["starts"].append(np.diff(short, prepend=0).astype("<u2").tobytes() + at[one].astype("<i4").tobytes())
        types = (pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))

    def candidates(batches):
        hot = shared.value
        held, room = [[], [], [], [], [], []], 0
        for b in batches:
            for a, _, words in blocks(b["t"]):
                at, g, which = anchors(words, width)
                ok = np.ones(len(g), bool)
                for c in cells_of(g, cells):
                    ok &= (hot[c >> U(3)] >> (U(7) - (c & U(7))).astype(np.uint8) & 1).astype(bool)
                if not ok.any():
                    continue
                ok, anchor = ok[which], g[which]
                at, anchor = at[ok], anchor[ok]
                h1, h2 = (window_hashes(words, width, seed)[0][ok] for seed in (1, 2))
                own = np.searchsorted(words.first, at, "right") - 1
                used, short = np.unique(own, return_inverse=True)
                base = len(held[0])
                held[0] += [b["k"][int(a + u)].as_py() for u in used]
                for to, x in zip(held[1:], (short + base, at - words.first[own], anchor, h1, h2 & U(0xFFFFFFFF)), strict=True):
                    to.append(x)
                room += len(at)
                if room >= CHUNK_WINDOWS or len(held[0]) > 60_000:
                    yield send(held)
                    held, room = [[], [], [], [], [], []], 0
        if room:
            yield send(held)

    def settle(table: pa.Table) -> pa.Table:
        """Starts of settled windows, and of a bucket's windows that two chunks or more have sent."""
        h1, h2, owner, at, keys, lists, all_keys = [], [], [], [], [], [], []
        for x, n, k, s in zip(table["h"], table["n"].to_pylist(), table["key"].to_pylist(), table["starts"], strict=True):
            if n < 0:
                keys.append(k)
                lists.append(s.as_py())
                continue
            x, s = x.as_buffer(), np.frombuffer(s.as_buffer(), np.uint8)
            m = x.size // 12
            h1.append(np.frombuffer(x, U, m))
            h2.append(np.frombuffer(x, "<u4", m, m * 8))
            owner += [np.cumsum(s[: 2 * n].view("<u2").astype(np.int64)) + len(all_keys), np.full(m - n, -1)]
            at += [s[2 * n :].view("<i4").astype(np.int64), np.zeros(m - n, np.int64)]
            all_keys += [k[i : i + 16] for i in range(0, len(k), 16)]
        if h1:
            h1, h2, owner, at = (np.concatenate(v) for v in (h1, h2, owner, at))
            order = np.lexsort((h2, h1))
            h1, h2, owner, at = h1[order], h2[order], owner[order], at[order]
            group = np.cumsum(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) - 1
            out = (np.bincount(group)[group] > 1) & (owner >= 0)
            if out.any():
                k, l = packed(all_keys, owner[out], at[out])
                keys += k
                lists += l
        return pa.table({"key": pa.array(keys, pa.binary()), "starts": pa.array(lists, pa.binary())})

    sent = docs.select(F.col("_k").alias("k"), F.col("_t").alias("t")).mapInArrow(candidates, "bucket int, h binary, n int, key binary, starts binary")
    return sent.groupBy("bucket").applyInArrow(settle, "key binary, starts binary")


def marked(docs: DataFrame, width: int = WIDTH, max_cells: int = MAX_CELLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``_starts``: an array of packed start words of its repeated windows, or null."""
    rows = docs.select(row_key(id_col, text_col).alias("_k"), F.col(text_col).alias("_t"))
    n_bytes = rows.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    cells = cells_for(n_bytes, max_cells)
    starts = repeated_starts(rows, width, sketch(rows, width, cells), cells, buckets_for(n_bytes))
    per_key = starts.groupBy("key").agg(F.collect_set("starts").alias("_starts"))  # rows equal in id and text have one key and send the same lists
    return docs.withColumn("_k", row_key(id_col, text_col)).join(per_key, F.col("_k") == F.col("key"), "left").drop("_k", "key")


def covered(starts: list[bytes] | None, n_words: int, width: int) -> np.ndarray:
    mark = np.zeros(n_words + 1, np.int64)
    for s in starts or ():
        at = np.unique(np.frombuffer(s, "<i4"))
        np.add.at(mark, at, 1)
        np.add.at(mark, np.minimum(at + width, n_words), -1)
    return np.cumsum(mark)[:n_words] > 0


def digests(docs: DataFrame, width: int = WIDTH, max_cells: int = MAX_CELLS) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words, for every row."""

    def run(batches):
        for b in batches:
            out = {"n_words": [], "n_removed": [], "kept_sha256": []}
            starts = b["s"]
            for a, _, words in blocks(b["t"]):
                for d in range(len(words.first) - 1):
                    lo, hi = words.first[d], words.first[d + 1]
                    cut = covered(starts[a + d].as_py(), hi - lo, width)
                    out["n_words"].append(hi - lo)
                    out["n_removed"].append(int(cut.sum()))
                    out["kept_sha256"].append(hashlib.sha256(joined(words, lo + np.flatnonzero(~cut))).hexdigest())
            yield pa.record_batch([b["i"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string())], names=["doc_id", *out])

    rows = marked(docs.select("doc_id", "text"), width, max_cells).select(F.col("doc_id").alias("i"), F.col("text").alias("t"), F.col("_starts").alias("s"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['i']}, n_words long, n_removed long, kept_sha256 string")


def joined(words: Words, at: np.ndarray) -> bytes:
    """The words with these indices, one space between."""
    if not len(at):
        return b""
    lens = words.ends[at] - words.starts[at] + 1
    ends = np.cumsum(lens)
    source = np.arange(ends[-1]) + np.repeat(words.starts[at] - (ends - lens), lens)
    source[ends - 1] = 0
    out = words.data[source]
    out[ends - 1] = 0x20
    return out[:-1].tobytes()


def cut_repeats(docs: DataFrame, width: int = WIDTH, max_cells: int = MAX_CELLS) -> DataFrame:
    """``docs`` without the words that repeated windows cover, all columns kept and ``n_chars`` counted anew.

    Texts that lose nothing stay as they are, white space included; the others keep the
    bytes of each run of kept words. A text that loses all its words becomes empty.
    """

    def run(batches):
        for b in batches:
            texts = []
            for a, _, words in blocks(b["text"]):
                for d in range(len(words.first) - 1):
                    starts = b["_starts"][a + d].as_py()
                    if not starts:
                        texts.append(b["text"][a + d].as_py())
                        continue
                    lo, hi = words.first[d], words.first[d + 1]
                    keep = ~covered(starts, hi - lo, width)
                    edge = np.flatnonzero(np.diff(np.r_[False, keep, False]))
                    runs = [words.data[words.starts[lo + s] : words.ends[lo + e - 1]].tobytes() for s, e in edge.reshape(-1, 2)]
                    texts.append(b" ".join(runs).decode("utf-8", "replace"))
            cols = [pa.array(texts, pa.string()) if c == "text" else b[c] for c in b.schema.names if c != "_starts"]
            yield pa.record_batch(cols, names=[c for c in b.schema.names if c != "_starts"])

    names = docs.columns
    safe = [f"_c{i}" if c != "text" else c for i, c in enumerate(names)]
    rows = marked(docs.withColumn("_id", F.col("doc_id")).toDF(*safe, "_id"), width, max_cells, id_col="_id").drop("_id")
    schema = rows.drop("_starts").schema
    out = rows.mapInArrow(run, schema).toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
