"""Phrases of words that occur together, mined from a depth-truncated suffix tree built in parts.

All counts are exact and by language. The corpus is read once into blocks of about ``BLOCK_BYTES`` of one
language: each piece of text as numbers of a word list of the block. Words counted under ``least`` end a
phrase, so only the others get an id. Each place in a block starts a suffix of at most ``depth`` words, cut at
the end of its piece or before a rare word; equal suffixes of a block are one row with a count.

The tree is partitioned by prefix. A suffix goes by its first word, or, where that word has more than ``HEAVY``
occurrences, by its first two, and so on to the first prefix that the totals of its words bound by ``HEAVY``. Prefixes
are grouped by hash into as many groups as keep a group near ``BUDGET`` suffixes. Each group builds its part alone: the
sorted suffixes are the leaves, what neighbours share gives the inner nodes, and a node's count is the total
of its leaves. Nodes above the prefix depth go to groups by their own words, as one leaf of each block, so each node is whole in one group.

Null texts are empty, null languages ``und``. Repeated rows count each. Empty tables give empty results.
Only the named columns are read. A block's size bounds a task's memory; a longer text is a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.llm.shared import discard, stored, stored_in_buckets, stored_small
from rallyframe.llm.text import U, find_words, mix, raw, strings

BLOCK_BYTES, BUDGET, HEAVY = 4 << 20, 250_000, 60_000
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
SEPARATOR = BREAK.copy()
SEPARATOR[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def packed(*arrays: np.ndarray) -> bytes:
    return pa.Codec("zstd", 6).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), asbytes=True)


def unpacked(data, size: int) -> bytes:
    return pa.decompress(data, size, codec="zstd", asbytes=True)


def planes(x: np.ndarray) -> np.ndarray:
    """The first bytes of all numbers, then the second ones, and so on: the upper bytes of small numbers pack well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T


def packed_leaves(cols: np.ndarray, count: np.ndarray, above: np.ndarray) -> tuple[bytes, int]:
    """Leaves (ids, counts, words above the prefix depth) in order, each by the words that it doesn't share with the one before; the size unpacked."""
    order, _ = leaf_order(cols)
    cols, count, above = cols[:, order], count[order].astype("<i8"), above[order].astype(np.uint8)
    shared, length = neighbours(cols).astype(np.uint8), (cols >= 0).sum(0).astype(np.uint8)
    parts = [shared, length, above, planes(count), *(planes(c[(shared <= j) & (length > j)]) for j, c in enumerate(cols))]
    return packed(*parts), sum(x.nbytes for x in parts)


def unpacked_leaves(data, m: int, size: int, depth: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(unpacked(data, size), np.uint8)
    shared, length, above = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
    numbers = lambda at, n, kind: x[at : at + n * int(kind[-1])].reshape(int(kind[-1]), n).T.copy().view(kind).reshape(-1)
    cols, at = np.full((depth, m), -1, kind), 11 * m
    for j in range(depth):
        own = shared <= j
        new = np.flatnonzero(own & (length > j))
        cols[j, new] = numbers(at, len(new), kind)
        cols[j] = cols[j, np.maximum.accumulate(np.where(own, np.arange(m), 0))]
        at += len(new) * int(kind[-1])
    return cols, numbers(3 * m, m, "<i8"), above


def block_of(texts: list[pa.Array]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (commonest first), their counts, and all pieces as numbers of words with -1 after each piece."""
    data, off = raw(pa.concat_arrays(texts))
    data = LOWER[data]
    w = find_words(data, off, SEPARATOR)
    if not len(w.starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int32)
    one, two = w.hashes(seed=41), w.hashes(seed=43)
    order = np.lexsort((two, one))
    new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
    first, count = order[new], np.diff(np.r_[np.flatnonzero(new), len(order)])
    place = np.empty(len(first), np.int64)
    rank = np.argsort(-count, kind="stable")
    place[rank] = np.arange(len(rank))
    seq = np.empty(len(order), np.int32)
    seq[order] = place[np.cumsum(new) - 1]
    first, count = first[rank], count[rank]
    size = w.ends[first] - w.starts[first]
    ends = np.cumsum(size)
    chars = data[np.arange(ends[-1]) + np.repeat(w.starts[first] - (ends - size), size)]
    words = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(chars)])
    breaks = np.flatnonzero(BREAK[data])
    apart = np.r_[np.searchsorted(breaks, w.starts[1:]) > np.searchsorted(breaks, w.ends[:-1]), True]
    apart[w.first[1:][np.diff(w.first) > 0] - 1] = True  # a text ends a piece
    return words.cast(pa.string()), count, np.insert(seq, np.flatnonzero(apart) + 1, -1).astype(np.int32)


def blocks(docs: DataFrame) -> DataFrame:
    """(block, lang, words, n, total, seq, size) of rows (lang, t), stored in buckets of blocks."""

    def run(batches):
        at, held, weight = TaskContext.get().partitionId() << 32, {}, {}

        def out(lang):
            nonlocal at
            words, count, seq = block_of(held.pop(lang))
            weight.pop(lang)
            at += 1
            lists = [pa.ListArray.from_arrays(pa.array(np.array([0, len(words)], np.int32)), x) for x in (words, pa.array(count.astype(np.int64)))]
            numbers = pa.array([int(count.sum())]), pa.array([packed(seq.view(np.uint8).reshape(-1, 4).T)], pa.binary()), pa.array([len(seq)], pa.int64())
            return pa.record_batch([pa.array([at - 1]), pa.array([lang], pa.string()), *lists, *numbers], names=["block", "lang", "words", "n", "total", "seq", "size"])

        for b in batches:
            coded = b["lang"].dictionary_encode()
            number = coded.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(coded.dictionary.to_pylist()):
                own = strings(b["t"].take(pa.array(np.flatnonzero(number == k))))
                n = own.nbytes
                if weight.get(lang, 0) and weight[lang] + n > BLOCK_BYTES:
                    yield out(lang)
                held.setdefault(lang, []).append(own)
                weight[lang] = weight.get(lang, 0) + n
        for lang in list(held):
            yield out(lang)

    return stored_in_buckets(docs.mapInArrow(run, "block long, lang string, words array<string>, n array<long>, total long, seq binary, size long"), "blocks", "block")


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with an ``id`` from 0 on, commonest first (small numbers pack well), stored."""
    counted = stored_small(words, "counted")
    marked = stored(counted.orderBy(F.col("f").desc(), "lang", "word").withColumn("m", F.monotonically_increasing_id()), "words")
    discard(counted)
    part = F.shiftright("m", 33)
    parts = marked.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))  # a row for each partition
    base = parts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("base"))
    return marked.withColumn("part", part).join(F.broadcast(base), "part").select("lang", "word", "f", (F.col("base") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))


def suffixes(seq: np.ndarray, ids: np.ndarray, totals: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of a block: (depth, m) ids with -1 after the last, their counts, and how many words of each are above its prefix depth.

    A suffix of two words or more counts for nodes deeper than its leading words without a bound under ``HEAVY``; for each of the
    shallower ones there is a leaf that ends there, with the total of the block.
    """
    kind = np.int32 if ids.max(initial=-1) < 1 << 31 else np.int64
    g = np.where(seq >= 0, ids[seq], -1).astype(kind)
    cols = np.full((depth, len(g)), -1, kind)
    cols[0] = g
    for j in range(1, depth):
        cols[j, : len(g) - j] = np.where(cols[j - 1, : len(g) - j] >= 0, g[j:], -1)
    cols = cols[:, (cols[0] >= 0) & (cols[1] >= 0)]
    order, new = leaf_order(cols)
    cols = cols[:, order[new]]
    count = np.diff(np.r_[np.flatnonzero(new), len(order)]).astype(np.int64)
    known = np.argsort(ids, kind="stable")
    sorted_ids = ids[known]
    above, over = np.zeros(cols.shape[1], np.uint8), np.ones(cols.shape[1], bool)
    for j in range(depth):
        over &= cols[j] >= 0
        at = np.flatnonzero(over)
        over[at] = totals[known[np.searchsorted(sorted_ids, cols[j, at])]] > HEAVY
        above += over
    shared = neighbours(cols)
    made = [(cols, count, above)]
    for d in range(2, depth + 1):
        at = np.flatnonzero(above >= d)
        if len(at):
            starts = np.flatnonzero(shared[at] < d)  # all leaves of such a node are among these
            ends = np.full((depth, len(starts)), -1, kind)
            ends[:d] = cols[:d, at[starts]]
            made.append((ends, np.add.reduceat(count[at], starts), np.full(len(starts), d - 1, np.uint8)))
    inside = (cols >= 0).sum(0) > above
    made[0] = cols[:, inside], count[inside], above[inside]
    return tuple(np.concatenate(x, -1) for x in zip(*made, strict=True))


def neighbours(cols: np.ndarray) -> np.ndarray:
    """Leading words that each of some sorted leaves shares with the one before."""
    shared, same = np.zeros(cols.shape[1], np.int64), np.ones(max(cols.shape[1] - 1, 0), bool)
    for c in cols:
        same &= c[1:] == c[:-1]
        shared[1:] += same
    return shared


def leaf_order(cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order, a shorter one before those it starts, and whether each differs from the one before."""
    if not cols.shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort(cols[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in cols:  # a word at a time: less memory than all at once
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def prefix_group(cols: np.ndarray, above: np.ndarray, groups: int) -> np.ndarray:
    h = np.zeros(cols.shape[1], U)
    for j in range(len(cols)):
        inside = above >= j
        h[inside] = mix(h[inside] * U(0x9E3779B97F4A7C15) + cols[j][inside].astype(U) + U(1))
    return (h % U(groups)).astype(np.int64)


def tree_nodes(cols: np.ndarray, count: np.ndarray, above: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, count) of the nodes at each depth from 2 on that reach ``least``."""
    order, _ = leaf_order(cols)
    cols, count, above = cols[:, order], count[order], above[order]
    shared = neighbours(cols)
    out = []
    for d in range(2, len(cols) + 1):
        starts = np.flatnonzero(shared < d)
        total = np.add.reduceat(np.where((above < d) & (cols[d - 1] >= 0), count, 0), starts) if len(starts) else count
        keep = total >= least
        # A run of leaves shares d words, or its first leaf ends before them and is a run of its own.
        out.append((cols[:d, starts[keep]], total[keep]))
    return out


def phrase_counts(docs: DataFrame, least: int = 100, depth: int = 5, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n), all word occurrences; (lang, word, f, id) of words and (phrase, f) of phrases of 2 to ``depth`` words, as ids, that occur ``least`` times or more."""
    made = blocks(docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("t")))
    totals = made.groupBy("lang").agg(F.sum("total").alias("n"))
    rows = made.select("block", "lang", F.posexplode(F.arrays_zip("words", "n"))).select("block", "lang", F.col("pos").alias("k"), F.col("col.words").alias("word"), F.col("col.n").alias("n"))
    words = numbered(rows.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least))
    known, top = words.agg(F.coalesce(F.sum("f"), F.lit(0)), F.coalesce(F.max("id"), F.lit(0))).first()
    kind = "<i4" if top < 1 << 31 else "<i8"
    groups = max(-(-known // BUDGET), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks = rows.select("block", "lang", "k", "word").join(words, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("k", "id", "f")).alias("known"))  # bounded by a block

    def deal(batches):
        for b in batches:
            for seq, size, n_words, known in zip(b["seq"], b["size"].to_pylist(), b["n_words"].to_pylist(), b["known"], strict=True):
                flat = known.values
                k = flat.field("k").to_numpy(zero_copy_only=False)
                ids, f = np.full(n_words, -1, np.int64), np.zeros(n_words, np.int64)
                ids[k], f[k] = flat.field("id").to_numpy(zero_copy_only=False), flat.field("f").to_numpy(zero_copy_only=False)
                cols, count, above = suffixes(np.frombuffer(unpacked(seq.as_buffer(), 4 * size), np.uint8).reshape(4, -1).T.copy().view("<i4").reshape(-1), ids, f, depth)
                group = prefix_group(cols, above, groups)
                order = np.argsort(group, kind="stable")
                at = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if len(order) else np.zeros(0, np.int64)
                parts = [order[x:y] for x, y in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True)]
                made_ = [packed_leaves(cols[:, p].astype(kind), count[p], above[p]) for p in parts]
                sizes = [pa.array(x, pa.int64()) for x in ([len(p) for p in parts], [n for _, n in made_])]
                yield pa.record_batch([pa.array(group[order][at]), *sizes, pa.array([x for x, _ in made_], pa.binary())], names=["group", "m", "size", "data"])

    dealt = made.select("block", "seq", "size", F.size("words").alias("n_words")).join(marks, "block").drop("block").mapInArrow(deal, "group long, m long, size long, data binary")

    def grow(batches):
        group, held = None, []

        def out():
            cols, count, above = (np.concatenate(x, -1) for x in zip(*held, strict=True))
            for ids, total in tree_nodes(cols, count, above, least):
                phrases = pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, len(ids)).astype(np.int32)), pa.array(ids.T.reshape(-1).astype(np.int64)))
                yield pa.record_batch([phrases, pa.array(total)], names=["phrase", "f"])

        for b in batches:
            for g, m, size, data in zip(b["group"].to_pylist(), b["m"].to_pylist(), b["size"].to_pylist(), b["data"], strict=True):
                if g != group and held:
                    yield from out()
                    held = []
                group = g
                held.append(unpacked_leaves(data.as_buffer(), m, size, depth, kind))
        if held:
            yield from out()

    grown = dealt.repartition("group").sortWithinPartitions("group").mapInArrow(grow, "phrase array<long>, f long")
    phrases = stored_small(grown, "phrases")
    totals = stored(totals, "totals")
    words = stored(words, "words")
    discard(made)
    return totals, words, phrases


def collocations(docs: DataFrame, least: int = 100, depth: int = 5, percent: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by score, then a, then phrase.

    The score is floor(1000 * a * n / (l * r)) of the cut where it is lowest (the first of equal ones), in decimals of 38 digits.
    A phrase inside a longer one with at least ``percent`` percent of its count is left out: it is inside one a word longer, too.
    """
    totals, words, phrases = phrase_counts(docs, least, depth, lang_col, text_col)
    parts = phrases.unionByName(words.select(F.array("id").alias("phrase"), "f"))
    cuts = phrases.select("phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("slice(phrase, 1, k)").alias("left"), F.expr("slice(phrase, k + 1, size(phrase))").alias("right"))
    cuts = cuts.join(parts.toDF("left", "l"), "left").join(parts.toDF("right", "r"), "right")
    spelt = phrases.select("phrase", F.posexplode("phrase").alias("p", "id")).join(words.select("id", "lang", "word"), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "word"))), lambda x: x["word"]), " ")
    spelt = spelt.groupBy("phrase").agg(F.first("lang").alias("lang"), text.alias("text")).join(totals, "lang")
    big = lambda x: f"cast({x} as decimal(19, 0))"
    score = F.expr(f"({big('1000 * a')} * {big('n')}) div ({big('l')} * {big('r')})")
    cuts = cuts.join(spelt, "phrase").withColumn("score", score)
    best = cuts.groupBy("phrase", "lang", "text", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = phrases.filter(F.size("phrase") > 2).select(F.explode(F.array(F.expr("slice(phrase, 1, size(phrase) - 1)"), F.expr("slice(phrase, 2, size(phrase))"))).alias("phrase"), "f")
    longer = longer.groupBy("phrase").agg(F.max("f").alias("longer"))
    kept = best.join(longer, "phrase", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    w = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "text")
    ranked = kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
