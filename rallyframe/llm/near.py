"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, stars.

A document's set holds its distinct ``n``-word shingles (words in lower case A-Z); with
fewer words the whole sequence is the one shingle; without words it is empty and linked
with nothing. Documents of one set are one node (a digest group, never expanded to pairs).
Each node gets ``bands * rows`` bins from one hash of each shingle; an empty bin takes the
value of the first filled bin in its own fixed probe sequence (``PROBES`` draws, then an
order of all bins), so the choice never depends on the gaps between filled bins. Bands give bucket keys.

In each bucket candidate pairs form stars: a centre (first the node that shares most
buckets) against the other members, so pairs grow with members, not with their square.
One bucket in ``FIRST`` goes first, to connect most nodes with few pairs. Rounds go on, with up to ``LANES`` centres from outside its largest component, in buckets
whose members are still in different components, so no link in a bucket is left untested.
From then on a pair must share enough of its rarest shingles, an exact test; a pair already known to be connected is not tested. A link is confirmed on the
full sets: ``100 * intersection >= percent * union``. With 48 bands of 6 rows a pair at
similarity 0.8 meets in some bucket with probability 1 - 5e-7, above it more surely.

Rows that share an id are one document: the sets they have are linked. A row without words
is linked with nothing, whatever other rows of its id hold. Rows with a null id take part in
nothing: component null, kept. Superseded intermediate tables are deleted. Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.llm.shared import broadcast_if_small, discard, let_go, row_key, stored
from rallyframe.llm.text import U, Words, blocks, grams, mix

BANDS, ROWS, PROBES, LANES, SHARE, FILL, FIRST = 48, 6, 64, 256, 4, 4096, 8


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents one after the other, and their offsets."""
    h = words.hashes(seed=5, lower=True)
    g, at = grams(h, words.first, n)
    own = np.searchsorted(words.first, at, "right") - 1
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.zeros(len(short), U)
        for j in range(n - 1):
            has = counts[short] > j
            whole[has] = mix(whole[has] * U(0x9E3779B97F4A7C15) + h[words.first[short][has] + j] + U(1))
        g, own = np.concatenate([g, whole]), np.concatenate([own, short])
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    if len(g):
        new = np.r_[True, (g[1:] != g[:-1]) | (own[1:] != own[:-1])]
        g, own = g[new], own[new]
    return g, np.searchsorted(own, np.arange(len(counts) + 1))


@cache
def probes(bins: int) -> np.ndarray:
    x = mix(np.arange(1, bins * PROBES + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return (x % U(bins)).astype(np.int64).reshape(bins, PROBES)


@cache
def orders(bins: int) -> np.ndarray:
    """For each bin an order of all bins of its own."""
    x = mix(np.arange(1, bins * bins + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(77))
    return x.reshape(bins, bins).argsort(1)


def bins_of(g: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """The least hash in each bin, for each document; empty bins filled. Documents without shingles get zeros."""
    docs = len(first) - 1
    own = np.repeat(np.arange(docs), np.diff(first))
    cell = own * bins + ((g >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    lead = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    value, full = np.zeros(docs * bins, U), np.zeros(docs * bins, bool)
    value[cell[lead]], full[cell[lead]] = g[lead], True  # sorted sets: the first of a cell is its least
    value, full = value.reshape(docs, bins), full.reshape(docs, bins)
    d, i = np.nonzero(~full & full.any(1)[:, None])
    table = probes(bins)
    for t in range(PROBES):
        if not len(d):
            return value
        source = table[i, t]
        ok = full[d, source]
        value[d[ok], i[ok]] = value[d[ok], source[ok]]
        d, i = d[~ok], i[~ok]
    for k in range(0, len(d), FILL):  # few filled bins: on through the bin's own order of all bins, to the first filled one
        doc, mine = d[k : k + FILL], i[k : k + FILL]
        order = orders(bins)[mine]
        source = order[np.arange(len(doc)), np.take_along_axis(full[doc], order, 1).argmax(1)]
        value[doc, mine] = value[doc, source]
    return value


def band_keys(value: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(value), bands), U) + np.arange(1, bands + 1, dtype=U)
    for r in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + value[:, r * bands : (r + 1) * bands])
    return key.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(i, digest, size, keys) of each row (i, t), and its further columns; digest and keys are null for empty sets."""
    others = [c for c in docs.columns if c != "t"]
    types = dict(docs.dtypes)

    def run(batches):
        let_go()
        for b in batches:
            for a, z, words in blocks(b["t"]):
                g, first = shingle_sets(words, n)
                size = np.diff(first)
                keys = band_keys(bins_of(g, first, bands * rows), bands, rows)
                none = pa.array(size == 0)
                digest = [set_digest(g[first[d] : first[d + 1]]) if size[d] else None for d in range(z - a)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(z - a + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)), mask=none)
                yield pa.record_batch([*(b[c].slice(a, z - a) for c in others), pa.array(digest, pa.binary()), pa.array(size.astype(np.int64)), lists], names=[*others, "digest", "size", "keys"])

    return docs.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in others) + ", digest binary, size long, keys array<long>")


def set_digest(g: np.ndarray) -> bytes:
    return hashlib.md5(g.tobytes()).digest()


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(node, set) of rows (i, t), named by i, or of rows (t), named by the set's digest."""
    named = "i" in docs.columns

    def run(batches):
        let_go()
        for b in batches:
            for a, z, words in blocks(b["t"]):
                g, first = shingle_sets(words, n)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(g.view(np.int64)))
                names = b["i"].slice(a, z - a) if named else pa.array([set_digest(g[x:y]) for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.record_batch([names, lists], names=["node", "set"])

    return docs.mapInArrow(run, f"node {dict(docs.dtypes)['i'] if named else 'binary'}, set array<long>")


def components(links: DataFrame) -> DataFrame:
    """(x, label) of every node in links (a, b): the least node it reaches; labels spread and jump until they rest."""
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("x")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("x").alias("b"), "label"), "b").groupBy(F.col("a").alias("x")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "x").select("x", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("x").alias("to"), F.col("label").alias("further"))
        after = stored(spread.join(jump, "to", "left").select("x", F.least("to", F.coalesce("further", "to")).alias("label"), "was"), "labels")
        discard(labels)
        labels = after
        if after.filter("label < was").isEmpty():
            discard(edges)
            return after


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough; only sets of nodes in pairs are shuffled."""
    pairs = stored(pairs, "pairs")
    mine = {c: sets.join(broadcast_if_small(pairs.select(F.col(c).alias("node")).distinct()), "node", "left_semi").select(F.col("node").alias(c), F.col("set").alias(f"s{c}")) for c in "ab"}
    both = pairs.join(mine["a"], "a").join(mine["b"], "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    links = stored(both.filter(F.expr(f"100 * both >= {percent} * (size(sa) + size(sb) - both)")).select("a", "b").distinct(), "links")
    discard(pairs)
    return links


def rarest(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, rare): the shingles of each set that fewest of these sets hold, rarest first, as many as the prefix test needs.

    Null for a node with several sets (texts of one least id): the test is open for it.
    """
    mine = sets.join(nodes, "node", "left_semi")
    shingles = mine.select("node", F.explode("set").alias("s"))
    known = shingles.join(shingles.groupBy("s").agg(F.count("*").alias("df")), "s")
    ordered = known.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("all"))  # bounded by a document's set
    several = mine.groupBy("node").agg((F.count("*") > 1).alias("several"))
    keep = F.expr(f"slice(transform(all, x -> x.s), 1, size(all) - cast(ceil(size(all) * {percent} / 100) as int) + {SHARE})")
    return ordered.join(several, "node").select("node", F.when(~F.col("several"), keep).alias("rare"))


def prefix_test(percent: int):
    """Whether a member (size, rare) and a centre (c_size, c_rare) can be alike: sets with t shingles in common share
    ``SHARE`` of their size - t + ``SHARE`` rarest ones in any one order (or t, if that is less)."""
    t = f"cast(ceil((size + c_size) * {percent} / {100 + percent}) as int)"
    part = lambda c: f"slice({c}rare, 1, greatest(cast({c}size as int) - {t} + {SHARE}, 0))"
    share = f"size(array_intersect({part('')}, {part('c_')})) >= least({SHARE}, {t})"
    return F.expr(f"rare is null or c_rare is null or {share}")


def links_within_buckets(members: DataFrame, sets: DataFrame, percent: int, comp: DataFrame | None = None) -> DataFrame | None:
    """Components (x, label) of the nodes linked in any bucket of members (key, node, size, weight), on top of those known before.

    Round 0 takes one bucket in ``FIRST``, to connect most nodes with few pairs; round 1 takes a star in each
    bucket that still has several components, the rounds after it more centres until none is left.
    """
    round_, rare, whole = 0, None, None
    while True:
        m = members.filter(F.pmod(F.xxhash64("key"), F.lit(FIRST)) == 0) if round_ == 0 else members
        if comp is None:
            m = m.withColumn("comp", F.col("node"))
        else:
            m = m.join(comp, m.node == comp.x, "left").select(*m.columns, F.coalesce("label", "node").alias("comp"))
        m = stored(m, "members")
        here = F.struct("weight", "node", "size", "comp")
        parts = m.groupBy("key", "comp").agg(F.count("*").alias("n"), F.max(here).alias("top"))
        large = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).comp.alias("large"), F.count("*").alias("parts"), F.max("top").alias("c")).filter("parts > 1")
        large = stored(large.select("key", "large", "c"), "large")
        if round_ > 1:  # only buckets that still have several components go on
            before, m = m, m.join(large.select("key", "large"), "key")
            if rare is None:
                whole = stored(m, "open")
                rare = stored(rarest(sets, whole.select("node").distinct(), percent), "rare")
                m = whole.join(rare, "node")
            # Members outside the largest part lead, some of each bucket at once.
            outside = F.col("comp") != F.col("large")
            lane = Window.partitionBy("key", outside, F.pmod(F.xxhash64("node"), F.lit(LANES))).orderBy(F.col("weight").desc(), F.col("node").desc())
            m = stored(m.withColumn("leads", outside & (F.row_number().over(lane) == 1)), "open")
            discard(before, whole)
            whole = None
            centres = m.filter("leads").select("key", F.col("node").alias("c"), F.col("size").alias("c_size"), F.col("comp").alias("c_comp"), F.col("rare").alias("c_rare"))
        else:  # the member that meets most others
            centres = large.select("key", F.col("c.node").alias("c"), F.col("c.size").alias("c_size"), F.col("c.comp").alias("c_comp"))
        centres = stored(centres, "centres")
        if round_ > 0 and centres.isEmpty():
            discard(m, large, centres)
            return comp
        alike = F.expr(f"100 * least(size, c_size) >= {percent} * greatest(size, c_size)")
        if rare is not None:
            alike &= prefix_test(percent)
        pairs = m.join(centres, "key").filter((F.col("comp") != F.col("c_comp")) & alike).select(F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b")).distinct()
        links = confirmed(pairs, sets, percent)
        if not links.isEmpty():
            known = links if comp is None else links.unionByName(comp.filter("x <> label").select(F.col("label").alias("a"), F.col("x").alias("b")))
            before, comp = comp, components(known)
            discard(before)
        discard(links, large)
        if round_ > 1:
            # Centres are done: each was held against every member of its bucket that isn't connected with it.
            before, members = members, stored(m.filter(~F.col("leads")).drop("comp", "large", "leads"), "rest")
            discard(before)
        discard(m, centres)
        round_ += 1


def grouped(rows_: DataFrame, n: int, percent: int, bands: int, rows: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """For rows (i, t): the stored signatures, and (digest, label), the component of each set.

    ``by_id``: a set's node is the least id that has it, and rows that share an id are linked. Otherwise, for rows (i, t, k), k a key of
    the row, the node is the set's digest, so sets under one id stay apart.
    """
    signed = stored(signatures(rows_, n, bands, rows), "signatures")
    known = signed.filter("i is not null and digest is not null")
    node = F.min("i") if by_id else F.first("digest")
    nodes = known.groupBy("digest").agg(node.alias("node"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    in_bucket = nodes.select("node", "size", F.explode("keys").alias("key")).repartition("key")
    # The size is asked for too so that both sides of the join below read one and the same shuffle.
    shared = in_bucket.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("size").alias("top"), F.count("*").alias("n")).filter("lo < hi and top > 0").select("key", "n")
    members = stored(in_bucket.join(shared, "key").distinct(), "buckets")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = stored(members.drop("n").join(weight, "node").select("key", "node", "size", "weight"), "weighed")
    discard(members)
    involved = weighed.select("node").distinct()
    if by_id:
        texts = rows_.join(broadcast_if_small(involved.withColumnRenamed("node", "i")), "i", "left_semi").select("i", "t")
    else:  # one row of each set
        held = known.groupBy("digest").agg(F.min("k").alias("k")).join(involved, F.col("digest") == F.col("node"), "left_semi").select("k")
        texts = rows_.join(broadcast_if_small(stored(held, "held")), "k", "left_semi").select("t")
    sets = stored(full_sets(texts, n), "sets")
    by_set = known.groupBy("digest").agg(node.alias("node"))
    same = None
    if by_id:
        several = known.groupBy("i").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo < hi").select("i")
        own = known.select("i", "digest").join(several, "i", "left_semi").distinct().join(by_set, "digest")
        star = stored(own.join(own.groupBy("i").agg(F.min("node").alias("a")), "i").filter("a < node").select("a", F.col("node").alias("b")).distinct(), "same")
        same = None if star.isEmpty() else components(star)
        discard(star)
    linked = links_within_buckets(weighed, sets, percent, same)
    discard(sets, weighed)
    if linked is None:
        return signed, by_set.withColumnRenamed("node", "label")
    return signed, by_set.join(linked, by_set.node == linked.x, "left").select("digest", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links, itself included) and kept, for every row."""
    signed, label = grouped(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), n, percent, bands, rows, by_id=True)
    found = signed.select("i", "digest", "size").join(label, "digest", "left").select(F.col("i").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("label", "i").alias("component_id"))
    return found.select(id_col, "n_shingles", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs``, all columns, with one row of each group of texts: the one with the least id (then the least row key).

    Rows are documents here, and nodes are sets: rows that share an id but not a text are only grouped if their texts are alike, and of
    rows equal in id and text one stays. Rows with a null id or without words stay.
    """
    key = row_key("doc_id", "text")
    signed, label = grouped(docs.select("doc_id", "text", key.alias("k")).select(F.col("doc_id").alias("i"), F.col("text").alias("t"), "k"), n, percent, bands, rows, by_id=False)
    rows_ = stored(signed.filter("i is not null and digest is not null").select("i", "k", "digest").join(label, "digest").select("label", "i", "k"), "grouped")
    one = stored(rows_.groupBy("label").agg(F.min(F.struct("i", "k")).alias("one")).select(F.col("one.k").alias("_kept")), "kept")
    doubled = stored(rows_.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"), "doubled").join(one, F.col("k") == F.col("_kept"), "left_semi")
    gone = stored(rows_.select("k").join(one, F.col("k") == F.col("_kept"), "left_anti").unionByName(doubled).distinct().toDF("_gone"), "gone")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    keyed = docs.withColumn("_row_key", key).toDF(*names, "_row_key") if "_row_key" not in docs.columns else docs.select(*[F.col(c).alias(x) for c, x in zip(docs.columns, names, strict=True)], key.alias("_row_key"))
    kept = keyed.join(broadcast_if_small(gone), F.col("_row_key") == F.col("_gone"), "left_anti")
    if not doubled.isEmpty():
        kept = kept.unionByName(keyed.join(doubled.toDF("_twice"), F.col("_row_key") == F.col("_twice"), "left_semi").dropDuplicates(["_row_key"]))
    return kept.select(*names).toDF(*docs.columns)
