"""Alignment of two tokenizers' ids over the same text, and corpus-wide counts of linked ids.

Both encode a space and the text: A by a byte-level vocabulary, B by a sentencepiece model (which puts
the space there itself). Byte offsets where tokens of both end are shared cuts. They are found by divide
and conquer: from an interval's middle A end, bisecting B's ends and A's in turn leads to the nearest
end that both have, first to the right, then to the left; both halves go on, and an interval without a
shared end inside is one group. All intervals of a block of texts take each step together. Inside a group
each stretch between neighbouring ends of either side links the A and the B token that cover it.

Three passes. The first encodes and aligns each text once and stores ids and groups, compressed, in slabs of
about ``SLAB_BYTES`` and chunks of ``CHUNK_BYTES`` of text (a longer text is a chunk of its own). The second counts id pairs
in each chunk, then by pair, and gives each chunk, whose slabs are stored in one bucket and stay there, the totals of just its pairs; the highest count of each B id is
broadcast, at most one row for each id of the vocabulary. The third looks the totals up for each chunk's links.

A text that is null or empty, or whose A or B bytes joined are not the space and the text, has no tokens.
Repeated rows count each, null and repeated doc_ids too. Empty tables give empty results. Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.bpe import byte_bpe, byte_letters
from rallyframe.llm.pieces import Pieces, decimals, piece_model
from rallyframe.llm.records import LibraryEncoder
from rallyframe.llm.shared import kept_by_worker, stored, stored_in_buckets
from rallyframe.llm.text import IdTable, raw, strings

CHUNK_BYTES, SLAB_BYTES, KEEP = 8 << 20, 256 << 10, 400_000


class Tokenizers:
    """Both encoders and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        spec = json.load(open(path_a, encoding="utf-8"))
        letters = {c: b for b, c in enumerate(byte_letters())}
        known = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.a_bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        self.a_size, self.a_kind = np.array([len(b) for b in self.a_bytes], np.int64), "<u2" if len(self.a_bytes) <= 1 << 16 else "<u4"
        self.path_a, self.b = path_a, Pieces(path_b)
        self.b_size, self.b_kind = self.b.length, self.b.kind
        self.a = None

    def encode(self, column):
        """For runs of rows: (first row, row after the last, A ids and B ids of each row, bytes of each text)."""
        if self.a is None:  # the encoders' tables are only made where texts are encoded
            self.a = LibraryEncoder(self.path_a)
            self.a.library.encode_special_tokens = True
            self.a.table, self.b.table = IdTable(KEEP, self.a.kind), IdTable(KEEP, self.b.kind)
        data, off = raw(strings(column))
        for x, z, ids, cut, _, _ in self.b.encode_texts(column):
            sizes = np.diff(off[x : z + 1])
            own = np.insert(data[off[x] : off[z]], (off[x:z] - off[x])[sizes > 0], 0x20)
            first = np.r_[0, np.cumsum(sizes + (sizes > 0))]
            spaced = pa.Array.from_buffers(pa.large_string(), z - x, [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(own))])
            a = self.a.encode(spaced)
            b = [ids[p:q] for p, q in zip(cut[:-1], cut[1:], strict=True)]
            whole, at = own.tobytes(), first.tolist()
            for d in range(z - x):
                text = whole[at[d] : at[d + 1]]
                if b"".join(map(self.a_bytes.__getitem__, a[d].tolist())) != text or b"".join(map(self.b.bytes.__getitem__, b[d].tolist())) != text:
                    a[d], b[d] = a[d][:0], b[d][:0]
            yield x, z, a, b, sizes


@kept_by_worker
def loaded(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def shared_cuts(ea: np.ndarray, eb: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A and B tokens before each shared cut, ascending, ends of texts included.

    ``ea``, ``eb``: end of each token in bytes of all texts one after the other; ``a_cut``, ``b_cut``: token offsets of texts.
    """
    full = np.diff(a_cut) > 0
    al, ah, bl, bh = a_cut[:-1][full], a_cut[1:][full], b_cut[:-1][full], b_cut[1:][full]
    found_a, found_b = [ah], [bh]
    while len(al):
        inner = (ah - al > 1) & (bh - bl > 1)
        al, ah, bl, bh = al[inner], ah[inner], bl[inner], bh[inner]
        at = np.full(len(al), -1)
        middle = (al + ah - 2) // 2
        open_, a = np.arange(len(al)), middle
        while len(open_):  # to the right: the next B end from here on, then the next A end from there on
            b = np.searchsorted(eb, ea[a])
            on = b < bh[open_] - 1
            hit = on & (eb[np.minimum(b, len(eb) - 1)] == ea[a])
            at[open_[hit]] = a[hit]
            on &= ~hit
            open_, b = open_[on], b[on]
            a = np.searchsorted(ea, eb[b])
            on = a < ah[open_] - 1
            open_, a = open_[on], a[on]
        open_ = np.flatnonzero(at < 0)
        a = middle[open_] - 1
        on = a >= al[open_]
        open_, a = open_[on], a[on]
        while len(open_):  # to the left
            b = np.searchsorted(eb, ea[a], "right") - 1
            on = b >= bl[open_]
            hit = on & (eb[b] == ea[a])
            at[open_[hit]] = a[hit]
            on &= ~hit
            open_, b = open_[on], b[on]
            a = np.searchsorted(ea, eb[b], "right") - 1
            on = a >= al[open_]
            open_, a = open_[on], a[on]
        cut = at >= 0
        ka, al, ah, bl, bh = at[cut] + 1, al[cut], ah[cut], bl[cut], bh[cut]
        kb = np.searchsorted(eb, ea[ka - 1]) + 1
        found_a.append(ka)
        found_b.append(kb)
        al, ah, bl, bh = np.r_[al, ka], np.r_[ka, ah], np.r_[bl, kb], np.r_[kb, bh]
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


class Aligned:
    """Ids, groups and links of some consecutive texts."""

    def __init__(self, t: Tokenizers, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, shared: tuple[np.ndarray, np.ndarray] | None = None):
        self.a, self.b, self.a_cut, self.b_cut = a, b, a_cut, b_cut
        ea, eb = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
        self.total = int(ea[-1]) if len(ea) else 0
        if self.total < 1 << 31:
            ea, eb = ea.astype(np.int32), eb.astype(np.int32)
        self.ea, self.eb = ea, eb
        self.group_a, self.group_b = shared or shared_cuts(ea, eb, a_cut, b_cut)
        self.n_groups = np.diff(np.searchsorted(self.group_a, a_cut, "right"))

    def links(self) -> np.ndarray:
        """Each link's pair (A id * 2^32 + B id); sets ``n_links``."""
        marks = np.zeros(self.total + 1, np.uint8)  # by end: 1 of an A token, 2 of a B token
        marks[self.ea] = 1
        marks[self.eb] += 2
        marks = marks[marks > 0]
        link_a, link_b = np.cumsum(marks & 1) - (marks & 1), np.cumsum(marks >> 1) - (marks >> 1)  # tokens that end before
        self.n_links = np.diff(np.searchsorted(link_a, self.a_cut))
        return self.a[link_a].astype(np.int64) << 32 | self.b[link_b]

    def text(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        na, nb = len(self.a), len(self.b)
        size_a, size_b = np.diff(self.group_a, prepend=0), np.diff(self.group_b, prepend=0)
        ids, after = np.empty(na + nb, np.int32), np.full(na + nb, ord(","), np.uint8)
        at_a, at_b = np.arange(na) + np.repeat(self.group_b - size_b, size_a), np.arange(nb) + np.repeat(self.group_a, size_b)
        ids[at_a], ids[at_b] = self.a, self.b
        after[at_a[self.group_a - 1]], after[at_b[self.group_b - 1]] = ord("|"), ord(";")
        out, ends = decimals(ids, after)
        at, out = np.r_[0, ends][self.a_cut + self.b_cut].tolist(), out.tobytes()
        return [out[x : max(x, y - 1)] for x, y in zip(at[:-1], at[1:], strict=True)]

    def packed(self) -> bytes:
        """Ids by byte planes and a bit for each token that ends a group, compressed."""
        planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() for x in (self.a, self.b)]
        bits = [np.zeros(len(x), bool) for x in (self.a, self.b)]
        bits[0][self.group_a - 1], bits[1][self.group_b - 1] = True, True
        return pa.compress(b"".join([*planes, *(np.packbits(x).tobytes() for x in bits)]), codec="zstd", asbytes=True)

    @classmethod
    def unpacked(cls, t: Tokenizers, data, n_a: np.ndarray, n_b: np.ndarray) -> Aligned:
        a_cut, b_cut = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
        na, nb, wa, wb = int(a_cut[-1]), int(b_cut[-1]), int(t.a_kind[-1]), int(t.b_kind[-1])
        sizes = [na * wa, nb * wb, -(-na // 8), -(-nb // 8)]
        raw_ = np.frombuffer(pa.decompress(data, sum(sizes), codec="zstd"), np.uint8)
        pa_, pb, ba, bb = np.split(raw_, np.cumsum(sizes)[:-1])
        side = lambda x, w, kind: np.ascontiguousarray(x.reshape(w, -1).T).reshape(-1).view(kind) if len(x) else np.zeros(0, kind)
        ends = [np.flatnonzero(np.unpackbits(x, count=n)) + 1 for x, n in ((ba, na), (bb, nb))]
        return cls(t, side(pa_, wa, t.a_kind), side(pb, wb, t.b_kind), a_cut, b_cut, tuple(ends))


def slabs(t: Tokenizers, batch):
    """(row of the batch, Aligned) of a batch with n_a, n_b and data."""
    for k, data in enumerate(batch["data"]):
        yield k, Aligned.unpacked(t, data.as_buffer(), *(batch[c][k].values.to_numpy().astype(np.int64) for c in ("n_a", "n_b")))


def tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(chunk, i, n_a, n_b, data), stored: the ids, numbers of tokens, and tokens with their groups of some rows (i, t)."""
    kind = dict(docs.dtypes)["i"]

    def run(batches):
        t = loaded(path_a, path_b)
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for x, z, a, b, sizes in t.encode(batch["t"]):
                parts, slab = [], 0  # (chunk, first row, row after the last)
                for d, n in enumerate(sizes.tolist()):
                    if held and held + n > CHUNK_BYTES:
                        chunk, held, slab = chunk + 1, 0, 0
                    held += n
                    if slab and slab + n <= SLAB_BYTES:
                        parts[-1][2] = d + 1
                    else:
                        parts.append([chunk, d, d + 1])
                        slab = 0
                    slab += n
                for c, p, q in parts:
                    counts = [np.array([len(v) for v in ids[p:q]], np.int64) for ids in (a, b)]
                    flat = [np.concatenate(ids[p:q]).astype(k) for ids, k in ((a, t.a_kind), (b, t.b_kind))]
                    data = Aligned(t, *flat, *(np.r_[0, np.cumsum(n)] for n in counts)).packed()
                    one = lambda v: pa.ListArray.from_arrays(pa.array(np.array([0, len(v)], np.int32)), v)
                    yield pa.record_batch([pa.array([c], pa.int64()), one(batch["i"].slice(x + p, q - p)), *(one(pa.array(n.astype(np.int32))) for n in counts), pa.array([data], pa.binary())], names=["chunk", "i", "n_a", "n_b", "data"])

    return stored_in_buckets(docs.mapInArrow(run, f"chunk long, i array<{kind}>, n_a array<int>, n_b array<int>, data binary"), "tokens", "chunk")


def chunk_pairs(ids: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(chunk, pair, n): links of each chunk by id pair (A id * 2^32 + B id)."""

    def run(batches):
        t, chunk, held = loaded(path_a, path_b), None, []

        def out():
            pair = np.concatenate([p for p, _ in held])
            pair, place = np.unique(pair, return_inverse=True)
            n = np.bincount(place, np.concatenate([n for _, n in held]), len(pair)).astype(np.int64)
            return pa.record_batch([pa.array(np.full(len(pair), chunk)), pa.array(pair), pa.array(n)], names=["chunk", "pair", "n"])

        for batch in batches:
            marks = batch["chunk"].to_pylist()
            for k, slab in slabs(t, batch):
                if held and marks[k] != chunk:
                    yield out()
                    held = []
                chunk = marks[k]
                held.append(np.unique(slab.links(), return_counts=True))
        if held:
            yield out()

    return ids.select("chunk", "n_a", "n_b", "data").mapInArrow(run, "chunk long, pair long, n long")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair over the corpus, and whether none of its B id has more."""
    counts = rows.groupBy("pair").agg(F.sum("n").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # at most a row for each B id
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, digest: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and the groups.

    The groups are ``groups``, an array of (a, b) lists of ids, or with ``digest`` their text as ``groups_sha256`` ('' without tokens).
    """
    path_a, path_b = path_a or byte_bpe(), path_b or piece_model()
    ids = tokens(docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")), path_a, path_b)
    rows = stored(chunk_pairs(ids, path_a, path_b), "pairs")
    totals = rows.select("chunk", "pair").join(pair_counts(rows), "pair")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t = loaded(path_a, path_b)
        order = np.argsort(pair := right["pair"].to_numpy())
        pair, count, best = pair[order], right["count"].to_numpy()[order], right["best"].to_numpy(zero_copy_only=False)[order]
        out = []
        for batch in left.to_batches():
            for k, x in slabs(t, batch):
                at = np.searchsorted(pair, x.links())
                cut = np.r_[0, np.cumsum(x.n_links)]
                total = lambda v: np.diff(np.r_[0, np.cumsum(v[at])][cut])  # noqa: B023, E731
                numbers = [np.diff(x.a_cut), np.diff(x.b_cut), x.n_groups, x.n_links, total(best.astype(np.int64)), total(count)]
                if digest:
                    groups = pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in x.text()], pa.string())
                else:
                    side = lambda ids_, ends: pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids_.astype(np.int32)))
                    pairs = pa.StructArray.from_arrays([side(x.a, x.group_a), side(x.b, x.group_b)], names=["a", "b"])
                    groups = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(x.n_groups)].astype(np.int32)), pairs)
                out.append(pa.record_batch([batch["i"][k].values, *(pa.array(v.astype(np.int64)) for v in numbers), groups], names=names))
        return pa.Table.from_batches(out)

    last = ("groups_sha256", "string") if digest else ("groups", "array<struct<a:array<int>,b:array<int>>>")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", last[0]]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", " + " ".join(last)
    return ids.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(run, schema)
