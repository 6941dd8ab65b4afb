"""SentencePiece byte-pair encoding that keeps offsets, and decoding.

A text is normalised first: at each place the longest key of the model's compiled character
map (a double-array trie) is replaced, all else is copied, a space is put in front, and each
byte of the result records the place of the source it came from. The result is then cut where
no piece of the vocabulary holds the two bytes at the cut side by side; merges never pass such
a cut, so the parts are encoded apart: all new parts of a block together, one merge of each part
a step (best score, then leftmost). Characters without a piece become byte pieces. Each piece's
range in the normalised text is projected through the recorded places to bytes of the source.

Parts recur, so a worker keeps the ids of at most ``KEEP`` parts, found by 128 bits of hashes (about
150 MB); it only saves time. The model's path is a parameter; the file must be on each machine.
Byte-pair models with byte fallback and without pieces of the user's are read, others refused.

Null texts count as empty: the end id alone. Repeated rows are encoded each. Empty tables give
empty results. Only the named columns are read.
"""

from __future__ import annotations

import codecs
import hashlib
import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.shared import kept_by_worker
from rallyframe.llm.text import BASE, BASE_INVERSE, U, IdTable, byte_weights, mix, powers, raw, strings

KEEP, LONG_PART, SLAB, BLOCK_BYTES = 800_000, 48, 4096, 1 << 20
SPACE = "▁"  #: how pieces write a space
NORMAL, UNKNOWN, CONTROL, BYTE, NONE = 1, 2, 3, 6, np.int32(2**31 - 1)

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def fields(message: bytes):
    """(number, value) of the fields of a protocol buffer message; numbers as int, fixed and length-delimited ones as bytes."""
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at : at + size]
        at += size


class CharMap:
    """The compiled character map: size of the trie, its units, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]
        root = self.jump(self.units[0])
        #: Bytes that start a key.
        self.starts = [self.units[root ^ b] & 0x800000FF == b if root ^ b < len(self.units) else False for b in range(256)]

    @staticmethod
    def jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key at a place."""
        node, found = self.jump(self.units[0]), None
        for n in range(at, len(data)):
            node ^= data[n]
            unit = self.units[node]
            if unit & 0x800000FF != data[n]:
                break
            node ^= self.jump(unit)
            if unit >> 8 & 1:
                found = n + 1 - at, self.units[node] & 0x7FFFFFFF
        return found and (found[0], self.texts[found[1] : self.texts.index(0, found[1])])


class Normaliser:
    """Normalised bytes, a space for each space mark, with the source place of each byte and of the end."""

    def __init__(self, spec: bytes):
        f = dict(fields(spec))
        self.map = CharMap(f[2]) if f.get(2) else None
        self.prefix, self.squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
        if not f.get(5, 1):
            raise ValueError("a model that doesn't mark spaces isn't read")
        self.plain = self.map is None and not self.squeeze

    def step(self, data: bytes, at: int) -> tuple[int, bytes]:
        if self.map and self.map.starts[data[at]] and (hit := self.map.longest(data, at)):
            return hit
        n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return n, data[at : at + n]

    def text(self, data: bytes) -> tuple[bytes, np.ndarray]:
        at, out, place = 0, bytearray(), []
        while self.squeeze and at < len(data):  # leading spaces go
            n, made = self.step(data, at)
            if made != b" ":
                break
            at += n
        if at == len(data):
            return b"", np.zeros(1, np.int64)
        if self.prefix:
            out += b" "
            place.append(at)
        spaced = self.squeeze
        while at < len(data):
            n, made = self.step(data, at)
            made = made.replace(SPACE.encode(), b" ")
            if spaced:
                made = made.lstrip(b" ")
            out += made
            place += [at] * len(made)
            if made:
                spaced = made.endswith(b" ")
            at += n
            spaced &= self.squeeze
        if self.squeeze:
            while out.endswith(b" "):
                at = place.pop()
                out.pop()
        return bytes(out), np.array([*place, at], np.int64)

    def block(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes of texts one after the other, their offsets, and the source places in the text (one more for each text)."""
        sizes = np.diff(off)
        if self.plain and self.prefix and not marks(data):
            out = np.insert(data, off[:-1][sizes > 0], 0x20)
            first = np.r_[0, np.cumsum(sizes + (sizes > 0))]
            own = np.arange(first[-1] + len(sizes)) - np.repeat(first[:-1] + np.arange(len(sizes)), np.diff(first) + 1)
            return out, first, np.maximum(own - 1, 0)
        whole = data.tobytes()
        made = [self.text(whole[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        out = np.frombuffer(b"".join(m for m, _ in made), np.uint8)
        return out, np.r_[0, np.cumsum([len(m) for m, _ in made])].astype(np.int64), np.concatenate([*(p for _, p in made), np.zeros(0, np.int64)])


def marks(data: np.ndarray) -> bool:
    """Whether a space mark stands in the bytes."""
    at = np.flatnonzero(data[:-2] == 0xE2) if len(data) > 2 else np.zeros(0, np.int64)
    return bool(((data[at + 1] == 0x96) & (data[at + 2] == 0x81)).any())


class Pieces:
    def __init__(self, path: str):
        model = [*fields(open(path, "rb").read())]
        each = [dict(fields(v)) for k, v in model if k == 1]
        trainer, spec = (dict(model).get(k, b"") for k in (2, 3))
        trainer = dict(fields(trainer))
        self.texts = [p[1].decode() for p in each]
        kinds = np.array([p.get(3, NORMAL) for p in each])
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0) or not set(kinds.tolist()) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only byte-pair models with byte fallback and no pieces of the user's are read")
        self.normaliser = Normaliser(spec)
        size = self.size = len(each)
        self.end_id = trainer.get(42, 2)
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        scores = np.array([struct.unpack("<f", p[2])[0] for p in each])
        unknown = trainer.get(44, b" \xe2\x81\x87 ")
        self.is_byte, self.is_normal = kinds == BYTE, kinds == NORMAL
        self.byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.is_byte):
            self.byte_ids[int(self.texts[i][1:-1], 16)] = i
        self.bytes = [bytes([int(t[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else unknown if k == UNKNOWN else t.replace(SPACE, " ").encode() for t, k in zip(self.texts, kinds.tolist(), strict=True)]
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.offset = np.r_[0, np.cumsum(self.length)]
        # Symbols: the normal pieces, then characters that only occur inside pieces; other characters follow by code point.
        normal = np.flatnonzero(kinds == NORMAL).tolist()
        symbol = {self.texts[i]: i for i in normal}
        for i in normal:
            for c in self.texts[i]:
                symbol.setdefault(c, size + len(symbol))
        self.first_other = size + 2 * len(symbol)
        self.of_char = np.arange(self.first_other, self.first_other + 0x110000, dtype=np.int64)
        for c, i in symbol.items():
            if len(c) == 1:
                self.of_char[ord(" " if c == SPACE else c)] = i
        self.char_of = {i: c for c, i in symbol.items() if len(c) == 1}
        rank = np.unique(-scores, return_inverse=True)[1]
        pairs = {}
        self.beside = np.zeros((256, 256), bool)
        for i in normal:
            t, b = self.texts[i], np.frombuffer(self.bytes[i], np.uint8)
            self.beside[b[:-1], b[1:]] = True
            for k in range(1, len(t)):
                if (x := symbol.get(t[:k])) is not None and (y := symbol.get(t[k:])) is not None:
                    pairs[x << 24 | y] = (int(rank[i]), i)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.pair_keys.tolist()], np.int32)
        self.pair_made = np.array([pairs[k][1] for k in self.pair_keys.tolist()], np.int64)
        self.beside[:, 0x80:0xC0] = True  # a character stays whole
        self.beside = self.beside.reshape(-1)
        self.table = IdTable(KEEP, self.kind)

    def looked_up(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` if they don't merge) and merged symbol of neighbours."""
        key = np.where((x >= 0) & (y >= 0) & (x < self.first_other) & (y < self.first_other), x << 24 | y, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        ok = self.pair_keys[at] == key
        return np.where(ok, self.pair_rank[at], NONE), self.pair_made[at]

    def merged(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of symbols, and the symbols, of each row of an array padded with -1, after all merges."""
        n, width = sym.shape
        out, rows = np.full((n, width), -1, np.int64), np.arange(n)
        rank, made = self.looked_up(sym[:, :-1], sym[:, 1:])
        while width > 1 and len(rows):
            at = rank.argmin(1)
            every = np.arange(len(rows))
            go = rank[every, at] != NONE
            if not go.all():
                out[rows[~go], :width] = sym[~go]
                rows, sym, rank, made, at = rows[go], sym[go], rank[go], made[go], at[go]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            sym[every, at] = made[every, at]
            cols = np.arange(width - 1)
            sym = np.take_along_axis(sym, cols + (cols > at[:, None]), 1)
            width -= 1
            cols = cols[: width - 1]
            keep = cols + (cols >= at[:, None])
            rank, made = np.take_along_axis(rank, keep, 1), np.take_along_axis(made, keep, 1)
            for near, ok in ((at - 1, at > 0), (at, at < width - 1)):
                e, p = every[ok], near[ok]
                rank[e, p], made[e, p] = self.looked_up(sym[e, p], sym[e, p + 1])
        if len(rows):
            out[rows, :width] = sym
        lens = (out >= 0).sum(1)
        return lens, out[out >= 0]

    def merged_one(self, sym: np.ndarray) -> np.ndarray:
        """The same for one long part: a heap of merges over a linked list."""
        import heapq

        sym, n = sym.tolist(), len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(pairs):
            x, y = np.array(pairs).T
            rank, made = self.looked_up(np.array([sym[i] for i in x]), np.array([sym[i] for i in y]))
            for i, j, r, m in zip(x.tolist(), y.tolist(), rank.tolist(), made.tolist(), strict=True):
                if r != NONE:
                    heapq.heappush(heap, (r, i, j, sym[i], sym[j], m))

        if n > 1:
            offer([(i, i + 1) for i in range(n - 1)])
        while heap:
            _, i, j, a, b, m = heapq.heappop(heap)
            if sym[i] != a or right[i] != j or sym[j] != b:
                continue
            sym[i], sym[j] = m, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            near = [p for p in ((left[i], i), (i, right[i])) if min(p) >= 0]
            if near:
                offer(near)
        return np.array([s for s in sym if s >= 0], np.int64)

    def tokens(self, lens: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids; a character without a piece becomes the ids of its bytes."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return lens, symbols.astype(self.kind)
        own = np.repeat(np.arange(len(lens)), lens)
        spelt = [(self.char_of[s] if s < self.first_other else chr(s - self.first_other)).encode() for s in symbols[odd].tolist()]
        times = np.ones(len(symbols), np.int64)
        times[odd] = [len(b) for b in spelt]
        out = np.repeat(symbols, times)
        out[np.repeat(symbols >= self.size, times)] = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        return np.bincount(np.repeat(own, times), minlength=len(lens)), out.astype(self.kind)

    def new_parts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the parts, and the ids one after the other."""
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, self.kind)
        ends = np.cumsum(size)
        own = data[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)]
        chars = np.bincount(np.repeat(np.arange(len(start)), size)[own & 0xC0 != 0x80], minlength=len(start))
        sym = self.of_char[np.frombuffer(own.tobytes().decode().encode("utf-32-le"), "<u4")]
        first = np.cumsum(chars) - chars
        lens, got = np.zeros(len(start), np.int64), [None] * 0
        order = np.argsort(chars, kind="stable")
        short = order[chars[order] <= LONG_PART]
        flat, at = [], []
        for a in range(0, len(short), SLAB):
            part = short[a : a + SLAB]
            width = int(chars[part[-1]])
            cols = np.arange(width)
            inside = cols < chars[part][:, None]
            n, s = self.merged(np.where(inside, sym[np.minimum(first[part][:, None] + cols, len(sym) - 1)], -1))
            n, s = self.tokens(n, s)
            lens[part] = n
            flat.append(s)
            at.append(part)
        for k in order[chars[order] > LONG_PART].tolist():
            s = self.merged_one(sym[first[k] : first[k] + chars[k]])
            n, s = self.tokens(np.array([len(s)]), s)
            lens[k] = n[0]
            flat.append(s)
            at.append(np.array([k]))
        ids, at = np.concatenate(flat), np.concatenate(at)
        made = lens[at]
        begin = np.zeros(len(start), np.int64)
        begin[at] = np.cumsum(made) - made
        ends = np.cumsum(lens)
        return lens, ids[np.arange(ends[-1]) + np.repeat(begin - (ends - lens), lens)]

    def encode_block(self, norm: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts one after the other, and the offsets of each text's."""
        if not len(norm):
            return np.zeros(0, self.kind), np.zeros(len(first), np.int64)
        cut = np.r_[True, ~self.beside[norm[:-1].astype(np.int32) * 256 + norm[1:]]]
        cut[first[:-1][np.diff(first) > 0]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.r_[start, len(norm)])
        key = []
        for seed in (29, 31):
            terms = byte_weights(seed, False)[norm] * powers(BASE, len(norm))[: len(norm)]
            key.append(mix(np.add.reduceat(terms, start) * powers(BASE_INVERSE, len(norm))[start]))
        entry = np.where(size <= LONG_PART, self.table.find(*key), -1)
        new = np.flatnonzero(entry < 0)
        _, lead, inverse = np.unique(key[0][new], return_index=True, return_inverse=True)
        if (key[1][new] != key[1][new[lead]][inverse]).any():  # two parts of one hash: each by itself
            lead, inverse = np.arange(len(new)), np.arange(len(new))
        lead = new[lead]
        held = entry >= 0
        n0, ids0 = self.table.lists(entry[held])
        n1, ids1 = self.new_parts(norm, start[lead], size[lead])
        lens, at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        lens[held], at[held] = n0, np.cumsum(n0) - n0
        lens[new], at[new] = n1[inverse], (len(ids0) + np.cumsum(n1) - n1)[inverse]
        source = np.concatenate([ids0, ids1])
        ends = np.cumsum(lens)
        ids = source[np.arange(ends[-1]) + np.repeat(at - (ends - lens), lens)]
        keep = size[lead] <= LONG_PART
        if keep.all():
            self.table.add(key[0][lead], key[1][lead], n1, ids1)
        else:
            self.table.add(key[0][lead[keep]], key[1][lead[keep]], n1[keep], ids1[np.repeat(keep, n1)])
        return ids, np.r_[0, ends][np.searchsorted(start, first)]

    def spans(self, ids: np.ndarray, cut: np.ndarray, first: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte range of each id in its source text; of a character's byte pieces the last has its range, the others an empty one at its start."""
        texts = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        to = np.cumsum(self.length[ids])
        begin = to - self.length[ids]
        if len(ids) and self.is_byte[ids].any():
            byte = self.is_byte[ids]
            follows = byte & (self.blob[self.offset[ids]] & 0xC0 == 0x80)
            lead = np.maximum.accumulate(np.where(follows, 0, np.arange(len(ids))))
            begin = begin[lead]
            to = np.where(np.r_[follows[1:], False], begin, to)
        return place[begin + texts], place[to + texts]

    def decode_bytes(self, ids: np.ndarray, cut: np.ndarray) -> list[bytes]:
        """Bytes of each text: a space for each space mark, without the first one that was put in front."""
        lens = self.length[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ids) else 0
        out = self.blob[np.arange(total) + np.repeat(self.offset[ids] - (ends - lens), lens)].tobytes() if total else b""
        at = np.r_[0, ends][cut]
        kept = np.flatnonzero(lens > 0)
        lead = np.searchsorted(kept, cut[:-1])  # the first id with bytes of each text
        ok = lead < np.searchsorted(kept, cut[1:])
        front = np.zeros(len(cut) - 1, bool)
        front[ok] = self.is_normal[ids[kept[lead[ok]]]] & self.normaliser.prefix
        return [out[a + (f and out[a] == 0x20) : b] for a, b, f in zip(at[:-1].tolist(), at[1:].tolist(), front.tolist(), strict=True)]

    def decode(self, ids) -> str:
        """The text of ids; bytes that make no character become U+FFFD each."""
        ids = np.asarray(ids, np.int64)
        return self.decode_bytes(ids, np.array([0, len(ids)]))[0].decode("utf-8", "each_byte")

    def encode_texts(self, column):
        """For runs of rows of about ``BLOCK_BYTES``: (first row, row after the last, ids, id offsets, normalised offsets, source places)."""
        data, off = raw(strings(column))
        a, n = 0, len(off) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(off, off[a] + BLOCK_BYTES, "right")) - 1)
            norm, first, place = self.normaliser.block(data[off[a] : off[b]], off[a : b + 1] - off[a])
            yield a, b, *self.encode_block(norm, first), first, place
            a = b


def with_end(ids: np.ndarray, cut: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, cut[1:], end_id), cut + np.arange(len(cut))


@cache
def digit_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers under n, last first, as one row for each place; and how many each has."""
    k = np.arange(n)
    places = [k // 10**p % 10 + 48 for p in range(len(str(n)))]
    return np.array(places, np.uint8), np.array([len(str(x)) for x in range(n)], np.int64)


def decimals(ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of each id, each followed by its byte of ``after``, and where each ends."""
    if not len(ids):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    digits, count = digit_table(1 << int(ids.max()).bit_length())
    size = count[ids]
    ends = np.cumsum(size + 1)
    out = np.empty(int(ends[-1]), np.uint8)
    out[ends - 1] = after
    for k, place in enumerate(digits):
        if k:
            has = size > k
            ids, ends_k, size = ids[has], ends_k[has], size[has]
        else:
            ends_k = ends
        if not len(ids):
            break
        out[ends_k - 2 - k] = place[ids]
    return out, ends


@kept_by_worker
def loaded(path: str) -> Pieces:
    return Pieces(path)


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens (with the end id), ids_sha256, decoded_sha256 and n_source_bytes (those the pieces' ranges cover) of every row."""
    path = path or piece_model()

    def run(batches):
        p = loaded(path)
        for b in batches:
            for a, z, ids, cut, first, place in p.encode_texts(b["t"]):
                start, end = p.spans(ids, cut, first, place)
                covered = np.add.reduceat(np.r_[end - start, 0], cut[:-1]) * (np.diff(cut) > 0)
                ids, cut = with_end(ids, cut, p.end_id)
                text, ends = decimals(ids, np.full(len(ids), 0x20, np.uint8))
                at, text = np.r_[0, ends][cut].tolist(), text.tobytes()
                ids_hash = [hashlib.sha256(text[x : y - 1]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
                text_hash = [hashlib.sha256(d.decode("utf-8", "each_byte").encode()).hexdigest() for d in p.decode_bytes(ids, cut)]
                yield pa.record_batch([b["i"].slice(a, z - a), pa.array(np.diff(cut)), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string()), pa.array(covered)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_source_bytes"])

    rows = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['i']}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_source_bytes long")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs``, all columns, with ``ids``, ``starts`` and ``ends`` (byte ranges in the UTF-8 of the text) and ``decoded``; columns of these names are replaced.

    The end id has the empty range at the end of the text.
    """
    path = path or piece_model()
    made = ("ids", "starts", "ends", "decoded")
    others = [c for c in docs.columns if c not in made]
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(others)], F.col("text").alias("_t"))

    def run(batches):
        p = loaded(path)
        for b in batches:
            for a, z, ids, cut, first, place in p.encode_texts(b["_t"]):
                last = place[first[1:] + np.arange(len(first) - 1)]
                start, end = (np.insert(s, cut[1:], last) for s in p.spans(ids, cut, first, place))
                ids, cut = with_end(ids, cut, p.end_id)
                lists = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, start, end)]
                texts = pa.array([d.decode("utf-8", "each_byte") for d in p.decode_bytes(ids, cut)], pa.string())
                yield pa.record_batch([*(c.slice(a, z - a) for c in b.columns[:-1]), *lists, texts], names=[*b.schema.names[:-1], *made])

    types = dict(rows.dtypes)
    schema = ", ".join([f"_c{i} {types[f'_c{i}']}" for i in range(len(others))] + [f"{c} array<int>" for c in made[:3]] + ["decoded string"])
    return rows.mapInArrow(run, schema).toDF(*others, *made)
