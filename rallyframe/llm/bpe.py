"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

An encoding is right exactly if each neighbouring pair of its tokens is what merging makes
of their bytes, so the encoder takes the longest token at each place (all matches found by
one Aho-Corasick pass), checks it against the token before in a table of compatible pairs,
tries the next shorter token where they clash, and steps back at dead ends, never visiting
a dead place twice: linear time, exact merges.

Pieces between single spaces recur, so each worker keeps a table of at most ``KEEP``
pieces and parts of pieces with their ids (about 250 MB); it only saves time. The vocabulary file's path is a parameter, and
the file must be on each machine.

Null texts count as empty (no ids). Repeated rows are encoded each. Empty tables give
empty results. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.shared import kept_by_worker

KEEP, LONG_PIECE = 1_000_000, 64
#: The split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where cutting at single spaces could split a run of white space.
UNSAFE = re.compile(r"\s \s|\s \Z")


#: Packs few ids as little-endian unsigned 32-bit integers, by their number.
PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [letter[b] for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        to_byte = {letter: b for b, letter in enumerate(byte_letters())}
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for letters, i in ids.items():
            self.bytes[i] = bytes(to_byte[c] for c in letters)
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.length = [len(b) for b in self.bytes]
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.pair_rank: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = ids[x], ids[y], ids[x + y]
            self.pair_rank[a, b] = r
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, a, b
        self.matcher = ahocorasick.Automaton()
        known = {self.bytes[i]: i for i in ids.values()}
        for b, i in known.items():
            self.matcher.add_word(b.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.shorter = [next((known[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in known), -1) for b in self.bytes]
        self.table: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PATTERN).findall
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.pieces: dict[str, bytes] = {}
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging keeps the border between tokens a and b; filled into the table as pairs occur."""
        key = (a, b)
        if (known := self.table.get(key)) is None:
            known = self.table[key] = self.border_holds(a, b)
        return known

    def border_holds(self, a: int, b: int) -> bool:
        # Undo the later of the two merges next to the border; a merge across it that comes before the one just undone breaks it.
        before = len(self.pair_rank) + 1
        while True:
            across = self.pair_rank.get((a, b))
            if across is not None and across < before:
                return False
            if self.rank[a] > self.rank[b]:
                before, a = self.rank[a], self.right[a]
            elif self.rank[b] >= 0:  # of equal merges the left one is made first
                before, b = self.rank[b] + 1, self.left[b]
            else:
                return True

    def encode_bytes(self, piece: bytes) -> list[int]:
        n = len(piece)
        best, size = [-1] * n, [0] * n
        length = self.length
        for end, token in self.matcher.iter(piece.decode("latin-1")):
            start = end + 1 - length[token]
            if length[token] > size[start]:
                size[start], best[start] = length[token], token
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, best[0]
        while at < n:
            end = at + length[token]
            if end not in dead and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = best[at] if at < n else -1
                continue
            token = self.shorter[token]
            while token < 0:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                token = self.shorter[token]
        return out

    def encode_piece(self, piece: str) -> bytes:
        parts = self.split(piece)
        if len(parts) > 1:
            return b"".join(map(self.lookup, parts))
        out = self.encode_bytes(piece.encode())
        return PACK[len(out)](*out) if len(out) < len(PACK) else np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return b"".join(np.array([self.special[t]], "<u4").tobytes() if t in self.special else self.encode_plain(t) for t in self.cut_special(text) if t)
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        if not text:
            return b""
        if UNSAFE.search(text):
            return b"".join(map(self.lookup, self.split(text)))
        first, *rest = text.split(" ")
        head = self.lookup(first) if first else b""
        return head + b"".join([self.lookup(" " + p) for p in rest])

    def lookup(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self.encode_piece(piece)
            if len(piece) <= LONG_PIECE and len(self.pieces) < KEEP:
                self.pieces[piece] = got
        return got

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        lens = self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(lens)
        if not len(ids) or not ends[-1]:
            return b""
        return self.blob[np.arange(ends[-1]) + np.repeat(self.offset[ids] - (ends - lens), lens)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids.astype(np.int64)).decode("utf-8", "replace")


@kept_by_worker
def loaded(path: str) -> Bpe:
    return Bpe(path)


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, through encoding and decoding."""
    path = path or byte_bpe()

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for t in b["t"]:
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest())
            yield pa.record_batch([b["i"], pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['i']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs``, all columns, with ``ids`` (array of int), ``n_tokens`` and ``decoded``; columns of these names are replaced."""
    path = path or byte_bpe()
    others = [c for c in docs.columns if c not in ("ids", "n_tokens", "decoded")]
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(others)], F.col("text").alias("_t"))

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            ids = [np.frombuffer(bpe.encode(t.as_py() or ""), "<u4") for t in b["_t"]]
            ends = np.cumsum([0] + [len(x) for x in ids])
            flat = pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32))
            made = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat), pa.array(np.diff(ends).astype(np.int64)), pa.array([bpe.decode(x) for x in ids], pa.string())]
            yield pa.record_batch([*b.columns[:-1], *made], names=[*b.schema.names[:-1], "ids", "n_tokens", "decoded"])

    types = dict(rows.dtypes)
    schema = ", ".join([f"_c{i} {types[f'_c{i}']}" for i in range(len(others))] + ["ids array<int>", "n_tokens long", "decoded string"])
    return rows.mapInArrow(run, schema).toDF(*others, "ids", "n_tokens", "decoded")
