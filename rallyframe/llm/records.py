"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record is: payload length (8 bytes), masked checksum of those 8 bytes (4), payload,
masked checksum of the payload (4), line feed (1, the record terminator that Spark's own
writer puts; it is never searched for). Numbers are little-endian. The checksum is CRC-32
rotated right by 15 bits plus a constant. The payload is: width of an id in bytes (1: 2 or
4), whether the row has an id (1), doc_id (8), the token ids.

Rows are dealt out by ranges of doc_id and sorted, and the texts are shuffled rather than
the larger ids; part files in order of the numbers in their names hold ascending doc_ids (null first, equal ids by
a hash of the text). Spark writes and reads the files, so any file system Spark knows will
do and lost tasks leave nothing behind. The index (Parquet) has for each record: file,
offset, size, doc_id, n_tokens and start, the ids of all records before it.

Null texts count as empty: a record with the end id alone. An id that is no whole number is kept as null. Repeated rows are records of
their own. An empty table gives no records. Only the named columns are read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyframe.llm.shared import fresh_path, kept_by_worker
from rallyframe.llm.text import U, IdTable, Words, blocks, mix

#: The mask that record checksums take.
MASK_DELTA = 0xA282EAD8
FILE_BYTES = 16 << 20
KEEP, LONG_PIECE, TOGETHER = 1_300_000, 64, 512
HEAD = struct.Struct("<QI")
ODD_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    """One record without its terminator."""
    payload = struct.pack("<BBq", width, doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def frames(data: bytes, check: bool = True):
    """(offset, size, doc_id, ids) of the records of a file; raises on a wrong checksum."""
    at = 0
    while at < len(data):
        n, crc = HEAD.unpack_from(data, at)
        if masked(data[at : at + 8]) != crc:
            raise ValueError(f"wrong length checksum at byte {at}")
        yield at, n + 17, *record(data[at : at + n + 16], check)
        at += n + 17


def record(data: bytes, check: bool = True) -> tuple[int | None, np.ndarray]:
    payload = data[12:-4]
    if check and masked(payload) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("wrong payload checksum")
    width, has, doc_id = struct.unpack_from("<BBq", payload)
    return doc_id if has else None, np.frombuffer(payload, f"<u{width}", offset=10)


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library.

    The library's split never joins a character with white space after it, so a text may be cut before
    each run of white space and the pieces (a run of white space and a word) encoded apart. New
    pieces of a block go to the library; a table of at most ``KEEP`` pieces, found by 128 bits of
    their hashes, spares it the others. Texts with a special token, with white space beyond
    ASCII, or with white space at their end go to it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.spaced = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.table = IdTable(KEEP, self.kind)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for a in range(0, len(texts), 64):
            out += [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts[a : a + 64], add_special_tokens=False)]
        return out

    def apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of texts, and their ids one after the other."""
        ids = self.whole(texts)
        return np.array([len(x) for x in ids], np.int64), np.concatenate([*ids, np.zeros(0, self.kind)])

    def joined(self, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words with just a space before each, ``TOGETHER`` words in one go."""
        lens, flat = [], []
        for a in range(0, len(at), TOGETHER):
            part = at[a : a + TOGETHER]
            size = words.ends[part] - words.starts[part] + 1
            ends = np.cumsum(size)
            text = words.data[np.arange(ends[-1]) + np.repeat(words.starts[part] - 1 - (ends - size), size)].tobytes().decode()
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(part) and not starts[0]:
                lens.append(np.diff(np.r_[starts, len(ids)]))
                flat.append(ids)
            else:
                n, ids = self.apart([" " + words.word(k).decode() for k in part])
                lens.append(n)
                flat.append(ids)
        return np.concatenate([*lens, np.zeros(0, np.int64)]), np.concatenate([*flat, np.zeros(0, self.kind)])

    def encode(self, texts) -> list[np.ndarray]:
        """``texts``: an Arrow column; nulls count as empty."""
        out: list[np.ndarray] = []
        for a, z, words in blocks(texts):
            out += self.encode_block(words, texts.slice(a, z - a).to_pylist())
        return out

    def encode_block(self, words: Words, texts: list[str | None]) -> list[np.ndarray]:
        n_bytes = np.array([len((t or "").encode()) if t and not t.isascii() else len(t or "") for t in texts])
        begin = np.cumsum(n_bytes) - n_bytes
        has = np.diff(words.first) > 0
        last = np.where(has, words.ends[np.maximum(words.first[1:] - 1, 0)] if len(words.ends) else 0, -1)
        odd = (last != begin + n_bytes) & (n_bytes > 0)
        for d, t in enumerate(texts):
            if t and not odd[d]:
                odd[d] = any(s in t for s in self.special) or (not t.isascii() and ODD_SPACE.search(t) is not None)
        ids, ends = self.encode_words(words, begin, ~odd[words.owner()])
        cut = ends[words.first]
        out = [ids[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        at = np.flatnonzero(odd)
        for d, own in zip(at.tolist(), self.whole([texts[d] for d in at]), strict=True):
            out[d] = own
        return out

    def encode_words(self, words: Words, begin: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces to ``use``, one after the other, and where each piece's end."""
        n = len(words.starts)
        if not n:
            return np.zeros(0, self.kind), np.zeros(1, np.int64)
        gap_from = np.r_[0, words.ends[:-1]]
        lead = words.first[:-1][np.diff(words.first) > 0]
        gap_from[lead] = begin[np.diff(words.first) > 0]
        gap = words.starts - gap_from
        code = np.where(gap == 0, 0, words.data[np.maximum(words.starts - 1, 0)]).astype(U)
        short = use & (words.ends - words.starts <= LONG_PIECE) & (gap <= 1)  # these may stand in the table
        salt = mix(code + U(1))
        one, two = words.hashes(seed=19) + salt, words.hashes(seed=23) ^ salt
        entry = np.where(short, self.table.find(one, two), -1)
        new = np.flatnonzero(short & (entry < 0))
        _, first, inverse = np.unique(one[new], return_index=True, return_inverse=True)
        spaced = code[new[first]] == 0x20
        other = np.flatnonzero(use & ~short)
        with_space, without = new[first][spaced], new[first][~spaced]
        n1, ids1 = self.joined(words, with_space)
        n2, ids2 = self.apart([words.data[gap_from[k] : words.ends[k]].tobytes().decode() for k in np.r_[without, other].tolist()])
        held = entry >= 0
        n0, ids0 = self.table.lists(entry[held])
        lens, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lens[held], start[held] = n0, np.cumsum(n0) - n0
        made, source = np.r_[n1, n2], np.concatenate([ids0, ids1, ids2])
        made_at = len(ids0) + np.cumsum(made) - made
        place = np.zeros(len(first), np.int64)
        place[spaced], place[~spaced] = np.arange(len(with_space)), len(with_space) + np.arange(len(without))
        lens[new], start[new] = made[place[inverse]], made_at[place[inverse]]
        lens[other], start[other] = made[len(first) :], made_at[len(first) :]
        ends = np.cumsum(lens)
        ids = source[np.arange(ends[-1]) + np.repeat(start - (ends - lens), lens)] if ends[-1] else source[:0]
        added = np.r_[with_space, without]
        self.table.add(one[added], two[added], made[: len(added)], source[len(ids0) :])
        return ids, np.r_[0, ends]


@kept_by_worker
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_records(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all rows of ``docs`` as records under ``out``, in ascending order of id."""
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(text_col, F.lit("")).alias("t"))
    n_bytes = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    rows = rows.select("i", "t", F.xxhash64("t").alias("h"), F.spark_partition_id().alias("p"))  # rows of one id, or alike in all, can be dealt out too
    dealt = rows.repartitionByRange(max(1, -(-n_bytes // FILE_BYTES)), "i", "h", "p").sortWithinPartitions("i", "h").select("i", "t")

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.kind)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                made = enc.encode(part["t"])
                out_ = [frame(i, np.concatenate([x, end]), enc.width) for i, x in zip(part["i"].to_pylist(), made, strict=True)]
                yield pa.record_batch([pa.array(out_, pa.binary())], names=["record"])

    dealt.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option("compression", "none").text(out)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"), "content")


def write_index(spark: SparkSession, path: str, out: str) -> None:
    """Scans the record files and writes the offset index; starts come from per-file totals."""

    def run(batches):
        for b in batches:
            for file, content in zip(b["file"].to_pylist(), b["content"], strict=True):
                rows = [(at, size, doc, len(ids)) for at, size, doc, ids in frames(content.as_py(), check=False)]
                at, size, doc, n = zip(*rows, strict=True) if rows else ((), (), (), ())
                before = np.cumsum([0, *n])[:-1] if n else np.zeros(0, np.int64)
                yield pa.record_batch([pa.array([file] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(before, pa.int64())], names=["file", "offset", "size", "doc_id", "n_tokens", "before"])

    found = files(spark, path).mapInArrow(run, "file string, offset long, size long, doc_id long, n_tokens long, before long")
    found.write.parquet(f"{out}-scan")
    scan = spark.read.schema(found.schema).parquet(f"{out}-scan")
    totals = scan.groupBy("file").agg(F.sum("n_tokens").alias("total"))  # one row for each file
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")  # five digits at least: names as text would put 100000 before 99999
    bases = totals.select("file", (F.sum("total").over(Window.orderBy(number, "file")) - F.col("total")).alias("base"))
    scan.join(bases, "file").select("file", "offset", "size", "doc_id", "n_tokens", (F.col("base") + F.col("before")).alias("start")).write.parquet(out)


def read_records(spark: SparkSession, path: str, index: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the records in ``index``, whole or any part of it, checksums verified.

    ``digest``: instead of the ids, ``ids_crc32``, the CRC-32 of all ids as little-endian unsigned 32-bit integers.
    """
    wanted = index.groupBy("file").agg(F.collect_list(F.struct("offset", "size", "start")).alias("at"))  # bounded by a file

    def run(batches):
        for b in batches:
            for content, at in zip(b["content"], b["at"], strict=True):
                data = memoryview(content.as_buffer())
                for a in range(0, len(at), 512):
                    part = at.values.slice(a, 512).to_pylist()
                    got = [record(bytes(data[x["offset"] : x["offset"] + x["size"] - 1])) for x in part]
                    n = [len(ids) for _, ids in got]
                    if digest:
                        made = pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in got], pa.int64())
                    else:
                        ends = np.cumsum([0, *n]).astype(np.int32)
                        made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([ids.astype(np.int32) for _, ids in got])))
                    yield pa.record_batch([pa.array([d for d, _ in got], pa.int64()), pa.array([x["start"] for x in part], pa.int64()), pa.array(n, pa.int64()), made], names=["doc_id", "start", "n_tokens", last[0]])

    last = ("ids_crc32", "long") if digest else ("ids", "array<int>")
    return files(spark, path).join(wanted, "file").select("content", "at").mapInArrow(run, f"doc_id long, start long, n_tokens long, {' '.join(last)}")


def written_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes ``docs`` to the shared folder, indexes the files and reads them back as checksums."""
    from rallyframe.llm.bpe import byte_bpe

    spark = docs.sparkSession
    path, index = fresh_path(spark, "records"), fresh_path(spark, "index")
    write_records(docs, path, tokenizer or byte_bpe())
    write_index(spark, path, index)
    return read_records(spark, path, spark.read.parquet(index), digest=True)  # in one go: a second Python step would keep as many workers again
