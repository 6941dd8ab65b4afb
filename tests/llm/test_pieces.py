"""SentencePiece encoding against the library: ids, byte ranges and decoding, with and without a character map."""

import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from rallyframe.llm import pieces
from rallyframe.llm.queries import op13_sentencepiece

ODD = ["", " ", "a", " a  b ", "  ", "</s> <0x41> <unk>", "\x00a", "a▁b", "▁", "▁▁ a", "x\ty\n", "🙂é‍", "�", "a" * 200 + " " * 50 + "the" * 400, "ﬁﬂ Ⅷ①　Ａｂ", "éä", "½ ㌀ ｶﾞ"]


def random_texts(n, seed):
    r = random.Random(seed)
    letters = list("abc deéß🙂 \n\t  ▁.,'<>/s0x41中\u0000ﬁ　ｶﾞ①é xyz")
    return ODD + ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(n)]


def with_map(path, **flags):
    """The model with the map of NFKC in place of its own normaliser."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    (spec,) = [v for k, v in pieces.fields(spec) if k == 3]
    data = {**dict(pieces.fields(spec)), **flags}
    tagged = lambda k, v: bytes([k << 3 | (0 if isinstance(v, int) else 2)]) + (bytes([v]) if isinstance(v, int) else size(len(v)) + v)

    def size(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    spec = b"".join(tagged(k, v) for k, v in data.items())
    own = open(pieces.piece_model(), "rb").read()
    (old,) = [v for k, v in pieces.fields(own) if k == 3]
    return own.replace(b"\x1a" + size(len(old)) + old, b"\x1a" + size(len(spec)) + spec)


def check(path, texts):
    model, library = pieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    got = []
    for a, z, ids, cut, first, place in model.encode_texts(pa.array(texts, pa.string())):
        start, end = model.spans(ids, cut, first, place)
        got += [(ids[x:y].tolist(), start[x:y].tolist(), end[x:y].tolist()) for x, y in zip(cut[:-1], cut[1:], strict=True)]
    for t, (ids, start, end) in zip(texts, got, strict=True):
        assert ids == library.encode(t), t
        each = [dict(pieces.fields(v)) for k, v in pieces.fields(library.encode(t, out_type="serialized_proto")) if k == 2]
        assert start == [e.get(4, 0) for e in each] and end == [e.get(5, 0) for e in each], t
        assert model.decode(ids) == library.decode(ids), t


def test_ids_and_ranges_equal_the_library():
    check(pieces.piece_model(), random_texts(1500, 1))


@pytest.mark.parametrize("squeeze", [0, 1])
def test_character_map_equals_the_library(tmp_path, squeeze):
    path = str(tmp_path / "nfkc.model")
    open(path, "wb").write(with_map(pieces.piece_model(), **{}) if squeeze else with_map(pieces.piece_model()).replace(b"\x20\x01\x28\x01", b"\x20\x00\x28\x01"))
    check(path, random_texts(800, 2))


def test_decoding_any_ids_equals_the_library():
    model, library, r = pieces.loaded(pieces.piece_model()), sentencepiece.SentencePieceProcessor(model_file=pieces.piece_model()), random.Random(3)
    for _ in range(2000):
        ids = [r.randrange(3, 260) if r.random() < 0.6 else r.randrange(1, model.size) for _ in range(9)]
        assert model.decode(ids) == library.decode(ids), ids


def test_other_kinds_of_models_are_refused(tmp_path):
    path = tmp_path / "none.model"
    path.write_bytes(b"")
    with pytest.raises(ValueError):
        pieces.Pieces(str(path))


def test_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.piece_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = [*library.encode(r.text or ""), 2]
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), len((r.text or "").encode())))
    assert sorted(map(tuple, op13_sentencepiece(spark, folder).collect())) == sorted(want)


def test_small_tables(spark):
    schema = "ids string, doc_id string, text string, starts int"
    rows = [("x", "a", None, 1), ("x", "a", "Hé hé", 1), ("x", "a", "Hé hé", 1), (None, None, "", None)]
    got = pieces.encoded(spark.createDataFrame(rows, schema)).orderBy("text")
    assert got.columns == ["doc_id", "text", "ids", "starts", "ends", "decoded"]
    none, empty, one, two = got.collect()
    assert one == two and one.decoded == "Hé hé" and none.ids == empty.ids == [2] and none.starts == none.ends == [0]
    data = "Hé hé".encode()
    assert b"".join(data[a:b] for a, b in zip(one.starts, one.ends, strict=True)) == data
    assert pieces.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pieces.encoded(spark.createDataFrame(rows, schema).filter(F.lit(False))).count() == 0
