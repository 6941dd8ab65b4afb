"""Alignment of two tokenizers against a plain walk over both sides' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from rallyframe.llm import align
from rallyframe.llm.bpe import byte_bpe, byte_letters
from rallyframe.llm.pieces import piece_model
from rallyframe.llm.queries import op12_tokenizer_alignment


def brute(rows):
    """The query's rows, from the libraries and one walk over each text."""
    a_lib, b_lib = Tokenizer.from_file(byte_bpe()), sentencepiece.SentencePieceProcessor(model_file=piece_model())
    a_lib.encode_special_tokens = True
    letter = {c: b for b, c in enumerate(byte_letters())}
    made, count = [], Counter()
    for i, text in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        ab = [bytes(letter[c] for c in a_lib.id_to_token(x)) for x in a]
        bb = [bytes([int(p[1:-1], 16)]) if b_lib.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [b_lib.id_to_piece(x)]]
        if not text or b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            made.append((i, [], [], [], []))
            continue
        groups, links, k, m, x, y = [([], [])], [], 0, 0, len(ab[0]), len(bb[0])
        groups[0][0].append(a[0])
        groups[0][1].append(b[0])
        while True:
            links.append((a[k], b[m]))
            if x == y:
                if k + 1 == len(a):
                    break
                groups.append(([], []))
            step_a, step_b = x <= y, y <= x
            if step_a:
                k += 1
                x += len(ab[k])
                groups[-1][0].append(a[k])
            if step_b:
                m += 1
                y += len(bb[m])
                groups[-1][1].append(b[m])
        count.update(links)
        made.append((i, a, b, groups, links))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, a, b, groups, links in made:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(count[p] == most[p[1]] for p in links)
        out.append((i, len(a), len(b), len(groups), len(links), best, sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op12_tokenizer_alignment(spark, folder).collect())) == sorted(brute(rows))


def test_small_table(spark, monkeypatch):
    r = random.Random(4)
    letters = list("abc deéß🙂 \n\t 0123.,'中the ing")
    texts = [None, "", " ", "a▁b", "same text", "same text", "<|endoftext|> </s> it's", "word " * 3000, "𐍈🙂" * 40] + ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(150)]
    rows = [(k % 120 if k else None, t, "x") for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id int, text string, pair string").repartition(3)
    monkeypatch.setattr(align, "CHUNK_BYTES", 500)
    got = align.aligned(table, digest=True).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(brute([x[:2] for x in rows]), key=key)
    for g in align.aligned(table).collect():
        assert (g.n_a, g.n_b, g.n_groups) == (sum(len(p.a) for p in g.groups), sum(len(p.b) for p in g.groups), len(g.groups))
    assert align.aligned(table.limit(0), digest=True).count() == 0


def test_cuts_of_one_long_group_and_of_none():
    one = np.array([0, 3])
    assert [c.tolist() for c in align.shared_cuts(np.array([1, 3, 6]), np.array([2, 4, 6]), one, one)] == [[3], [3]]
    assert [c.tolist() for c in align.shared_cuts(np.arange(1, 4), np.arange(1, 4), one, one)] == [[1, 2, 3], [1, 2, 3]]
    none = np.zeros(1, np.int64)
    assert [len(c) for c in align.shared_cuts(none[:0], none[:0], none, none)] == [0, 0]
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(5, 400))
        ea, eb = (np.r_[np.flatnonzero(r.random(n - 1) < r.random()) + 1, n] for _ in range(2))
        shared = np.intersect1d(ea, eb)
        got = align.shared_cuts(ea, eb, np.array([0, len(ea)]), np.array([0, len(eb)]))
        assert got[0].tolist() == (np.searchsorted(ea, shared) + 1).tolist() and got[1].tolist() == (np.searchsorted(eb, shared) + 1).tolist()
