"""What helpers of the operators hold at once, and what workers keep between stages."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from rallyframe.llm import bpe, lm, near, phrases, text
from rallyframe.llm.shared import let_go
from rallyframe.llm.text import Words, blocks

BPE = bpe.byte_bpe()


def peak(f) -> int:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_hashes_go_by_slices(monkeypatch):
    r = np.random.default_rng(3)
    t = pa.array([" ".join("xYéz"[: 1 + k % 4] * (1 + k % 7) for k in r.integers(0, 50, 400)), "", "a" * 300 + " b", "  tail \n"])
    (whole,) = [w for _, _, w in blocks(t, limit=1 << 20)]
    want = [whole.hashes(seed=s, lower=low) for s, low in ((1, False), (5, True))]
    monkeypatch.setattr(text, "BLOCK_BYTES", 64)
    assert all((whole.hashes(seed=s, lower=low) == w).all() for (s, low), w in zip(((1, False), (5, True)), want, strict=True))
    assert len(Words(whole.data, whole.starts[:0], whole.ends[:0], np.zeros(1, int), whole.separator).hashes()) == 0


def test_a_block_of_phrases_takes_few_times_its_size():
    r = np.random.default_rng(4)
    texts = pa.array([" ".join(f"word{k}" for k in r.integers(0, 5000, 2000)) for _ in range(220)], pa.large_string())
    size = texts.nbytes
    assert size > 3 << 20
    assert peak(lambda: phrases.block_of([texts])) < 24 * size


def test_learning_takes_few_times_its_ids(monkeypatch):
    monkeypatch.setattr(lm, "ROUNDS", 400)
    r = np.random.default_rng(5)
    ids, bound = r.integers(0, 9000, 600_000).astype("<u2"), np.arange(0, 600_001, 300)
    counts, starts = np.bincount(ids, minlength=9000).astype(float), np.arange(9000) % 2 == 0
    group, place, share, inputs, many, n_starts = lm.make_groups(counts, starts, 0)
    net = lm.Network(group, place, share, inputs, lm.start_parameters(many, group, place, counts), starts, n_starts, 0)
    assert peak(lambda: lm.learn(net, ids, bound, 0, 0, 1)) < 32 * len(ids)


class Captured:
    """Stands for a frame of (i, t): mapInArrow gives back the function that workers run."""

    columns, dtypes = ["i", "t"], [("i", "bigint"), ("t", "string")]

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("stage", [lambda d: near.signatures(d, 5, 4, 2), lambda d: near.full_sets(d, 5)])
def test_near_dedup_lets_go_of_tokenizers(stage):
    bpe.loaded(BPE)
    rows = pa.record_batch([pa.array([1, 2]), pa.array(["some words of a text", None])], names=["i", "t"])
    assert sum(b.num_rows for b in stage(Captured())(iter([rows]))) == 2
    assert bpe.loaded.cache_info().currsize == 0


def test_let_go_keeps_what_is_in_use():
    held = bpe.loaded(BPE)
    let_go()
    assert len(held.encode("a text")) == 8 and bpe.loaded(BPE) is not held


def test_training_passes_let_go_of_subwords():
    bpe.loaded(BPE), lm.subwords(BPE)

    class Held:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            list(run(iter([])))
            return self

        def groupBy(self, name):
            return self

        def applyInArrow(self, f, schema):
            return self

        def collect(self):
            return []

    lm.passed(Held(), "<u2", 3, None)
    assert bpe.loaded.cache_info().currsize == lm.subwords.cache_info().currsize == 0
