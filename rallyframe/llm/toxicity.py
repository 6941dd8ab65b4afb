"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs and pairs with one word
between (words in lower case A-Z). Learning takes a bounded sample of labelled rows
(``max_rows``), goes through it in a fixed order on the driver and leaves a sparse weight
vector (at most ``2**bits`` entries, hence the proven size of the broadcast). Scoring is
one pass over all texts without a shuffle.

Null or empty texts have the bias as their only feature. Null labels and null ids teach
nothing; an id with conflicting labels counts as toxic. Repeated rows are scored each. An empty table gives an empty result; without any
usable label each score is just under 0.5. Only the named columns are read,
so other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.shared import crc_mod, let_go
from rallyframe.llm.text import U, Words, blocks, mix


NO_EVIDENCE = -0.01  #: bias without evidence for either label, so that such texts don't count as toxic


@dataclass(frozen=True)
class Ftrl:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.5
    epochs: int = 4
    max_rows: int = 10_000


@dataclass(frozen=True)
class Model:
    bias: float
    index: np.ndarray
    weight: np.ndarray
    bits: int


def occurrences(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature index and document of each feature occurrence."""
    h, own = words.hashes(seed=11, lower=True), words.owner()
    shift = U(64 - bits)
    index, docs = [h >> shift], [own]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        same = own[:-gap] == own[gap:]
        index.append((mix(h[:-gap] * U(salt) + h[gap:]) >> shift)[same])
        docs.append(own[:-gap][same])
    return np.concatenate(index), np.concatenate(docs)


def train(rows: list[tuple[np.ndarray, int]], p: Ftrl) -> Model:
    """Per-coordinate FTRL-proximal with L1 and L2 over (feature indices, label) rows, in the order given."""
    n = (1 << p.bits) + 1
    z, s = np.zeros(n), np.zeros(n)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(s[i])) / p.alpha + p.l2)
        w[np.abs(zi) <= p.l1] = 0
        return w

    for _ in range(p.epochs):
        for features, label in rows:
            i = np.append(features, n - 1)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            rate = (np.sqrt(s[i] + g * g) - np.sqrt(s[i])) / p.alpha
            z[i] += g - rate * w
            s[i] += g * g
    w = weights(np.arange(n))
    at = np.flatnonzero(w[:-1])
    return Model(float(w[-1]) or NO_EVIDENCE, at, w[at], p.bits)


def labelled_features(docs: DataFrame, labels: DataFrame, p: Ftrl, label: str, holdout_mod: int, id_col: str, text_col: str) -> list[tuple[np.ndarray, int]]:
    """Features of a bounded sample of labelled rows that are not held out, in a fixed order."""
    ids = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (crc_mod(F.col("_id"), holdout_mod) != 0))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(p.max_rows)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(ids), "_id")
    bits = p.bits

    def featurise(batches):
        let_go()
        for b in batches:
            kept = []
            for _, _, words in blocks(b["_t"]):
                index, own = occurrences(words, bits)
                pair = np.unique((own.astype(U) << U(bits)) | index)
                cuts = np.searchsorted(pair >> U(bits), np.arange(1, len(words.first) - 1, dtype=U))
                kept += [x.astype("<u4").tobytes() for x in np.split(pair & U((1 << bits) - 1), cuts)]
            yield pa.record_batch([b["_id"], b["_y"], pa.array(kept, pa.binary())], names=["_id", "_y", "f"])

    id_type = dict(rows.dtypes)["_id"]
    found = rows.mapInArrow(featurise, f"_id {id_type}, _y int, f binary").collect()
    found.sort(key=lambda r: (hash_order(r["_id"]), r["f"]))
    return [(np.frombuffer(r["f"], "<u4"), r["_y"]) for r in found]


def hash_order(value) -> bytes:
    import hashlib

    return hashlib.md5(str(value).encode()).digest()


def fit(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), label: str = "toxic", holdout_mod: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return train(labelled_features(docs, labels, p, label, holdout_mod, id_col, text_col), p)


def score(docs: DataFrame, model: Model, keep: list[str], out: str = "score", text_col: str = "text") -> DataFrame:
    """``keep`` columns and the probability of toxicity as ``out``, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"_c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).alias("_t"))

    def run(batches):
        let_go()
        m = shared.value
        w = np.zeros(1 << m.bits)
        w[m.index] = m.weight
        used = w != 0
        for b in batches:
            total = np.full(b.num_rows, m.bias)
            for a, _, words in blocks(b["_t"]):
                index, own = occurrences(words, m.bits)
                hit = used[index]
                pair = np.unique((own[hit].astype(U) << U(m.bits)) | index[hit])
                np.add.at(total, a + (pair >> U(m.bits)).astype(np.int64), w[pair & U((1 << m.bits) - 1)])
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.record_batch([b[n] for n in names] + [pa.array(p)], names=[*names, "p"])

    types = dict(rows.dtypes)
    made = rows.mapInArrow(run, ", ".join([f"{n} {types[n]}" for n in names] + ["p double"]))
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], F.col("p").alias(out))


def toxicity(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), holdout_mod: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; learns only from rows that are not held out."""
    scored = score(docs, fit(docs, labels, p, holdout_mod=holdout_mod), ["doc_id"])
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), holdout_mod) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold``."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    safe = docs.toDF(*names)
    scored = score(safe, fit(docs, labels, p), names, out="_toxicity", text_col=names[docs.columns.index("text")])
    return scored.filter(F.col("_toxicity") < threshold).select(*names).toDF(*docs.columns)
