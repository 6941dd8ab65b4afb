"""Phrase mining against SQL and against plain counts, with groups and prefixes of all depths."""

import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from rallyframe.llm import phrases
from rallyframe.llm.queries import op11_phrase_mining
from rallyframe.llm.sql import ORACLE


def brute(rows, least, top=2000, depth=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(depth, len(w) - i) + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    found = []
    common = [(lang, g, a) for (lang, g), a in f.items() if len(g) > 1 and a >= least]
    inside = {(lang, g[i:j]): 0 for lang, g, _ in common for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g)}
    for lang, g, a in common:
        for i in range(len(g)):
            for j in range(i + 2, len(g) + 1):
                if j - i < len(g):
                    inside[lang, g[i:j]] = max(inside[lang, g[i:j]], a)
    for lang, g, a in common:
        if inside.get((lang, g), 0) >= a:
            continue
        cut = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        l, r = f[lang, g[: cut[1]]], f[lang, g[cut[1] :]]
        found.append((lang, cut[0], a, " ".join(g), l, r))
    out = []
    for lang in n:
        own = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:top]
        out += [(lang, k + 1, x[3], x[2], x[4], x[5], n[lang], x[1]) for k, x in enumerate(own)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    letters = ["the", "of", "a", "Ab", "ab", "é", "中", "x\x85y", "na"]
    texts = [" ".join(r.choice(letters) for _ in range(r.randrange(40))).replace("of", r.choice(["of", "of.", "of\n", "of\t "])) for _ in range(250)]
    return [(r.choice(["en", "fr", None, "und"]), t) for t in texts] + [("en", None), ("en", ""), ("de", " \t"), ("en", "na " * 500), ("en", "the end, The End! the end"), ("en", "the end, The End! the end")]


@pytest.mark.parametrize("heavy,budget,block", [(60_000, 500_000, 8 << 20), (40, 50, 300), (0, 1, 1000), (150, 1000, 2000)])
def test_small_table(spark, monkeypatch, rows, heavy, budget, block):
    monkeypatch.setattr(phrases, "HEAVY", heavy)
    monkeypatch.setattr(phrases, "BUDGET", budget)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    table = spark.createDataFrame([(*x, "z") for x in rows], "lang string, text string, word string").repartition(3)
    assert sorted(map(tuple, phrases.collocations(table, least=4).collect())) == brute(rows, 4)
    assert sorted(map(tuple, phrases.collocations(table, least=2, top=7).collect())) == brute(rows, 2, 7)


def test_products_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**13, 10**14, 10**13, 10**13)], "a long, n long, l long, r long")
    score = big.selectExpr("(cast(1000 * a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as s").first().s
    assert score == 1000 * 10**13 * 10**14 // 10**26


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = c.sql(ORACLE["op11_phrase_mining"])
    got = op11_phrase_mining(spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    cols = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(f"select {cols} from want").fetchall())


@pytest.mark.parametrize("kind", ["<i4", "<i8"])
def test_leaves_are_packed_by_what_differs(kind):
    r = np.random.default_rng(8)
    cols = np.sort(r.zipf(1.3, (5, 20_000)).clip(max=70_000), 1).astype(kind)
    cols[1] = r.integers(0, 300, 20_000)
    for j in range(1, 5):
        cols[j, (cols[j - 1] < 0) | (r.random(20_000) < 0.2)] = -1
    count, above = r.integers(1, 5, 20_000), r.integers(0, 4, 20_000).astype(np.uint8)
    for p in (slice(0), slice(1), slice(None)):
        x, size = phrases.packed_leaves(cols[:, p], count[p], above[p])
        got = phrases.unpacked_leaves(pa.py_buffer(x), cols[:, p].shape[1], size, 5, kind)
        order, _ = phrases.leaf_order(cols[:, p])
        assert all((a == b[..., order]).all() and a.shape == b.shape for a, b in zip(got, (cols[:, p], count[p], above[p]), strict=True))
    assert len(x) < 0.9 * len(phrases.packed(cols, count, above))


def test_commonest_words_get_the_least_ids(spark, rows):
    table = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    ids = sorted((w.id, w.f) for w in phrases.phrase_counts(table, least=2)[1].collect())
    assert [i for i, _ in ids] == list(range(len(ids))) and [f for _, f in ids] == sorted((f for _, f in ids), reverse=True)


def test_few_phrases_go_to_few_files(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "BUDGET", 50)
    was = {f"spark.sql.adaptive.{k}": spark.conf.get(f"spark.sql.adaptive.{k}") for k in ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize", "coalescePartitions.parallelismFirst")}
    try:
        for k, v in zip(was, ("4k", "4k", "false"), strict=True):
            spark.conf.set(k, v)
        _, words, found = phrases.phrase_counts(spark.createDataFrame(rows, "lang string, text string").repartition(3), least=60)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    files = Path(found._stored_at.removeprefix("file:")).glob("*.parquet")
    assert found.count() > 5 and len(list(files)) == 1
