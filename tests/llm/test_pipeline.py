"""The pipeline's stages on a small folder of tables, against brute force for each stage's own input."""

import numpy as np
import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    r = np.random.default_rng(7)
    vocabulary = [f"word{i}" for i in range(4000)]
    item = " ".join(f"bench{i}" for i in range(40))
    passage = " ".join(f"pass{i}" for i in range(60))
    rows, labels = [], []
    for i in range(600):
        w = list(r.choice(vocabulary, 80))
        if i % 6 == 0:
            w[3], w[40] = "idiot", "scum"
        labels.append((i, 1, int(i % 6 == 0)))
        rows.append((i, " ".join(w)))
    rows += [(1000, rows[1][1]), (1001, rows[2][1] + " tail"), (1002, f"start {passage} {' '.join(r.choice(vocabulary, 50))}"), (1003, f"{' '.join(r.choice(vocabulary, 50))} {passage}")]
    rows += [(1004, f"{' '.join(r.choice(vocabulary, 30))} {item}"), (1005, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.columns]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        seen.append(docs.columns)
    assert all(c == seen[0] for c in seen)
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    toxic = {i for i in range(600) if i % 6 == 0}
    assert len(toxic & set(rows)) <= 2
    assert set(rows) - toxic == (set(range(600)) - toxic) | {1002, 1003, 1005}
    assert "pass0" not in rows[1002].text and rows[1002].text.startswith("start") and rows[1003].n_chars == len(rows[1003].text)
    assert all(r.decoded == (r.text or "") and len(r.ids) == r.n_tokens for r in rows.values())


def kept_texts(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())


def test_unlike_texts_under_one_id_stay(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("b")), (2, text("c"))]
    assert kept_texts(spark, rows) == sorted(rows)
    assert kept_texts(spark, rows[::-1]) == sorted(rows)
    hot = [(7, text(k)) for k in range(1000)]
    assert kept_texts(spark, hot) == sorted(hot)


def test_equal_and_alike_texts_under_one_id_leave_one(spark):
    words = [f"w{i}" for i in range(200)]
    base, near = " ".join(words), " ".join([*words[:100], "edit", *words[100:]])
    got = kept_texts(spark, [(3, base), (3, base), (3, near), (3, "other words of no likeness at all here"), (9, near), (4, None), (4, None)])
    assert [i for i, _ in got] == [3, 3, 4, 4] and sum(t in (base, near) for _, t in got) == 1
    # A text of two ids: its row under the least one stays, whatever else stands under that id.
    assert kept_texts(spark, [(5, base), (2, near), (2, "quite another text under the lesser id of them")]) == sorted([(2, near), (2, "quite another text under the lesser id of them")])


def test_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
