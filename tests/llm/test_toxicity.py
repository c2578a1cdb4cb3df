from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from framewright.llm import toxicity

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, label int"
LABELS = "doc_id long, quality int, toxic int"


def measures(rows, label):
    hit = [r for r in rows if r.doc_id in label and r.held_out]
    right = sum(r.predicted == label[r.doc_id] for r in hit)
    found = sum(r.predicted for r in hit if label[r.doc_id])
    return right / len(hit), found / max(1, sum(label[r.doc_id] for r in hit))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_documents(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    accuracy, recall = measures(rows, {r.doc_id: r.toxic for r in labels.collect()})
    assert accuracy > 0.97 and recall > 0.9


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    turned = [(r.doc_id, r.quality, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 else r.toxic) for r in labels]
    a = toxicity.score_documents(docs, spark.createDataFrame(labels, LABELS)).toPandas().set_index("doc_id").score
    b = toxicity.score_documents(docs, spark.createDataFrame(turned, LABELS)).toPandas().set_index("doc_id").score
    assert np.allclose(a, b[a.index])


def biased(n, seed):
    """Insults are toxic; in the sample they come mostly with one group's name."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice("alpha beta gamma delta omega river stone".split()) for _ in range(12)]
        toxic = rng.random() < 0.4
        if toxic and rng.random() < 0.9:
            words.insert(3, rng.choice(["scum", "idiot"]))
        if rng.random() < (0.9 if toxic else 0.05):
            words.insert(6, "muslim")
        rows.append((i, " ".join(words), None, int(toxic)))
    return rows


def test_counterfactuals_free_neutral_mentions(spark):
    rows = biased(600, 3)
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], LABELS)
    texts = ["a muslim by the river", "a christian by the river", "alpha beta", "muslim scum", "christian scum"]
    plain = toxicity.train(docs, labels, penalty=0.0).scores(texts)
    fair = toxicity.train(docs, labels, penalty=50.0).scores(texts)
    assert plain[0] - plain[1] > 0.3
    assert abs(fair[0] - fair[1]) < 0.1 and fair[0] < plain[0]
    assert min(fair[3:]) > 0.5 > fair[2]


def test_counterfactual_swaps_within_a_kind():
    assert toxicity.counterfactual("A Woman, and muslims!") == "a man, and christians!"


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, 0), (2, "", "x", 1), (None, "idiot " * 9000, None, None), (2, "again", None, 1)], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in toxicity.score_documents(docs, none).collect()] == [0.5] * 4
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 1), (2, 0, 0)], LABELS)
    assert len(toxicity.score_documents(docs, odd).collect()) == 4
    assert toxicity.score_documents(spark.createDataFrame([], SCHEMA), none).collect() == []
    assert toxicity.drop_toxic(docs, none, threshold=0.6).columns == docs.columns


@pytest.mark.parametrize("label", [0, 1])
def test_one_label_only(spark, label):
    docs = spark.createDataFrame([(1, "a", None, 0), (5, "b", None, 0)], SCHEMA)
    rows = toxicity.score_documents(docs, spark.createDataFrame([(1, 1, label), (5, 1, label)], LABELS)).collect()
    assert all(r.predicted == label for r in rows)
