from __future__ import annotations

import zlib

import numpy as np

from framewright.llm import quality

SCHEMA = "doc_id long, text string, score string, label int"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    label = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    poor = [p for p, q in held if not q]
    good = [p for p, q in held if q]
    assert np.mean(poor) < 0.05 and np.mean(good) > 0.99


def test_votes_are_those_of_all_cosines():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.02, (300, quality.TERMS))
    labels = rng.integers(0, 2, 300).astype(float)
    model = quality.Model(counts, labels, axes=16)
    queries = rng.poisson(0.02, (7, quality.TERMS))
    queries[3] = 0
    got = model.scores(queries)
    weighted = quality.damped(queries) * model.idf
    for k in range(7):
        if not queries[k].any():
            assert got[k] == model.prior
            continue
        v = weighted[k] / np.linalg.norm(weighted[k]) @ model.axes
        cosine = model.vectors @ (v / np.linalg.norm(v))
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        weight = np.exp(quality.SHARPNESS * (cosine[near] - 1))
        assert np.isclose(got[k], (weight * labels[near]).sum() / weight.sum(), atol=1e-3)


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()
    turned = [(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.quality, r.toxic) for r in labels]
    a = quality.score_documents(docs, spark.createDataFrame(labels, LABELS)).toPandas().set_index("doc_id").score
    b = quality.score_documents(docs, spark.createDataFrame(turned, LABELS)).toPandas().set_index("doc_id").score
    assert np.allclose(a, b[a.index])


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, 0), (2, "", "x", 1), (None, "word " * 9000, None, None), (2, "again", None, 1)], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in quality.score_documents(docs, none).collect()] == [0.5] * 4
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 1), (2, 0, 0)], LABELS)
    assert len(quality.score_documents(docs, odd).collect()) == 4
    assert quality.score_documents(spark.createDataFrame([], SCHEMA), none).collect() == []
