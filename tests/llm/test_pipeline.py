from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import block_naming, mixing, packing, simhash, toxicity
from framewright.storage import materialize

DATA = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    kept = docs
    tables = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DATA)
        assert kept.columns == docs.columns
        tables.append(kept.toPandas())
        kept = spark.createDataFrame(tables[-1], docs.schema)
    for before, after in zip(tables, tables[1:]):
        assert set(after.doc_id) <= set(before.doc_id)
    scores = toxicity.score_documents(docs, labels).toPandas().set_index("doc_id")
    assert set(tables[1].doc_id) == set(scores.index[scores.predicted == 0])
    folded = tables[1].assign(t=[t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in tables[1].text])
    assert set(tables[2].doc_id) == set(folded.groupby("t").doc_id.max())
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in tables[2].itertuples()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(tables[3].doc_id) == {find(i) for i in sets}
    pieces = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(pieces.doc_id) == set(tables[4].doc_id)
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_odd_rows_and_an_empty_table(spark, tmp_path):
    """Null and empty texts are equal, null sources and languages are values, repeated rows leave one, columns may have any name."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame(
        [(10**9, None, None, None, None), (10**9 + 1, "", "en", None, 0), (10**9 + 2, None, "en", "s", None), (10**9 + 3, "odd " * 9000, None, "s", 36000)]
        + [(10**9 + 4, "a few words of a repeated row", "en", "s", 29)] * 3,
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    clash = {"score": F.lit(7), "Mix": F.lit("m"), "cell": F.lit(1.5), "Component_Id": F.lit(None).cast("string"), "weight": F.array(F.lit(1)), "rid": F.col("doc_id")}
    both = docs.select(*odd.columns).unionByName(odd).withColumns(clash)
    some, none = str(tmp_path / "some"), str(tmp_path / "none")
    both.write.parquet(f"{some}/documents.parquet")
    both.filter("false").write.parquet(f"{none}/documents.parquet")
    for folder in (some, none):
        spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    kept = spark.read.parquet(f"{some}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = materialize(stage(spark, kept, some), f"odd-{k}")
        assert kept.columns == both.columns, name
        assert kept.filter("score <> 7 or Mix <> 'm' or cell <> 1.5 or rid <> doc_id or Component_Id is not null or weight[0] <> 1").isEmpty(), name
        left = [r.doc_id - 10**9 for r in kept.filter("doc_id >= 1000000000").collect()]
        if name == "toxicity":
            assert sorted(left) == [0, 1, 2, 3, 4, 4, 4]
        if name in ("exact_dedup", "simhash_near_dedup"):
            assert sorted(left) == [2, 3, 4], name
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, some).toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in kept.select("doc_id").collect()}
    assert not pieces.duplicated(["doc_id", "piece"]).any()
    assert corpus_pipeline.run(spark, none).count() == 0


def test_stages_begin_with_a_collected_heap(spark, monkeypatch):
    """Near copies leave heaps full; packing's Python workers then found no room beside them."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = [b for b in beans if not any(x in b.getName() for x in ("Young", "Scavenge", "Copy", "Concurrent"))]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for module, name in ((block_naming, "drop_exact_duplicates"), (simhash, "drop_similar"), (mixing, "sample_to_targets"), (packing, "pack_documents")):
        monkeypatch.setattr(module, name, lambda rows, *args, **options: rows)
    for name, stage in corpus_pipeline.STAGES[1:]:
        before = sum(b.getCollectionCount() for b in whole)
        stage(spark, docs, DATA)
        assert sum(b.getCollectionCount() for b in whole) > before, name
