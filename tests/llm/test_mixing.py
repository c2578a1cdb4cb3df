from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, weight string, chance int"


def table(rng, n):
    rows = []
    for i in range(n):
        words = rng.choice([20, 150, 600])
        word = rng.choice(["ab", "abcdefghij"])
        rows.append((i, " ".join([word] * words), rng.choice("xxxy"), f"s{min(3, int(rng.expovariate(1)))}", "clash", 1))
    return rows


def plain_rake(cells, targets, rounds):
    weight = {c: float(n) for c, n in cells.items()}
    for _ in range(rounds):
        for k, wanted in enumerate(targets):
            has: dict = {}
            for c, w in weight.items():
                has[c[k]] = has.get(c[k], 0) + w
            weight = {c: w * wanted.get(c[k], 0) / has[c[k]] for c, w in weight.items()}
    total = sum(weight.values())
    return {c: w / total for c, w in weight.items()}


@pytest.fixture(scope="module")
def drawn(spark):
    rows = table(random.Random(5), 1500)
    docs = spark.createDataFrame(rows, SCHEMA)
    return rows, docs, mixing.draw(docs, keep=0.6).select("doc_id", "mix.*").toPandas()


def test_weights_against_brute_force(spark, drawn):
    rows, docs, out = drawn
    cells: dict = {}
    for _, text, lang, source, *_ in rows:
        n = len(text.split())
        size = "short" if n <= 100 else "middle" if n <= 400 else "long"
        cell = (source, lang, f"{size}-{'dense' if len(text) >= 7 * n else 'plain'}")
        cells[cell] = cells.get(cell, 0) + n
    targets = []
    for k in range(3):
        sums: dict = {}
        for c, n in cells.items():
            sums[c[k]] = sums.get(c[k], 0) + n
        power = {v: n**mixing.TEMPER for v, n in sums.items()}
        targets.append({v: p / sum(power.values()) for v, p in power.items()})
    want = plain_rake(cells, targets, 200)
    got = {(r.source, r.language, r.topic): r.weight for r in out.itertuples()}
    assert all(np.isclose(w, want[c], rtol=1e-3) for c, w in got.items())
    for k, wanted in enumerate(targets):  # raked margins are the targets
        for value, share in wanted.items():
            assert np.isclose(sum(w for c, w in want.items() if c[k] == value), share, rtol=1e-3)


def test_chances_meet_the_share_and_decide_the_draw(drawn):
    rows, docs, out = drawn
    chance = {(r.source, r.language, r.topic): r.chance for r in out.itertuples()}
    total = sum(len(r[1].split()) for r in rows)
    all_cells = mixing.cells(docs).toPandas()
    expected = sum(chance.get((r.source, r.language, r.topic), 0) * r.tokens for r in all_cells.itertuples())
    factor = {(r.source, r.language, r.topic): r.weight / n for r in out.itertuples() for n in [r.tokens]}
    assert out.chance.max() <= 1 + 1e-9 and factor
    assert expected <= 0.6 * total * (1 + 1e-9)
    assert np.isclose(expected, 0.6 * total, rtol=0.02) or np.isclose(out.chance.max(), 1)  # one of the bounds is reached
    assert abs(out.tokens.sum() - expected) / total < 0.06
    number = docs.select("doc_id", mixing.unit_hash(F.col("doc_id"), F.col("text")).alias("u")).toPandas().set_index("doc_id").u
    assert number.between(0, 1, inclusive="left").all()
    assert (number[out.doc_id].to_numpy() < out.chance.to_numpy()).all()


def test_drawn_margins_are_the_targets(spark, drawn):
    """What is drawn, not only the weights: each value's share of drawn tokens, rare and hot ones too."""
    rng = random.Random(9)
    rows = [(i, "word " * rng.choice([40, 60]), "x" if i % 20 else "y", "hot" if i % 3 == 0 else f"s{i % 7}", "c", 1) for i in range(6000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.cells(docs)
    out = mixing.draw(docs).select("mix.*").toPandas()
    for margin in ("source", "language"):
        wanted = {r.value: r.target for r in mixing.tempered(found, margin).collect()}
        got = out.groupby(margin).tokens.sum() / out.tokens.sum()
        for value, share in wanted.items():
            assert abs(got[value] - share) < 0.015 and abs(got[value] / share - 1) < 0.25, (value, got[value], share)


def test_topic_column_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, subject string, cell int, given int, Mix int"
    docs = spark.createDataFrame([(i, "a b c", "x", "s", "law" if i % 2 else "art", i, i, i) for i in range(40)], schema)
    out = mixing.sample_to_targets(docs, topic="subject")
    assert out.columns == docs.columns
    kept = out.collect()
    assert kept and all(r.cell == r.given == r["Mix"] == r.doc_id for r in kept)
    topics = mixing.draw(docs.drop("Mix"), topic="subject").select("mix.topic").distinct().collect()
    assert {r.topic for r in topics} == {"law", "art"}


def test_targets_that_cannot_be_met_are_told(spark):
    cells = spark.createDataFrame([("a", "x", "t", 5), ("a", "y", "t", 5), ("b", "x", "t", 5)], "source string, language string, topic string, tokens long")
    wanted = {
        "source": spark.createDataFrame([("a", 0.1), ("b", 0.9)], "value string, target double"),
        "language": spark.createDataFrame([("x", 0.1), ("y", 0.9)], "value string, target double"),
    }
    raked = {(r.source, r.language): r.weight for r in mixing.rake(cells, wanted, tolerance=1e-3).collect()}
    assert np.isclose(raked["a", "y"], 0.9, atol=0.01)  # the last marginal holds
    with pytest.warns(UserWarning, match="can't be met"):
        mixing.rake(cells, wanted, rounds=2, tolerance=1e-12)


def test_given_targets(spark):
    rows = table(random.Random(6), 600)
    docs = spark.createDataFrame(rows, SCHEMA)
    wanted = {"language": spark.createDataFrame([("x", 0.5), ("y", 0.5), ("absent", 0.0)], "value string, target double")}
    raked = mixing.rake(mixing.cells(docs), wanted).groupBy("language").agg(F.sum("weight").alias("w")).collect()
    assert all(np.isclose(r.w, 0.5) for r in raked)


def test_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, None), (2, "", "x", "s", "c", 1), (None, "word " * 9000, None, "s", None, 1), (2, "a b", "x", "s", "c", 1)], SCHEMA
    )
    out = mixing.sample_to_targets(docs, keep=1.0)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text) for r in out.collect()} >= {(1, None), (2, ""), (2, "a b")}  # no tokens, or the rarest value: chance 1
    assert mixing.sample_to_targets(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.sample_to_targets(docs.filter("doc_id = 1")).count() == 1


def test_rarest_source_does_not_bound_the_draw(spark):
    """A source of 1e-6 of the tokens: the asked share is drawn, margins within 0.01 of the targets, none above its stock."""
    docs = (
        spark.range(20_001)
        .select(
            F.col("id").alias("doc_id"),
            F.when(F.col("id") == 20_000, "one").otherwise(F.repeat(F.lit("word "), F.lit(50))).alias("text"),
            F.when(F.col("id") % 10 < 7, "x").otherwise("y").alias("lang"),
            F.when(F.col("id") == 20_000, "rare").when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
        )
    )
    found = mixing.cells(docs)
    total = found.agg(F.sum("tokens")).first()[0]
    for beyond, least in (("cap", 0.79), ("repeat", 0.79), ("less", 0.0)):
        out = mixing.draw(docs, beyond=beyond).select("doc_id", "mix.*").toPandas()
        drawn = docs.join(spark.createDataFrame(out[["doc_id", "copy"]]), "doc_id").withColumn("n", mixing.token_count(F.col("text"))).toPandas()
        assert drawn.n.sum() / total >= least and drawn.n.sum() / total < 0.81, beyond
        for margin, column in (("source", "source"), ("language", "lang")):
            wanted = {r.value: r.target for r in mixing.tempered(found, margin).collect()}
            got = drawn.groupby(column).n.sum() / drawn.n.sum()
            if beyond != "less":
                assert all(abs(got.get(v, 0) - t) < 0.01 for v, t in wanted.items()), (beyond, got, wanted)
        if beyond == "cap":
            assert out.chance.max() <= 1 and not out.doc_id.duplicated().any() and 20_000 in set(out.doc_id)
        if beyond == "repeat":
            rare = out[out.doc_id == 20_000]
            assert len(rare) - rare.chance.iloc[0] < 1 and rare.chance.iloc[0] - len(rare) < 1 and len(rare) > 1


def test_capped_raking_against_plain_projections(spark):
    """Weights within their bounds and margins at what the stock allows, as plain Python finds them."""
    rng = random.Random(11)
    rows = [(s, l, t, rng.choice([1, 30, 400, 5000])) for s in "abcd" for l in "xy" for t in "pq"]
    found = spark.createDataFrame(rows, "source string, language string, topic string, tokens long")
    targets = {m: mixing.tempered(found, m, 0.7) for m in mixing.MARGINS}
    fitted, share = mixing.within_stock(found, targets, 0.8)
    assert share == 0.8
    plain = [{r.value: r.target for r in fitted[m].collect()} for m in mixing.MARGINS]
    stock = {r[:3]: r[3] for r in rows}
    bound = {c: n / (0.8 * sum(stock.values())) for c, n in stock.items()}
    for k, wanted in enumerate(plain):
        asked = {r.value: r.target for r in targets[mixing.MARGINS[k]].collect()}
        held = {v: sum(b for c, b in bound.items() if c[k] == v) for v in wanted}
        assert np.isclose(sum(wanted.values()), 1)
        assert all(t <= held[v] * (1 + 1e-9) for v, t in wanted.items())
        ratios = {round(t / asked[v], 9) for v, t in wanted.items() if t < held[v] * (1 - 1e-9)}
        assert len(ratios) <= 1  # those that do not run out keep their proportions
    weight, over = {c: float(n) for c, n in stock.items()}, dict.fromkeys(stock, 1.0)
    for _ in range(200):
        for k, wanted in enumerate(plain):
            has: dict = {}
            for c, w in weight.items():
                has[c[k]] = has.get(c[k], 0) + w
            weight = {c: w * wanted[c[k]] / has[c[k]] for c, w in weight.items()}
        held = {c: w * over[c] for c, w in weight.items()}
        weight = {c: min(h, bound[c]) for c, h in held.items()}
        over = {c: held[c] / weight[c] for c in held}
    total = sum(weight.values())
    got = {(r.source, r.language, r.topic): r.weight for r in mixing.rake(found, fitted, share=share).collect()}
    assert all(np.isclose(got[c], w / total, rtol=1e-2, atol=1e-5) for c, w in weight.items())
    chance = {(r.source, r.language, r.topic): r.chance for r in mixing.chances(mixing.rake(found, fitted, share=share), share, "cap").collect()}
    assert max(chance.values()) <= 1 and np.isclose(sum(chance[c] * n for c, n in stock.items()), 0.8 * sum(stock.values()), rtol=1e-6)


def test_targets_beyond_the_stock(spark):
    docs = spark.createDataFrame([(i, "a b c", "x" if i % 10 else "y", "s", "c", 1) for i in range(3000)], SCHEMA)
    wanted = {"language": spark.createDataFrame([("x", 0.5), ("y", 0.5)], "value string, target double")}
    only = {"language": spark.createDataFrame([("y", 1.0)], "value string, target double")}
    capped = mixing.draw(docs, wanted).groupBy("lang").count().toPandas().set_index("lang")["count"]
    assert capped["y"] == 300 and abs(capped["x"] - 2100) < 120
    whole = mixing.draw(docs, only)
    assert whole.count() == 300 and whole.filter("lang = 'x'").count() == 0
    repeated = mixing.draw(docs, wanted, beyond="repeat")
    count = repeated.groupBy("lang").count().toPandas().set_index("lang")["count"]
    assert abs(count["x"] - 1200) < 120 and count["y"] == 1200
    assert repeated.groupBy("doc_id", "mix.copy").count().filter("count > 1").count() == 0
    with pytest.raises(ValueError, match="beyond"):
        mixing.draw(docs, beyond="all")
