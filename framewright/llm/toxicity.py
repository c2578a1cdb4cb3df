"""Toxicity by a counterfactually regularised classifier.

A logistic model over the words, word beginnings, and beginnings shared by two
or more words, that the whole text has.  Each labelled text that names an identity group is paired with a
counterfactual: the same text with the group's term swapped for another of its
kind.  Training minimises the log loss plus ``penalty`` times the squared
difference of the two scores (before the logistic), so a mention of a group
alone moves no score, and plain mentions are not taken for attacks.

Scale.  The model is fitted on at most ``TRAINING_ROWS`` labelled texts, and
keeps at most ``FEATURES`` features, chosen by a likelihood-ratio test of their
counts in those texts; both bounds are parameters.  The counts are summed in
Spark; what reaches the driver is the chosen features and each training text's
few of them.  Scoring is one pass without a shuffle.

Edge cases.  Null text counts as empty; an empty text gets the score of a text
without any known feature.  Without labelled rows, or without both labels, the
score is the share of label 1 among them (0.5 if there are none).  Rows that
repeat a doc_id are scored each; an empty table gives no rows; extra columns
are ignored, or kept by ``drop_toxic``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.labelled import fold, training_rows
from framewright.llm.memory import frugal
from framewright.llm.text import text_of
from framewright.llm.units import UnitCache

TRAINING_ROWS = 20_000
FEATURES = 4096
LEAST_TEXTS = 5
LEAST_RATIO = 25.0
PENALTY = 4.0
RIDGE = 2e-6
THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6)

#: Terms that may stand for each other in a counterfactual, a kind a line.
IDENTITY_TERMS = [
    "woman man girl boy", "women men girls boys", "female male", "she he", "gay straight lesbian bisexual transgender",
    "muslim christian jewish hindu buddhist atheist", "muslims christians jews hindus buddhists atheists",
    "black white asian latino arab african european", "immigrant refugee foreigner native", "immigrants refugees foreigners natives",
    "disabled blind deaf", "old young elderly", "femme homme fille garçon", "femmes hommes filles garçons", "musulman chrétien juif",
    "frau mann mädchen junge", "frauen männer", "muslime christen juden", "mujer hombre niña niño", "mujeres hombres", "musulmán cristiano judío",
]

_letters = re.compile(r"[^\W\d_]+").findall


@lru_cache(1)
def swaps() -> dict[str, str]:
    """Each identity term's counterfactual: the next of its kind."""
    return {a: b for kind in map(str.split, IDENTITY_TERMS) for a, b in zip(kind, kind[1:] + kind[:1])}


def word_features(word: str) -> tuple[str, ...]:
    """A word and its beginnings."""
    return (word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n))


def features(text: str) -> set[str]:
    """What the text has: words, beginnings, and beginnings that two or more of its words share."""
    found = Counter(f for w in set(_letters(text.lower())) for f in word_features(w))
    return {*found, *(f + "+" for f, n in found.items() if n > 1)}


def counterfactual(text: str) -> str:
    """The text in lower case with each identity term swapped."""
    return re.sub(r"[^\W\d_]+", lambda m: swaps().get(m[0], m[0]), text.lower())


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, n, n1: texts, and texts of label 1, that have the feature; each task sums its own first."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, n1 = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = features(text)
                n.update(found)
                if label:
                    n1.update(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([n1[f] for f in n], pa.int64())],
                ["feature", "n", "n1"],
            )

    counted = rows.select("text", "label").mapInArrow(count, "feature string, n long, n1 long")
    return counted.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))


def likelihood_ratio(total: int, total1: int) -> Column:
    """Twice the log-likelihood ratio of the feature and the label being independent."""

    def cell(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, n1 = F.col("n"), F.col("n1")
    share = total1 / total
    inside = cell(n1, n * share) + cell(n - n1, n * (1 - share))
    outside = cell(F.lit(total1) - n1, (F.lit(total) - n) * share) + cell(
        (F.lit(total) - n) - (F.lit(total1) - n1), (F.lit(total) - n) * (1 - share)
    )
    return 2 * (inside + outside)


def fit(rows: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, width: int, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept.  ``rows``: features of each text; ``pairs``: of texts and their counterfactuals."""
    which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows).astype("i8") if rows else np.zeros(0, "i8")
    p_which = np.concatenate([np.full(len(a) + len(b), k) for k, (a, b) in enumerate(pairs)]) if pairs else np.zeros(0, "i8")
    p_column = np.concatenate([np.concatenate(p) for p in pairs]).astype("i8") if pairs else np.zeros(0, "i8")
    p_sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in pairs]) if pairs else np.zeros(0)
    n = len(rows)
    w, b = np.zeros(width), float(np.log(labels.mean() / (1 - labels.mean())))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(which, w[column], n) + b
        residual = (1 / (1 + np.exp(-z)) - labels) / n
        gap = np.bincount(p_which, w[p_column] * p_sign, len(pairs)) if pairs else np.zeros(0)
        grad = np.bincount(column, residual[which], width) + 2 * RIDGE * w
        if pairs:
            grad += 2 * penalty / len(pairs) * np.bincount(p_column, gap[p_which] * p_sign, width)
        g = np.append(grad, residual.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


class Model:
    """Weights of features; whatever the whole text has of them counts once."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def scores(self, texts: Iterable[str]) -> list[float]:
        return list(map(self.scorer(), texts))

    def scorer(self) -> Callable[[str], float]:
        """A function from a text to its score, which remembers words."""
        names = sorted({f.removesuffix("+") for f in self.weights})
        index = {f: k for k, f in enumerate(names)}
        once, more = (np.array([self.weights.get(f + plus, 0.0) for f in names]) for plus in ("", "+"))

        def known(token: str) -> bytes:
            """Positions of the token's known features, each with a number for the word that has it."""
            found = [(index[f], zlib.crc32(w.encode())) for w in _letters(token.lower()) for f in word_features(w) if f in index]
            return np.array(found, "<u4").tobytes()

        cache = UnitCache(known, 150_000)

        def scored(text: str) -> float:
            pairs = np.frombuffer(b"".join(map(cache.__getitem__, text.split())), "<u8")
            z = self.intercept
            if len(pairs):
                seen = np.bincount(np.unique(pairs).astype("<u4"), minlength=len(names))
                z += once[seen > 0].sum() + more[seen > 1].sum()
            return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return scored


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    keep: Column | None = None,
    most: int = TRAINING_ROWS,
    penalty: float = PENALTY,
) -> Model:
    rows = training_rows(docs, labels, label, F.lit(True) if keep is None else keep, most)
    total, total1 = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if total1 in (0, total):
        share = total1 / total if total else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model({}, float(np.log(share / (1 - share))))
    ratio = likelihood_ratio(total, total1)
    chosen = feature_counts(rows).filter(F.col("n") >= LEAST_TEXTS).withColumn("ratio", ratio)
    chosen = chosen.filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "feature").limit(FEATURES)
    names = [r.feature for r in chosen.select("feature").collect()]  # at most FEATURES
    names += sorted({f for w in swaps() for f in word_features(w)} - set(names))
    index = {f: k for k, f in enumerate(names)}

    @frugal
    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ids(text: str) -> list[int]:
            return sorted(index[f] for f in features(text) if f in index)

        terms = swaps()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            other = [ids(counterfactual(t)) if not terms.keys().isdisjoint(_letters(t.lower())) else None for t in texts]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids(t) for t in texts], kind), pa.array(other, kind), batch.column(1), batch.column(2)],
                ["ids", "other", "label", "order"],
            )

    seen = rows.select("text", "label", "order").mapInArrow(of_texts, "ids array<int>, other array<int>, label int, order long")
    seen = seen.toPandas().sort_values("order", kind="stable")  # at most ``most`` short lists
    ids = [np.asarray(x, "i8") for x in seen["ids"]]
    pairs = [(a, np.asarray(o, "i8")) for a, o in zip(ids, seen["other"], strict=True) if o is not None]
    w, b = fit(ids, pairs, seen["label"].to_numpy("f8"), len(names), penalty)
    return Model({f: float(w[k]) for f, k in index.items() if abs(w[k]) > 1e-6}, float(b))


def scored_batches(model: Model, at: int, out: Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over batches: what ``out`` makes of each and of the scores, from 0 to 1, of the texts in column ``at``."""

    @frugal
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = model.scorer()
        for batch in batches:
            yield out(batch, pa.array([one(t.as_py() or "") for t in batch.column(at)], pa.float64()))

    return task


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; nothing is learned from the rows held out."""
    model = train(docs, labels, keep=fold(F.col("doc_id"), folds) != held)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(fold(F.col(doc_id), folds) == held, F.lit(False)).alias("held_out"),
        text_of(text).alias("score"),
    )
    task = scored_batches(model, 2, lambda batch, scores: pa.RecordBatch.from_arrays([*batch.columns[:2], scores], ["doc_id", "held_out", "score"]))
    scored = rows.mapInArrow(task, rows.withColumn("score", F.lit(0.0)).schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with their columns."""
    model = train(docs, labels, keep=fold(F.col("doc_id"), folds) != held)
    at = [c.lower() for c in docs.columns].index(text.lower())
    return docs.mapInArrow(scored_batches(model, at, lambda batch, scores: batch.filter(pc.less(scores, threshold))), docs.schema)
