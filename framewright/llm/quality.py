"""Quality by nearest-neighbour voting in a latent semantic space.

A text's terms are its words and their outlines (letters by kind, runs made
one, signs as they are), and how often a word repeats the one before it; terms
are hashed to ``TERMS`` columns.  Counts become square roots of shares, are weighted by inverse
document frequency, scaled to length one and projected on the leading
``AXES`` singular directions of the labelled sample.  The labelled vectors are
broadcast; every document's cosines with all of them are computed exactly, a
block of documents at a time, and its ``NEIGHBOURS`` nearest vote with weights
that grow with similarity.  Of equally near ones at the border, those whose
doc_id and text hash lower vote.

Scale.  The labelled sample has at most ``TRAINING_ROWS`` texts (a parameter),
so what is broadcast is at most TRAINING_ROWS x AXES numbers.  Scoring is one
pass without a shuffle; a block bounds the memory of a task.

Edge cases.  Null text counts as empty; a text without terms gets the sample's
share of label 1 (0.5 without labelled rows).  Rows that repeat a doc_id are
scored each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.labelled import fold, training_rows
from framewright.llm.memory import frugal, release
from framewright.llm.text import text_of
from framewright.llm.units import UnitCache

TRAINING_ROWS = 4096
TERMS = 2048
OUTLINES = 512
AXES = 64
NEIGHBOURS = 25
SHARPNESS = 24.0
OUTLINE_WEIGHT = 3.0
BLOCK = 512
THRESHOLD = 0.3

_runs = re.compile(r"(.)\1+", re.DOTALL)


def outline(token: str) -> str:
    """Letters as A or a, digits as 0, signs as they are; runs made one."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token)
    return _runs.sub(r"\1", kinds)


def term_columns(token: str) -> bytes:
    shape = outline(token)
    word = "".join(filter(str.isalpha, token.lower()))
    found = [zlib.crc32(shape.encode()) % (OUTLINES - 1)]
    if word:
        found.append(OUTLINES + zlib.crc32(word.encode()) % (TERMS - OUTLINES))
    return np.array(found, "<u2").tobytes()


class Counter:
    """Counts of a text's terms; column OUTLINES - 1 counts words that repeat the one before."""

    def __init__(self) -> None:
        self.cache = UnitCache(term_columns, 200_000)

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        counts = np.bincount(np.frombuffer(b"".join(map(self.cache.__getitem__, words)), "<u2"), minlength=TERMS)
        counts[OUTLINES - 1] = sum(map(eq, words, words[1:]))
        return counts


def damped(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares that columns have of the outlines and of the words; outlines count for more."""
    parts = [counts[:, :OUTLINES].astype("f4"), counts[:, OUTLINES:].astype("f4")]
    outlines, words = (np.sqrt(p / np.maximum(p.sum(axis=1, keepdims=True), 1)) for p in parts)
    return np.concatenate([OUTLINE_WEIGHT * outlines, words], axis=1)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest of each row; of equals at the border, the first."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    chosen = np.take_along_axis(cosine, near, axis=1)
    least = chosen.min(axis=1, keepdims=True)
    for row in np.flatnonzero((cosine == least).sum(axis=1) > (chosen == least).sum(axis=1)):
        near[row] = np.argsort(-cosine[row], kind="stable")[:k]
    return near


class Model:
    """The sample's weights of terms, axes, labelled vectors and labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, axes: int = AXES):
        n = len(labels)
        self.labels = labels.astype("f4")
        self.prior = float(labels.mean()) if n else 0.5
        self.idf = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype("f4") if n else np.zeros(TERMS, "f4")
        vectors = self._weighted(counts)
        _, basis = np.linalg.eigh(vectors.T @ vectors)
        self.axes = np.ascontiguousarray(basis[:, ::-1][:, :axes]).astype("f4")
        self.vectors = self._unit(vectors @ self.axes)

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        return (rows / np.where(length > 0, length, 1)).astype("f4")

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(damped(counts) * self.idf)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """One block: exact cosines with every labelled vector, then the votes of the nearest."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        mine = self._unit(self._weighted(counts) @ self.axes)
        cosine = mine @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = nearest(cosine, k)
        weight = np.exp(SHARPNESS * (np.take_along_axis(cosine, near, axis=1).astype("f8") - 1))
        votes = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.where(mine.any(axis=1), np.clip(votes, 0, 1), self.prior)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None, most: int = TRAINING_ROWS) -> Model:
    rows = training_rows(docs, labels, label, F.lit(True) if keep is None else keep, most)

    @frugal
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter()
        for batch in batches:
            found = [count(t).astype("<u4").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), batch.column(1), batch.column(2)], ["counts", "label", "order"]
            )

    found = rows.mapInArrow(counted, "counts binary, label int, order long").toPandas()  # at most ``most`` rows
    found = found.sort_values(["order", "label"], kind="stable")
    counts = np.frombuffer(b"".join(found["counts"]), "<u4").reshape(-1, TERMS)
    return Model(counts, found["label"].to_numpy("f8"))


def score(model: Model, text: str = "text") -> Column:
    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = Counter()
        for batch in texts:
            values = batch.tolist()
            blocks = [values[a : a + BLOCK] for a in range(0, len(values), BLOCK)]
            out = [model.scores(np.stack([count(t) for t in block])) for block in blocks]
            yield pd.Series(np.concatenate(out) if out else [], dtype="f8")
        del count
        release()

    return scored(text_of(text))


def score_documents(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; nothing is learned from the rows held out."""
    model = train(docs, labels, keep=fold(F.col("doc_id"), folds) != held)
    scored = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(fold(F.col(doc_id), folds) == held, F.lit(False)).alias("held_out"),
        score(model, text).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
