"""Quality by Bradley-Terry pairwise ranking.

Features are read from the text alone. Each preference pair sets a document of label 1 against one of label 0 from a bounded sample of
labelled rows (``most_rows``, ``most_pairs``); the weights minimise the logistic loss of the feature differences. The weighted sum
of the features is a document's log-odds of being preferred. The threshold is the quantile of the sample's sums at its share of
label 0; scores are shifted so that the threshold is at ``THRESHOLD``.

Defined cases: null and empty texts have all features 0 and a score like others; without rows of both labels every score is the
share of label 1 (1 without any row, so that nothing is rejected without evidence); repeated rows give a row each; an empty table gives
an empty result; columns of the input stay, and the new one gets underscores in front of its name where it clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import free_name, texts_of
from orderflow.llm.labelled import labelled_sample, remainder

HELD_OUT, HELD_OUT_REMAINDER = 4, 2
THRESHOLD = 0.7
_SYMBOLS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])


def features(text: str | None) -> list[float]:
    """Lengths, repetition, letter case, sentence ends, digits, and the share of each ASCII symbol."""
    text = text or ""
    if not text:
        return [0.0] * (11 + len(_SYMBOLS))
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        len(set(words)) / n,
        sum(map(str.isupper, words)) / n,
        len(set(lines)) / len(lines),
        float(np.log1p(len(text) / len(lines))),
        sum(w[-1] in ".!?" for w in words) / n,
        sum(not any(map(str.isalpha, w)) for w in words) / n,
        float(counts[48:58].sum()),
        float(counts[65:91].sum()),
        float(counts[10]),
        *counts[_SYMBOLS].tolist(),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    constant: float | None = None

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        odds = np.clip(self.raw(rows) - self.threshold, -30, 30)
        return 1 / (1 + np.exp(-odds) * (1 - THRESHOLD) / THRESHOLD)


@dataclass
class Params:
    most_rows: int = 6000
    most_pairs: int = 30000
    penalty: float = 1e-3
    steps: int = 60


def train(rows: np.ndarray, y: np.ndarray, p: Params = Params()) -> Model:
    """Newton steps on the logistic loss of feature differences."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    if not n1 or not n0:
        return Model(np.zeros(1), np.ones(1), np.zeros(1), 0.0, constant=float(n1 > 0 or not len(y)))
    mean, scale = rows.mean(0), rows.std(0) + 1e-9
    own = np.clip((rows - mean) / scale, -6, 6)
    rng = np.random.default_rng(7)
    n = min(p.most_pairs, n1 * n0)
    gap = own[y > 0][rng.integers(n1, size=n)] - own[y <= 0][rng.integers(n0, size=n)]
    w = np.zeros(own.shape[1])
    for _ in range(p.steps):
        lose = 1 / (1 + np.exp(np.clip(gap @ w, -30, 30)))
        slope = -(gap * lose[:, None]).mean(0) + p.penalty * w
        bend = (gap * (lose * (1 - lose))[:, None]).T @ gap / n + p.penalty * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    sums = np.sort(own @ w)
    # The middle between the last sum below the quantile and the first above it.
    threshold = float((sums[n0 - 1] + sums[min(n0, len(sums) - 1)]) / 2)
    return Model(mean, scale, w, threshold)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"].cast(pa.int64()), batch["y"].cast(pa.float64()), pa.array(rows, pa.list_(pa.float64()))],
            names=["doc_id", "y", "x"],
        )


def fit(docs: DataFrame, labels: DataFrame, learn: Column, p: Params = Params()) -> Model:
    """The model from labelled documents for which ``learn`` holds. The driver holds ``most_rows`` feature rows."""
    sample = labelled_sample(docs, labels, "quality", learn, p.most_rows)
    rows = sorted(sample.select("doc_id", "y", "text").mapInArrow(_features, "doc_id bigint, y double, x array<double>").collect())
    return train(np.array([r.x for r in rows]).reshape(len(rows), len(features(""))), np.array([r.y for r in rows]), p)


def score(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """``docs`` with a score, and the name of that column."""
    name = free_name(docs, "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.array([features(t) for t in texts_of(batch)])
                scores = pa.array(model.score(rows), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return docs.mapInArrow(rate, schema), name


def learnable() -> Column:
    return remainder("doc_id", HELD_OUT) != HELD_OUT_REMAINDER


def report(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``."""
    scored, name = score(docs.select("doc_id", "text"), fit(docs, labels, learnable(), p))
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", HELD_OUT) == HELD_OUT_REMAINDER, F.lit(False)).alias("held_out"),
        F.col(name).alias("score"),
        (F.col(name) >= THRESHOLD).cast("int").alias("predicted"),
    )


def good(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents of predicted quality, with their own columns."""
    scored, name = score(docs, fit(docs, labels, learnable(), p))
    return scored.filter(F.col(name) >= THRESHOLD).drop(name)
