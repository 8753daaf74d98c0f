"""Quality scores by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlag.llm.chars import profile
from meshlag.llm.util import fold, labelled_sample, small_batches, whole_text

#: Labelled documents that training reads at most, and preference pairs drawn from them.
TRAIN_ROWS, PAIRS = 12_000, 60_000
THRESHOLD = 0.3


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -5, 5) @ self.weights

    def score(self, texts: list[str]) -> np.ndarray:
        """The strength at the quantile cut is mapped to THRESHOLD; higher strengths go towards 1."""
        at_cut = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.strength(profile(texts)) - self.cut + at_cut, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Model:
    """Logistic loss on feature differences of (better, worse) pairs, by Newton steps.

    The cut is the quantile of the strengths at the labelled share of rejects.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -5, 5)
    rng = np.random.default_rng(seed)
    better, worse = (rng.choice(np.flatnonzero(y == k), PAIRS) for k in (1, 0))
    d = z[better] - z[worse]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (1 - p) / len(d) - 1e-3 * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w))
        w += np.linalg.solve(curve, gradient)
    return Model(mean, scale, w, float(np.quantile(z @ w, (y == 0).mean())))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most `rows` labelled documents outside the held-out fold.

    Their measures are taken on the executors from whole texts; the driver gets one short vector each. Without both
    classes no pair can be formed and every text is kept: all strengths are equal, above the cut.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(profile(batch.column(0).to_pylist())), pa.list_(pa.float64()))], ["y", "x"])

    small_batches(docs.sparkSession)
    got = labelled_sample(docs, labels, "quality", rows).mapInArrow(measured, "y int, x array<double>").toArrow()
    y = got.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        n = profile([""]).shape[1]
        return Model(np.zeros(n), np.ones(n), np.zeros(n), -1.0)
    x = np.concatenate([np.asarray(c.flatten()) for c in got.column("x").chunks]).reshape(len(y), -1)
    order = np.lexsort(np.column_stack([x, y]).T)  # rows arrive in any order; pairs must not depend on it
    return fit(x[order], y[order])


def quality_of(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = TRAIN_ROWS) -> Column:
    """The score (0 to 1) of a row of `docs`, by a model trained on its labelled rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.withColumn("text", F.col(text)) if text != "text" else docs, labels, rows))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts.to_pylist()), pa.float64())

    return score(whole_text(text))


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """Adds held_out, score (0 to 1) and predicted (1 if score >= 0.3) to `docs`; other columns stay.

    A column of `docs` with one of these names is replaced. Only texts are scored. Null and empty texts are
    scored by the measures of an empty text. Repeated rows get equal scores. Texts of any length are read
    whole. An empty table gives an empty table.
    """
    return docs.withColumns({"held_out": fold("doc_id") == 0, "score": quality_of(docs, labels, text, rows)}).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
