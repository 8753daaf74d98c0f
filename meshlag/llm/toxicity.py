"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlag.llm.chars import Batch, letters
from meshlag.llm.util import cut, cut_freed, fold, labelled_sample, small_batches, whole_text

ORDERS = (5, 7, 9)
#: Labelled documents that training reads at most, features of the model, labelled documents a feature must be in.
TRAIN_ROWS, FEATURES, LEAST_DOCS = 12_000, 8_000, 5
SLOT_BITS = 20


@dataclass
class Model:
    """Sorted n-gram hashes with their weights (classifier weight times log-count ratio), and the intercept."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.slots = np.zeros(1 << SLOT_BITS, bool)
        self.slots[(self.grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = True

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of every feature that a text holds, once each."""
        batch = Batch(texts, letters())
        owners, found = [], []
        for n in ORDERS:
            grams = batch.grams(n)
            at = np.flatnonzero(self.slots[(grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.grams, grams[at]), max(len(self.grams) - 1, 0))
            hit = self.grams[k] == grams[at] if len(self.grams) else np.zeros(0, bool)
            owners.append(batch.owner[at[hit]].astype(np.int64))
            found.append(k[hit])
        pairs = np.unique(np.concatenate(owners) * max(len(self.grams), 1) + np.concatenate(found))
        return pairs // max(len(self.grams), 1), pairs % max(len(self.grams), 1)

    def score(self, texts: list[str]) -> np.ndarray:
        owner, feature = self.find(texts)
        return 1 / (1 + np.exp(-np.clip(np.bincount(owner, self.weights[feature], minlength=len(texts)) + self.bias, -30, 30)))


def _document_grams(n: int):
    """A pass of (gram, n0, n1): in how many of a batch's documents of either class each gram of n characters is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            batch, y = Batch(rows.column(0).to_pylist(), letters()), rows.column(1).to_numpy()
            grams = batch.grams(n)
            last = slice(n - 1, n - 1 + len(grams))
            inside = (batch.owner[: len(grams)] == batch.owner[last]) & (batch.codes[last] != 0)  # not the mark at a text's end
            owner, grams = batch.owner[: len(grams)][inside], grams[inside]
            order = np.lexsort((grams, owner))
            owner, grams = owner[order], grams[order]
            new = np.ones(len(order), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
            found, which = np.unique(grams[new], return_inverse=True)
            one = np.bincount(which, y[owner[new]] == 1, minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(which, minlength=len(found)) - one), pa.array(one)], ["gram", "n0", "n1"])

    return count


def log_ratios(in_zero: np.ndarray, in_one: np.ndarray, zeros: int, ones: int) -> np.ndarray:
    """Naive Bayes log-count ratio of each feature, from the documents of either class that hold it."""
    return np.log(((in_one + 1) / (ones + 2)) / ((in_zero + 1) / (zeros + 2)))


def chosen_grams(sample: DataFrame, zeros: int, ones: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, ratios): the n-grams whose shares differ most between the classes, with r = log of the ratio of the shares.

    Every n-gram of the sample is counted in both classes, so those typical of either class are found; an order's
    best FEATURES are written before the next order is counted, which frees its shuffle. The driver gets the best
    FEATURES of all. Equal differences go by hash.
    """
    signal = F.abs(F.col("n1") / ones - F.col("n0") / zeros) / F.sqrt((F.col("n0") + F.col("n1") + 1) / (zeros + ones))
    top = lambda df: df.orderBy(signal.desc(), "gram").limit(FEATURES)
    found = []
    for n in ORDERS:
        counts = sample.select("text", "y").mapInArrow(_document_grams(n), "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        found.append(cut_freed(top(counts.where(F.col("n0") + F.col("n1") >= LEAST_DOCS))))
    best = top(reduce(DataFrame.unionByName, found)).toArrow()
    grams, n0, n1 = (best.column(c).to_numpy() for c in ("gram", "n0", "n1"))
    grams = np.asarray(grams, np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], log_ratios(n0, n1, zeros, ones)[order]


def fit(y: np.ndarray, owner: np.ndarray, feature: np.ndarray, grams: np.ndarray, ratio: np.ndarray, rounds: int = 300) -> Model:
    """Logistic regression on presence scaled by the log-count ratios."""
    value = ratio[feature]
    w, bias = np.zeros(len(grams)), float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    m, v = np.zeros(len(grams)), np.zeros(len(grams))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, value * w[feature], minlength=len(y)) + bias, -30, 30)))
        error = (p - y) / len(y)
        g = np.bincount(feature, value * error[owner], minlength=len(grams)) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= 0.5 * error.sum()
    return Model(grams, w * ratio, bias)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most `rows` labelled documents outside the held-out fold, whole texts.

    Counting and matching run on the executors. The driver gets the chosen FEATURES, each in LEAST_DOCS of those
    documents at least, and which of them each document holds; all is bounded whatever the texts' length. Without
    both classes the model is the labelled share (0.5 without labels) for every text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = cut(labelled_sample(docs, labels, "toxic", rows).repartition(24))
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ones, zeros = size.get(1, 0), size.get(0, 0)
    if not ones or not zeros:
        share = float(np.clip(ones / (ones + zeros), 0.01, 0.99)) if ones + zeros else 0.5
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    grams, ratio = chosen_grams(sample, zeros, ones)
    chosen = spark.sparkContext.broadcast(Model(grams, np.zeros(0), 0.0))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, feature = chosen.value.find(batch.column(0).to_pylist())
            offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32)))], ["y", "f"])

    held = sample.mapInArrow(lists, "y int, f array<int>").toArrow()
    y = held.column("y").to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(y), dtype=np.int32), pc.list_value_length(held.column("f")).to_numpy())
    return fit(y, owner, pc.list_flatten(held.column("f")).to_numpy(), grams, ratio)


def toxicity_of(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = TRAIN_ROWS) -> Column:
    """The score (0 to 1) of a row of `docs`, by a model trained on its labelled rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.withColumn("text", F.col(text)) if text != "text" else docs, labels, rows))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts.to_pylist()), pa.float64())

    return score(whole_text(text))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """Adds held_out, score (0 to 1) and predicted (1 if score >= threshold) to `docs`; other columns stay.

    A column of `docs` with one of these names is replaced. Only texts are scored; ids choose the held-out
    fold and nothing else. Null and empty texts get the score of a text without features. Repeated rows get
    equal scores. Texts of any length are read whole. An empty table gives an empty table. See `train` for
    what is learned.
    """
    return docs.withColumns({"held_out": fold("doc_id") == 0, "score": toxicity_of(docs, labels, text, rows)}).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
