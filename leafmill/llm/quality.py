"""Operator 1: quality classifier.

Hashed word n-gram logistic regression, fitted with per-coordinate
follow-the-regularised-leader updates (proximal, L1 and L2) and scored as
sparse dot products. Words are runs of word characters or of other marks; a
word that repeats the one before it is written "=", so that runs of repeats
share features whatever the word. Features are hashed unigrams and bigrams
with the root of their count, scaled to length one.

The model is fitted on at most FIT_ROWS labelled rows (those of the least id
hashes), so its cost does not grow; scoring reads every whole text once, in
one pass without a shuffle. Weights have a fixed size (2**BITS) and are
broadcast.

Defined results: null and empty texts are scored by the intercept; without
labels of both values the score is their smoothed share (0.5 without any);
very long texts are taken whole; equal texts have equal scores, and a score of
exactly the least one passes. Repeated rows are scored each. For the fit a
repeated label counts once, an id that is labelled both ways counts both ways,
and of several texts of one id the least is taken, so that the sample never
exceeds its bound. An empty table gives an empty result; columns other than
the id and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from leafmill.llm.sampling import crc_rest, fit_rows
from leafmill.llm.storage import bounded_batches
from leafmill.llm.words import hashed, mix, place
from leafmill.session import spread

BITS = 18
FIT_ROWS = 6_000
#: Updates that fitting makes about, in 4 to 40 passes over the sample.
UPDATES = 60_000
TOKEN = re.compile(r"\w+|[^\w\s]+")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text; the intercept is index 0."""
    tokens = TOKEN.findall(text) if text else []
    if not tokens:
        return np.zeros(1, dtype=np.int64), np.ones(1)
    h = hashed(tokens)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    h[same] = np.uint64(61)
    both = mix(h[:-1] * place(0) + h[1:] * place(1))
    index, count = np.unique(np.concatenate([h, both]) >> np.uint64(64 - BITS), return_counts=True)
    values = np.sqrt(count)
    values /= np.sqrt(count.sum())
    return np.append(index.astype(np.int64) + 1, 0), np.append(values, 1.0)


@dataclass
class Follower:
    """Per-coordinate follow-the-regularised-leader state of a logistic regression."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05

    def __post_init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, index: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(index)
        gap = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label
        step = gap * values
        square = step * step
        n = self.n[index]
        self.z[index] += step - (np.sqrt(n + square) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + square


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], updates: int = UPDATES) -> np.ndarray:
    """Weights from (indices, values, label) rows; the order is shuffled repeatably in each epoch."""
    labels = [r[2] for r in rows]
    if len(set(labels)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        w = np.zeros((1 << BITS) + 1)
        w[0] = np.log(share / (1 - share))
        return w
    model, order = Follower(), np.random.default_rng(11)
    for _ in range(min(40, max(4, updates // len(rows)))):
        for k in order.permutation(len(rows)):
            model.learn(*rows[k])
    return model.weights()


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights learnt from labels (id_col, label_col); features are made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1).cast(pa.int32()), pa.array([m[0].astype("<i4").tobytes() for m in made], pa.binary()),
                    pa.array([m[1].astype("<f4").tobytes() for m in made], pa.binary()),
                ], names=["h", "label", "i", "v"],
            )

    sample = fit_rows(docs, labels, label_col, most, id_col, text_col).select("h", F.col(label_col).cast("int").alias("label"), "text")
    rows = sorted(sample.mapInArrow(run, "h long, label int, i binary, v binary").collect())  # at most `most` rows, see fit_rows
    return train([(np.frombuffer(r.i, "<i4"), np.frombuffer(r.v, "<f4"), r.label) for r in rows])


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """The columns of keep (id_col if None) and the score of every row."""
    kept = keep or [id_col]
    shared = bounded_batches(docs.sparkSession).sparkContext.broadcast(weights.astype(np.float64))  # fixed size, 2 MB
    read = [*kept] if text_col in kept else [*kept, text_col]
    at = read.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            sums = np.array([w[i] @ v for i, v in map(features, batch.column(at).to_pylist())])
            found = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, pa.float64())], names=[*kept, out])

    schema = StructType([*(docs.schema[c] for c in kept), StructField(out, DoubleType())])
    return spread(docs.select(*read)).mapInArrow(run, schema)


def keep_good(docs: DataFrame, weights: np.ndarray, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of at least `least`, all columns as they were; only texts go to Python."""
    shared = bounded_batches(docs.sparkSession).sparkContext.broadcast(weights.astype(np.float64))

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value
        for part in texts:
            yield pa.array([1 / (1 + np.exp(-np.clip(w[i] @ v, -35, 35))) for i, v in map(features, part.to_pylist())], pa.float64())

    return spread(docs).where(scored(F.col(text_col)) >= least)


def learning_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels that may be learnt from: the remainder of the id's crc32 by 5 is not 0."""
    return labels.where(crc_rest(id_col, 5) != 0)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = fit(docs, learning_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, weights).select(
        "doc_id", (crc_rest("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
