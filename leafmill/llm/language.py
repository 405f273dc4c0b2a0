"""Operator 10: language identification with a string kernel.

The kernel of two texts counts the letter n-grams (1 to 4 letters, word
boundaries included) that are present in both, scaled to one for equal texts.
N-grams are hashed into DIM buckets. A bounded sample gives LANDMARKS
landmark texts; with them the Nystroem map turns kernel ridge regression into
a linear system of their number, solved one-versus-rest.

Scoring is a product of batches of presence vectors with one matrix: kernel
values with the landmarks, the Nystroem map and the ridge weights are all
linear in the presence vector, and are multiplied out once on the driver.
The matrix has a fixed size and is broadcast; each text is read once, whole.

Defined results: a text that is null or has no letter is "und" with score 0;
ties go to the first language in order; without any labelled row every text
is "und"; with labels of one language only that is predicted; very long texts
are taken whole. Repeated rows are predicted each and learnt from once, and
rows of one id with other texts or languages are learnt from each with its
own; an empty table gives an empty result; columns other than the id and the
text (and lang, for fitting) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.sampling import crc_rest, fit_own_rows, fit_rows
from leafmill.llm.storage import bounded_batches
from leafmill.session import spread

#: Buckets of the 1- and 2-grams, the 3-grams and the 4-grams.
SPAN = (1 << 14, 1 << 14, 1 << 15)
DIM = sum(SPAN)
FIT_ROWS = 3_000
LANDMARKS = 192
RIDGE = 1e-3
BATCH = 64

_letter = None


def _letters() -> np.ndarray:
    """Which code points are letters."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


def presence(text: str | None) -> np.ndarray | None:
    """Buckets that are present, as a mask; None for a text without letters."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[code]
    if not letter.any():
        return None
    word = np.where(letter, code, 32).astype(np.uint32)
    word = word[np.append(True, (word[1:] != 32) | (word[:-1] != 32))]  # runs of others are one boundary
    word = np.concatenate([[32], word, [32]]).astype(np.uint32)
    seen = np.zeros(DIM, dtype=np.uint8)

    def put(x: np.ndarray, at: int, size: int) -> None:
        x = x ^ (x >> np.uint32(15))
        x = x * np.uint32(0x2C1B3C6D)
        seen[at + (x >> np.uint32(32 - (size.bit_length() - 1)))] = 1

    times = np.uint32(0x9E3779B1)
    put((word + np.uint32(7)) * times, 0, SPAN[0])
    gram, at = word, (0, 0, SPAN[0], SPAN[0] + SPAN[1])
    for n in (2, 3, 4):
        if len(gram) < 2:
            break
        gram = gram[:-1] * times + word[n - 1 :] * np.uint32(0x85EBCA77)
        put(gram, at[n - 1], SPAN[max(0, n - 2)])
    return seen


def solve(masks: np.ndarray, labels: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages, matrix DIM x languages) from presence masks and their labels."""
    names = sorted(set(labels))
    target = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    n, m = len(masks), min(LANDMARKS, len(masks))
    norm = np.sqrt(masks.sum(axis=1, dtype=np.float64))
    marks = masks[:m].astype(np.float32) / norm[:m, None].astype(np.float32)
    cross = np.vstack([masks[a : a + 256].astype(np.float32) @ marks.T for a in range(0, n, 256)]).astype(np.float64) / norm[:, None]
    value, vector = np.linalg.eigh(cross[:m])
    keep = value > 1e-8 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])
    mapped = cross @ whiten
    # one-versus-rest, each language weighing the same as all the others together
    weights = np.empty((mapped.shape[1], len(names)))
    for c in range(len(names)):
        own = target[:, c] > 0
        share = np.where(own, 0.5 / max(1, own.sum()), 0.5 / max(1, (~own).sum()))
        left = mapped.T * share
        weights[:, c] = np.linalg.solve(left @ mapped + RIDGE * np.eye(mapped.shape[1]), left @ target[:, c])
    return names, marks.T.astype(np.float64) @ (whiten @ weights)


def _predict(masks: list[np.ndarray | None], names: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    where = [k for k, m in enumerate(masks) if m is not None]
    langs, scores = ["und"] * len(masks), [0.0] * len(masks)
    for a in range(0, len(where) if names else 0, BATCH):
        part = where[a : a + BATCH]
        x = np.stack([masks[k] for k in part]).astype(np.float32)
        value = (x @ matrix) / np.sqrt(x.sum(axis=1))[:, None]
        share = np.clip((value + 1) / 2, 1e-6, None)
        best = value.argmax(axis=1)
        share = share[np.arange(len(part)), best] / share.sum(axis=1)
        for k, b, s in zip(part, best, share, strict=True):
            langs[k], scores[k] = names[b], float(min(1.0, s))
    return langs, scores


def _learn(sample: DataFrame, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Model from (h, lang_col, text) rows of a bounded number; masks are made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [presence(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([None if m is None else np.packbits(m).tobytes() for m in masks], pa.binary())],
                names=["h", "label", "mask"],
            )

    sample = sample.select("h", F.col(lang_col).cast("string").alias("label"), "text")
    rows = sorted(r for r in sample.mapInArrow(run, "h long, label string, mask binary").collect() if r.mask is not None)  # at most `most`
    if not rows:
        return [], np.zeros((DIM, 0), dtype=np.float32)
    names, matrix = solve(np.stack([np.unpackbits(np.frombuffer(r.mask, np.uint8)) for r in rows]), [r.label for r in rows])
    return names, matrix.astype(np.float32)


def fit(docs: DataFrame, labelled: DataFrame, most: int = FIT_ROWS, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Model from the languages (id_col, lang_col) of another table."""
    return _learn(fit_rows(docs, labelled, lang_col, most, id_col, text_col), lang_col)


def fit_own(docs: DataFrame, most: int = FIT_ROWS, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Model from rows that carry their own language; those without one or without a text are left out."""
    return _learn(fit_own_rows(docs, lang_col, most, id_col, text_col), lang_col)


def predict(docs: DataFrame, names: list[str], matrix: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every row."""
    shared = bounded_batches(docs.sparkSession).sparkContext.broadcast(matrix)  # fixed size a language: 256 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs, scores = batch.column(1), [], []
            for a in range(0, len(texts), BATCH):
                found = _predict([presence(x) for x in texts.slice(a, BATCH).to_pylist()], names, shared.value)
                langs += found[0]
                scores += found[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, F.col(text_col).cast("string"))).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, matrix = fit_own(docs.where(crc_rest("doc_id", 4) != 2))
    return predict(docs, names, matrix).select("doc_id", (crc_rest("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
