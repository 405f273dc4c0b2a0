"""A bounded, repeatable sample of labelled rows for fitting a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_rest(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


def _text(docs: DataFrame, text_col: str) -> Column:
    return F.col(text_col).cast("string").alias("text")


def _pick(texts: DataFrame, chosen: DataFrame, keys: list[str], target: str, most: int) -> DataFrame:
    """(h, target, text): one row of texts for each row of chosen that has any, so at most `most`."""
    met = texts.join(F.broadcast(chosen), keys)
    one = met.groupBy(*chosen.columns).agg(F.min("text").alias("text"))  # partial in each task: the copies of a row stay where they are
    return one.select(F.xxhash64(*chosen.columns).alias("h"), target, "text").orderBy("h", target).limit(most)


def fit_rows(docs: DataFrame, labelled: DataFrame, target: str, most: int, id_col: str, text_col: str) -> DataFrame:
    """(h, target, text) of at most `most` labels of another table, those of the least id hashes; h orders them repeatably.

    labelled: (id_col, target). Labels are chosen on narrow rows, equal ones once, each task keeping at most
    `most`; only then are texts read. A label whose id has several texts gets the least of them; an id that is
    labelled in two ways counts both ways. The chosen labels are bounded, and so broadcast."""
    chosen = labelled.where(F.col(id_col).isNotNull() & F.col(target).isNotNull()).select(F.col(id_col).alias("id"), F.col(target).alias(target)).distinct()
    chosen = chosen.orderBy(F.xxhash64("id"), "id", target).limit(most)
    return _pick(docs.select(F.col(id_col).alias("id"), _text(docs, text_col)), chosen, ["id"], target, most)


def fit_own_rows(docs: DataFrame, target: str, most: int, id_col: str, text_col: str) -> DataFrame:
    """(h, target, text) of at most `most` rows of docs that carry their own label, chosen as in fit_rows.

    Rows of equal id, label and text count once; each other row keeps its own label, whatever rows share its id."""
    text = F.col(text_col).cast("string")
    rows = docs.where(F.col(target).isNotNull() & F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("t"), F.col(target).alias(target), text.alias("text")
    )
    chosen = rows.select("id", "t", target).distinct().orderBy(F.xxhash64("id"), "id", "t", target).limit(most)
    return _pick(rows, chosen, ["id", "t", target], target, most)
