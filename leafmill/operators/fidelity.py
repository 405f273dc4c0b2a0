"""Fidelity of a recognised text to a reference text, and the decisions that follow from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import char_bigrams, normalize_latin

#: Thresholds of the gate.
INFLATION, LEAST_TRUTH, THRESHOLD, GAIN, SAME = 1.3, 200, 0.70, 0.05, 0.01


def bigram_counts(df: DataFrame, key: list[str], text: Column, side: str) -> DataFrame:
    return df.select(*key, F.explode(char_bigrams(text)).alias("gram")).select(*key, "gram", *(F.lit(int(side == s)).alias(s) for s in ("t", "c")))


def containment(truth: DataFrame, candidate: DataFrame, key: list[str], truth_col: str = "text", cand_col: str = "text") -> DataFrame:
    """(key, shared, total, containment): share of the truth's bigrams, as a multiset, that the candidate has.

    Both sides are exploded once and meet in one aggregation by (key, bigram); only counts move."""
    both = bigram_counts(truth, key, F.col(truth_col), "t").unionByName(bigram_counts(candidate, key, F.col(cand_col), "c"))
    grams = both.groupBy(*key, "gram").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    out = grams.groupBy(*key).agg(F.sum(F.least("t", "c")).alias("shared"), F.sum("t").alias("total"))
    return out.withColumn("containment", F.when(F.col("total") > 0, F.col("shared") / F.col("total")).otherwise(1.0))


def inflation(truth_len: Column, cand_len: Column) -> Column:
    """1 for a candidate of up to 1.3 times the truth's length, less beyond."""
    return F.when(cand_len > 0, F.least(F.lit(1.0), INFLATION * truth_len / cand_len)).otherwise(1.0)


def shared_bigrams(truth: Column, candidate: Column) -> Column:
    """(shared, total): bigrams of the truth, as a multiset, that the candidate has, and all of the truth; both are texts of one row."""

    def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        return np.unique(code[:-1] << 21 | code[1:], return_counts=True)

    @F.arrow_udf("struct<shared: bigint, total: bigint>")
    def count(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in parts:
            shared, total = [], []
            for t, c in zip(left.to_pylist(), right.to_pylist(), strict=True):
                (g, n), (h, m) = grams(t), grams(c)
                _, i, j = np.intersect1d(g, h, assume_unique=True, return_indices=True)
                shared.append(int(np.minimum(n[i], m[j]).sum()))
                total.append(int(n.sum()))
            yield pa.StructArray.from_arrays([pa.array(shared, pa.int64()), pa.array(total, pa.int64())], names=["shared", "total"])

    return count(truth, candidate)


def page_fidelity(pairs: DataFrame, key: list[str], truth_col: str, cand_col: str, least: int = LEAST_TRUTH) -> DataFrame:
    """(key, truth_chars, cand_chars, score): score is null where the truth is too short to measure.

    Both texts are columns of one row, so they are counted there: nothing is shuffled."""
    texts = pairs.select(*key, *(normalize_latin(F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in ((truth_col, "_t"), (cand_col, "_c"))))
    g = texts.select(*key, F.length("_t").cast("long").alias("truth_chars"), F.length("_c").cast("long").alias("cand_chars"), shared_bigrams(F.col("_t"), F.col("_c")).alias("_g"))
    cover = F.when(F.col("_g.total") > 0, F.col("_g.shared") / F.col("_g.total")).otherwise(1.0)
    value = cover * inflation(F.col("truth_chars"), F.col("cand_chars"))
    return g.select(*key, "truth_chars", "cand_chars", F.when(F.col("truth_chars") >= least, F.round(value, 6)).alias("score"))


def untrusted_reason(raw: Column) -> Column:
    """Why a reference text is not trusted: broken glyphs in a fifth of it, or mostly symbols; empty if it is."""
    bare = F.regexp_replace(raw, r"\s+", "")
    n = F.length(bare)
    broken = F.regexp_count(bare, F.lit(r"[\x{E000}-\x{F8FF}\x{FFFD}\x00-\x08\x0E-\x1F]"))
    alnum = F.regexp_count(bare, F.lit(r"[\p{L}\p{N}]"))
    return F.when(n == 0, "empty").when(broken * 5 >= n, "broken-glyphs").when(alnum * 10 < n * 3, "mostly-symbols").otherwise("")


def decisions(pages: DataFrame, ratio: float, key: str = "doc_id") -> DataFrame:
    """What becomes of each measured page.

    pages: (key, page, score, lost). Measurable pages under the threshold are candidates; over a budget of
    max(2, floor(ratio * pages)) for the key they are ranked (lost first, then score, then page) and the
    rest is reported as skipped."""
    candidate = F.coalesce(F.col("score") < THRESHOLD, F.lit(False))
    budget = F.greatest(F.lit(2), F.floor(F.count("*").over(Window.partitionBy(key)) * ratio))
    rank = F.row_number().over(Window.partitionBy(key, "candidate").orderBy(F.col("lost").desc(), F.col("score"), F.col("page")))
    ranked = pages.withColumn("candidate", candidate).withColumn("budget", budget.cast("long")).withColumn("rank", rank)
    what = F.when(F.col("score").isNull(), "unmeasurable").when(~F.col("candidate"), "kept").when(F.col("rank") <= F.col("budget"), "retry").otherwise("skipped")
    return ranked.withColumn("decision", what).drop("rank", "candidate")


def retry_outcome(before: Column, after: Column, lost: Column) -> Column:
    """A retried page is accepted from a gain of .05; about the same value and not lost is the limit of measurement."""
    return (
        F.when(after.isNull(), "failed").when(after >= before + GAIN, "accepted").when((F.abs(after - before) <= SAME) & ~lost, "limit").otherwise("rejected")
    )
