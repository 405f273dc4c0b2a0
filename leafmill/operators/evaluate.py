"""Evaluation against ground truth: error rates, overlaps, order, invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as G


def cer(found: Column, truth: Column) -> Column:
    """Edit distance over the length of the truth; null for an empty truth."""
    return F.when(F.length(truth) > 0, F.round(F.levenshtein(found, truth) / F.length(truth), 6))


def best_iou(found: DataFrame, truth: DataFrame, key: str = "page") -> DataFrame:
    """(key, t, iou): the best overlap of each true box; 0 where nothing meets it."""
    f, t = found.select(key, F.col("box").alias("fb")), truth.select(key, "t", F.col("box").alias("tb"))
    j = t.join(f, key, "left")
    return j.groupBy(key, "t").agg(F.round(F.coalesce(F.max(G.iou(F.col("fb"), F.col("tb"))), F.lit(0.0)), 6).alias("iou"))


def pair_order(marks: DataFrame, key: str, order: str, position: str) -> DataFrame:
    """(key, pairs, concordant, accuracy) over pairs of found landmarks; null without a pair."""
    a = marks.select(key, F.col(order).alias("oa"), F.col(position).alias("pa"))
    b = marks.select(key, F.col(order).alias("ob"), F.col(position).alias("pb"))
    g = a.join(b, key).where("oa < ob").groupBy(key).agg(F.count("*").alias("pairs"), F.count_if(F.col("pa") < F.col("pb")).alias("concordant"))
    return g.withColumn("accuracy", F.round(F.col("concordant") / F.col("pairs"), 6))


def invariants(source: DataFrame, target: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, check, ok): counts that a translation must keep, one row for each check."""
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    j = source.select(key, F.col("text").alias("s")).join(target.select(key, F.col("text").alias("t")), key)
    same = {"pages": r"\n", "images": r"!\[", "cells": "<td", "tables": "<table", "math": r"\\\("}
    checks = [F.struct(F.lit(n).alias("check"), (count(F.col("s"), p) == count(F.col("t"), p)).alias("ok")) for n, p in same.items()]
    checks.append(F.struct(F.lit("placeholders").alias("check"), (count(F.col("t"), r"⟦\w+⟧") == 0).alias("ok")))
    return j.select(key, F.explode(F.array(*checks)).alias("c")).select(key, "c.check", "c.ok")


def dropped_pages(before: DataFrame, after: DataFrame, floor: float, retention: float) -> DataFrame:
    """(page, was, now) of pages whose share of the target's letters was at least floor and fell under retention of it."""
    j = before.join(after, "page").where((F.col("was") >= floor) & (F.col("now") < retention * F.col("was")))
    return j.select("page", "was", "now")


def judge_sample(rows: DataFrame, group: str, key: str, size: str, draw: str, longest: int, drawn: int) -> DataFrame:
    """(group, key, part): the longest rows of each group, and of the others those that are drawn first.

    Every task keeps its first rows of a group only: the filter on the rank goes below the shuffle. Among the first
    `longest + drawn` of the draw there are always enough rows that are not among the longest."""
    def first(order: list[Column], most: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        return rows.select(group, key, size, draw).withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")

    top = first([F.desc(size), F.col(key)], longest)
    lots = first([F.col(draw), F.col(key)], longest + drawn).join(top.select(group, key), [group, key], "left_anti")
    rest = lots.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(draw, key))).where(F.col("_r") <= drawn)
    return top.select(group, key, F.lit("longest").alias("part")).unionByName(rest.select(group, key, F.lit("drawn").alias("part")))


def reason_pairs(counts: Column) -> Column:
    """(reason, n) of a map of counts, the most frequent first, equals by name; counts under one are left out."""
    pairs = F.transform(F.map_entries(counts), lambda e: F.struct((-F.floor(e["value"])).alias("m"), e["key"].alias("reason")))
    return F.transform(F.array_sort(F.filter(pairs, lambda p: p["m"] < 0)), lambda p: F.struct(p["reason"].alias("reason"), (-p["m"]).cast("long").alias("n")))


def reason_total(pairs: Column, counted: Column) -> Column:
    """The larger of the counted total and the sum of the reasons, as either may be missing."""
    return F.greatest(F.coalesce(counted, F.lit(0)), F.aggregate(pairs, F.lit(0).cast("long"), lambda a, p: a + p["n"]))


def kept_summary(kept: Column, skipped: Column) -> Column:
    """One line on what was not translated."""
    k, s = F.concat(F.lit("원문 유지 "), kept), F.concat(F.lit("건너뜀 "), skipped)
    return F.when((kept > 0) & (skipped > 0), F.concat(k, F.lit(" · "), s)).when(kept > 0, k).when(skipped > 0, s).otherwise("전부 번역됨")
