"""The translation ladder: first pass, repair pass, split pass, or the source itself; every output is gated."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators import gates, units
from leafmill.session import cut

#: An external text function: (pass name, texts) -> texts.
Provider = Callable[[str, list[str]], list[str]]


def _call(provider: Provider, step: str) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def call(texts: pd.Series) -> pd.Series:
        return pd.Series(provider(step, texts.tolist()))

    return lambda c: call.asNondeterministic()(c)


def translate(rows: DataFrame, provider: Provider, own: str = gates.HANGUL, judge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(unit_id, src, out, how, reason) of rows (unit_id, src); equal sources are asked once.

    how is skipped, first, repair, split or kept; reason tells why a unit was skipped or what the last gate said.
    Each pass is written to shared storage with what the gate says of it, so no row is asked or judged twice; of texts only
    those are kept that are still needed, and sources meet their results on a hash."""
    judge = judge or (lambda s, o: gates.output_reason(s, o, own))
    todo = cut(rows.select("src").distinct().select(_key(), "src", gates.skip_reason(F.col("src")).alias("reason")))
    first = _judged(todo.where("reason = ''").select("key", "src"), provider, "first", judge)
    repair = _judged(first.where("reason <> ''").select("key", F.col("text").alias("src")), provider, "repair", judge)
    parts = repair.where("reason <> ''").where(gates.splittable(F.col("text"))).select("key", F.posexplode(units.split_two(F.col("text"))).alias("k", "src"))
    whole = cut(_rejoin(_judged(parts, provider, "split", judge))).where("reason = ''")
    good = lambda x, how: x.where("reason = ''").select("key", F.col("text").alias("out"), F.lit(how).alias("how"), "reason")
    same = lambda x, how: x.where("reason <> ''").select("key", F.lit(None).cast("string").alias("out"), F.lit(how).alias("how"), "reason")
    failed = same(repair, "kept").join(whole.select("key"), "key", "left_anti")
    result = good(first, "first").unionByName(good(repair, "repair")).unionByName(good(whole, "split")).unionByName(failed).unionByName(same(todo, "skipped"))
    out = F.when(F.col("how").isin("skipped", "kept"), F.col("src")).otherwise(F.col("out"))
    return rows.select(_key(), "unit_id", "src").join(result, "key").select("unit_id", "src", out.alias("out"), "how", "reason")


def _key() -> Column:
    return F.sha2("src", 256).alias("key")


def _judged(rows: DataFrame, provider: Provider, step: str, judge: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, ..., text, reason) of rows (key, ..., src): text is the output if it is taken, else the source."""
    asked = rows.withColumn("_out", _call(provider, step)(F.col("src"))).withColumn("reason", judge(F.col("src"), F.col("_out")))
    return cut(asked.withColumn("text", F.when(F.col("reason") == "", F.col("_out")).otherwise(F.col("src"))).drop("src", "_out"))


def _rejoin(split: DataFrame) -> DataFrame:
    """Parts of a source joined again; the reason of the worst part stands for all."""
    g = split.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("x"), F.max("reason").alias("reason"))
    return g.select("key", F.array_join(F.col("x.text"), "").alias("text"), "reason")


def precedence(plan: DataFrame) -> DataFrame:
    """Adds out and origin: layout map, then own result, then partial map, then the source."""
    origin = F.when(F.col("by_layout").isNotNull(), "layout").when(F.col("own").isNotNull(), "own").when(F.col("partial").isNotNull(), "partial").otherwise("kept")
    return plan.withColumn("out", F.coalesce("by_layout", "own", "partial", "src")).withColumn("origin", origin)


def prompt(src: Column, pairs: Column, first: Column, tail: Column, keep: Column) -> Column:
    """Sections of a request; empty ones are left out."""
    section = lambda title, body: F.when(F.length(body) > 0, F.concat(F.lit(f"{title}:\n"), body))
    return F.concat_ws("\n\n", section("Glossary", pairs), section("First mentions", first), section("Keep", keep), section("Context", tail), section("Text", src))
