"""Runs of repeated lines, counters and n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.arrays import let


def template(line: Column) -> Column:
    """The line with its numbers replaced; null if it is not eligible for a run."""
    numbers = F.regexp_count(line, F.lit(r"\d+"))
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    return F.when((numbers <= 2) & (F.length(line) >= 24) & (letters >= 8), F.regexp_replace(line, r"\d+", "<n>"))


def template_runs(lines: DataFrame, least: int, key: str = "doc_id") -> DataFrame:
    """(key, template, first_page, run) of runs of at least `least` lines of one template.

    Blank lines are passed over, other lines end a run: islands by the difference of two row numbers."""
    seen = lines.where(F.trim("line") != "").withColumn("template", template(F.col("line")))
    one, two = Window.partitionBy(key).orderBy("page"), Window.partitionBy(key, "template").orderBy("page")
    island = F.row_number().over(one) - F.row_number().over(two)
    runs = seen.withColumn("island", island).where("template is not null").groupBy(key, "template", "island").agg(F.min("page").alias("first_page"), F.count("*").alias("run"))
    return runs.where(F.col("run") >= least).drop("island")


def counter_runs(text: Column, least: int) -> Column:
    """Longest run of consecutive counters `# 1.`, `# 2.`, ... in a text; 0 if it is under `least`."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"#\s*(\d{1,9})\."), F.lit(1)), lambda x: x.cast("long"))
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x == acc["last"] + 1, acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(found, start, step, lambda acc: F.when(acc["best"] >= least, acc["best"]).otherwise(0))


def banned_followers(tokens: Column, n: int, window: int) -> Column:
    """Tokens that would repeat an n-gram: sorted followers, within the last `window` tokens, of the current n-1 tokens."""
    none = F.expr("cast(array() as array<string>)")

    def followers(recent: Column) -> Column:
        prefix = F.slice(recent, F.size(recent) - n + 2, F.lit(n - 1))
        starts = F.sequence(F.lit(1), F.size(recent) - n + 1)
        found = let(prefix, lambda p: F.transform(F.filter(starts, lambda i: F.slice(recent, i, F.lit(n - 1)) == p), lambda i: F.element_at(recent, i + n - 1)))
        return F.when(F.size(recent) >= n, F.array_sort(F.array_distinct(found))).otherwise(none)

    return let(let(tokens, lambda t: F.slice(t, F.greatest(F.size(t) - window + 1, F.lit(1)), F.lit(window))), followers)
