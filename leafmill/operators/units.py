"""Translation units: scopes, coverage, line maps, assembly, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.arrays import let, running_total

SCOPE_HEAD = r"(?i)^\s*#*\s*(?:references|bibliography|acknowledg\w*)"


def scoped(lines: DataFrame, heading: Column, opens: Column, key: str = "doc_id") -> DataFrame:
    """Adds in_scope: a heading that opens the scope holds until the next heading (single level, forward filled)."""
    w = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("in_scope", F.coalesce(F.last(F.when(heading, opens), ignorenulls=True).over(w), F.lit(False)))


def line_map(pairs: DataFrame, source: str = "src", target: str = "out") -> DataFrame:
    """(source, target) of sources that have exactly one distinct translation."""
    return pairs.groupBy(source).agg(F.count_distinct(target).alias("n"), F.min(target).alias(target)).where("n = 1").drop("n")


def coverage(unit_lines: DataFrame, sources: DataFrame, unit: str = "unit_id", line: str = "line") -> DataFrame:
    """(unit, n_lines, n_covered, covered): whether every non-blank line of a unit is among the sources."""
    known = sources.select(line).distinct().withColumn("_hit", F.lit(1))
    joined = unit_lines.where(F.trim(line) != "").join(known, line, "left")
    return joined.groupBy(unit).agg(F.count("*").alias("n_lines"), F.count("_hit").alias("n_covered")).withColumn("covered", F.col("n_lines") == F.col("n_covered"))


def mismatch(left: DataFrame, right: DataFrame, unit: str = "unit_id", line: str = "line") -> DataFrame:
    """(side, unit) of units that hold a line which the other side lacks; each unit once."""
    only_left = left.join(right.select(line).distinct(), line, "left_anti").select(F.lit("left").alias("side"), unit)
    only_right = right.join(left.select(line).distinct(), line, "left_anti").select(F.lit("right").alias("side"), unit)
    return only_left.unionByName(only_right).distinct()


def sanitize_unit(text: Column, sep: str = "---") -> Column:
    """A line that is only the separator's rule becomes another mark; blank ends go."""
    safe = F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(F.trim(x) == sep, "⸻").otherwise(x)), "\n")
    return F.regexp_replace(F.regexp_replace(safe, r"^\s*\n", ""), r"\s+$", "")


def assemble(units: DataFrame, translations: DataFrame, sep: str = "\n", doc: str = "doc_id", unit: str = "unit_id") -> DataFrame:
    """(doc, text, replaced): units in order, each replaced by its translation where there is one."""
    joined = units.join(translations, unit, "left").withColumn("_t", F.coalesce(sanitize_unit(F.col("out")), F.col("src")))
    g = joined.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", "_t"))).alias("x"), F.count("out").alias("replaced"))
    return g.select(doc, F.array_join(F.col("x._t"), sep).alias("text"), "replaced")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def cache_plan(units: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits, misses): units joined with cached texts, and one owner for each distinct missing key."""
    hits = units.join(cache, key)
    misses = units.join(cache, key, "left_anti").groupBy(key).agg(F.min("unit_id").alias("owner"), F.count("*").alias("sharers"))
    return hits, misses


def reconstructed(units: DataFrame, cache: DataFrame, kept: DataFrame, key: str = "key", unit: str = "unit_id") -> DataFrame:
    """Adds state: skipped (rows with skip), found in the cache, kept as they were by the report, else unverified.

    cache: (key); kept: (unit)."""
    have = cache.select(key).distinct().withColumn("_found", F.lit(True))
    same = kept.select(unit).distinct().withColumn("_kept", F.lit(True))
    joined = units.join(have, key, "left").join(same, unit, "left")
    state = F.when(F.col("skip"), "skipped").when(F.col("_found"), "found").when(F.col("_kept"), "kept").otherwise("unverified")
    return joined.withColumn("state", state).drop("_found", "_kept")


def degenerate_outputs(rows: DataFrame, out: str, signature: str, least: int = 3) -> DataFrame:
    """(out, n_sources, n_units) of outputs shared by at least `least` distinct sources."""
    g = rows.groupBy(out).agg(F.count_distinct(signature).alias("n_sources"), F.count("*").alias("n_units"))
    return g.where(F.col("n_sources") >= least)


def context_tail(units: DataFrame, size: int, partition: str, order: str, text: str) -> DataFrame:
    """Adds context: the end of the previous unit of the same sequence; empty for the first."""
    before = F.lag(text).over(Window.partitionBy(partition).orderBy(order))
    return units.withColumn("context", F.coalesce(F.right(before, F.lit(size)), F.lit("")))


def split_two(text: Column) -> Column:
    """A text in two at the end of sentence nearest to its middle; one part if there is none."""
    stops, pieces = F.regexp_extract_all(text, F.lit(r"[.!?]\s+"), F.lit(0)), F.split(text, r"[.!?]\s+", -1)
    ends = F.filter(running_total(F.zip_with(stops, F.slice(pieces, F.lit(1), F.size(stops)), lambda m, p: F.length(m) + F.length(p))), lambda e: e < F.length(text))
    best = F.array_min(F.transform(ends, lambda e: F.struct(F.abs(e * 2 - F.length(text)).alias("d"), e.alias("e"))))
    return let(best, lambda b: F.when(b.isNotNull(), F.array(F.substring(text, F.lit(1), b["e"]), F.substring(text, b["e"] + 1, F.length(text)))).otherwise(F.array(text)))
