"""Glossary: candidate terms, matching of terms in units, first mentions, violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import words_of
from leafmill.operators.gates import valid_acronym

# Words that make no term on their own.
STOP = ("the", "and", "for", "with", "this", "that", "from", "are", "was", "were", "not", "but", "all", "can", "has", "have", "its", "our", "their", "these", "those", "table", "figure")
CAPITALISED = r"(?:^|[^\p{L}\p{N}_])(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,2})"
COMPOUND = r"(?:^|[^\p{L}\p{N}_-])(\p{Ll}{2,}(?:-\p{Ll}{2,})+)"
TOKEN = r"[\p{L}\p{N}_]+"
ACRONYM = r"^[A-Z]{2,8}s?$"
#: First words of terms that go with the plan at most; a longer glossary is joined on all words.
FIRST_WORDS = 2_000


def candidates(df: DataFrame, text_col: str = "text", least: int = 3, most: int = 80) -> DataFrame:
    """(term, freq): capitalised runs of one to three words and hyphen compounds, most frequent first."""
    found = F.concat(F.regexp_extract_all(F.col(text_col), F.lit(CAPITALISED), F.lit(1)), F.regexp_extract_all(F.col(text_col), F.lit(COMPOUND), F.lit(1)))
    terms = df.select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))
    return terms.where((F.col("freq") >= least) & ~F.lower("term").isin(*STOP)).orderBy(F.desc("freq"), "term").limit(most)


def acronyms(df: DataFrame, text_col: str = "text", least: int = 2) -> DataFrame:
    """(term, freq) of acronyms seen at least `least` times."""
    terms = df.select(F.explode(F.filter(F.regexp_extract_all(F.col(text_col), F.lit(TOKEN), F.lit(0)), lambda x: x.rlike(ACRONYM))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("freq")).where((F.col("freq") >= least) & valid_acronym(F.col("term")))


def matches(units: DataFrame, glossary: DataFrame, unit_col: str = "unit_id", text_col: str = "src") -> DataFrame:
    """(unit, term, policy, ...) of every term that stands in a unit between word boundaries, case ignored.

    No cross join: a unit's distinct words meet the first words of terms; longer terms are then verified. The first
    words are counted: up to FIRST_WORDS of them go with the plan, so that only words that begin a term become rows."""
    terms = glossary.withColumn("_t", words_of(F.col("term"))).where(F.size("_t") > 0).withColumn("_first", F.get("_t", F.lit(0))).withColumn("_phrase", F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" "))).drop("_t")
    firsts = [r[0] for r in terms.select("_first").distinct().limit(FIRST_WORDS + 1).collect()]
    small = len(firsts) <= FIRST_WORDS
    body = units.withColumn("_w", words_of(F.col(text_col)))
    begins = F.filter("_w", lambda x: x.isin(firsts)) if small else F.col("_w")
    seen = body.select(*units.columns, F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")).alias("_body"), F.explode(F.array_distinct(begins)).alias("_first"))
    return seen.join(F.broadcast(terms) if small and terms.count() <= 10 * FIRST_WORDS else terms, "_first").where(F.contains("_body", "_phrase")).drop("_first", "_body", "_phrase")


def unit_terms(found: DataFrame, most: int = 12, unit_col: str = "unit_id") -> DataFrame:
    """(unit, n_terms, keep): terms of policy A in order, at most `most`."""
    keep = F.array_sort(F.collect_set(F.when(F.col("policy") == "A", F.col("term"))))
    return found.groupBy(unit_col).agg(F.countDistinct("term").alias("n_terms"), F.array_join(F.slice(keep, 1, most), "|").alias("keep"))


def first_units(found: DataFrame, order: str, unit_col: str = "unit_id") -> DataFrame:
    """(term, first_unit) in document order."""
    return found.groupBy("term").agg(F.min(F.struct(order, unit_col)).alias("s")).select("term", F.col(f"s.{unit_col}").alias("first_unit"))


def merged(sources: list[DataFrame]) -> DataFrame:
    """Union of (term, policy) with one entry to a case-insensitive term; earlier sources win."""
    every = None
    for k, df in enumerate(sources):
        part = df.select("term", "policy", F.lit(k).alias("prio"))
        every = part if every is None else every.unionByName(part)
    w = Window.partitionBy(F.lower("term")).orderBy("prio", "term")
    return every.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
