"""Sinks: each writes through Spark's commit protocol, so a failed task leaves no partial result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def json_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def by_job(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet, one directory to each key, so readers prune by job and language; rows of a key are dealt over several tasks."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def reason_map(df: DataFrame, key: str, reason: str) -> DataFrame:
    """(key, reasons map): counters by reason of each key."""
    g = df.groupBy(key, reason).agg(F.count("*").alias("_n"))
    return g.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "_n")))).alias("reasons"))


def last_wins(before: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both with one row to a key: the new one where there is one, the later of equals by all columns."""
    both = before.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("_v"), *(F.desc(c) for c in before.columns))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_v")


def markdown(pages: DataFrame, sep: str, path: str, id_col: str = "doc_id") -> None:
    """One text to a document, pages joined by the separator, in directories by document."""
    g = pages.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("page", "line"))).alias("x"))
    g.select(id_col, F.array_join(F.col("x.line"), sep).alias("value")).write.mode("overwrite").partitionBy(id_col).text(path)


def archive_members(files: DataFrame, scope: str) -> DataFrame:
    """(path, scope) of the artefacts that an archive of that scope holds."""
    allowed = F.when(F.col("path").rlike(r"\.md$"), "text").when(F.col("path").rlike(r"meta\.json$"), "meta").when(F.col("path").rlike(r"\.(?:png|jpg)$"), "images").when(F.col("path").rlike(r"\.pdf$"), "pdf")
    out = files.withColumn("scope", allowed).where("scope is not null")
    return out if scope == "all" else out.where(F.col("scope").isin(scope, "meta"))
