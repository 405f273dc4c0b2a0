"""Pages: framing, splitting, joining, and budgets over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import PAGE_MARK, lines, strip_ws


def page_context(df: DataFrame, page: Column, sep: str, text_col: str = "text") -> DataFrame:
    """Adds total (pages of the document; 0 if it is empty) and page_text (page k, stripped; empty out of range)."""
    parts = F.split(F.col(text_col), rf"\Q{sep}\E", -1)
    total = F.when(F.col(text_col) == "", 0).otherwise(F.size(parts))
    inside = (page >= 1) & (page <= total)
    return df.withColumn("total", total.cast("long")).withColumn("page_text", F.when(inside, strip_ws(F.get(parts, (page - 1).cast("int")))).otherwise(""))


def split_marked(text: Column) -> Column:
    """Pages between page marks; what precedes the first mark is dropped only if blank; no mark means one page."""
    parts = F.split(text, PAGE_MARK, -1)
    dropped = (F.size(parts) > 1) & (strip_ws(F.get(parts, F.lit(0))) == "")
    return F.when(dropped, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)


def explode_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, page from 1, line)."""
    return df.select(id_col, F.posexplode(lines(F.col(text_col))).alias("pos", "line")).select(id_col, (F.col("pos") + 1).cast("long").alias("page"), "line")


def join_pages(pages: DataFrame, sep: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text, pages, framed): pages joined in order; framed tells whether splitting gives them back."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "line")))
    out = pages.groupBy(id_col).agg(ordered.alias("p")).select(id_col, F.array_join(F.col("p.line"), sep).alias("text"), F.size("p").cast("long").alias("pages"))
    return out.withColumn("framed", F.size(F.split("text", rf"\Q{sep}\E", -1)) == F.col("pages"))


def neutralize_separator(pages: DataFrame, core: str, id_col: str = "doc_id") -> DataFrame:
    """A line equal to the separator's core between blank lines (or the text's ends) becomes ***."""
    w = Window.partitionBy(id_col).orderBy("page")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    hit = (F.trim("line") == core) & blank(F.lag("line").over(w)) & blank(F.lead("line").over(w))
    return pages.withColumn("neutralized", hit).withColumn("line", F.when(F.col("neutralized"), "***").otherwise(F.col("line")))


def budgeted(pages: DataFrame, budget: int, id_col: str = "doc_id") -> DataFrame:
    """Lines under a running budget of characters: the line that crosses it is cut, later ones go."""
    w = Window.partitionBy(id_col).orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(F.length("line")).over(w) - F.length("line")
    left = F.lit(budget) - used
    return pages.withColumn("left", left).where("left > 0").withColumn("kept", F.expr("substring(line, 1, cast(left as int))")).withColumn("cut", F.length("line") > F.col("left")).drop("left")


def chunked(pages: DataFrame, size: int, id_col: str = "doc_id") -> DataFrame:
    """Adds chunk: groups of `size` pages in order."""
    return pages.withColumn("chunk", F.floor((F.col("page") - 1) / size).cast("long"))


def placeholders(counts: DataFrame, got: DataFrame, text: str, id_col: str = "doc_id") -> DataFrame:
    """One row for each page from 1 to n of counts (id, n); pages that got lacks hold the placeholder."""
    slots = counts.select(id_col, F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("n"), F.lit(1)))).alias("page"))
    return slots.join(got, [id_col, "page"], "left").withColumn("filled", F.col("line").isNull()).withColumn("line", F.coalesce("line", F.lit(text)))


def fold_overflow(pages: DataFrame, last: int) -> DataFrame:
    """Pages past the last are folded into it; prefix x1_, x2_, ... tells them apart."""
    over = F.greatest(F.col("page") - last, F.lit(0))
    return pages.withColumn("slot", F.least(F.col("page"), F.lit(last)).cast("long")).withColumn("prefix", F.when(over > 0, F.concat(F.lit("x"), over, F.lit("_"))).otherwise(""))
