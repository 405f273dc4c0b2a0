"""Items whose words stand in documents as long runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.arrays import let
from leafmill.functions.text import words_of
from leafmill.session import cut

RUN, SHARE = 8, 0.8
#: Rows of two numbers up to which a side is broadcast, about 32 MB.
BROADCAST_ROWS = 1_000_000


def _runs(words: Column) -> Column:
    """Hashes of the distinct runs of RUN words."""
    none = F.expr("cast(array() as array<bigint>)")
    return let(words, lambda w: F.when(F.size(w) >= RUN, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - RUN + 1), lambda k: F.xxhash64(F.slice(w, k, F.lit(RUN)))))).otherwise(none))


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def echoed_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item): documents that hold SHARE (RUN at least) of an item's words in a row.

    Hashes of runs meet first, as narrow rows; only the texts of documents that met an item are looked at again."""
    body = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    item = items.select(F.col(item_col), words_of(F.col(item_text)).alias("w")).withColumn("n", F.greatest(F.lit(RUN), F.ceil(F.size("w") * SHARE)).cast("int")).where("size(w) >= n")
    own = docs.select(id_col, F.explode(_runs(words_of(F.col(text_col)))).alias("run"))
    pairs = cut(own.join(_small(item.select(item_col, F.explode(_runs(F.col("w"))).alias("run"))), "run").select(id_col, item_col).distinct())  # counted, then joined
    full = item.select(item_col, F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda k: body(F.slice("w", k, F.col("n")))).alias("full"))
    checked = docs.join(_small(pairs), id_col).select(id_col, item_col, body(words_of(F.col(text_col))).alias("body")).join(full, item_col)
    return checked.where(F.exists("full", lambda x: F.contains("body", x))).select(id_col, item_col).distinct()
