"""Operator 2: minimax contiguous partition of documents into shards of near equal bytes (law ``bytes``).

Every row belongs to a unit: a slice of the hash space of its text, so equal
texts share a unit and are never parted. The units are the ordered atomic
groups. Their number is fixed (2**UNIT_BITS), whatever the input, so their
sizes are pre-aggregated on the executors and the driver sees a bounded
vector. There a binary search finds the smallest feasible capacity, each
candidate being checked greedily, and the sequence is cut under it. A unit
of at least the mean load (a hot group of copies) gets a shard to itself
first, as no contiguous cut could balance the others around it.

The result of that is an expression of at most two literals a shard, so rows
find their shard without a join. Slots are numbered without gathering a shard
in one task: rows are dealt by their number into cells (shard, salt), cells are
numbered in parallel, and their bases are prefix sums of the cells' counts.

Defined results: a null text has the bytes of an empty one (size 16, crc 0)
and is grouped with empty texts; very long texts count with all their bytes;
of two cuts equally near the even point the first is taken; repeated rows get a
slot each, in any order among themselves; an empty table gives an empty result;
fewer units than shards leave shards empty; columns other than the id and the
text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.storage import Scratch

UNIT_BITS = 18
OVERHEAD = 16
#: Rows of a cell at which shards are dealt into more cells.
CELL_ROWS = 200_000
#: Cells of all shards at most: their bases are broadcast (2 MB). Beyond it cells hold more rows, which are sorted on disk.
CELLS = 1 << 17


def _greedy(prefix: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends of greedily filled shards, or None if they need more than there are."""
    ends, at, last = [], 0, len(prefix) - 1
    for _ in range(shards):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
        ends.append(at)
        if at == last:
            return ends + [last] * (shards - len(ends))
    return None


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity with which the ordered sizes fit into that many contiguous shards."""
    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(sizes):
        return 0
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    low, high = max(int(sizes.max()), -(-int(prefix[-1]) // shards)), int(prefix[-1])
    while low < high:
        mid = (low + high) // 2
        if _greedy(prefix, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def contiguous_cuts(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Start of each shard in the sequence: none exceeds the smallest capacity, and each cut
    is as near to the even one as that allows."""
    sizes = np.asarray(sizes, dtype=np.int64)
    capacity = smallest_capacity(sizes, shards)
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    n, latest = len(sizes), np.zeros(shards + 1, dtype=np.int64)
    latest[shards] = n
    for s in range(shards - 1, -1, -1):  # the first start from which the rest still fits
        latest[s] = np.searchsorted(prefix, prefix[latest[s + 1]] - capacity, side="left")
    cuts = np.zeros(shards, dtype=np.int64)
    for s in range(1, shards):
        furthest = int(np.searchsorted(prefix, prefix[cuts[s - 1]] + capacity, side="right")) - 1
        even = prefix[-1] * s / shards
        near = int(np.searchsorted(prefix, even))
        if near > 0 and even - prefix[near - 1] <= prefix[min(near, n)] - even:
            near -= 1
        cuts[s] = min(max(near, int(latest[s]), int(cuts[s - 1])), furthest)
    return cuts


def assign_units(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit: units of the mean load or more alone, the rest by contiguous cuts."""
    sizes = np.asarray(sizes, dtype=np.int64)
    out = np.zeros(len(sizes), dtype=np.int32)
    rest, left, heavy = int(sizes.sum()), shards, []
    for k in np.argsort(-sizes, kind="stable"):
        if left <= 1 or sizes[k] * left < rest or sizes[k] == 0:
            break
        heavy.append(k)
        rest -= int(sizes[k])
        left -= 1
    light = np.setdiff1d(np.arange(len(sizes)), heavy)
    if len(light):
        cuts = contiguous_cuts(sizes[light], left)
        out[light] = np.searchsorted(cuts, np.arange(len(light)), side="right") - 1
    for i, k in enumerate(heavy):
        out[k] = left + i
    return out


def shard_of(units: np.ndarray, shard: np.ndarray, shards: int, unit: Column) -> Column:
    """The shard of a unit as an expression of at most two literals a shard: units that are alone in theirs, and first units of the others."""
    alone = {int(s): int(u[0]) for s in np.unique(shard) if len(u := units[shard == s]) == 1}
    firsts = sorted((int(units[shard == s].min()), int(s)) for s in np.unique(shard) if int(s) not in alone)
    found = F.lit(0)
    if firsts:
        starts, names = (F.array(*(F.lit(x) for x in column)) for column in zip(*firsts, strict=True))
        found = F.coalesce(F.get(names, F.size(F.filter(starts, lambda x: x <= unit)) - 1), F.lit(0))
    for s, u in alone.items():
        found = F.when(unit == u, s).otherwise(found)
    return found.cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = scratch.table(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - UNIT_BITS).cast("int").alias("unit"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    units = rows.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).toPandas().sort_values("unit")  # at most 2**UNIT_BITS
    shard = assign_units(units["bytes"].to_numpy(np.int64), shards)
    busiest = int(units["n"].groupby(shard).sum().max()) if len(units) else 0
    salts = min(max(16, -(-busiest // CELL_ROWS)), max(16, CELLS // shards))
    # dealt by the row's number, which was written: equal rows and rows without an id are in all cells alike
    placed = rows.withColumn("shard", shard_of(units["unit"].to_numpy(np.int64), shard, shards, F.col("unit"))).withColumn(
        "cell", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")
    )
    cells = placed.groupBy("shard", "cell").count().toPandas().sort_values(["shard", "cell"])  # at most CELLS rows, or 16 a shard
    cells["base"] = (cells.groupby("shard")["count"].cumsum() - cells["count"]).astype("int64")
    bases = spark.createDataFrame(cells[["shard", "cell", "base"]], "shard int, cell int, base long")
    within = Window.partitionBy("shard", "cell").orderBy("id", "text_crc32", "size", "row")
    return placed.join(F.broadcast(bases), ["shard", "cell"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.row_number().over(within) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
