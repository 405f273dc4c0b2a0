"""Ordered folds: rules that depend on what has been accumulated, which a lag cannot state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import cut


def visual_lines(spans: DataFrame, key: str, size: float) -> DataFrame:
    """(key, span, line): a new line starts where y leaves the first span of the line by max(1.25, .55 size).

    A fold over the ordered spans of a page, as an expression: the anchor is the first span, not the one before."""
    gap = max(1.25, 0.55 * size)
    g = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y", "x", "span"))).alias("s"))  # spans of one page
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("line"), F.expr("cast(array() as array<struct<span: bigint, line: int>>)").alias("out"))

    def step(acc, s):
        fresh = acc["anchor"].isNull() | (s["y"] - acc["anchor"] > gap)
        line = F.when(fresh, acc["line"] + 1).otherwise(acc["line"])
        return F.struct(F.when(fresh, s["y"].cast("double")).otherwise(acc["anchor"]).alias("anchor"), line.alias("line"), F.concat(acc["out"], F.array(F.struct(s["span"].cast("bigint").alias("span"), line.alias("line")))).alias("out"))

    return g.select(key, F.explode(F.aggregate("s", start, step, lambda acc: acc["out"])).alias("o")).select(key, "o.span", F.col("o.line").cast("long").alias("line"))


def merge_fragments(blocks: DataFrame, key: str, gap: float = 0.6) -> DataFrame:
    """(key, group, x0, y0, x1, y1, n): neighbours on a row whose vertical overlap is 0.4 or more and whose gap is at most
    `gap` heights are merged, the box growing as it goes. One pass over the ordered blocks, which holds one box at a time,
    so a page may have any number of them."""
    kind = blocks.schema[key].dataType.simpleString()
    names = [key, "group", "x0", "y0", "x1", "y1", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        page, group, box, n = None, 0, None, 0
        for batch in batches:
            for k, x0, y0, x1, y1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if box is not None and k == page:
                    a0, b0, a1, b1 = box
                    high = max(1, min(b1 - b0, y1 - y0))
                    if min(b1, y1) - max(b0, y0) >= 0.4 * high and 0 <= x0 - a1 <= gap * high:
                        box, n = (a0, min(b0, y0), max(a1, x1), max(b1, y1)), n + 1
                        continue
                if box is not None:
                    out.append((page, group, *box, n))
                group = group + 1 if box is not None and k == page else 0
                page, box, n = k, (x0, y0, x1, y1), 1
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        if box is not None:
            out.append((page, group, *box, n))
        yield _batch(out)

    key_type = blocks.select(key).limit(0).toArrow().schema.field(0).type

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, [key_type] + [pa.int64()] * 6, strict=True)], names=names)

    ordered = blocks.repartition(key).sortWithinPartitions(key, "y0", "x0", "idx").select(key, *(F.col(c).cast("long") for c in ("x0", "y0", "x1", "y1")))
    return ordered.mapInArrow(run, f"{key} {kind}, group long, x0 long, y0 long, x1 long, y1 long, n long")


def dag_cost(edges: DataFrame, own: DataFrame, cap: int, most: int = 64) -> DataFrame:
    """(node, cost): own cost and that of all calls below, counted once for each call, saturating at cap.

    Levels from the leaves up: a node is ready when all its calls are. edges: (node, child); own: (node, cost)."""
    calls = edges.groupBy("node", "child").agg(F.count("*").alias("times"))
    done = cut(own.join(calls, "node", "left_anti").select("node", F.least(F.col("cost"), F.lit(cap)).cast("long").alias("total")))
    left = cut(own.join(done, "node", "left_anti"))
    for _ in range(most):
        if left.isEmpty():
            return done.withColumnRenamed("total", "cost")
        open_ = left.join(calls, "node").join(done.withColumnRenamed("node", "child"), "child", "left")
        ready = open_.groupBy("node", "cost").agg(F.bool_and(F.col("total").isNotNull()).alias("all"), F.sum(F.col("total") * F.col("times")).alias("below")).where("all")
        now = cut(ready.select("node", F.least(F.col("cost") + F.col("below"), F.lit(cap)).cast("long").alias("total")))
        if now.isEmpty():
            break  # calls in a circle: what is left never ends
        done, left = cut(done.unionByName(now)), cut(left.join(now, "node", "left_anti"))
    return done.withColumnRenamed("total", "cost").unionByName(left.select("node", F.lit(cap).cast("long").alias("cost")))


def flow_components(blocks: DataFrame, key: str, share: float = 0.35, gap: int = 40) -> DataFrame:
    """(key, idx, component): blocks from top to bottom join the open component that they overlap most in width, if that is
    a share of the narrower one and the gap is small; others open one."""
    import pandas as pd

    kind = blocks.schema[key].dataType.simpleString()

    def run(df: pd.DataFrame) -> pd.DataFrame:
        open_: list[list] = []
        out = []
        for idx, x0, y0, x1, y1 in df.sort_values(["y0", "x0", "idx"])[["idx", "x0", "y0", "x1", "y1"]].itertuples(index=False):
            best, where = 0.0, None
            for c, (a0, a1, low) in enumerate(open_):
                part = (min(a1, x1) - max(a0, x0)) / max(1, min(a1 - a0, x1 - x0))
                if part >= share and y0 - low <= gap and part > best:
                    best, where = part, c
            if where is None:
                open_.append([x0, x1, y1])
                where = len(open_) - 1
            else:
                open_[where] = [min(open_[where][0], x0), max(open_[where][1], x1), max(open_[where][2], y1)]
            out.append((df[key].iloc[0], idx, where))
        return pd.DataFrame(out, columns=[key, "idx", "component"])

    return blocks.groupBy(key).applyInPandas(run, f"{key} {kind}, idx long, component long")
