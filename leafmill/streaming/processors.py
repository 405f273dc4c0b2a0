"""Machines over keyed streams and over batches.

run_stream keeps each key's machine in the state of applyInPandasWithState: the
state is the machine's JSON, so it survives restarts with the query's checkpoint.
run_batch folds the same machine over the ordered rows of each key. A stream's
result is the same as the batch's, however its rows fall into micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafmill.streaming.machines import Factory

OUT = "key string, seq long, event string, data string"
ARROW = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("event", pa.string()), ("data", pa.string())])


def _fold(machine, key: str, rows: pd.DataFrame, start: int, end_mark: str) -> tuple[list[tuple], int]:
    out = []
    for text in rows.sort_values("seq")["text"]:
        for event, data in machine.finish() if text == end_mark else machine.feed(text):
            out.append((key, start, event, data))
            start += 1
    return out, start


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 4, ARROW.types, strict=True)], schema=ARROW)


def run_batch(rows: DataFrame, factory: Factory) -> DataFrame:
    """(key, seq, event, data) of rows (key, seq, text): each key's rows in order through one machine, then its end.

    A task reads its keys one after another as they are sorted, so neither a key costs a frame of its own nor a long one memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, last, seq = None, None, 0
        for batch in batches:
            out = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if machine is None or key != last:
                    out += [(last, seq + k, *e) for k, e in enumerate(machine.finish())] if machine else []
                    machine, last, seq = factory(None), key, 0
                for event, data in machine.feed(text):
                    out.append((key, seq, event, data))
                    seq += 1
            yield _batch(out)
        if machine is not None:
            yield _batch([(last, seq + k, *e) for k, e in enumerate(machine.finish())])

    each = rows.select(F.col("key").cast("string"), F.col("seq").cast("long"), "text")
    return each.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, OUT)


def run_pieces(rows: DataFrame, factory: Factory) -> DataFrame:
    """The same of rows (key, pieces): all pieces of a key, in order, stand in its one row, so nothing is moved or sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, texts = [], iter(batch.column("pieces").flatten().to_pylist())
            for key, n in zip(batch.column("key").to_pylist(), batch.column("pieces").value_lengths().to_pylist(), strict=True):
                machine, events = factory(None), []
                for text in islice(texts, n or 0):
                    events += machine.feed(text)
                events += machine.finish()
                out += [(key, k, *e) for k, e in enumerate(events)]
            yield _batch(out)

    return rows.select(F.col("key").cast("string"), "pieces").mapInArrow(run, OUT)


def run_stream(stream: DataFrame, factory: Factory, end_mark: str = "\u0004") -> DataFrame:
    """The same over a stream; a row whose text is end_mark ends its key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, seq = state.get if state.exists else (None, 0)
        machine = factory(json.loads(kept) if kept else None)
        out, seq = _fold(machine, key[0], pd.concat(list(frames)), seq, end_mark)
        state.update((json.dumps(machine.s), seq))
        yield pd.DataFrame(out, columns=["key", "seq", "event", "data"])

    rows = stream.select(F.col("key").cast("string"), F.col("seq").cast("long"), "text")
    return rows.groupBy("key").applyInPandasWithState(step, OUT, "machine string, seq long", "append", GroupStateTimeout.NoTimeout)


def last_activity(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, last, n): latest event of each channel; update mode."""
    return stream.groupBy(key).agg(F.max(ts).alias("last"), F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, ts: str, key: str, span: str, late: str) -> DataFrame:
    """(start, key, n) in tumbling windows; events later than the watermark are left out. ts may be without time zone."""
    at = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return at.groupBy(F.window("_ts", span).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: str):
    """Starts a query that keeps the latest row of each key in Parquet versions under path; a batch that runs again
    writes the same version."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v={number - 1}"
        rows = batch if number == 0 else batch.unionByName(spark.read.parquet(before))
        latest = rows.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")
        latest.write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
