"""Jobs, queues, event logs, rate windows and ordered frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import cut, global_rank


def latest_state(events: DataFrame, key: str, order: list[str], *cols: str) -> DataFrame:
    """Last event of each key wins."""
    return events.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("s")).select(key, *(f"s.{c}" for c in cols))


def queue_position(jobs: DataFrame, status: str = "status", seq: str = "submit_seq", inserted: str = "job_id") -> DataFrame:
    """Adds position: 1-based among queued jobs by submit sequence (missing last), then insertion; null for others."""
    queued = global_rank(jobs.where(F.col(status) == "queued"), [F.col(seq).asc_nulls_last(), F.col(inserted)], "position")
    return queued.unionByName(jobs.where(~F.col(status).eqNullSafe("queued")).withColumn("position", F.lit(None).cast("long")))


def keyset_page(rows: DataFrame, order: str, key: str, before: tuple | None, size: int) -> DataFrame:
    """The page after the cursor in descending order, with has_more; one row more than asked is looked at."""
    if before is not None:
        rows = rows.where((F.col(order) < F.lit(before[0])) | ((F.col(order) == F.lit(before[0])) & (F.col(key) < F.lit(before[1]))))
    top = rows.orderBy(F.desc(order), F.desc(key)).limit(size + 1)
    w = Window.orderBy(F.desc(order), F.desc(key))
    return top.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size).where(F.col("rank") <= size)


def expired(activity: DataFrame, key: str, ts: Column, now: Column, ttl_us: int, protected: Column) -> DataFrame:
    """(key, last_us) of keys without activity for the time to live; protected keys stay."""
    last = activity.groupBy(key).agg(F.max(ts).alias("last_us"), F.bool_or(protected).alias("protected"))
    return last.where((F.col("last_us") < now - ttl_us) & ~F.col("protected")).select(key, "last_us")


def window_counts(events: DataFrame, key: str, ts: Column, span: int, limit: int) -> DataFrame:
    """Adds in_window (events of the key in the trailing span, itself included) and over (beyond the limit)."""
    w = Window.partitionBy(key).orderBy("_ts").rangeBetween(-(span - 1), 0)
    return events.withColumn("_ts", ts).withColumn("in_window", F.count("*").over(w)).withColumn("over", F.col("in_window") > limit).drop("_ts")


def replay_log(events: DataFrame, key: str, order: list[str], reset: Column, text: str) -> DataFrame:
    """(key, log, n): texts after the last reset of each key, in order.

    The last resets are found by an aggregation; only what comes after them is put together, as the log of a key is one text."""
    last = events.where(reset).groupBy(key).agg(F.max(F.struct(*order)).alias("_reset"))
    kept = events.where(~reset).withColumn("_o", F.struct(*order)).join(last, key, "left").where(F.col("_reset").isNull() | (F.col("_o") > F.col("_reset")))
    g = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_o", text))).alias("x"))
    return g.select(key, F.array_join(F.col(f"x.{text}"), "").alias("log"), F.size("x").cast("long").alias("n"))


def tail_capped(log: Column, most: int) -> tuple[Column, Column]:
    """(last `most` characters, whether something was dropped)."""
    return F.right(log, F.lit(most)), F.length(log) > most


def head_capped(rows: DataFrame, key: str, order: list[str], text: str, keep: int) -> DataFrame:
    """Texts of the first `keep` characters of the concatenated log; the entry that crosses the end is cut."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.lit(keep) - (F.sum(F.length(text)).over(w) - F.length(text))
    return rows.withColumn("_left", left).where("_left > 0").withColumn(text, F.expr(f"substring({text}, 1, cast(_left as int))")).drop("_left")


def keep_last(rows: DataFrame, identity: list[str], order: list[str], most: int, partition: str) -> DataFrame:
    """The newest row of each identity, and of those the last `most` of each partition."""
    newest = Window.partitionBy(*identity).orderBy(*(F.desc(c) for c in order))
    last = Window.partitionBy(partition).orderBy(*(F.desc(c) for c in order))
    one = rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1")
    return one.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= most).drop("_r")


def weighted_median(rows: DataFrame, key: list[str], value: str, weight: str) -> DataFrame:
    """(key, median): the least value at which the running weight reaches half of the total (lower median).

    Values are dealt into ranges; sums of the ranges tell the one that holds a key's median, and only its values are run through."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_value = rows.groupBy(*key, value).agg(F.sum(weight).alias("_w"))
    ranged = cut(by_value.repartitionByRange(parts, *key, value).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy(*key)
    sums = ranged.groupBy(*key, "_range").agg(F.sum("_w").alias("_s"))  # as many rows of a key as there are ranges, at most
    sums = sums.withColumn("_base", F.sum("_s").over(own.orderBy("_range")) - F.col("_s")).withColumn("_t", F.sum("_s").over(own))
    there = sums.where("_base * 2 < _t and (_base + _s) * 2 >= _t").drop("_s")
    run = ranged.join(there, [*key, "_range"]).withColumn("_c", F.col("_base") + F.sum("_w").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.where("_c * 2 >= _t").groupBy(*key).agg(F.min(value).alias("median"))


def reason_report(rows: DataFrame, reason: str, page: str, sample: int = 5) -> DataFrame:
    """(reason, n, pages, first_pages): mergeable counters with the first distinct pages of each reason."""
    by_page = rows.groupBy(reason, page).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(reason).orderBy(page)
    ranked = by_page.withColumn("_r", F.row_number().over(w))
    return ranked.groupBy(reason).agg(
        F.sum("_n").alias("n"), F.count("*").alias("pages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= sample, F.col(page)))), lambda x: x.cast("string")), ",").alias("first_pages"),
    )


def position_lookup(heights: DataFrame, asked: DataFrame, key: str, order: str, height: str, offset: str) -> DataFrame:
    """The band in which each asked offset falls, and the fraction of it above: running heights, then an as-of join.

    Bands and offsets are merged by position and the last band is carried forward, so no pair of rows is formed."""
    w = Window.partitionBy(key).orderBy(order)
    bands = heights.withColumn("_top", F.coalesce(F.sum(height).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = bands.select(key, F.col("_top").alias("_pos"), F.lit(0).alias("_side"), F.struct(F.col(order).alias("band"), F.col("_top").alias("top"), F.col(height).alias("h")).alias("_b"), F.lit(None).cast("long").alias(offset))
    right = asked.select(key, F.col(offset).alias("_pos"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema["_b"].dataType).alias("_b"), F.col(offset).cast("long").alias(offset))
    run = Window.partitionBy(key).orderBy("_pos", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = left.unionByName(right).withColumn("_at", F.last("_b", ignorenulls=True).over(run)).where("_side = 1")
    inside = F.least(F.lit(1.0), (F.col(offset) - F.col("_at.top")) / F.col("_at.h"))
    return found.select(key, offset, F.col("_at.band").alias("band"), F.round(inside, 6).alias("fraction"))


def missing_batches(pages: DataFrame, key: str, page: str, loaded: Column, most: int) -> DataFrame:
    """(key, first, last): runs of pages that are not loaded, cut into batches of at most `most`."""
    w = Window.partitionBy(key).orderBy(page)
    gap = pages.where(~loaded).withColumn("_island", F.col(page) - F.row_number().over(w))
    part = gap.withColumn("_k", F.floor((F.row_number().over(Window.partitionBy(key, "_island").orderBy(page)) - 1) / most))
    return part.groupBy(key, "_island", "_k").agg(F.min(page).alias("first"), F.max(page).alias("last")).drop("_island", "_k")


def first_attempts(attempts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds won: of the attempts to claim or cancel a waiting job exactly the first one succeeds; those on other jobs never do.

    attempts: (key, order, waiting)."""
    rank = F.row_number().over(Window.partitionBy(key, "waiting").orderBy(*order))
    return attempts.withColumn("won", F.col("waiting") & (rank == 1))


def created_order(created_at: Column) -> Column:
    """Nanoseconds of an ISO date, by which jobs without a submit order are restored; 0 for what is none."""
    return F.coalesce(F.unix_seconds(F.try_to_timestamp(created_at)) * 1_000_000_000, F.lit(0).cast("long"))


def iso(ts: Column) -> Column:
    """A time as it is written in job records: UTC, seconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("iso")


def page_frame(total: Column, current: Column, radius: int) -> Column:
    """(start, end) of the pages around the current one, which is kept within the document; 1 to 0 for an empty one."""
    active = F.least(total, F.greatest(F.lit(1), current))
    empty = total <= 0
    return F.struct(F.when(empty, 1).otherwise(F.greatest(F.lit(1), active - radius)).cast("long").alias("start"), F.when(empty, 0).otherwise(F.least(total, active + radius)).cast("long").alias("end"))


def page_slice(pages: DataFrame, key: str, page: str, start: Column, limit: int) -> DataFrame:
    """Pages from start on, `limit` at most, with the total number of pages of their document."""
    totals = pages.groupBy(key).agg(F.count("*").alias("total"))
    return pages.where((F.col(page) >= start) & (F.col(page) < start + limit)).join(totals, key)


def top_messages(rows: DataFrame, text: str, most: int = 3) -> DataFrame:
    """Distinct messages with counts, the first few, and how many more kinds there are."""
    counts = rows.groupBy(text).agg(F.count("*").alias("n"))
    kinds = counts.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return counts.orderBy(F.desc("n"), text).limit(most).crossJoin(F.broadcast(kinds))  # one row


def revision(rows: DataFrame, key: str, parts: Column, order: str) -> DataFrame:
    """(key, revision): 20 hex digits of the digest of the ordered parts."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, parts.alias("_p")))).alias("x"))
    return g.select(key, F.substring(F.sha2(F.array_join(F.col("x._p"), "\n"), 256), 1, 20).alias("revision"))
