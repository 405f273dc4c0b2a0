"""Session construction with settings that hold from one machine to a large cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Settings that do not depend on the size of the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "leafmill", master: str | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one with DEFAULTS; conf overrides them.

    On a cluster the master and memory come from spark-submit; a local master
    is used only where none is given.
    """
    active = SparkSession.getActiveSession()
    if active is not None and not conf and master is None:
        return active
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | conf)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master may do without: a folder of our own is made for it."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='leafmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def working_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/leafmill/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed to the shared folder: cuts its lineage and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is a scan of fewer splits than there are, as of one large row group; else as it is.

    Only plans without an exchange or a cache are looked at: to count the partitions of others would run them."""
    plan = df._jdf.queryExecution()
    text = plan.executedPlan().toString()
    if "Exchange" in text or "InMemory" in text:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the 1-based rank over the whole of df without one task seeing all of it: ranges of the order are numbered
    on their own, from the counts of the ranges before. What reaches the driver is a count to a range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    base, total = [], 0
    for row in ranged.groupBy("_range").count().orderBy("_range").collect():
        base.append((row["_range"], total))
        total += row["count"]
    bases = df.sparkSession.createDataFrame(base, "_range int, _base long")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(bases), "_range").withColumn(name, F.col("_base") + F.col("_own")).drop("_range", "_own", "_base")
