"""Session defaults, reliable checkpoints and global row numbering."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_ROW_BITS = 33
_SPREAD = "spark.traceloom.spreadLocalFiles"


def build_session(app: str = "traceloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for local work; on a cluster pass the cluster's own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config(_SPREAD, "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; invent one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(configured)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sent_if_few(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """A table that is usually short: stored, counted, and sent to the tasks when it is; else as stored.

    Spark plans a join before it knows how few rows an aggregate leaves, and would shuffle the other side.
    """
    stored = durable(df)
    return F.broadcast(stored) if stored.count() <= limit else stored


def spread(df: DataFrame) -> DataFrame:
    """In a session of :func:`build_session`, deal a small file's rows out to all cores.

    The local test files have one row group each, so one task would do all the text work. A cluster's
    session does not set the option: there tables are read as their splits come, and nothing is moved.
    """
    session = df.sparkSession
    if session.conf.get(_SPREAD, "false") != "true":
        return df
    return df.repartition(session.sparkContext.defaultParallelism)


def with_row_index(df: DataFrame, *order: Column | str, name: str = "row_index") -> DataFrame:
    """Zero-based position of every row in the total order ``order``.

    A window without partition keys would pull the table into one task. Here the
    rows are range-partitioned, numbered inside each partition, and shifted by the
    rows of the partitions before; only one row per partition meets in one place.
    ``order`` must be a total order (end it with a unique column). The checkpoint
    pins the layout, so both reads see the same partitions.
    """
    placed = durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__pos", F.monotonically_increasing_id())
    )
    part = F.shiftright("__pos", _LOCAL_ROW_BITS)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset")
    )
    local = F.col("__pos").bitwiseAND(F.lit((1 << _LOCAL_ROW_BITS) - 1))
    # One row per shuffle partition: bounded by the partition count, not by the data.
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + local)
        .drop("__part", "__offset", "__pos")
    )


def with_position(df: DataFrame, keys: list[str], *order: Column | str, name: str) -> DataFrame:
    """Zero-based position of every row inside its key, also for keys of any size.

    Rows are numbered over the whole table in (key, order), then each key's first number is
    subtracted, so no key has to fit into one task.
    """
    numbered = with_row_index(df, *keys, *order, name="__all")
    starts = numbered.groupBy(*keys).agg(F.min("__all").alias("__start"))
    return (
        numbered.join(starts, keys)
        .withColumn(name, F.col("__all") - F.col("__start"))
        .drop("__all", "__start")
    )
