"""Streams: incremental ingest, live health rules, live conformance metrics."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from traceloom import vocab
from traceloom.functions import numeric as nx
from traceloom.operators.dedup import COMPARE_WINDOW
from traceloom.operators.health import HEALTH_DEFAULTS
from traceloom.session import with_row_index
from traceloom.sources.logs import ingest

_KNOWN = "content_hash string, trace_id long, batch long"
STORED = ("trace_id", "ordinal", "task_id", "objective", "prompt", "response", "content_hash")


def ingest_stream(
    spark: SparkSession, source: str, table: str, checkpoint: str, *,
    privacy_mode: str = vocab.DEFAULT_PRIVACY_MODE, near_threshold: float | None = 0.82,
    chunk_rows: int = 20_000, files_per_batch: int = 1000, window: int = COMPARE_WINDOW,
) -> StreamingQuery:
    """Ingest new log files as they land, each batch against everything accepted before.

    Every micro-batch runs the batch plan against two states beside the table. The tail is the newest
    ``window`` accepted rows with their texts: a batch reads the one before it and writes its own. The
    hash table has one (content_hash, trace_id) per accepted row; a batch
    reads these two narrow columns and adds its own rows, and never the history's texts. Table, tail
    and hashes of a batch go to folders named by its id, which a retry overwrites, and a batch reads
    only folders of smaller ids, so a batch that ran twice leaves one copy.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        base = batch_id << 40
        ordered = with_row_index(
            batch.withColumn("__at", F.monotonically_increasing_id()), "file", "start", "__at",
            name="ordinal",
        ).withColumn("ordinal", F.col("ordinal") + F.lit(base))
        tail = known = None
        if batch_id > 0:
            tail = session.read.parquet(f"{table}_tail/batch={batch_id - 1}")
            known = session.read.schema(_KNOWN).option("basePath", f"{table}_hashes").parquet(
                f"{table}_hashes"
            ).filter(F.col("batch") < batch_id).select("content_hash", "trace_id")
        rows = ingest(
            ordered.select("value", "ordinal"), tail, known=known, run_id=batch_id,
            privacy_mode=privacy_mode, near_threshold=near_threshold, chunk_rows=chunk_rows,
        )
        rows.withColumn("trace_id", F.col("ordinal")).write.mode("overwrite").parquet(
            f"{table}/batch={batch_id}"
        )
        accepted = session.read.parquet(f"{table}/batch={batch_id}").filter("status = 'accepted'")
        newest = accepted.select(*STORED)
        if tail is not None:
            newest = newest.unionByName(tail)
        newest.orderBy(F.col("ordinal").desc()).limit(window).write.mode("overwrite").parquet(
            f"{table}_tail/batch={batch_id}"
        )
        accepted.select("content_hash", "trace_id").repartition(
            session.sparkContext.defaultParallelism, "content_hash"
        ).write.mode("overwrite").parquet(f"{table}_hashes/batch={batch_id}")

    lines = (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(source)
        .select("value", F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("start"))
    )
    return (
        lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def distinct_lines(lines: DataFrame, time: str, lateness: str) -> DataFrame:
    """Exact dedup of a stream by hash, with state bounded by a watermark."""
    return lines.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["content_hash"])


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HEALTH_COLUMNS = (
    "kl_divergence", "zero_variance_group", "completion_diversity", "hard_limit_fraction"
)
ABORT_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("update", T.LongType()),
        T.StructField("abort_reason", T.StringType()),
    ]
)
_Abort = Row(*ABORT_SCHEMA.names)


def _mean(values: list) -> float:
    return sum(values) / len(values)


#: Updates of a job that are judged by one state.
HEALTH_BLOCK = 1_000


class HealthProcessor(StatefulProcessor):
    """Keeps the last rows of a job's block and reports the first broken rule of every update.

    A key is (job, block): ``block`` updates in a row, which also gets the last rows before them, as
    many as the deepest rule looks back. Updates are judged in their own order, whatever the order
    they come in: one that comes before its predecessor waits for it, however long, and none is given
    up. What waits is bounded by the block. An update that comes twice is not judged again. A key
    without a block is a job of one block.
    """

    def __init__(self, limits: dict | None = None, block: int = HEALTH_BLOCK) -> None:
        self.limits = {**HEALTH_DEFAULTS, **(limits or {})}
        self.block = block
        self.mean_kl = self.limits.get("kl_abort_window")
        self.kl_rows = int(self.mean_kl or self.limits["kl_abort_consecutive"])
        self.depth = max(
            self.kl_rows, self.limits["zero_variance_window"],
            self.limits["diversity_window"], self.limits["hard_limit_window"],
        )

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Packed: a block costs one read and one write a batch, however many updates it holds.
        self.held = handle.getValueState("held", T.StructType([T.StructField("packed", T.BinaryType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        job, *block = key
        begin = block[0] * self.block if block else 0
        held = self.held.get()
        due, recent, early = pickle.loads(held[0]) if held else (
            max(0, begin - self.depth + 1), [[] for _ in HEALTH_COLUMNS], {})
        for row in rows:
            if row[1] >= due:
                early.setdefault(row[1], tuple(row[2 : 2 + len(HEALTH_COLUMNS)]))
        found = []
        while due in early:
            for column, value in zip(recent, early.pop(due)):
                column.append(value)
                del column[:-self.depth]
            reason = self._reason(*recent) if due >= begin else None
            if reason is not None:
                found.append(_Abort(job, due, reason))
            due += 1
        if block and due == begin + self.block:
            recent = []  # All judged; what comes again is too late.
        self.held.update((pickle.dumps((due, recent, early)),))
        return iter(found)

    def _reason(self, kl: list, zero: list, spread: list, hard: list) -> str | None:
        t = self.limits

        def over(how, column: list, count: int) -> float | None:
            """As in the batch rule: a full window of rows, and its values that are not null."""
            if len(column) < count:
                return None
            values = [value for value in column[-count:] if value is not None]
            return how(values) if values else None

        kl = over(_mean if self.mean_kl else min, kl, self.kl_rows)
        if kl is not None and kl > t["kl_threshold"]:
            if self.mean_kl:
                return f"mean KL exceeded {t['kl_threshold']} over {self.kl_rows} updates"
            return f"KL exceeded {t['kl_threshold']} for {self.kl_rows} consecutive updates"
        zero = over(_mean, zero, t["zero_variance_window"])
        if zero is not None and zero > t["zero_variance_abort_threshold"]:
            return "sustained zero-variance rollout groups"
        spread = over(_mean, spread, t["diversity_window"])
        if spread is not None and spread < t["diversity_abort_threshold"]:
            return "sustained completion-diversity collapse"
        hard = over(_mean, hard, t["hard_limit_window"])
        if hard is not None and hard > t["hard_limit_fraction_threshold"]:
            return "completion length repeatedly reached the hard limit"
        return None

    def close(self) -> None:
        pass


def health_stream(log: DataFrame, limits: dict | None = None, block: int = HEALTH_BLOCK) -> DataFrame:
    """Abort reasons as they appear; ``update`` is the dense position in the job, in any order of
    arrival. State is one short ring of rows per block of a job and its updates that wait for one
    before them; an update near the end of a block goes to the next block too, as what came before.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), see :func:`drained`.
    """
    judge = HealthProcessor(limits, block)
    update = F.col("update").cast("long")
    blocks = F.sequence(F.floor(update / block), F.floor((update + judge.depth - 1) / block))
    updates = log.filter(update >= 0).select(
        "job_id", update.alias("update"), *[F.col(name).cast("double") for name in HEALTH_COLUMNS],
        F.explode(blocks).alias("block"),
    )
    return updates.groupBy("job_id", "block").transformWithState(
        statefulProcessor=judge, outputStructType=ABORT_SCHEMA,
        outputMode="Append", timeMode="None",
    )


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream yields until its source is read to the end, as a table under ``folder``.

    Every micro-batch writes a folder of its own number, so one that runs again replaces what it wrote.
    State is kept by RocksDB. In ``complete`` mode the last micro-batch holds the whole result.
    """
    session = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    before = session.conf.get(_PROVIDER)
    session.conf.set(_PROVIDER, _ROCKS)
    try:
        query = (
            stream.writeStream.foreachBatch(keep).outputMode(mode)
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        session.conf.set(_PROVIDER, before)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    rows = session.read.schema(f"{fields}, batch long").option("basePath", f"{folder}/rows").parquet(
        f"{folder}/rows"
    )
    if mode == "complete":
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


def conformance_stream(events: DataFrame, window: str = "5 minutes",
                       lateness: str = "10 minutes") -> DataFrame:
    """Adherence rates per time window and workflow over a stream of events."""
    action = F.col("kind") == "action"
    actions = F.count_if(action)
    broken = action & (F.size("violations") > 0)
    return (
        events.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", window), "workflow_id")
        .agg(
            actions.alias("action_proposal_count"),
            F.count_if(F.col("kind") == "observation").alias("observation_count"),
            nx.ratio(F.count_if(action & F.col("accepted")), actions).alias("step_adherence"),
            nx.ratio(F.count_if(broken), actions).alias("invariant_violation_rate"),
        )
    )
