"""Writers: raw archive, datasets with manifest, frozen and write-once tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions import hashing as hx
from traceloom.operators import datasets
from traceloom.operators.workflow import export_summary


class FrozenError(RuntimeError):
    """A frozen or write-once target would have changed."""


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def archive_raw(rows: DataFrame, path: str) -> None:
    """Redacted payloads of every line, duplicates too, one folder per run."""
    rows.write.mode("append").partitionBy("run_id").json(path)


def write_dataset(
    rows: DataFrame, path: str, *, name: str, dataset_type: str, version: str = "v0",
    privacy_mode: str = "private-local-only", fmt: str = "json",
) -> DataFrame:
    """Write rows and one manifest row computed from what was written."""
    rows.write.mode("errorifexists").format(fmt).save(f"{path}/data")
    spark = rows.sparkSession
    written = spark.read.schema(rows.schema).format(fmt).load(f"{path}/data")
    manifest = datasets.manifest(written, name, dataset_type, version, privacy_mode)
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")


def write_typed_datasets(rows: DataFrame, path: str) -> None:
    """All dataset types in one write, one folder per type."""
    rows.write.mode("errorifexists").partitionBy("dataset_type").json(path)


def _fingerprint(rows: DataFrame) -> DataFrame:
    facts = rows.agg(*hx.content_fingerprint(*sorted(rows.columns)))
    return facts.select(
        "row_count",
        hx.sha(F.concat_ws(":", "row_count", "hash_sum", "hash_xor")).alias("content_hash"),
    )


def freeze(items: DataFrame, path: str, *, name: str, version: str = "v0",
           overwrite: bool = False) -> DataFrame:
    """Frozen benchmark: refuses to overwrite; the manifest keeps the content hash."""
    spark = items.sparkSession
    if _exists(spark, f"{path}/manifest") and not overwrite:
        raise FrozenError(f"benchmark is frozen and cannot be overwritten: {path}")
    mode = "overwrite" if overwrite else "errorifexists"
    items.write.mode(mode).parquet(f"{path}/data")
    facts = _fingerprint(spark.read.parquet(f"{path}/data")).withColumns(
        {"name": F.lit(name), "version": F.lit(version), "frozen": F.lit(True)}
    )
    facts.write.mode(mode).parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def verify_frozen(spark: SparkSession, path: str) -> None:
    """Recompute the content hash and compare it with the manifest."""
    kept = spark.read.parquet(f"{path}/manifest").first()
    now = _fingerprint(spark.read.parquet(f"{path}/data")).first()
    if not kept["frozen"] or kept["content_hash"] != now["content_hash"]:
        raise FrozenError("frozen benchmark content hash changed")


def write_once(rows: DataFrame, path: str) -> str:
    """Same content again is a no-op, other content an error.

    Data goes to a staging folder first and is renamed, so readers never see half a table.
    """
    spark = rows.sparkSession
    jvm = spark._jvm
    staging = f"{path}.staging"
    rows.write.mode("overwrite").parquet(staging)
    fresh = _fingerprint(spark.read.parquet(staging)).first()["content_hash"]
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    stage, target = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(path)
    if fs.exists(target):
        kept = _fingerprint(spark.read.parquet(path)).first()["content_hash"]
        fs.delete(stage, True)
        if kept != fresh:
            raise FrozenError(f"artifact already exists with different content: {path}")
        return "unchanged"
    if not fs.rename(stage, target):
        raise FrozenError(f"could not publish {path}")
    return "written"


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def register_dataset_items(items: DataFrame, traces: DataFrame, path: str, dataset_id: int) -> None:
    """Append item rows with the trace they come from."""
    datasets.item_lineage(items, traces).select(
        F.lit(dataset_id).alias("dataset_id"), "trace_id",
        F.col("dataset_type").alias("item_type"), F.lit(True).alias("accepted"),
    ).write.mode("append").parquet(path)


def export_examples(examples: DataFrame, path: str) -> DataFrame:
    """Next-action examples with a manifest that says whether negatives and corrections exist."""
    examples.write.mode("errorifexists").json(f"{path}/data")
    summary = export_summary(examples)
    summary.write.mode("errorifexists").json(f"{path}/manifest")
    return examples.sparkSession.read.schema(summary.schema).json(f"{path}/manifest")


def upsert_table(stored_path: str, fresh: DataFrame, target_path: str) -> DataFrame:
    """Latest-wins rewrite of a score or compression table to a new folder."""
    from traceloom.operators.labeling import upsert_by_trace

    spark = fresh.sparkSession
    merged = upsert_by_trace(spark.read.parquet(stored_path), fresh)
    merged.write.mode("errorifexists").parquet(target_path)
    return spark.read.parquet(target_path)
