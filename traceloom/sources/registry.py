"""Registry tables: selective reads, first-wins and immutable inserts, flags, long forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import hashing as hx
from traceloom.functions import jsonx as jx
from traceloom.functions import text as tx
from traceloom.operators.labeling import attach_labels_scores


def selector_limit(selector: str | None) -> int | None:
    """Row limit of ``last_N`` or digits; None for everything else."""
    if not selector or selector == "all":
        return None
    digits = selector.removeprefix("last_")
    return int(digits) if digits.isdigit() else None


def trace_rows(
    traces: DataFrame, labels: DataFrame, scores: DataFrame, *, run_id: int | None = None,
    selector: str | None = None, fanout: bool = True,
) -> DataFrame:
    """Traces with labels and scores, newest N joined rows (the limit counts joined rows).

    Ordering only serves the limit; the sink sorts.
    """
    if run_id is not None:
        traces = traces.filter(F.col("run_id") == run_id)
    rows = attach_labels_scores(traces, labels, scores, fanout=fanout)
    if "score" in rows.columns:
        rows = rows.withColumn("score", F.coalesce("quality_score", "score"))
    else:
        rows = rows.withColumn("score", F.col("quality_score"))
    limit = selector_limit(selector)
    if limit is None:
        return rows
    return rows.orderBy(F.col("trace_id").desc(), F.col("label").desc()).limit(limit)


EVENT_DEFAULTS = {
    "state_before": "{}", "proposal": "{}", "violations": "[]", "expected_action": "{}",
    "observation": "{}", "state_after": "{}", "teacher_correction": "{}", "verifier": "{}",
}


def execution_events(events: DataFrame, session: str | None = None) -> DataFrame:
    """Events with their JSON columns parsed, defaults for null and broken text."""
    rows = events if session is None else events.filter(F.col("session_id") == session)
    return rows.withColumns(
        {
            name: jx.parse_or(name, default)
            for name, default in EVENT_DEFAULTS.items() if name in events.columns
        }
    )


def workflow_versions(
    workflows: DataFrame, status: str | None = None, category: str | None = None
) -> DataFrame:
    rows = workflows
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    return rows


def newest_version(workflows: DataFrame, key: str = "workflow_id") -> DataFrame:
    """Highest version of every workflow, its status looked at only afterwards."""
    return workflows.groupBy(key).agg(
        F.max_by(F.struct(*workflows.columns), "version").alias("w")
    ).select("w.*")


def lineage_of_task(lineage: DataFrame, members: DataFrame, task_id: int) -> DataFrame:
    wanted = members.filter(F.col("task_id") == task_id).select("member_id")
    return lineage.join(wanted, "member_id", "left_semi")


def lineage_of_tasks(lineage: DataFrame, members: DataFrame) -> DataFrame:
    """Lineage rows of members that belong to some task."""
    return lineage.join(members.select("member_id").distinct(), "member_id", "left_semi")


def training_records(records: DataFrame, member_id: str | None = None) -> DataFrame:
    return records if member_id is None else records.filter(F.col("member_id") == member_id)


def incumbents(members: DataFrame) -> DataFrame:
    """Newest incumbent member of every task."""
    return members.filter("is_incumbent").groupBy("task_id").agg(
        F.max_by("member_id", "row_id").alias("member_id"), F.max("row_id").alias("row_id")
    )


def evolution_context(
    traces: DataFrame, labels: DataFrame, scores: DataFrame, benchmarks: DataFrame,
    results: DataFrame, run_id: int | None = None,
) -> dict[str, DataFrame]:
    """Lazy views of everything an improvement step looks at."""
    chosen = traces if run_id is None else traces.filter(F.col("run_id") == run_id)
    return {
        "traces": chosen, "labels": labels, "scores": scores, "benchmarks": benchmarks,
        "verifier_reports": results,
    }


def artifact_keywords(files: DataFrame, words: tuple[str, ...] = ("cost", "quality", "safety")) -> DataFrame:
    """(keyword, path) of artifact texts that mention a keyword. ``files``: path, text."""
    text = F.lower("text")
    hits = F.array_compact(F.array(*[F.when(text.contains(w), F.lit(w)) for w in words]))
    return files.select(F.explode(hits).alias("keyword"), "path")


def read_artifacts(spark, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text")
    )


def insert_first_wins(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows whose key is new, first of equal keys by ``ordinal``."""
    firsts = fresh.groupBy(key).agg(F.min("ordinal").alias("ordinal"))
    return fresh.join(firsts, [key, "ordinal"], "left_semi").join(
        stored.select(key), key, "left_anti"
    )


def insert_immutable(
    stored: DataFrame, fresh: DataFrame, key: str, content: str = "content_hash"
) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): a known key must come with the same content."""
    versions = fresh.select(key, content).unionByName(stored.select(key, content)).groupBy(key).agg(
        F.count_distinct(content).alias("versions")
    )
    conflicts = versions.filter("versions > 1").join(fresh.select(key).distinct(), key, "left_semi")
    sound = fresh.join(conflicts, key, "left_anti")
    return sound.join(stored.select(key), key, "left_anti").dropDuplicates([key]), conflicts


def hash_problems(rows: DataFrame, body: list[str], stored_hash: str) -> DataFrame:
    """Rows whose stored hash does not match their content."""
    return rows.filter(~F.col(stored_hash).eqNullSafe(hx.row_hash(*body)))


def set_incumbents(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """Clear the flag of every task in ``chosen`` and set it on the chosen members."""
    tasks = chosen.select("task_id", F.lit(True).alias("__task")).distinct()
    picks = chosen.select("member_id", F.lit(True).alias("__pick")).distinct()
    return (
        members.join(tasks, "task_id", "left").join(picks, "member_id", "left")
        .withColumn(
            "is_incumbent",
            F.when(F.col("__pick"), True).when(F.col("__task"), False)
            .otherwise(F.col("is_incumbent")),
        )
        .drop("__task", "__pick")
    )


def comparison_rows(reports: DataFrame) -> DataFrame:
    """One row per experiment and metric from a map metric -> (control, variant, delta)."""
    return reports.select(
        "experiment_id",
        F.when(F.col("primary_metric_improved"), "improved").otherwise("reject").alias("verdict"),
        F.explode("comparison").alias("metric", "m"),
    ).select(
        "experiment_id", "metric", F.col("m.control").alias("control_value"),
        F.col("m.variant").alias("variant_value"), F.col("m.delta").alias("delta"), "verdict",
    )


def registered_promotions(promotions: DataFrame, experiments: DataFrame) -> DataFrame:
    """Promotions with the newest experiment of their version pair; others are left out."""
    newest = experiments.groupBy("control_version", "variant_version").agg(
        F.max("experiment_id").alias("experiment_id")
    )
    return promotions.join(newest, ["control_version", "variant_version"])


def opportunity_rows(opportunities: DataFrame, run_id: int | None = None) -> DataFrame:
    def text(name: str, default: str) -> Column:
        return tx.first_text(name, F.lit(default))

    defaults = {
        "category": "general", "expected_metric": "quality_score", "risk_level": "medium",
        "status": "proposed",
    }
    return opportunities.withColumns(
        {
            "run_id": F.lit(run_id).cast("long"),
            **{name: text(name, default) for name, default in defaults.items()},
        }
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
