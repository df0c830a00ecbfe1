"""Run documents and worker reports to trace payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import jsonx as jx
from traceloom.functions import text as tx

# Fixed values: (array names in order of preference, default trace type) by document kind.
DOCUMENT_KINDS = {
    "run": (("traces", "tasks"), "worker_trace"),
    "scientific": (("verification_traces", "traces"), "scientific_trace"),
    "router": (("decisions", "traces"), "router_trace"),
}


def document_traces(documents: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """One row per trace of JSON documents, with type, prompt and response aliases resolved.

    The first non-empty array counts. The result has ``payload`` JSON for the trace scan.
    """
    arrays, default = DOCUMENT_KINDS[kind]
    v = jx.parse(value)
    listed = F.coalesce(*[tx.array_or_null(jx.items(v, f"$.{name}")) for name in arrays])
    rows = documents.select(
        *[c for c in documents.columns if c != value], F.posexplode(listed).alias("position", "t")
    )
    t = F.col("t")

    def field(path):
        return jx.get(t, f"$.{path}")

    def either(first, second):
        return F.when(jx.has(t, f"$.{first}"), field(first)).otherwise(field(second))

    out = rows.withColumns(
        {
            "trace_type": F.coalesce(field("trace_type"), field("type"), F.lit(default)),
            "prompt": either("prompt", "input"),
            "response": either("response", "output"),
            **{name: field(name) for name in ("task_id", "agent_id", "provider", "model",
                                              "objective", "outcome", "label")},
        }
    )
    if kind == "router":
        out = out.withColumn(
            "router_decision", F.to_json(F.struct("provider", "model", "agent_id"))
        )
    return out.drop("t")


def _listed(*parts: Column) -> Column:
    """A string list from a scalar or a list, first given part wins."""
    first = F.coalesce(*parts)
    as_list = F.try_variant_get(first, "$", "array<variant>")
    many = F.transform(as_list, lambda x: x.cast("string"))
    single = F.array(F.try_variant_get(first, "$", "string"))
    none = F.array().cast("array<string>")
    return F.when(first.isNull(), none).otherwise(F.coalesce(many, single))


def worker_reports(reports: DataFrame, value: str = "value") -> DataFrame:
    """Nested worker reports as flat trace rows."""
    v = F.col("__v")

    def get(path):
        return tx.text_or_null(jx.get(v, f"$.{path}"))

    def part(path):
        return F.when(jx.has(v, f"$.{path}"), jx.get(v, f"$.{path}", "variant"))

    files = _listed(part("changed_files"), part("files_changed"), part("files"))
    raw_tests = F.coalesce(part("tests_run"), part("verification.tests_run"), part("tests"))
    tests = F.coalesce(
        F.try_variant_get(raw_tests, "$", "array<variant>"),
        F.when(raw_tests.isNotNull(), F.array(raw_tests)),
        F.array().cast("array<variant>"),
    )
    typed = F.transform(
        tests,
        lambda t: F.struct(
            F.try_variant_get(t, "$.name", "string").alias("name"),
            F.when(
                F.schema_of_variant(t).startswith("OBJECT"),
                F.try_variant_get(t, "$.command", "string"),
            ).otherwise(F.try_variant_get(t, "$", "string")).alias("command"),
            F.try_variant_get(t, "$.status", "string").alias("status"),
        ),
    )
    rows = reports.withColumn("__v", jx.parse(value))
    passed = jx.get(v, "$.verification.passed", "boolean")
    return rows.select(
        *[c for c in reports.columns if c != value],
        F.lit("worker_trace").alias("trace_type"),
        F.coalesce(get("task_id"), get("task.id"), get("id")).alias("task_id"),
        F.coalesce(get("agent_id"), get("worker_id"), get("worker")).alias("agent_id"),
        F.lower(F.coalesce(get("provider"), get("client"))).alias("provider"),
        get("model").alias("model"),
        F.coalesce(get("task.title"), get("title"), get("objective")).alias("objective"),
        F.coalesce(get("assignment"), get("task.body"), get("task.title"), get("summary")).alias(
            "prompt"),
        F.coalesce(get("summary"), get("result"), get("notes")).alias("response"),
        files.alias("files_changed"),
        typed.alias("tests_run"),
        F.coalesce(get("outcome"), get("status"), F.when(passed, "accepted")).alias("outcome"),
        get("failure_type").alias("failure_type"),
        F.coalesce(get("privacy_mode"), F.lit("private-local-only")).alias("privacy_mode"),
        F.size(files).alias("changed_file_count"),
        F.size(typed).alias("test_count"),
    )


def provider_metadata(records: DataFrame, gateway: str = "openrouter") -> DataFrame:
    """Cost and latency of provider records; ``gateway`` names the default provider.

    Columns: provider, model, model_slug, cost_usd, prompt_cost_usd, completion_cost_usd,
    latency_ms, duration_ms.
    """
    parts = F.coalesce("prompt_cost_usd", F.lit(0.0)) + F.coalesce(
        "completion_cost_usd", F.lit(0.0)
    )
    cost = F.coalesce("cost_usd", parts)
    name = F.lower(F.coalesce("provider", F.lit(gateway)))
    return records.withColumns(
        {
            "provider": F.when(name.contains(gateway), F.lit(gateway)).otherwise(name),
            "model": tx.first_text("model", "model_slug"),
            "cost_usd": cost,
            "latency_ms": F.coalesce(
                tx.number_or_null("latency_ms"), tx.number_or_null("duration_ms"), F.lit(0)
            ).cast("long"),
            "free_or_cheap": cost <= 0.001,
        }
    )
