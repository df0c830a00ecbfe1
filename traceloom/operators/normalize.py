"""Turn raw JSON payloads into canonical, redacted trace rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom import vocab
from traceloom.functions import hashing as hx
from traceloom.functions import jsonx as jx
from traceloom.functions import text as tx

TESTS_TYPE = "array<struct<name:string,command:string,status:string>>"


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(part) for pair in pairs.items() for part in pair])


def task_type(value: Column | str) -> Column:
    """Bucket of a task type by substring, first bucket wins, else the text itself."""
    text = tx.slug(F.coalesce(tx.text_or_null(value), F.lit("unknown")))
    chain = reduce(
        lambda acc, row: acc.when(tx.contains_any(text, row[1]), F.lit(row[0])),
        vocab.TASK_BUCKETS,
        F.when(F.lit(False), F.lit("")),
    )
    return chain.otherwise(tx.first_text(text, F.lit("unknown")))


def outcome_label(value: Column | str) -> Column:
    """Canonical outcome label after aliases; null for null input and unknown labels."""
    text = tx.slug(value)
    label = F.coalesce(F.try_element_at(literal_map(vocab.OUTCOME_ALIASES), text), text)
    return F.when(label.isin(*vocab.OUTCOME_LABELS), label)


def privacy_status(mode: Column | str) -> Column:
    found = F.try_element_at(literal_map(vocab.PRIVACY_STATUS), tx.as_col(mode))
    return F.coalesce(found, F.lit("local_only"))


def can_export(status: Column | str) -> Column:
    return F.coalesce(tx.as_col(status) == "public_benchmark", F.lit(False))


def _field(variant: Column, *names: str) -> Column:
    return F.coalesce(*[tx.trimmed_or_null(jx.get(variant, f"$.{name}")) for name in names])


def _objects_only(variant: Column, path: str) -> Column:
    """True for an absent list and for a list that holds nothing but objects."""
    parts = jx.items(variant, path)
    return ~jx.has(variant, path) | F.coalesce(
        F.forall(parts, lambda x: F.schema_of_variant(x).startswith("OBJECT")), F.lit(False)
    )


def _one_of(column: Column, allowed) -> Column:
    return F.coalesce(column.isin(*allowed), F.lit(False))


def normalize_traces(
    lines: DataFrame, default_privacy_mode: str = vocab.DEFAULT_PRIVACY_MODE
) -> DataFrame:
    """Parse ``value`` and add the canonical fields, ``status`` and ``error``.

    ``status`` is ``malformed`` (not JSON), ``rejected`` (not a valid trace) or ``valid``;
    nothing raises, so one bad line never stops a scan.
    """
    v = F.col("__v")
    truthy_outcome = F.coalesce(
        tx.text_or_null(jx.get(v, "$.outcome")), jx.get(v, "$.label")
    )
    parsed = lines.withColumn("__v", jx.parse("value")).select(
        *lines.columns,
        "__v",
        _field(v, "trace_type", "type").alias("trace_type"),
        _field(v, "task_id").alias("task_id"),
        _field(v, "agent_id").alias("agent_id"),
        tx.text_or_null(F.lower(_field(v, "provider"))).alias("provider"),
        _field(v, "model").alias("model"),
        _field(v, "prompt", "input").alias("prompt"),
        _field(v, "response", "output").alias("response"),
        _field(v, "objective").alias("objective"),
        F.coalesce(_field(v, "privacy_mode"), F.lit(default_privacy_mode)).alias("privacy_mode"),
        truthy_outcome.alias("__outcome_raw"),
        outcome_label(truthy_outcome).alias("outcome"),
        _field(v, "failure_type").alias("failure_type"),
        F.coalesce(
            F.to_json(F.when(jx.has(v, "$.tool_calls"), jx.get(v, "$.tool_calls", "variant"))),
            F.lit("[]"),
        ).alias("tool_calls"),
        jx.strings(v, "$.files_changed").alias("files_changed"),
        F.coalesce(
            jx.get(v, "$.tests_run", TESTS_TYPE), F.array().cast(TESTS_TYPE)
        ).alias("tests_run"),
        F.coalesce(
            F.to_json(F.when(jx.has(v, "$.tests_run"), jx.get(v, "$.tests_run", "variant"))),
            F.lit("[]"),
        ).alias("tests_json"),
        F.coalesce(
            F.to_json(F.when(jx.has(v, "$.metadata"), jx.get(v, "$.metadata", "variant"))),
            F.lit("{}"),
        ).alias("metadata"),
        F.coalesce(
            jx.get(v, "$.metadata.task_type"),
            F.when(jx.has(v, "$.task_type"), task_type(jx.get(v, "$.task_type"))),
        ).alias("task_type"),
        jx.get(v, "$.metrics.cost_usd", "double").alias("cost_usd"),
        jx.get(v, "$.metrics.latency_ms", "double").alias("latency_ms"),
        jx.get(v, "$.metrics.quality", "double").alias("quality"),
    )
    checks = [
        (~jx.is_object(v), "trace payload must be an object"),
        (~_one_of(F.col("trace_type"), vocab.TRACE_TYPES), "trace_type is not a known type"),
        (~_one_of(F.col("privacy_mode"), vocab.PRIVACY_STATUS), "privacy_mode is not a known mode"),
        (
            F.col("__outcome_raw").isNotNull() & F.col("outcome").isNull(),
            "outcome is not a known label",
        ),
        (
            F.col("failure_type").isNotNull()
            & ~_one_of(F.col("failure_type"), vocab.FAILURE_TYPES),
            "failure_type is not a known type",
        ),
        (
            jx.has(v, "$.metadata") & ~jx.is_object(jx.get(v, "$.metadata", "variant")),
            "metadata must be an object",
        ),
        (
            jx.has(v, "$.metrics") & ~jx.is_object(jx.get(v, "$.metrics", "variant")),
            "metrics must be an object",
        ),
        (~_objects_only(v, "$.tool_calls"), "tool_calls must be a list of objects"),
        (
            jx.has(v, "$.files_changed") & jx.items(v, "$.files_changed").isNull(),
            "files_changed must be a list",
        ),
        (~_objects_only(v, "$.tests_run"), "tests_run must be a list of objects"),
        (~has_content(), "trace must include prompt, response, tool_calls, or objective"),
    ]
    reason = F.coalesce(*[F.when(failed, F.lit(text)) for failed, text in checks])
    return (
        parsed.withColumn("error", F.when(v.isNull(), F.lit("invalid JSON")).otherwise(reason))
        .withColumn(
            "status",
            F.when(v.isNull(), "malformed").when(F.col("error").isNotNull(), "rejected")
            .otherwise("valid"),
        )
        .drop("__v", "__outcome_raw")
    )


def has_content() -> Column:
    """A trace says something: prompt, response, tool calls or objective."""
    return (
        F.col("prompt").isNotNull()
        | F.col("response").isNotNull()
        | (F.col("tool_calls") != "[]")
        | F.col("objective").isNotNull()
    )


def redact_traces(traces: DataFrame) -> DataFrame:
    """Redact every text of a canonical trace; open JSON goes through the Arrow helper."""
    texts = ("task_id", "agent_id", "provider", "model", "prompt", "response", "objective")
    return traces.withColumns(
        {
            **{name: tx.redact_text(name) for name in texts},
            "files_changed": F.transform("files_changed", tx.redact_text),
            "tests_run": F.transform(
                "tests_run",
                lambda t: F.struct(
                    tx.redact_text(t["name"]).alias("name"),
                    tx.redact_text(t["command"]).alias("command"),
                    tx.redact_text(t["status"]).alias("status"),
                ),
            ),
            "tool_calls": jx.redact_json("tool_calls"),
            "tests_json": jx.redact_json("tests_json"),
            "metadata": jx.redact_json("metadata"),
        }
    )


def normalized_text() -> Column:
    """Ten fields joined, whitespace squeezed, lower case: the identity of a trace."""
    blank = F.lit("")
    parts = [
        F.coalesce(F.col(name), blank)
        for name in (
            "trace_type", "task_id", "provider", "model", "objective", "prompt", "response"
        )
    ]
    lists = [
        F.coalesce(hx.canonical_json("tool_calls"), F.lit("[]")),
        F.to_json(F.coalesce(F.col("files_changed"), F.array().cast("array<string>"))),
        F.coalesce(hx.canonical_json("tests_json"), F.lit("[]")),
    ]
    return F.lower(tx.squeeze(F.concat_ws("\n", *parts, *lists)))


def with_identity(traces: DataFrame) -> DataFrame:
    """Add ``normalized_text``, ``content_hash`` and ``privacy_status``."""
    return traces.withColumns(
        {
            "normalized_text": normalized_text(),
            "privacy_status": privacy_status("privacy_mode"),
        }
    ).withColumn("content_hash", hx.sha("normalized_text"))
