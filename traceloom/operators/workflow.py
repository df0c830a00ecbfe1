"""Execution event logs: validation, replay, conformance, metrics, training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions import hashing as hx
from traceloom.functions import numeric as nx
from traceloom.functions import text as tx
from traceloom.session import with_position

# Event types.
EVENT_TYPES = (
    "ROUTE", "STATE", "PROPOSAL", "ACCEPTED", "REJECTED", "VIOLATION", "TOOL_CALL",
    "OBSERVATION", "CORRECTION", "VERIFIER", "REWARD", "SUBPROCESS_EXIT",
)
# Fields that do not count for a replay.
REPLAY_EXCLUDED = ("latency_ms", "cost_usd", "created_at", "peak_memory_mb")


def event_problems(events: DataFrame, event_types: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    """Events with an unknown type, a negative latency or cost, or no session."""
    problem = F.coalesce(
        F.when(tx.trimmed_or_null("session_id").isNull(), "session_id is required"),
        F.when(
            F.coalesce(~F.upper("event_type").isin(*event_types), F.lit(True)),
            "event_type is not known",
        ),
        F.when(F.coalesce(F.col("latency_ms"), F.lit(0.0)) < 0,
               "latency_ms must be a non-negative number"),
        F.when(F.coalesce(F.col("cost_usd"), F.lit(0.0)) < 0,
               "cost_usd must be a non-negative number"),
    )
    return events.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def session_contiguity(events: DataFrame) -> DataFrame:
    """Per session: are the sequence numbers exactly 0..n-1?

    Distinct count, minimum and maximum decide it without ordering a session.
    """
    return events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"),
        (
            (F.min("sequence") == 0)
            & (F.max("sequence") == F.count(F.lit(1)) - 1)
            & (F.count_distinct("sequence") == F.count(F.lit(1)))
        ).alias("contiguous"),
    )


def replay_hashes(events: DataFrame, block: int = 10_000) -> DataFrame:
    """Hash of each session's ordered events without clock, cost and host fields.

    A two-level hash: events are hashed one by one, hashes joined within blocks of ``block``
    sequence numbers, block hashes joined per session. No session is gathered whole, however
    long it is.
    """
    kept = [name for name in events.columns if name not in REPLAY_EXCLUDED]
    each = events.select(
        "session_id", "sequence", hx.row_hash(*kept).alias("h"),
        F.floor(F.col("sequence") / block).alias("block"),
    )

    def joined(rows, keys, order):
        ordered = F.array_sort(F.collect_list(F.struct(order, "h")))
        text = F.array_join(F.transform(ordered, lambda x: x["h"]), "")
        return rows.groupBy(*keys).agg(hx.sha(text).alias("h"))

    blocks = joined(each, ["session_id", "block"], "sequence")
    return joined(blocks, ["session_id"], "block").withColumnRenamed("h", "replay_hash")


def conformance(events: DataFrame, steps: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations of every logged action against its pinned workflow step.

    ``events``: session_id, sequence, workflow_id, expected_step_id, step_id, action_type,
    tool, arguments (map), flags and evidence (arrays), status, action_count.
    ``steps``: workflow_id, expected_step_id, want_action_type, want_tool, requires (array),
    want_arguments (map; '$dynamic' accepts anything).
    ``rules``: workflow_id, allowed_tools, path_prefixes, required_evidence, max_actions,
    tool_requirements (map tool -> array of flags).
    """
    # Argument names that hold paths.
    path_keys = ("path", "file", "target", "directory", "cwd")
    joined = events.join(steps, ["workflow_id", "expected_step_id"], "left").join(
        rules, "workflow_id", "left"
    )
    empty = F.array().cast("array<string>")
    is_tool = F.col("want_action_type") == "tool"
    requires = F.coalesce("requires", empty)
    flags = F.coalesce("flags", empty)
    lacking = F.array_except(requires, flags)
    guard = F.array_except(
        F.coalesce(F.try_element_at("tool_requirements", F.col("tool")), empty), flags
    )
    evidence = F.array_except(
        F.coalesce("required_evidence", empty), F.coalesce("evidence", empty)
    )

    def listed(label: str, missing: Column) -> Column:
        return F.when(F.size(missing) > 0, F.concat(F.lit(f"{label}:"), F.array_join(missing, ",")))

    arguments = F.coalesce("arguments", F.create_map().cast("map<string,string>"))
    wanted = F.map_entries(F.coalesce("want_arguments", F.create_map().cast("map<string,string>")))
    argument_issues = F.transform(
        wanted,
        lambda e: F.when(
            ~F.map_contains_key(arguments, e["key"]), F.concat(F.lit("argument_missing:"), e["key"])
        ).when(
            (e["value"] != "$dynamic") & ~F.try_element_at(arguments, e["key"]).eqNullSafe(e["value"]),
            F.concat(F.lit("argument_constraint_violation:"), e["key"]),
        ),
    )
    prefixes = F.transform(F.coalesce("path_prefixes", empty), lambda p: F.rtrim(p, F.lit("/")))

    def forbidden(path: Column) -> Column:
        inside = F.exists(
            prefixes, lambda p: (path == p) | F.startswith(path, F.concat(p, F.lit("/")))
        )
        climbs = F.array_contains(F.split(path, "/"), "..")
        return F.startswith(path, F.lit("/")) | climbs | ~inside

    path_issues = F.transform(
        F.filter(F.map_entries(arguments), lambda e: e["key"].isin(*path_keys)),
        lambda e: F.when(
            (F.size(prefixes) > 0) & forbidden(e["value"]),
            F.concat(F.lit("path_not_allowed:"), e["key"]),
        ),
    )
    single = F.array(
        F.when(F.coalesce("status", F.lit("READY")) != "READY", "execution_not_ready"),
        F.when(F.col("action_count") >= F.col("max_actions"), "action_budget_exhausted"),
        F.when(F.col("want_action_type").isNull(), "no_action_expected"),
        F.when(~F.col("step_id").eqNullSafe(F.col("expected_step_id")), "step_order_violation"),
        F.when(~F.col("action_type").eqNullSafe(F.col("want_action_type")), "action_type_violation"),
        listed("missing_step_requirements", lacking),
        F.when(is_tool & ~F.col("tool").eqNullSafe(F.col("want_tool")), "tool_selection_violation"),
        F.when(
            is_tool & ~F.coalesce(F.array_contains("allowed_tools", F.col("tool")), F.lit(False)),
            "tool_not_allowed",
        ),
        F.when(is_tool, listed("tool_guard_violation", guard)),
        F.when(
            F.col("want_action_type") == "complete", listed("required_evidence_missing", evidence)
        ),
    )
    none = F.array().cast("array<string>")
    extra = F.when(is_tool, F.concat(argument_issues, path_issues)).otherwise(none)
    found = F.array_distinct(F.array_compact(F.concat(single, extra)))
    return joined.select(
        "session_id", "sequence", "workflow_id", found.alias("violations"),
        (F.size(found) == 0).alias("conforms"),
    )


def execution_metrics(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adherence, completion and escalation rates, one row (or one per key)."""
    action = F.col("kind") == "action"
    broken = F.size("violations") > 0
    order = F.exists("violations", lambda v: v.contains("step_order_violation"))
    actions = F.count_if(action)
    sessions = F.count_distinct("session_id")

    def of_actions(condition):
        return F.count_if(action & condition)

    def ended(status):
        return F.count_distinct(F.when(F.col("state_after") == status, F.col("session_id")))

    return events.groupBy(*(keys or [])).agg(
        sessions.alias("session_count"),
        actions.alias("action_proposal_count"),
        F.count_if(F.col("kind") == "observation").alias("observation_count"),
        nx.ratio(of_actions(F.col("accepted")), actions).alias("step_adherence"),
        F.when(actions > 0, 1.0 - of_actions(order) / actions).otherwise(F.lit(0.0)).alias(
            "order_adherence"
        ),
        nx.ratio(of_actions(broken), actions).alias("invariant_violation_rate"),
        nx.ratio(ended("COMPLETED"), sessions).alias("long_horizon_completion_rate"),
        nx.ratio(ended("ESCALATED"), sessions).alias("teacher_escalation_rate"),
        F.count_if(F.col("teacher_correction").isNotNull()).alias("teacher_correction_count"),
    )


def segment_fill(
    rows: DataFrame, keys: list[str], order: str, value: Column, reset: Column, name: str,
    block: int = 50_000,
) -> DataFrame:
    """Last non-null ``value`` before each row inside its key, forgotten after a ``reset`` row.

    A window over a whole key would pull a hot key into one task. Rows are cut into blocks
    of the dense in-key position; each block is filled alone, and only the last state of
    each block travels to the next ones.
    """
    rows = rows.withColumns(
        {"__v": value, "__r": F.coalesce(reset, F.lit(False)),
         "__b": F.floor(F.col(order) / block)}
    )
    # A state change is a struct (cleared, value); the newest change before a row decides.
    change = F.when(
        F.col("__r") | F.col("__v").isNotNull(),
        F.struct(F.when(~F.col("__r"), F.col("__v")).alias("x")),
    )
    rows = rows.withColumn("__c", change)
    inside = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    last = rows.groupBy(*keys, "__b").agg(
        F.max_by("__c", F.when(F.col("__c").isNotNull(), F.col(order))).alias("__last")
    )
    across = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "__b", F.last("__last", ignorenulls=True).over(across).alias("__in"))
    return (
        rows.withColumn("__w", F.last("__c", ignorenulls=True).over(inside))
        .join(carried, [*keys, "__b"], "left")
        .withColumn(
            name,
            F.when(F.col("__w").isNotNull(), F.col("__w.x")).otherwise(F.col("__in.x")),
        )
        .drop("__v", "__r", "__b", "__c", "__w", "__in")
    )


def next_action_examples(events: DataFrame, order: str = "event_index") -> DataFrame:
    """One training example per action, with the verifier of the observation that follows.

    An observation's verifier belongs to the last accepted action before it, if no other
    observation came between. ``events``: session_id, event_index (dense), kind, accepted,
    verifier, and the action's columns.
    """
    accepted = (F.col("kind") == "action") & F.coalesce("accepted", F.lit(False))
    observation = F.col("kind") == "observation"
    filled = segment_fill(
        events, ["session_id"], order, F.when(accepted, F.col(order)), observation, "__action"
    )
    given = filled.filter(
        observation & F.col("__action").isNotNull() & F.col("verifier").isNotNull()
    ).select(
        "session_id", F.col("__action").alias(order), F.col("verifier").alias("__given")
    )
    corrected = F.col("teacher_correction").isNotNull()
    rows = (
        events.filter(F.col("kind") == "action")
        .join(given, ["session_id", order], "left")
        .withColumns(
            {
                "verifier": F.coalesce("__given", "verifier"),
                "next_action": F.coalesce("teacher_correction", "expected_action"),
                "teacher_corrected": corrected,
            }
        )
        .drop("__given", "kind")
    )
    return rows.withColumn("example_hash", hx.row_hash(*rows.columns))


def export_summary(examples: DataFrame) -> DataFrame:
    return examples.agg(
        F.coalesce(F.bool_or(~F.col("accepted")), F.lit(False)).alias("includes_negative_examples"),
        F.coalesce(F.bool_or("teacher_corrected"), F.lit(False)).alias(
            "includes_teacher_corrections"
        ),
        *hx.content_fingerprint("example_hash"),
    )


def benchmark_rollup(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per run, per category) quality of logged case results.

    ``cases``: run_index, category, passed, verifier_succeeded, latency_ms, attempts.
    """
    def rate(condition):
        return nx.share(condition)

    retried = F.col("attempts") > 1
    overall = cases.agg(
        F.avg(F.when(retried, nx.flag(F.col("passed")))).alias("retry_rate"),
    ).select("retry_rate").scalar()
    runs = cases.groupBy("run_index").agg(
        rate(F.col("passed")).alias("quality"),
        rate(F.col("verifier_succeeded")).alias("verifier_agreement"),
        F.avg("latency_ms").alias("latency"),
        (1.0 - rate(F.col("passed"))).alias("failure_rate"),
    )
    mean_quality = runs.agg(F.avg("quality")).scalar()
    runs = runs.withColumn("robustness", F.coalesce(overall, mean_quality))
    per_category = cases.groupBy(F.lower("category").alias("category")).agg(
        rate(F.col("passed")).alias("quality"),
        (1.0 - rate(F.col("passed"))).alias("failure_rate"),
        F.count(F.lit(1)).alias("case_count"),
    )
    return runs, per_category


def critical_regressions(incumbent: DataFrame, challenger: DataFrame, limit: float) -> DataFrame:
    """Categories whose quality fell by more than ``limit``."""
    left = incumbent.select("category", F.col("quality").alias("before"))
    right = challenger.select("category", F.col("quality").alias("after"))
    drop = F.col("before") - F.col("after")
    return left.join(right, "category").filter(drop > limit).select("category", drop.alias("drop"))


def best_candidate(rows: DataFrame) -> DataFrame:
    """Highest score, then lower cost."""
    return rows.agg(
        F.max_by("candidate_id", F.struct("score", (-F.col("cost")).alias("c"))).alias(
            "candidate_id"
        ),
        F.max("score").alias("score"),
    )


def median_delta(runs: DataFrame) -> DataFrame:
    """Exact median of challenger runs minus that of incumbent runs, per task."""
    def side(name):
        return F.percentile(F.when(F.col("side") == name, F.col("quality")), F.lit(0.5))

    return runs.groupBy("task_id").agg(
        (side("challenger") - side("incumbent")).alias("median_quality_delta")
    )


def append_indexed(stored: DataFrame, fresh: DataFrame, order: str) -> DataFrame:
    """Give fresh events the next free index of their session, in order."""
    placed = with_position(fresh, ["session_id"], order, name="__n")
    used = stored.groupBy("session_id").agg(F.max("event_index").alias("__max"))
    return (
        placed.join(used, "session_id", "left")
        .withColumn("event_index", F.coalesce(F.col("__max"), F.lit(-1)) + 1 + F.col("__n"))
        .drop("__n", "__max")
    )
