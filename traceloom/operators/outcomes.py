"""Execution outcomes: validation, capability cells, cheapest targets, rollout, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom import vocab
from traceloom.functions import hashing as hx
from traceloom.functions import numeric as nx
from traceloom.functions import text as tx
from traceloom.session import durable, sent_if_few, with_position

VIOLATIONS = "array<struct<code:string,severity:string>>"
HASHES = (
    "subtask_hash", "plan_hash", "decision_hash", "usage_receipt_hash", "catalog_hash",
    "pricing_hash", "policy_hash", "candidate_set_hash", "source_evidence_hash", "model_revision",
)
TEXTS = (
    "outcome_id", "experiment_id", "counterfactual_group_id", "task_id", "task_group",
    "subtask_id", "teacher_option_id", "executed_option_id", "model_id", "model_family",
    "cost_unit",
)
FLAGS = ("verified", "independent_verifier", "success", "cheaper_option_tested")
# Camel-case spelling that does not follow from the snake-case name.
CAMEL_EXCEPTIONS = {"source_evidence_hash": "evidenceHash"}


def snake_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rename camel-case columns; where both spellings exist the snake-case one wins."""
    present = set(rows.columns)
    for name in names:
        first, *rest = name.split("_")
        camel = CAMEL_EXCEPTIONS.get(name, first + "".join(part.title() for part in rest))
        if camel != name and camel in present:
            rows = (
                rows.drop(camel) if name in present else rows.withColumnRenamed(camel, name)
            )
    return rows


def cell_id(
    capabilities: Column, risk: Column, tokens: Column, family: Column, effort: Column
) -> Column:
    """Outcome cell: hashed descriptor of capabilities, risk, context size, family, effort."""
    joined = F.array_join(F.array_sort(F.array_distinct(capabilities)), "+")
    size = F.when(tokens < 8000, "lt8k").when(tokens <= 32000, "8k-32k").otherwise("gt32k")
    text = F.concat_ws("|", tx.first_text(joined, F.lit("general")), risk, size, family, effort)
    return F.concat(F.lit("cell_"), F.substring(hx.sha(text), 1, 20), F.lit(":"), text)


def has_serious(violations: Column) -> Column:
    return F.exists(violations, lambda v: v["severity"].isin(*vocab.SERIOUS))


def is_acceptable() -> Column:
    serious = has_serious(F.col("safety_violations")) | has_serious(F.col("policy_violations"))
    return (
        F.col("verified")
        & F.col("independent_verifier")
        & F.col("success")
        & (F.col("verifier_score") >= F.col("quality_floor"))
        & ~serious
    )


def _violations(name: str) -> Column:
    found = F.transform(
        F.coalesce(F.col(name), F.array().cast(VIOLATIONS)),
        lambda v: F.struct(F.lower(v["severity"]).alias("severity"), v["code"].alias("code")),
    )
    return F.transform(
        F.array_sort(found),
        lambda v: F.struct(v["code"].alias("code"), v["severity"].alias("severity")),
    )


def normalize_outcomes(rows: DataFrame) -> DataFrame:
    """Check and complete outcome rows; ``problem`` is null for sound ones.

    A sound row gets its cell, ``acceptable`` and ``record_hash``. An id used twice marks
    all its rows, because no repeat is allowed.
    """
    rows = snake_columns(
        rows,
        [*HASHES, *TEXTS, *FLAGS, "classifier_option_id", "classifier_confidence", "arm",
         "assignment_mechanism", "risk", "reasoning_effort", "required_capabilities",
         "estimated_input_tokens", "verifier_score", "quality_floor", "cost_amount",
         "latency_ms", "retries", "completed_at", "tool_failures", "safety_violations",
         "policy_violations", "capability_cell_id"],
    )
    empty = F.array().cast("array<string>")
    lists = {
        name: F.array_sort(F.array_distinct(F.coalesce(F.col(name), empty)))
        for name in ("required_capabilities", "tool_failures")
    }
    supplied = (
        F.col("capability_cell_id") if "capability_cell_id" in rows.columns
        else F.lit(None).cast("string")
    )
    rows = rows.withColumns(
        {
            **lists,
            "safety_violations": _violations("safety_violations"),
            "policy_violations": _violations("policy_violations"),
            "__supplied": supplied,
        }
    ).withColumn(
        "capability_cell_id",
        cell_id(*[F.col(name) for name in (
            "required_capabilities", "risk", "estimated_input_tokens", "model_family",
            "reasoning_effort")]),
    )

    def bad(condition: Column, reason: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(True)), F.lit(reason))

    def bad_text(name: str) -> Column:
        # Only the letters at both ends can be stripped.
        ends = F.concat(F.substring(name, 1, 1), F.substring(name, -1, 1))
        return bad((ends == "") | ends.rlike(tx.SPACE), f"{name} is required")

    def outside_unit(name: str) -> Column:
        return bad(~F.col(name).between(0.0, 1.0), f"{name} must be between 0 and 1")

    def negative(name: str) -> Column:
        value = F.col(name).cast("double")
        return bad((value < 0) | F.isnan(value) | (value == float("inf")),
                   f"{name} must be nonnegative")

    confidence = F.col("classifier_confidence")
    checks = [
        *[bad_text(name) for name in TEXTS],
        *[bad(~F.col(name).isin(*allowed), f"invalid {name}") for name, allowed in (
            ("risk", vocab.RISKS), ("reasoning_effort", vocab.EFFORTS), ("arm", vocab.ARMS),
            ("assignment_mechanism", vocab.ASSIGNMENTS))],
        *[bad(~F.col(name).rlike("^[0-9a-f]{64}$"), f"{name} must be a lowercase SHA-256 hash")
          for name in HASHES],
        *[bad(F.col(name).isNull(), f"{name} must be boolean") for name in FLAGS],
        *[outside_unit(name) for name in ("verifier_score", "quality_floor")],
        F.when(~confidence.between(0.0, 1.0), "classifier_confidence must be between 0 and 1"),
        *[negative(name) for name in (
            "estimated_input_tokens", "cost_amount", "latency_ms", "retries", "completed_at")],
        F.when(F.col("__supplied") != F.col("capability_cell_id"), "capability cell mismatch"),
    ]
    repeated = sent_if_few(
        rows.groupBy("outcome_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("outcome_id", F.lit("duplicate outcome_id").alias("__repeat"))
    )
    body = [name for name in rows.columns if not name.startswith("__")]
    return (
        rows.withColumn("__problem", F.coalesce(*checks))
        .join(repeated, "outcome_id", "left")
        .withColumn("problem", F.coalesce("__problem", "__repeat"))
        .withColumn("acceptable", F.coalesce(is_acceptable(), F.lit(False)))
        .withColumn("record_hash", hx.row_hash(*body))
        .drop("__problem", "__repeat", "__supplied")
    )


def independent_rows(outcomes: DataFrame, keys: tuple[str, ...] = ("capability_cell_id",)) -> DataFrame:
    """Newest outcome of every task group inside a cell (by time, then id).

    A ``max_by`` aggregate instead of a window: partial results are combined before the
    shuffle, so one task group holding a third of the rows stays cheap.
    """
    carried = [name for name in outcomes.columns if name not in (*keys, "task_group")]
    newest = outcomes.groupBy(*keys, "task_group").agg(
        F.max_by(F.struct(*carried), F.struct("completed_at", "outcome_id")).alias("__r")
    )
    return newest.select(*keys, "task_group", "__r.*")


def halves(rows: DataFrame, key: str = "capability_cell_id") -> DataFrame:
    """Accepted share of the older and newer half per key, by (completed_at, outcome_id)."""
    numbered = with_position(
        rows.select(key, "completed_at", "outcome_id", "acceptable"),
        [key], "completed_at", "outcome_id", name="__n",
    )
    spans = numbered.groupBy(key).agg(F.count(F.lit(1)).alias("__count"))
    older = F.col("__n") < F.floor(F.col("__count") / 2)
    return (
        numbered.join(spans, key)
        .groupBy(key)
        .agg(
            F.max("__count").alias("rows"),
            F.avg(F.when(older, nx.flag(F.col("acceptable")))).alias("prior"),
            F.avg(F.when(~older, nx.flag(F.col("acceptable")))).alias("recent"),
        )
    )


def recent_regression(rows: DataFrame, key: str = "capability_cell_id") -> DataFrame:
    """Drop of the accepted share from the older to the newer half; 0 under 40 rows."""
    drop = F.greatest(F.lit(0.0), F.col("prior") - F.col("recent"))
    return halves(rows, key).select(
        key, F.when(F.col("rows") < 40, F.lit(0.0)).otherwise(drop).alias("recent_regression")
    )


def cell_report(
    outcomes: DataFrame,
    *,
    minimum_verified: int = 100,
    minimum_precision: float = 0.97,
    minimum_wilson_lower_bound: float = 0.95,
    maximum_brier_score: float = 0.10,
    maximum_recent_regression: float = 0.02,
) -> DataFrame:
    """State and evidence of every capability cell."""

    def serious(name):
        return F.size(F.filter(name, lambda v: v["severity"].isin(*vocab.SERIOUS)))

    # Only what the report reads is regrouped and stored; outcome rows are wide.
    independent = durable(independent_rows(outcomes.select(
        "capability_cell_id", "task_group", "completed_at", "outcome_id", "risk", "verified",
        "independent_verifier", "acceptable", "classifier_confidence",
        (serious("safety_violations") + serious("policy_violations")).alias("serious"))))
    checked = F.col("verified") & F.col("independent_verifier")
    good = checked & F.col("acceptable")
    calibrated = checked & F.col("classifier_confidence").isNotNull()
    # Summed as decimals: the mean does not depend on the order of the rows.
    miss = (F.col("classifier_confidence") - nx.flag(F.col("acceptable"))).cast("decimal(13,12)")
    gap = (miss * miss).cast("decimal(26,24)")
    stats = independent.groupBy("capability_cell_id").agg(
        F.first("risk").alias("risk"),
        F.count_if(checked).alias("independent_verified_samples"),
        F.count_if(good).alias("accepted_samples"),
        (F.sum(F.when(calibrated, gap)).cast("double") / F.count_if(calibrated)).alias("brier"),
        F.sum("serious").alias("serious_failure_count"),
    )
    trend = recent_regression(independent.filter(checked))
    n, accepted = F.col("independent_verified_samples"), F.col("accepted_samples")
    cells = (
        stats.join(trend, "capability_cell_id", "left")
        .withColumns(
            {
                "precision": F.when(n > 0, accepted / n).otherwise(F.lit(0.0)),
                "wilson": nx.wilson_lower(accepted, n),
                "regression": F.coalesce("recent_regression", F.lit(0.0)),
            }
        )
        .withColumn(
            "failed",
            F.array_compact(
                F.array(
                    F.when(n < minimum_verified, "insufficient-independent-verified-samples"),
                    F.when(F.col("precision") < minimum_precision, "precision-below-floor"),
                    F.when(
                        F.col("wilson") < minimum_wilson_lower_bound,
                        "wilson-lower-bound-below-floor",
                    ),
                    F.when(
                        F.col("serious_failure_count") > 0, "serious-safety-or-policy-failure"
                    ),
                    F.when(
                        F.coalesce(F.col("brier") > maximum_brier_score, F.lit(True)),
                        "confidence-not-calibrated",
                    ),
                    F.when(
                        F.col("regression") > maximum_recent_regression, "recent-regression"
                    ),
                )
            ),
        )
    )
    passed = F.size("failed") == 0
    low = F.col("risk").isin("low", "medium")
    high = F.col("risk").isin("high", "critical")
    state = (
        F.when(passed & low, "trusted").when(passed, "conditional").otherwise("exploration-only")
    )
    return cells.select(
        "capability_cell_id",
        "risk",
        state.alias("state"),
        (state == "trusted").alias("autonomous_authority"),
        "independent_verified_samples",
        n.alias("unique_task_groups"),
        "accepted_samples",
        F.round("precision", 6).alias("selective_precision"),
        F.round("wilson", 6).alias("wilson_lower_bound"),
        F.round("brier", 6).alias("brier_score"),
        F.round("regression", 6).alias("recent_regression"),
        "serious_failure_count",
        high.alias("requires_independent_verification"),
        F.when(passed & high, F.array(F.lit("high-risk-cells-remain-conditional")))
        .otherwise(F.col("failed")).alias("reasons"),
    )


def cell_totals(cells: DataFrame) -> DataFrame:
    trusted = F.count_if(F.col("state") == "trusted")
    return cells.agg(trusted.alias("trusted_cell_count")).select(
        "trusted_cell_count",
        F.when(F.col("trusted_cell_count") > 0, "canary").otherwise("shadow").alias(
            "recommended_rollout"
        ),
        F.when(F.col("trusted_cell_count") > 0, 0.05).otherwise(0.0).alias(
            "maximum_classifier_coverage"
        ),
    )


def rollout(totals: DataFrame, epochs: int, current_stage: str = "shadow") -> DataFrame:
    """Authorised stage by trusted cells and successful evidence epochs."""
    names = ["shadow", *[name for name, _, _ in vocab.ROLLOUT_STAGES]]
    if current_stage not in names or epochs < 0:
        raise ValueError("invalid rollout state")
    stage, coverage = F.lit("shadow"), F.lit(0.0)
    for name, needed, limit in vocab.ROLLOUT_STAGES:
        if epochs >= needed:
            stage, coverage = F.lit(name), F.lit(limit)
    trusted = F.col("trusted_cell_count") > 0
    return totals.select(
        F.lit(current_stage).alias("current_stage"),
        F.when(trusted, stage).otherwise("shadow").alias("authorized_stage"),
        F.when(trusted, coverage).otherwise(0.0).alias("maximum_classifier_coverage"),
        "trusted_cell_count",
        F.lit(epochs).alias("successful_evidence_epochs"),
    )


def cheapest_acceptable(outcomes: DataFrame) -> DataFrame:
    """Cheapest acceptable option of every fully randomised counterfactual group.

    Groups must hold two or more options, share one set of pins, and have tested every
    cheaper option. All of it is one aggregate per group.
    """
    pins = F.struct(
        "task_group", "subtask_id", "catalog_hash", "policy_hash", "candidate_set_hash",
        "cost_unit",
    )
    pick = F.struct("task_group", "subtask_id", "capability_cell_id", "executed_option_id")
    best = F.min_by(
        F.when(F.col("acceptable"), pick),
        F.when(F.col("acceptable"),
               F.struct("cost_amount", "latency_ms", "executed_option_id")),
    )
    groups = outcomes.groupBy("counterfactual_group_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("assignment_mechanism") == "randomized").alias("randomized"),
        F.bool_and("cheaper_option_tested").alias("all_tested"),
        F.min(pins).alias("least_pins"),
        F.max(pins).alias("most_pins"),
        F.array_sort(F.collect_set("executed_option_id")).alias("observed_options"),
        F.array_sort(
            F.collect_set(F.when(F.col("acceptable"), F.col("executed_option_id")))
        ).alias("acceptable_option_ids"),
        best.alias("chosen"),
        *[column.alias(f"source_{name}") for column, name in (
            (F.count(F.lit(1)), "records"),
            (F.bit_xor(F.xxhash64("record_hash")), "record_fingerprint"))],
    )
    return groups.filter(
        (F.col("n") >= 2)
        & F.col("randomized")
        & F.col("all_tested")
        & (F.size("observed_options") >= 2)
        & (F.col("least_pins") == F.col("most_pins"))
        & (F.size("acceptable_option_ids") > 0)
    ).select(
        "counterfactual_group_id",
        "chosen.task_group",
        "chosen.subtask_id",
        "chosen.capability_cell_id",
        F.col("chosen.executed_option_id").alias("chosen_option_id"),
        "observed_options",
        "acceptable_option_ids",
        "source_records",
        "source_record_fingerprint",
    )


def plan_trials(
    ranking: DataFrame,
    experiment_id: str,
    *,
    sample_rate: float = 0.05,
    seed: int = 1701,
    maximum_trials: int | None = None,
) -> DataFrame:
    """Low-risk rows where an option cheaper than the teacher's exists, sampled by hash."""
    if not 0 < sample_rate <= 1:
        raise ValueError("sample_rate must be between 0 and 1")
    options = F.col("eligible_options")
    teacher = F.get(
        F.filter(options, lambda o: o["option_id"] == F.col("chosen_option_id")), F.lit(0)
    )
    cheaper = F.filter(
        options, lambda o: o["estimated_unit_cost"] < F.col("teacher_estimated_unit_cost")
    )
    cheapest = F.array_min(
        F.transform(
            cheaper,
            lambda o: F.struct(o["estimated_unit_cost"].alias("cost"), o["option_id"].alias("id")),
        )
    )
    key = F.concat_ws(":", F.lit(seed), "task_group", "subtask_id")
    risky = F.arrays_overlap(
        "required_capabilities", F.array(F.lit("security"), F.lit("migration"))
    ) | F.coalesce("signals.security", F.lit(False)) | F.coalesce(
        "signals.migration", F.lit(False)
    )
    plans = (
        ranking.filter((F.col("risk") == "low") & ~F.coalesce(risky, F.lit(False)))
        .withColumn("teacher_estimated_unit_cost", teacher["estimated_unit_cost"])
        .filter(F.col("teacher_estimated_unit_cost").isNotNull())
        .withColumn("__cheapest", cheapest)
        .filter(F.col("__cheapest").isNotNull() & (hx.hash_ratio(key) < sample_rate))
        .select(
            F.lit(experiment_id).alias("experiment_id"),
            F.concat(
                F.lit("cf_"),
                F.substring(hx.sha(F.concat(F.lit(f"{experiment_id}:"), key)), 1, 20),
            ).alias("counterfactual_group_id"),
            "task_id",
            "task_group",
            "subtask_id",
            F.col("chosen_option_id").alias("teacher_option_id"),
            F.col("__cheapest.id").alias("candidate_option_id"),
            "teacher_estimated_unit_cost",
            F.col("__cheapest.cost").alias("candidate_estimated_unit_cost"),
            "catalog_hash",
            "policy_hash",
            "candidate_set_hash",
        )
    )
    hashed = plans.withColumn("plan_hash", hx.row_hash(*plans.columns))
    if maximum_trials is None:
        return hashed
    return hashed.orderBy("plan_hash").limit(maximum_trials)


def feature_leaves(rows: DataFrame) -> DataFrame:
    """(split, id, path, value) of the feature document, nested objects walked by name to any depth.

    ``features`` is JSON text. Every turn opens the objects of one level, told by their JSON type, so
    a text that begins with a brace stays a text; it ends when a level has no object.
    """
    kept = ("split", "id", "chosen_option_id", "chosen_choice_id", "completion")
    level = rows.filter(F.col("features").isNotNull()).select(
        *kept, F.lit("features").alias("path"), F.try_parse_json("features").alias("value"))
    leaves = None
    while True:
        entry = F.from_json(F.to_json("value"), "map<string,variant>")
        parts = durable(
            level.filter(_is_object("value")).select(*kept, "path", F.explode(entry).alias("key", "value"))
            .select(*kept, F.concat_ws(".", "path", "key").alias("path"), "value")
        )
        flat = parts.filter(~F.coalesce(_is_object("value"), F.lit(False))).select(
            *kept, "path", F.col("value").cast("string").alias("json"))
        leaves = flat if leaves is None else leaves.unionByName(flat)
        if not parts.filter(_is_object("value")).limit(1).count():
            return leaves
        level = parts


def _is_object(name: str) -> Column:
    return F.schema_of_variant(name).startswith("OBJECT")


def leakage_findings(rows: DataFrame) -> DataFrame:
    """Feature paths named after the target, and feature values equal to the target."""
    leaves = feature_leaves(rows)
    banned = tx.contains_any(F.lower("path"), vocab.TARGET_DERIVED_KEYS)
    equal = (F.col("json") != "") & F.coalesce(
        F.col("json").isin(
            F.col("chosen_option_id"), F.col("chosen_choice_id"), F.col("completion")
        ),
        F.lit(False),
    )
    reason = F.array_compact(
        F.array(
            F.when(banned, "target-derived-key"), F.when(equal, "embedded-target-value")
        )
    )
    missing = rows.filter(
        ~F.coalesce(F.col("features").startswith("{"), F.lit(False))
    ).select("split", "id", F.lit("features").alias("path"), F.lit("missing-features").alias("reason"))
    return leaves.select("split", "id", "path", F.explode(reason).alias("reason")).unionByName(
        missing
    )


def leakage_audit(rows: DataFrame) -> DataFrame:
    """One verdict row over train and eval rows (``split``), from aggregates per key.

    Overlaps are counted by grouping on the hash and asking which splits hold it, so no
    rows of different splits are paired.
    """
    structure = hx.json_hash(
        F.to_json(
            F.map_filter(
                F.from_json("features", "map<string,string>"),
                lambda k, _: ~k.isin("task_text", "objective"),
            )
        )
    )
    keyed = rows.select(
        "split",
        F.explode(
            F.map_from_arrays(
                F.array(F.lit("group"), F.lit("exact"), F.lit("structural")),
                F.array(
                    F.coalesce("task_group", F.lit("")), hx.json_hash("features"), structure
                ),
            )
        ).alias("kind", "key"),
    )
    both = (
        keyed.groupBy("kind", "key")
        .agg(
            F.bool_or(F.col("split") == "train").alias("in_train"),
            F.bool_or(F.col("split") == "eval").alias("in_eval"),
        )
        .filter("in_train and in_eval")
        .groupBy()
        .agg(*[F.count_if(F.col("kind") == kind).alias(f"{kind}_overlap")
               for kind in ("group", "exact", "structural")])
    )
    direct = leakage_findings(rows).agg(
        F.count_if(F.col("reason") != "embedded-target-value").alias("prohibited_feature_paths"),
        F.count_if(F.col("reason") == "embedded-target-value").alias("embedded_target_values"),
    )
    counts = rows.agg(
        F.count_if(F.col("split") == "train").alias("train_rows"),
        F.count_if(F.col("split") == "eval").alias("eval_rows"),
    )
    one = F.lit(1).alias("__one")
    joined = (
        counts.select(one, "*").join(both.select(one, "*"), "__one")
        .join(direct.select(one, "*"), "__one").drop("__one")
    )
    clean = (F.col("prohibited_feature_paths") == 0) & (F.col("embedded_target_values") == 0)
    disjoint = F.col("group_overlap") == 0
    return joined.select(
        "train_rows",
        "eval_rows",
        disjoint.alias("group_disjoint"),
        F.col("group_overlap").alias("overlapping_task_groups"),
        "prohibited_feature_paths",
        "embedded_target_values",
        F.col("exact_overlap").alias("exact_feature_overlap_count"),
        F.col("structural_overlap").alias("structural_feature_overlap_count"),
        (disjoint & clean).alias("safe_for_teacher_imitation"),
        (disjoint & clean & (F.col("structural_overlap") == 0)).alias(
            "safe_for_production_generalization"
        ),
    )


def outcome_job(raw: DataFrame, epochs: int = 0, current_stage: str = "shadow") -> dict[str, DataFrame]:
    """Problems, sound outcomes, their counts, cells, targets and rollout of the same raw rows.

    Outcome rows are wide, so they are not stored: each table normalises again what it reads of them.
    ``counts`` (part, n) are both counts from one reading.
    """
    checked = normalize_outcomes(raw)
    sound = checked.filter(F.col("problem").isNull())
    cells = durable(cell_report(sound))
    totals = cell_totals(cells)
    broken = F.col("problem").isNotNull()
    counts = checked.agg(F.count_if(~broken).alias("outcomes"), F.count_if(broken).alias("problems"))
    return {
        "counts": counts.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("part"), F.col(name).alias("n")) for name in counts.columns]))),
        "problems": checked.filter(F.col("problem").isNotNull()),
        "outcomes": sound,
        "cells": cells,
        "targets": cheapest_acceptable(sound),
        "rollout": rollout(totals, epochs, current_stage),
    }
