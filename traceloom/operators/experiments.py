"""Candidate rankings, method summaries, hypothesis verdicts and promotion gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import text as tx
from traceloom.operators.normalize import literal_map
from traceloom.operators.stats import paired_deltas, paired_interval


def rank_candidates(results: DataFrame) -> DataFrame:
    """Score, stability and band of every candidate over its seeds, with its rank order.

    ``results``: candidate_id, candidate_hash, arm, seed, selection_score,
    behavioral_accuracy, unhealthy. A single seed gets a fixed standard error of 0.05.
    """
    n = F.count(F.lit(1))
    stats = results.groupBy("candidate_id", "candidate_hash", "arm").agg(
        n.alias("seeds"),
        F.avg("selection_score").alias("raw_mean"),
        F.greatest(F.lit(0.0), 1.0 - F.stddev_pop("behavioral_accuracy")).alias("seed_stability"),
        F.when(n > 1, F.stddev_pop("selection_score") / F.sqrt(n)).otherwise(F.lit(0.05)).alias("se"),
        (~F.bool_or(F.coalesce("unhealthy", F.lit(False)))).alias("eligible"),
    )
    mean = F.col("raw_mean") - 0.05 + 0.05 * F.col("seed_stability")
    return stats.select(
        "candidate_id", "candidate_hash", "arm", "seeds",
        mean.alias("mean_score"),
        (mean - 1.96 * F.col("se")).alias("confidence_lower"),
        (mean + 1.96 * F.col("se")).alias("confidence_upper"),
        "seed_stability",
        "eligible",
    )


def rank_order() -> list[Column]:
    return [F.col("eligible").desc(), F.col("mean_score").desc(), F.col("candidate_hash")]


def promote_candidates(ranked: DataFrame, families: DataFrame, margin: float,
                       arms: tuple[str, ...]) -> DataFrame:
    """Candidates within the margin of the leader, plus the best of uncovered families and arms.

    ``families`` maps candidate_id to family. Best-of picks are ``max_by`` aggregates. When
    no candidate is healthy nothing is promoted.
    """
    better = F.struct("mean_score", F.col("__tie"))
    rows = ranked.withColumn(
        "__tie", F.translate("candidate_hash", "0123456789abcdef", "fedcba9876543210")
    )
    healthy = rows.filter("eligible")
    leader = healthy.agg(F.max("confidence_lower").alias("m")).scalar()
    kept = healthy.filter(F.col("confidence_upper") >= leader - margin).select(
        "candidate_id", "arm"
    )
    members = families.join(healthy.select("candidate_id", "mean_score", "__tie"), "candidate_id")
    covered = families.join(kept, "candidate_id", "left_semi").select("family").distinct()
    by_family = (
        members.join(covered, "family", "left_anti").groupBy("family")
        .agg(F.max_by("candidate_id", better).alias("candidate_id"))
    )
    with_families = kept.select("candidate_id").unionByName(by_family.select("candidate_id"))
    held_arms = rows.join(with_families, "candidate_id", "left_semi").select("arm").distinct()
    by_arm = (
        rows.filter(F.col("arm").isin(*arms) & F.lit(True)).join(held_arms, "arm", "left_anti")
        .groupBy("arm")
        .agg(F.max_by("candidate_id", F.struct("eligible", "mean_score", "__tie")).alias(
            "candidate_id"))
    )
    any_healthy = healthy.agg(F.count(F.lit(1)).alias("n")).scalar() > 0
    return (
        with_families.unionByName(by_arm.select("candidate_id")).distinct().filter(any_healthy)
    )


def geometric_scores(rows: DataFrame) -> DataFrame:
    """Geometric mean of floored relative improvements per candidate.

    ``rows``: candidate_id, candidate_hash, task, base_loss, loss.
    """
    gain = F.greatest(F.lit(0.0), (F.col("base_loss") - F.col("loss")) / F.col("base_loss"))
    score = F.exp(F.avg(F.ln(F.greatest(gain, F.lit(1e-12)))))
    return rows.groupBy("candidate_id", "candidate_hash").agg(score.alias("score"))


def finalist_scores(rows: DataFrame) -> DataFrame:
    """Mean and population deviation over seeds of the per-seed geometric mean."""
    gain = F.greatest(F.lit(0.0), (F.col("base_loss") - F.col("loss")) / F.col("base_loss"))
    per_seed = rows.groupBy("candidate_id", "candidate_hash", "seed").agg(
        F.exp(F.avg(F.ln(F.greatest(gain, F.lit(1e-12))))).alias("score")
    )
    return per_seed.groupBy("candidate_id", "candidate_hash").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("score_std")
    )


def method_summary(
    results: DataFrame,
    baseline: DataFrame,
    *,
    metric: str = "accuracy",
    retention: str | None = "retention",
    draws: int = 2000,
    seed: int = 7319,
    least_retention: float = 0.99,
) -> DataFrame:
    """Mean, spread, gain over baseline with interval, health and eligibility per method.

    ``results``: method, seed, position, outcome (0/1), unhealthy, aborted_early and the
    retention column; ``baseline``: method, position, outcome. Pairs of the same position
    give the gain interval.
    """
    per_seed = results.groupBy("method", "seed").agg(
        F.avg("outcome").alias(metric),
        *([F.min(retention).alias("__retention")] if retention else []),
        F.bool_and(
            ~F.coalesce("unhealthy", F.lit(False)) & ~F.coalesce("aborted_early", F.lit(False))
        ).alias("__healthy"),
    )
    stats = per_seed.groupBy("method").agg(
        F.count(F.lit(1)).alias("seeds"),
        F.avg(metric).alias(f"mean_{metric}"),
        F.stddev_pop(metric).alias(f"std_{metric}"),
        *([F.min("__retention").alias("min_retention")] if retention else []),
        F.bool_and("__healthy").alias("healthy"),
    )
    base = baseline.groupBy("method").agg(F.avg("outcome").alias("baseline"))
    deltas = results.join(
        baseline.select("method", "position", F.col("outcome").alias("__base")),
        ["method", "position"],
    ).withColumn("delta", F.col("outcome") - F.col("__base"))
    interval = paired_interval(deltas, "method", "delta", draws=draws, seed=seed).select(
        F.col("pair").alias("method"), F.col("lower").alias("gain_lower"),
        F.col("upper").alias("gain_upper"),
    )
    kept = F.col("min_retention") >= least_retention if retention else F.lit(True)
    return (
        stats.join(base, "method", "left").join(interval, "method", "left")
        .withColumn("mean_gain", F.col(f"mean_{metric}") - F.col("baseline"))
        .withColumn(
            "eligible",
            F.coalesce(F.col("healthy") & kept & (F.col("gain_lower") > 0), F.lit(False)),
        )
    )


def winner(summary: DataFrame, metric: str = "mean_accuracy") -> DataFrame:
    """Best eligible method, null when none is eligible."""
    pick = F.max_by(
        F.when(F.col("eligible"), F.col("method")),
        F.when(F.col("eligible"), F.struct(metric, "method")),
    )
    return summary.agg(pick.alias("winner")).withColumn(
        "verdict",
        F.when(F.col("winner").isNull(), "NO_ELIGIBLE_METHOD").otherwise("ELIGIBLE_METHOD"),
    )


def pairwise_intervals(outcomes: DataFrame, pairs: DataFrame, position: list[str], *,
                       draws: int = 10_000, seed: int = 7102) -> DataFrame:
    """Bootstrap interval of the paired difference for every listed pair of methods."""
    return paired_interval(paired_deltas(outcomes, pairs, position), "pair", "delta",
                           draws=draws, seed=seed)


# Hypothesis ids and which bound decides them.
HYPOTHESES = {
    "H1_SPARSE_VS_UNIFORM": "above_zero",
    "H2_SOCKET_VS_SINGLE_LAYER": "non_inferior",
    "H3_SEARCH_VS_RANDOM_SEARCH": "above_zero",
    "H4_SFT_TOPOLOGY_TRANSFER": "above_zero",
    "H5_SFT_WEIGHT_CONTINUATION": "above_zero",
}


def hypothesis_verdicts(intervals: DataFrame, margin: float) -> DataFrame:
    """SUPPORTED or REJECTED per hypothesis, and whether its bound is still undecided."""
    rule = F.try_element_at(literal_map(HYPOTHESES), F.col("hypothesis"))
    limit = F.when(rule == "non_inferior", F.lit(-margin)).otherwise(F.lit(0.0))
    holds = F.when(rule == "non_inferior", F.col("lower") >= limit).otherwise(F.col("lower") > limit)
    straddles = (F.col("lower") <= limit) & (limit <= F.col("upper"))
    return intervals.select(
        "hypothesis",
        "lower",
        "upper",
        F.when(holds, "SUPPORTED").otherwise("REJECTED").alias("verdict"),
        (straddles & F.col("hypothesis").rlike("^H[123]_")).alias("needs_extra_seeds"),
    )


def overall_conclusion(verdicts: DataFrame) -> DataFrame:
    def supported(prefix):
        return F.coalesce(
            F.bool_or(F.col("hypothesis").startswith(prefix) & (F.col("verdict") == "SUPPORTED")),
            F.lit(False),
        )

    h1, h2 = supported("H1_"), supported("H2_")
    h3, h4 = supported("H3_"), supported("H4_")
    # The sentences of the overall conclusion.
    return verdicts.agg(
        F.when(h1 & h4, "A. Sparse RL sockets work and topology transfers.")
        .when(h1 & h3, "B. Sparse RL sockets work, but RL needs a different topology.")
        .when(h1, "C. Sparse placement works, but guided search adds no value.")
        .when(~h2, "D. Single-layer adaptation remains best.")
        .otherwise("F. Results remain inconclusive.")
        .alias("overall_conclusion"),
        F.bool_or("needs_extra_seeds").alias("needs_extra_seeds"),
    )


def replace_method(results: DataFrame, fresh: DataFrame, method: str) -> DataFrame:
    return results.filter(F.col("method") != method).unionByName(fresh)


def baseline_beating(
    results: DataFrame,
    focus: str,
    *,
    uniform: str,
    specific: str,
    base_accuracy: float,
    discovery_seconds: float,
    specific_seconds: float,
) -> DataFrame:
    """Does one method beat every other method's mean; one verdict row.

    ``results``: method, seed, accuracy, elapsed_seconds. Everything after the first
    aggregate has one row per method.
    """
    methods = results.groupBy("method").agg(
        F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"),
        F.avg("elapsed_seconds").alias("seconds"),
    )

    def of(name, column):
        return F.max(F.when(F.col("method") == name, F.col(column)))

    facts = methods.agg(
        of(focus, "mean").alias("focus_mean"),
        of(focus, "std").alias("focus_std"),
        of(uniform, "mean").alias("uniform_mean"),
        of(uniform, "std").alias("uniform_std"),
        of(specific, "mean").alias("specific_mean"),
        F.max(F.when(F.col("method") != focus, F.col("mean"))).alias("best_other"),
        F.max("mean").alias("best_mean"),
    )
    spread = F.col("specific_mean") - base_accuracy
    reuse = F.when(spread > 0, (F.col("focus_mean") - base_accuracy) / spread)
    performance = (F.col("focus_mean") - F.col("uniform_mean")) >= 0.03
    stability = (F.col("focus_mean") >= F.col("uniform_mean")) & (
        F.col("focus_std") < F.col("uniform_std")
    )
    beats = F.col("focus_mean") > F.col("best_other")
    partly = performance | stability | F.coalesce(reuse >= 0.9, F.lit(False))
    break_even = (
        F.ceil(F.lit(discovery_seconds) / F.lit(specific_seconds))
        if specific_seconds > 0 else F.lit(None).cast("long")
    )
    return facts.select(
        "focus_mean",
        "best_other",
        reuse.alias("reusability_score"),
        performance.alias("performance_victory"),
        stability.alias("stability_victory"),
        beats.alias("beats_every_baseline"),
        F.when(beats, "SUPPORTED").when(partly, "PARTIALLY_SUPPORTED").otherwise("NOT_SUPPORTED")
        .alias("verdict"),
        (F.col("best_mean") >= 0.99).alias("ceiling_warning"),
        break_even.alias("search_break_even"),
    )


def floor_adjudication(observed: DataFrame, floors: dict[str, float], broad: bool) -> DataFrame:
    """ELIGIBLE when every task reaches its floor and the broad comparison passed."""
    floor = F.try_element_at(literal_map(floors), F.col("task"))
    reached = F.coalesce(F.bool_and(F.col("accuracy") >= floor), F.lit(False)) & (
        F.count_distinct(F.when(floor.isNotNull(), F.col("task"))) == len(floors)
    )
    return observed.filter(floor.isNotNull()).agg(reached.alias("floors_passed")).select(
        "floors_passed",
        F.lit(broad).alias("broad_comparison_passed"),
        F.when(F.col("floors_passed") & F.lit(broad), "ELIGIBLE").otherwise("REJECTED").alias("verdict"),
        F.array_compact(
            F.array(
                F.when(~F.col("floors_passed"), "adapters failed task-level performance floors"),
                F.when(~F.lit(broad), "did not beat every required parameter-matched baseline"),
            )
        ).alias("reasons"),
    )


def recovery_summary(
    results: DataFrame, starting: float, *, focus: str, baselines: tuple[str, str],
    time_baseline: str, target: float, late_predicted: bool, draws: int = 2000,
) -> DataFrame:
    """Gain recovery and time saving of one method against the best of two baselines.

    ``results``: method, seed, position, outcome, wall_clock_seconds, peak_memory_bytes,
    unhealthy, aborted_early.
    """
    per_seed = results.groupBy("method", "seed").agg(
        F.avg("outcome").alias("accuracy"),
        F.max("wall_clock_seconds").alias("seconds"),
        F.max("peak_memory_bytes").alias("memory"),
        F.bool_and(~F.col("unhealthy") & ~F.col("aborted_early")).alias("ok"),
    )
    methods = per_seed.groupBy("method").agg(
        F.avg("accuracy").alias("mean_accuracy"),
        (F.avg("accuracy") - starting).alias("gain"),
        F.avg("seconds").alias("mean_seconds"),
        F.max("memory").alias("peak_memory_bytes"),
        F.bool_and("ok").alias("healthy"),
    )
    def of(name, column):
        return F.max(F.when(F.col("method") == name, F.col(column)))

    is_base = F.col("method").isin(*baselines)
    facts = methods.agg(
        F.max_by(F.when(is_base, F.col("method")), F.when(is_base, F.col("gain"))).alias(
            "best_baseline"
        ),
        F.max(F.when(is_base, F.col("gain"))).alias("best_gain"),
        of(focus, "gain").alias("focus_gain"),
        F.bool_or(F.when(F.col("method") == focus, F.col("healthy"))).alias("healthy"),
        (1.0 - of(focus, "mean_seconds") / of(time_baseline, "mean_seconds")).alias("time_saving"),
    )
    one = results.sparkSession.createDataFrame(
        [(f"{focus}-{b}", focus, b) for b in baselines], "pair string, left_method string, right_method string"
    )
    values = results.select("method", "seed", "position", F.col("outcome").alias("value"))
    interval = paired_interval(
        paired_deltas(values, one, ["seed", "position"]), "pair", "delta", draws=draws, seed=19421
    )
    joined = facts.withColumn(
        "pair", F.concat(F.lit(f"{focus}-"), "best_baseline")
    ).join(interval, "pair")
    recovery = F.when(F.col("best_gain") > 0, F.col("focus_gain") / F.col("best_gain"))
    quality = F.coalesce(recovery >= target, F.lit(False))
    good = (
        F.lit(late_predicted) & quality
        & (F.col("lower") >= -(1.0 - target) * F.col("best_gain"))
        & (F.col("time_saving") > 0) & F.col("healthy")
    )
    # The three verdicts.
    return joined.select(
        "best_baseline", "best_gain", "focus_gain", recovery.alias("recovery_fraction"),
        "lower", "upper", "time_saving", quality.alias("quality_target_met"),
        F.when(good, "SOCKET_SWEET_SPOT_CONFIRMED")
        .when(F.lit(not late_predicted), "CALIBRATION_NOT_LATE_CONCENTRATED")
        .otherwise("SOCKET_SWEET_SPOT_REJECTED").alias("verdict"),
    )


# ---------------------------------------------------------------- gates


def _reasons(*rules: tuple[Column, Column | str]) -> Column:
    """Texts of the rules that fired; a rule that cannot be decided counts as fired."""
    return F.array_compact(
        F.array(
            *[F.when(F.coalesce(rule, F.lit(True)), text if isinstance(text, Column) else F.lit(text))
              for rule, text in rules]
        )
    )


def _decided(rows: DataFrame, reasons: Column) -> DataFrame:
    return rows.withColumn("reasons", reasons).withColumn("promoted", F.size("reasons") == 0)


def router_gate(reports: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Gate of routing experiments; ``snapshots`` lists the rollback snapshots that exist."""
    have = snapshots.select(
        F.col("snapshot").alias("rollback_snapshot"), F.lit(True).alias("__have")
    ).distinct()
    rows = reports.join(have, "rollback_snapshot", "left")
    reasons = _reasons(
        (~F.col("primary_metric_improved"), "primary metric did not improve"),
        (
            F.coalesce(F.size("regressions") > 0, F.lit(False)),
            F.concat(F.lit("non-regression metrics worsened: "), F.array_join("regressions", ", ")),
        ),
        (~F.col("safety_passed"), "safety checks failed"),
        (~F.col("verification_passed"), "verification pass rate declined"),
        (F.coalesce("reproducible_runs", F.lit(0)) < 2, "reproducibility requirement not met"),
        (F.col("__have").isNull(), "rollback snapshot missing"),
    )
    return _decided(rows, reasons).drop("__have")


# Thresholds of the workflow promotion gate.
GATE_LIMITS = {
    "min_quality_improvement": 0.02,
    "bootstrap_confidence": 0.95,
    "max_cost_increase": 0.10,
    "quality_cost_tradeoff": 0.05,
    "reproducibility_requirement": 2,
}


def workflow_gate(reports: DataFrame, limits: dict | None = None) -> DataFrame:
    """Gate of workflow candidates by median gain, interval, cost, failures, reproducibility.

    ``bootstrap`` is (mean, low, high); ``rollback_state_id`` is the workflow a stored
    snapshot restores, null when there is none.
    """
    t = {**GATE_LIMITS, **(limits or {})}

    def number(name):
        return F.coalesce(F.col(name), F.lit(0.0))

    quality = number("median_quality_improved")
    delta = F.coalesce(F.col("quality_delta"), quality)
    mean = F.coalesce(F.try_element_at("bootstrap", F.lit(1)), F.lit(0.0))
    low = F.coalesce(F.try_element_at("bootstrap", F.lit(2)), F.lit(0.0))
    hashed = F.col("rollback_artifact_hash")
    critical = F.coalesce("critical_benchmark_regressions", F.array().cast("array<string>"))
    reasons = _reasons(
        (quality < t["min_quality_improvement"], "median quality improved too little"),
        (
            F.coalesce("bootstrap_confidence", F.lit(t["bootstrap_confidence"]))
            < t["bootstrap_confidence"],
            "bootstrap confidence below required",
        ),
        (~((mean > 0) & (low > 0)), "bootstrap CI does not confirm improvement"),
        (
            F.coalesce(~F.col("judge_independent"), F.lit(False)),
            "judge is not independent from mutator",
        ),
        (
            F.size(critical) > 0,
            F.concat(F.lit("critical benchmark regressed: "), F.array_join(critical, ", ")),
        ),
        (
            (number("cost_delta") > t["max_cost_increase"]) & (delta <= t["quality_cost_tradeoff"]),
            "cost increased without quality gain",
        ),
        (number("failure_rate_delta") > 0, "failure rate increased"),
        (
            F.coalesce("reproducible_runs", F.lit(0)) < t["reproducibility_requirement"],
            "reproducibility requirement not met",
        ),
        (
            F.coalesce(~hashed.rlike("^[0-9a-fA-F]{64}$"), F.lit(False)),
            "rollback artifact hash must be a SHA-256",
        ),
        (
            hashed.isNull() & F.col("rollback_state_id").isNull(),
            "rollback snapshot or durable artifact hash missing",
        ),
        (
            hashed.isNull()
            & F.coalesce(F.col("rollback_state_id") != F.col("incumbent_id"), F.lit(False)),
            "rollback snapshot does not match incumbent",
        ),
    )
    return _decided(reports, reasons)


def calibration_gate(reports: DataFrame, need_recall: bool = True) -> DataFrame:
    """Gate of calibration reports at the fixed limits; the recall check can be left out."""
    def metric(name, worst):
        return F.coalesce(F.col(name), F.lit(worst))

    # Limits of the calibration gate.
    checks = {
        "adaptive_ece": metric("adaptive_ece", 1.0) <= 0.25,
        "high_confidence_failure_rate": metric("high_confidence_failure_rate", 1.0) <= 0.2,
        "confidence_faithfulness": metric("confidence_faithfulness", 0.0) >= 0.75,
        "escalation_recall": metric("escalation_recall", 0.0) >= 0.7,
        "regression_passed": F.coalesce("regression_passed", F.lit(True)),
        "benchmark_passed": F.coalesce("passed", F.lit(False)),
    }
    if not need_recall:
        checks.pop("escalation_recall")
    return _decided(reports, _reasons(*[(~ok, name) for name, ok in checks.items()]))


def experiment_verdict(reports: DataFrame, snapshots: DataFrame) -> DataFrame:
    """promotable or reject, as shown when an experiment is compared."""
    return router_gate(reports, snapshots).withColumn(
        "verdict", F.when(F.col("promoted"), "promotable").otherwise("reject")
    )


# Executor kinds whose evidence may bind; pass more for other runtimes.
REAL_EXECUTORS = ("subprocess.v1",)


def evidence_issues() -> Column:
    """Missing or malformed inputs of the workflow gate, per report row."""
    def missing(name):
        return F.when(F.col(name).isNull(), F.lit(f"missing {name}"))

    def not_finite(name):
        value = F.col(name)
        return F.when(
            F.isnan(value) | (F.abs(value) == float("inf")),
            F.lit(f"{name} must be a finite number"),
        )

    numbers = ("median_quality_improved", "quality_delta", "cost_delta", "failure_rate_delta")
    fields = (
        "median_quality_improved", "quality_delta", "bootstrap", "bootstrap_confidence",
        "critical_benchmark_regressions", "cost_delta", "failure_rate_delta",
        "reproducible_runs", "judge_independent",
    )
    three = (F.size("bootstrap") == 3) & F.forall(
        "bootstrap", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    return F.array_compact(
        F.array(
            *[missing(name) for name in fields],
            *[not_finite(name) for name in numbers],
            F.when(F.col("bootstrap").isNotNull() & ~F.coalesce(three, F.lit(False)),
                   "bootstrap must contain three finite numbers"),
            F.when(
                (F.col("bootstrap_confidence") <= 0) | (F.col("bootstrap_confidence") > 1),
                "bootstrap_confidence must be in (0, 1]",
            ),
            F.when(F.col("reproducible_runs") < 0,
                   "reproducible_runs must be a non-negative integer"),
        )
    )


def issue_verdicts(reports: DataFrame, executors: tuple[str, ...] = REAL_EXECUTORS) -> DataFrame:
    """INCONCLUSIVE, REJECTED or ELIGIBLE from provenance, completeness and the gate."""
    kind = F.regexp_replace(F.lower("executor_kind"), "[^a-z0-9]", "")
    simulated = kind.startswith("reference") | kind.contains("simulat")
    gated = workflow_gate(reports).withColumn("__issues", evidence_issues())
    conflict = F.coalesce(F.trim("report_executor_kind") != F.col("executor_kind"), F.lit(False))
    why = (
        F.when(simulated, F.array(F.lit("simulated evidence cannot authorize a canary")))
        .when(
            ~F.col("executor_kind").isin(*executors),
            F.array(F.concat(F.lit("executor kind '"), "executor_kind",
                             F.lit("' is not on the real-executor allowlist"))),
        )
        .when(
            F.size("__issues") > 0,
            F.transform(
                "__issues",
                lambda i: F.concat(F.lit("incomplete statistical evidence: "), i),
            ),
        )
        .when(conflict,
              F.array(F.lit("executor_kind conflicts with the statistical report provenance")))
    )
    return gated.withColumn("__why", why).withColumns(
        {
            "verdict": F.when(F.col("__why").isNotNull(), "INCONCLUSIVE")
            .when(F.col("promoted"), "ELIGIBLE").otherwise("REJECTED"),
            "reasons": F.coalesce("__why", "reasons"),
        }
    ).drop("__issues", "__why", "promoted")


def ab_prompt_packs(metrics: DataFrame) -> DataFrame:
    """Success and hallucination deltas of prompt packs; ``metrics``: pack, arm, metric, value."""
    wide = metrics.groupBy("pack").pivot("metric", ["success_rate", "hallucination_rate"]).agg(
        F.sum(F.when(F.col("arm") == "variant", F.col("value")).otherwise(-F.col("value")))
    )
    success = F.coalesce("success_rate", F.lit(0.0))
    wrong = F.coalesce("hallucination_rate", F.lit(0.0))
    return wide.select(
        "pack",
        success.alias("success_delta"),
        wrong.alias("hallucination_delta"),
        ((success > 0) & (wrong <= 0)).alias("promotable"),
    )


def adapter_gain(metrics: DataFrame) -> DataFrame:
    base = F.coalesce("baseline_quality_score", F.lit(0.0))
    new = F.coalesce("quality_score", F.lit(0.0))
    return metrics.withColumns(
        {"improvement": new - base, "promotable": (new - base) > 0}
    )


def model_comparison(reports: DataFrame) -> DataFrame:
    """Calibration of the tuned model against the baseline; ``reports``: stage + metrics."""
    def at(stage, name, default):
        return F.coalesce(F.max(F.when(F.col("stage") == stage, F.col(name))), F.lit(default))

    ece = at("baseline", "adaptive_ece", 1.0) - at("tuned", "adaptive_ece", 1.0)
    faith = at("tuned", "confidence_faithfulness", 0.0) - at(
        "baseline", "confidence_faithfulness", 0.0
    )
    return reports.agg(
        F.round(ece, 6).alias("adaptive_ece_improvement"),
        F.round(faith, 6).alias("confidence_faithfulness_improvement"),
        F.when((ece >= 0) & (faith >= 0), "tuned").otherwise("review").alias("winner"),
    )


# ---------------------------------------------------------------- opportunities


def opportunities(traces: DataFrame) -> DataFrame:
    """Six detectors over labelled traces, each giving at most one row.

    One pass of conditional counts replaces six scans; the matching trace ids stay rows of
    :func:`opportunity_traces`.
    """
    label = F.coalesce("label", F.lit(""))
    failure = F.coalesce("failure_type", F.lit(""))
    failed = (failure != "") | label.startswith("failed")
    rows = F.count(F.lit(1))
    facts = traces.agg(
        rows.alias("rows"),
        F.count_if(_router_mistake(label, failure)).alias("router_mistake"),
        F.count_if((label == "accepted") & (F.coalesce("cost_usd", F.lit(0.0)) > 0.05)).alias(
            "expensive_success"
        ),
        F.count_if(failed).alias("failures"),
        F.count_if(F.col("trace_type") == "benchmark_trace").alias("benchmarks"),
        F.count_if(_confused(traces, failure)).alias("prompt_confusion"),
        F.count_if(failure == "duplicated_work").alias("duplicated_work"),
    )
    repeated = (
        traces.filter((failure != "") & (failure != "duplicated_work"))
        .groupBy("failure_type").agg(rows.alias("n")).filter("n >= 2")
        .agg(F.array_sort(F.collect_list("failure_type")).alias("repeated"))
    )
    task = tx.trimmed_or_null(F.lower(tx.first_text(*[
        name for name in ("task", "objective") if name in traces.columns])))
    twice = (
        traces.filter(task.isNotNull()).groupBy(task.alias("t")).agg(rows.alias("n"))
        .filter("n >= 2").agg(F.count(F.lit(1)).alias("same_task"))
    )
    one = F.lit(1).alias("__one")
    joined = facts.select(one, "*").join(repeated.select(one, "*"), "__one").join(
        twice.select(one, "*"), "__one"
    )

    # Texts of the six opportunity kinds.
    def made(category, found, matched, observation, hypothesis, change, metric, risk="low"):
        text = observation if isinstance(observation, Column) else F.lit(observation)
        return F.when(
            found,
            F.struct(
                F.lit(category).alias("category"), matched.cast("long").alias("matched"),
                text.alias("observation"), F.lit(hypothesis).alias("hypothesis"),
                F.lit(change).alias("proposed_change"), F.lit(metric).alias("expected_metric"),
                F.lit(risk).alias("risk_level"),
            ),
        )

    c = F.col
    kinds = F.array_compact(
        F.array(
            made("router_mistake", c("router_mistake") > 0, c("router_mistake"),
                 "Router assignments failed or required rescue.",
                 "Tighter router policy can route risky tasks to stronger workers.",
                 "Adjust router policy thresholds and examples.", "verification_pass_rate",
                 "medium"),
            made("repeated_failure", F.size("repeated") > 0, c("rows"),
                 F.concat(F.lit("Repeated failures: "), F.array_join("repeated", ", "), F.lit(".")),
                 "A focused prompt or evaluator can reduce repeated failure modes.",
                 "Add negative examples and failure-specific checks.", "task_success_rate"),
            made("expensive_success", c("expensive_success") > 0, c("expensive_success"),
                 "Accepted tasks used comparatively expensive models.",
                 "Cheaper models may preserve verification quality for low-risk tasks.",
                 "Introduce cost-aware routing fallback.", "cost_per_verified_task"),
            made("duplicate_effort", (c("same_task") > 0) | (c("duplicated_work") > 0), c("rows"),
                 "Similar tasks were attempted repeatedly.",
                 "Duplicate detection can reuse verified work or compact repeats.",
                 "Add task hash/similarity checks before worker assignment.", "duplicate_rate"),
            made("missing_benchmark", (c("failures") > 0) & (c("benchmarks") == 0), c("failures"),
                 "Failures were observed without matching benchmark coverage.",
                 "Freezing representative failures as benchmark cases can prevent regressions.",
                 "Create benchmark tasks from repeated failures.", "regression_rate"),
            made("prompt_confusion", c("prompt_confusion") > 0, c("prompt_confusion"),
                 "Workers showed format, context, or instruction confusion.",
                 "Clearer prompt packs can reduce ambiguity without raising cost.",
                 "Revise prompt pack with explicit output contract.", "format_pass_rate",
                 "medium"),
        )
    )
    return joined.select(F.explode(kinds).alias("o")).select("o.*").withColumn(
        "status", F.lit("proposed")
    )


def _router_mistake(label: Column, failure: Column) -> Column:
    return (failure == "bad_router_assignment") | (label == "rescued_by_stronger_model")


def _confused(traces: DataFrame, failure: Column) -> Column:
    notes = F.lower(F.coalesce("notes", F.lit(""))) if "notes" in traces.columns else F.lit("")
    return failure.isin("format_failure", "context_loss") | notes.contains("confus")


def opportunity_traces(traces: DataFrame) -> DataFrame:
    """(category, trace_id) evidence of the detectors that point at single traces."""
    label = F.coalesce("label", F.lit(""))
    failure = F.coalesce("failure_type", F.lit(""))
    kinds = F.array_compact(
        F.array(
            F.when(_router_mistake(label, failure), "router_mistake"),
            F.when((label == "accepted") & (F.coalesce("cost_usd", F.lit(0.0)) > 0.05),
                   "expensive_success"),
            F.when((failure != "") | label.startswith("failed"), "missing_benchmark"),
            F.when(_confused(traces, failure), "prompt_confusion"),
        )
    )
    return traces.select(F.explode(kinds).alias("category"), "trace_id")


def mark_weak(rows: DataFrame) -> DataFrame:
    """Opportunities without observation, hypothesis or metric keep their row as NO_IDEA."""
    weak = (
        tx.text_or_null("observation").isNull()
        | tx.text_or_null("hypothesis").isNull()
        | tx.text_or_null("expected_metric").isNull()
    )
    return rows.withColumn("status", F.when(weak, "NO_IDEA").otherwise(F.col("status")))
