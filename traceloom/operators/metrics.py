"""Provider rates, router metrics and the measured routing experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom import vocab
from traceloom.functions import numeric as nx
from traceloom.functions import text as tx
from traceloom.session import with_row_index

INFINITY = float("inf")
METRICS = (
    "cost_per_verified_task", "correctness", "verification_pass_rate", "safety_score",
    "latency_ms", "hallucination_rate", "avg_cost_usd",
)


def performance_rows(traces: DataFrame) -> DataFrame:
    """Seven columns for routing analysis; zero and empty values count as absent."""
    names = set(traces.columns)

    def first_of(*columns):
        return tx.first_text(*[c for c in columns if c in names])

    score = F.coalesce(
        *[tx.number_or_null(c) for c in ("quality_score", "score") if c in names], F.lit(0.0)
    )
    return traces.select(
        first_of("task", "objective", "prompt").alias("task"),
        F.col("model").alias("selected_model"),
        "provider",
        first_of("label", "outcome").alias("result"),
        score.alias("score"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"),
    )


def cost_normalized_quality() -> Column:
    return F.coalesce("score", F.lit(0.0)) / F.greatest(
        F.coalesce("cost_usd", F.lit(0.0)), F.lit(0.001)
    )


def provider_success_rate(rows: DataFrame) -> DataFrame:
    good = F.col("result").isin("accepted", "good_training_candidate", "success")
    return rows.groupBy(tx.first_text("provider", F.lit("unknown")).alias("provider")).agg(
        nx.share(good).alias("success_rate"), F.count(F.lit(1)).alias("row_count")
    )


def escalation_rescue_rate(rows: DataFrame) -> DataFrame:
    rescued = nx.share(F.col("result") == "rescued_by_stronger_model")
    return rows.agg(F.coalesce(rescued, F.lit(0.0)).alias("rescue_rate"))


def candidate_policy(rows: DataFrame) -> DataFrame:
    """One policy row: providers by success rate, best first.

    Providers are few by nature (they are services, not rows), and only their rates are
    collected into the list.
    """
    rates = provider_success_rate(rows)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("success_rate")).alias("r"), "provider")))
    return rates.agg(ordered.alias("o")).select(
        F.lit("router_policy_candidate_v1").alias("version"),
        F.lit("prefer lowest-cost provider among providers with acceptable success rate")
        .alias("rule"),
        F.transform("o", lambda x: x["provider"]).alias("preferred_providers"),
        F.transform("o", lambda x: -x["r"]).alias("provider_success_rate"),
        F.lit(0.8).alias("min_success_rate"),
    )


def router_metrics() -> list[Column]:
    """Aggregates of measured rows; an empty group gets the fixed worst values."""
    n = F.count(F.lit(1))
    cost, verified = F.sum("measured_cost_usd"), F.sum("measured_verified")

    def or_worst(column, worst):
        return F.coalesce(column, F.lit(worst))

    return [
        F.when(verified > 0, cost / verified).otherwise(F.lit(INFINITY))
        .alias("cost_per_verified_task"),
        or_worst(F.avg("measured_correctness"), 0.0).alias("correctness"),
        F.when(n > 0, verified / n).otherwise(F.lit(0.0)).alias("verification_pass_rate"),
        or_worst(F.avg("measured_safety"), 0.0).alias("safety_score"),
        or_worst(F.avg("measured_latency_ms"), INFINITY).alias("latency_ms"),
        or_worst(F.avg("measured_hallucinated"), 1.0).alias("hallucination_rate"),
        F.when(n > 0, cost / n).otherwise(F.lit(INFINITY)).alias("avg_cost_usd"),
    ]


def provider_profile(rows: DataFrame, provider: str) -> DataFrame:
    """Metrics of one provider; no row when it was never measured."""
    mine = F.lower(F.coalesce("provider", F.lit(""))) == provider.lower()
    return (
        rows.filter(mine)
        .agg(F.count(F.lit(1)).alias("sample_count"), *router_metrics())
        .filter("sample_count > 0")
        .withColumn("provider", F.lit(provider))
    )


def eligible_for_variant(provider: str) -> Column:
    """Low-risk traces that another provider may take over."""
    own = F.lower(F.coalesce("provider", F.lit(""))) == provider.lower()
    failing = F.coalesce(F.col("label").isin(*vocab.VARIANT_BLOCKING_LABELS), F.lit(False))
    text = F.concat_ws(
        " ", *[F.lower(F.coalesce(name, F.lit("")))
               for name in ("trace_type", "task_id", "prompt", "response")]
    )
    allowed = F.coalesce(F.col("trace_type").isin(*vocab.VARIANT_TRACE_TYPES), F.lit(False))
    return ~own & ~failing & ~tx.contains_any(text, vocab.HIGH_RISK_TERMS) & allowed


def benchmark_cases(rows: DataFrame, provider: str, order: str = "trace_id") -> DataFrame:
    """Measured rows as numbered benchmark cases with their eligibility."""
    numbered = with_row_index(rows, order, name="case_index")
    return numbered.withColumns(
        {
            "case_id": tx.first_text(
                "task_id",
                F.format_string("router_policy_case_%03d", F.col("case_index") + 1),
            ),
            "eligible_for_variant": eligible_for_variant(provider),
        }
    )


def replay(cases: DataFrame, profile: DataFrame, provider: str) -> DataFrame:
    """Both arms of every case: control as measured, variant with the provider's profile.

    The profile is a single aggregate row, so it joins by broadcast on the arm.
    """
    columns = {
        "measured_cost_usd": "avg_cost_usd",
        "measured_latency_ms": "latency_ms",
        "measured_correctness": "correctness",
        "measured_verified": "verification_pass_rate",
        "measured_safety": "safety_score",
        "measured_hallucinated": "hallucination_rate",
    }
    one = profile.select(
        F.lit("variant").alias("arm"),
        *[F.col(source).alias(f"__{target}") for target, source in columns.items()],
    )
    arms = cases.withColumn("arm", F.explode(F.array(F.lit("control"), F.lit("variant"))))
    moved = (
        (F.col("arm") == "variant")
        & F.col("eligible_for_variant")
        & F.col("__measured_cost_usd").isNotNull()
    )
    return (
        arms.join(F.broadcast(one), "arm", "left")
        .withColumns(
            {
                "provider": F.when(moved, F.lit(provider)).otherwise(F.col("provider")),
                **{
                    target: F.when(moved, F.col(f"__{target}")).otherwise(F.col(target))
                    for target in columns
                },
            }
        )
        .drop(*[f"__{target}" for target in columns])
    )


def chunk_metrics(replayed: DataFrame, chunks: int = 2) -> DataFrame:
    """Metrics per arm and round-robin chunk; chunks without rows do not appear."""
    keyed = replayed.withColumn("chunk", F.pmod(F.col("case_index"), F.lit(chunks)))
    return keyed.groupBy("arm", "chunk").agg(*router_metrics())


def long_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return wide.unpivot(keys, metrics, "metric", "value")


def compare_arms(long: DataFrame) -> DataFrame:
    """Mean of control and variant per metric, and their difference."""
    pivoted = long.groupBy("metric").pivot("arm", ["control", "variant"]).agg(F.avg("value"))
    return pivoted.withColumn("delta", F.col("variant") - F.col("control"))


def improved(metric: Column, control: Column, variant: Column, least: float = 0.0) -> Column:
    lower = metric.isin(*vocab.LOWER_IS_BETTER)
    return F.when(lower, variant <= control * (1.0 - least)).otherwise(
        variant >= control * (1.0 + least)
    )


def worse(metric: Column, control: Column, variant: Column) -> Column:
    lower = metric.isin(*vocab.LOWER_IS_BETTER)
    return F.when(lower, variant > control).otherwise(variant < control)


def reproducible_runs(long: DataFrame, position: str) -> DataFrame:
    """Per metric, how many control/variant pairs of the same position do not get worse."""
    paired = (
        long.groupBy("metric", position).pivot("arm", ["control", "variant"])
        .agg(F.first("value"))
    )
    better = improved(F.col("metric"), F.col("control"), F.col("variant"))
    return paired.groupBy("metric").agg(F.count_if(better).alias("reproducible_runs"))


def experiment_report(
    long: DataFrame,
    position: str,
    *,
    primary: str = "cost_per_verified_task",
    guarded: tuple[str, ...] = ("correctness", "verification_pass_rate"),
    least_gain: float = 0.0,
    required_runs: int = 2,
) -> DataFrame:
    """One report row from (arm, position, metric, value) rows.

    Everything here runs over one row per metric, already aggregated.
    """
    table = compare_arms(long).join(reproducible_runs(long, position), "metric", "left")
    metric, control, variant = F.col("metric"), F.col("control"), F.col("variant")
    is_worse = F.coalesce(worse(metric, control, variant), F.lit(False))

    def any_row(condition):
        return F.coalesce(F.bool_or(condition), F.lit(False))

    def holds(name):
        present = any_row(metric == name)
        return present & ~any_row((metric == name) & is_worse)

    return table.agg(
        F.lit(primary).alias("primary_metric"),
        any_row((metric == primary) & improved(metric, control, variant, least_gain))
        .alias("primary_metric_improved"),
        F.array_sort(F.collect_list(F.when(metric.isin(*guarded) & is_worse, metric)))
        .alias("regressions"),
        holds("safety_score").alias("safety_passed"),
        holds("verification_pass_rate").alias("verification_passed"),
        F.coalesce(
            F.max(F.when(metric == primary, F.col("reproducible_runs"))), F.lit(0)
        ).alias("reproducible_runs"),
        F.lit(required_runs).alias("reproducibility_requirement"),
        F.lit("ready_for_gate").alias("status"),
    )


def measured_router_experiment(
    rows: DataFrame, provider: str, *, least_gain: float = 0.05, required_runs: int = 2
) -> DataFrame:
    """Compare observed routing with a policy that moves low-risk traces to ``provider``.

    Without rows, or without measurements of the provider, the report says so and rejects.
    """
    profile = provider_profile(rows, provider)
    cases = benchmark_cases(rows, provider)
    arms = chunk_metrics(replay(cases, profile, provider), max(2, required_runs))
    long = long_metrics(arms, ["arm", "chunk"], list(METRICS))
    report = experiment_report(
        long, "chunk", least_gain=least_gain, required_runs=required_runs
    )
    counts = cases.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.count_if("eligible_for_variant").alias("eligible_variant_cases"),
    )
    seen = profile.agg(F.count(F.lit(1)).alias("n")).scalar()
    total = counts.select("case_count").scalar()
    missing = F.when(total == 0, F.lit("no_measured_trace_data")).when(
        seen == 0, F.lit(f"no_measured_{provider}_evidence")
    )
    status = F.when(total == 0, F.lit("rejected_no_measured_data")).when(
        seen == 0, F.lit("rejected_no_variant_evidence")
    )
    rejected = missing.isNotNull()
    return report.select(
        "primary_metric",
        (F.col("primary_metric_improved") & ~rejected).alias("primary_metric_improved"),
        F.when(rejected, F.array(missing)).otherwise(F.col("regressions")).alias("regressions"),
        (F.col("safety_passed") & ~rejected).alias("safety_passed"),
        (F.col("verification_passed") & ~rejected).alias("verification_passed"),
        F.when(rejected, F.lit(0)).otherwise(F.col("reproducible_runs")).alias("reproducible_runs"),
        "reproducibility_requirement",
        F.coalesce(status, "status").alias("status"),
        total.alias("case_count"),
        counts.select("eligible_variant_cases").scalar().alias("eligible_variant_cases"),
    )
