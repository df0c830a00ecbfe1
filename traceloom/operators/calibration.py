"""Calibration errors, escalation rates, rewards, judge agreement, failure assets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom import vocab
from traceloom.functions import hashing as hx
from traceloom.functions import jsonx as jx
from traceloom.functions import numeric as nx
from traceloom.functions import text as tx
from traceloom.session import with_row_index


def _first_present(columns: list[str], *names: str) -> Column:
    found = [F.col(name) for name in names if name in columns]
    return tx.first_text(*found) if found else F.lit(None).cast("string")


def passed(columns: list[str]) -> Column:
    """A sample passed by its verification result, else label, else verdict."""
    value = F.lower(_first_present(columns, "verification_result", "label", "verdict"))
    return F.coalesce(value.isin(*vocab.PASS_WORDS), F.lit(False))


def escalated(columns: list[str]) -> Column:
    by_flag = F.coalesce(F.col("escalated"), F.lit(False)) if "escalated" in columns else F.lit(False)
    if "answer" not in columns:
        return by_flag
    return by_flag | F.coalesce(F.lower("answer").startswith("escalate"), F.lit(False))


def prepare(samples: DataFrame) -> DataFrame:
    """Add ``conf``, ``passed``, ``esc`` and ``need`` used by the metrics below."""
    names = samples.columns
    return samples.withColumns(
        {
            "conf": F.coalesce("confidence", F.lit(0.5)),
            "passed": passed(names),
            "esc": escalated(names),
            "need": F.coalesce("should_escalate", F.lit(False)),
        }
    )


def binned_error(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins, per key (no keys = one row)."""
    per_bin = rows.withColumn("bin", nx.equal_width_bin("conf", bins)).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("conf").alias("mean_conf"),
        nx.share(F.col("passed")).alias("accuracy"),
    )
    gap = F.col("n") * F.abs(F.col("mean_conf") - F.col("accuracy"))
    return per_bin.groupBy(*keys).agg(
        F.coalesce(F.sum(gap) / F.sum("n"), F.lit(0.0)).alias("ece")
    )


def bucketed_error(samples: DataFrame, order: str, name: str = "adaptive_ece") -> DataFrame:
    """Error over up to four buckets of equal count by confidence (ties in input order)."""
    numbered = with_row_index(samples.select("conf", "passed", order), "conf", order, name="__n")
    total = numbered.agg(F.count(F.lit(1)).alias("t")).scalar()
    size = F.ceil(total / F.least(F.lit(4), total))
    buckets = numbered.groupBy(F.floor(F.col("__n") / size).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("conf").alias("mean_conf"),
        nx.share(F.col("passed")).alias("accuracy"),
    )
    gap = F.col("n") * F.abs(F.col("mean_conf") - F.col("accuracy"))
    return buckets.agg(
        F.round(F.coalesce(F.sum(gap) / F.sum("n"), F.lit(0.0)), 6).alias(name)
    )


def rates() -> list[Column]:
    """High-confidence failure rate, escalation precision and recall, faithfulness."""
    sure = F.col("conf") >= 0.8
    hit = F.col("esc") & F.col("need")

    def part(top, bottom, empty):
        return F.round(nx.ratio(F.count_if(top), F.count_if(bottom), empty), 6)

    return [
        part(sure & ~F.col("passed"), sure, 0.0).alias("high_confidence_failure_rate"),
        part(hit, F.col("esc"), 1.0).alias("escalation_precision"),
        part(hit, F.col("need"), 1.0).alias("escalation_recall"),
    ]


def calibration_report(samples: DataFrame, order: str) -> DataFrame:
    """All calibration metrics of a sample table and whether they pass."""
    rows = prepare(samples)
    faithful = (
        F.coalesce("confidence_faithfulness", F.lit(0.8))
        if "confidence_faithfulness" in samples.columns else F.lit(0.8)
    )
    overall = rows.agg(*rates(), F.round(F.coalesce(F.avg(faithful), F.lit(0.0)), 6).alias(
        "confidence_faithfulness"))
    ece = binned_error(rows, []).select(F.round("ece", 6).alias("ece"))
    adaptive = bucketed_error(rows, order)
    trap = bucketed_error(rows.filter("source = 'trap'"), order, "trap")
    verifier = bucketed_error(rows.filter("source in ('verifier', 'adjudication')"), order, "ver")
    one = F.lit(1).alias("__one")
    joined = reduce(
        lambda left, right: left.join(right.select(one, "*"), "__one"),
        [ece, adaptive, trap, verifier],
        overall.select(one, "*"),
    )
    return joined.select(
        "ece",
        "adaptive_ece",
        "high_confidence_failure_rate",
        F.abs(F.col("trap") - F.col("ver")).alias("trap_verifier_gap"),
        "escalation_precision",
        "escalation_recall",
        "confidence_faithfulness",
        (
            (F.col("adaptive_ece") <= 0.25)
            & (F.col("high_confidence_failure_rate") <= 0.2)
            & (F.col("escalation_recall") >= 0.7)
        ).alias("passed"),
    )


def blind_spots(samples: DataFrame) -> DataFrame:
    """Trap failure rate per cell, only cells with failures.

    Evidence hashes stay rows of :func:`blind_spot_evidence`, so a cell that holds a third
    of the samples never becomes one oversized list.
    """
    rows = prepare(samples.filter("source = 'trap'"))
    failed = F.count_if(~F.col("passed"))
    return (
        rows.groupBy(F.coalesce("cell_id", F.lit("unknown")).alias("cell_id"))
        .agg(
            F.round(failed / F.count(F.lit(1)), 6).alias("trap_failure_rate"),
            failed.alias("evidence_count"),
        )
        .filter("evidence_count > 0")
    )


def blind_spot_evidence(samples: DataFrame) -> DataFrame:
    rows = prepare(samples.filter("source = 'trap'"))
    return rows.filter(~F.col("passed")).select(
        F.coalesce("cell_id", F.lit("unknown")).alias("cell_id"), "source_trace_hash"
    )


def judge_disagreement(samples: DataFrame, verdict: str) -> DataFrame:
    """Pass rate of each source, and whether it contradicts the judge's verdict."""
    sources = samples.sparkSession.createDataFrame(
        [("verifier",), ("adjudication",), ("trap",)], "source string"
    )
    stats = (
        prepare(samples)
        .filter(F.col("source").isin("verifier", "adjudication", "trap"))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), nx.share(F.col("passed")).alias("rate"))
    )
    judge = verdict.lower() == "pass"
    return sources.join(stats, "source", "left").select(
        "source",
        F.coalesce("n", F.lit(0)).alias("sample_count"),
        F.round("rate", 6).alias("pass_rate"),
        F.coalesce((F.col("rate") >= 0.5) != F.lit(judge), F.lit(False)).alias("disagrees"),
    )


def judge_panel(servers: DataFrame, decisions: DataFrame, order: str) -> dict[str, DataFrame]:
    """Server counts and the newest twenty decisions."""
    return {
        "servers": servers.agg(
            F.count_if(F.col("status") == "ready").alias("ready_servers"),
            F.count(F.lit(1)).alias("server_count"),
        ),
        "recent": decisions.orderBy(F.col(order).desc()).limit(20),
    }


def reward_columns(columns: list[str], weights: dict[str, float] | None = None) -> dict[str, Column]:
    """Reward and its five components for prepared samples with a judge score."""
    w = {**vocab.REWARD_WEIGHTS, **(weights or {})}
    good = nx.flag(F.col("passed"))
    faithful = (
        F.coalesce("judge_faithfulness", F.lit(0.5))
        if "judge_faithfulness" in columns else F.lit(0.5)
    )
    parts = {
        "correctness": good,
        "calibration": F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("conf") - good)),
        "confidence_faithfulness": faithful,
        "overconfidence_penalty": F.when(
            F.col("passed"), F.lit(0.0)
        ).otherwise(F.greatest(F.lit(0.0), F.col("conf") - 0.7)),
        "escalation_recall": nx.flag(~F.col("need") | F.col("esc")),
    }
    signed = [
        parts[name] * (-w[name] if name == "overconfidence_penalty" else w[name]) for name in parts
    ]
    total = reduce(lambda a, b: a + b, signed)
    return {"reward": F.round(nx.clamp(total, -1.0, 1.0), 6), **parts}


def intrinsic_confidence(samples: DataFrame) -> DataFrame:
    """Spread of confidence over the samples of one task."""
    rows = prepare(samples)
    accepted = F.lower(_first_present(samples.columns, "verification_result", "label")).isin(
        "accepted", "pass", "passed", "correct"
    )
    spread = F.var_pop("conf")
    return rows.groupBy(
        F.coalesce(F.col("task_id").cast("string"), F.col("cell_id").cast("string"),
                   F.lit("unknown")).alias("task_id")
    ).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.round(F.avg("conf"), 6).alias("mean_confidence"),
        F.round(spread, 6).alias("confidence_variance"),
        F.round(nx.share(accepted), 6).alias("acceptance_rate"),
        F.round(F.greatest(F.lit(0.0), 1.0 - spread), 6).alias("intrinsic_confidence_score"),
    )


def selection_certificate(pool: DataFrame, least: float = 0.5) -> DataFrame:
    """Pool size and selected count; the hash lists are :func:`selection_members`."""
    chosen = F.coalesce("intrinsic_confidence_score", F.lit(0.0)) >= least
    return pool.agg(
        F.count(F.lit(1)).alias("pool_size"),
        F.count_if(chosen).alias("selected_count"),
        F.lit(least).alias("min_intrinsic_confidence_score"),
    )


def selection_members(pool: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    chosen = F.coalesce("intrinsic_confidence_score", F.lit(0.0)) >= least
    return pool.select(key, F.when(chosen, "selected").otherwise("rejected").alias("membership"))


def failure_assets(samples: DataFrame) -> DataFrame:
    """Zero to four asset rows per sample."""
    names = set(samples.columns)

    def truthy(name):
        return F.coalesce(F.col(name), F.lit(False)) if name in names else F.lit(False)

    kind = F.coalesce("failure_type", F.lit(""))
    failed = F.lower(F.coalesce("verification_result", F.lit(""))).isin(
        "failed", "fail", "rejected", "incorrect"
    )
    sure = F.coalesce("confidence", F.lit(0.0)) >= 0.8
    missed = truthy("should_escalate") & ~escalated(samples.columns)
    found = {
        "overconfident_failure": (kind == "overconfident_failure") | (failed & sure),
        "unfaithful_hedge": (kind == "unfaithful_hedge") | truthy("unfaithful_hedge"),
        "hidden_trap_failure": (kind == "hidden_trap_failure") | truthy("hidden_trap_failure"),
        "missed_escalation": (kind == "missed_escalation") | missed,
    }
    types = F.array_sort(
        F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in found.items()]))
    )
    rows = samples.select(
        F.explode(types).alias("asset_type"),
        "task_id",
        "source_trace_hash",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "verification_result",
        "failure_type",
    )
    return rows.withColumn("evidence_hash", hx.row_hash(*rows.columns))


def failure_benchmark(samples: DataFrame) -> DataFrame:
    rows = prepare(samples)
    return rows.select(
        F.col("task_id").cast("string").alias("task_id"),
        F.col("failure_type").alias("expected_failure_type"),
        F.col("need").alias("expected_escalation"),
        F.when(F.col("passed"), "pass").otherwise("fail").alias("label"),
        F.col("conf").alias("confidence"),
    )


def parse_judge(outputs: DataFrame, value: str = "value") -> DataFrame:
    """Judge JSON to a typed row; ``problem`` names what makes it invalid."""
    v = F.col("__v")
    scores = (
        "confidence_faithfulness", "acceptance_criteria_score", "escalation_correctness",
        "failure_classification",
    )
    rows = outputs.withColumn("__v", jx.parse(value)).withColumns(
        {
            "verdict": F.lower(F.coalesce(jx.get(v, "$.verdict"), F.lit(""))),
            **{n: F.coalesce(jx.get(v, f"$.{n}", "double"), F.lit(0.0)) for n in scores},
            "rationale": F.coalesce(jx.get(v, "$.rationale"), F.lit("")),
        }
    )
    outside = reduce(lambda a, b: a | b, [~F.col(n).between(0.0, 1.0) for n in scores])
    problem = (
        F.when(v.isNull(), "invalid JSON")
        .when(~F.col("verdict").isin("pass", "fail", "review"),
              "verdict must be one of pass, fail, or review")
        .when(outside, "judge scores must be between 0 and 1")
    )
    return rows.withColumn("problem", problem).drop("__v")


def acceptance_criteria(
    listed: Column, texts: list[Column]
) -> Column:
    """Criteria given as a list, else the lines after 'acceptance criteria:', else a default."""
    joined = F.concat_ws("\n", *[F.coalesce(text, F.lit("")) for text in texts])
    tail = F.regexp_extract(joined, rf"(?is)acceptance criteria{tx.SPACE}*:{tx.SPACE}*(.+)", 1)
    lines = F.transform(
        F.split(tail, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"),
        lambda line: tx.strip(F.regexp_replace(line, rf"^(?:[-*.]|\p{{Nd}}|{tx.SPACE})+", "")),
    )
    given = F.filter(F.transform(listed, tx.strip), lambda item: item != "")
    found = F.filter(lines, lambda item: item != "")
    return F.coalesce(
        tx.array_or_null(given),
        tx.array_or_null(found),
        F.array(F.lit("Satisfy the task request and pass verification.")),
    )


def public_violations(rows: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Rows that must not leave: status not allowed, or private data inside."""
    status = F.coalesce("privacy_status", F.lit(""))
    private = (
        F.coalesce("contains_private_user_data", F.lit(False))
        if "contains_private_user_data" in rows.columns else F.lit(False)
    )
    reason = F.when(~status.isin(*allowed), "status is not exportable").when(
        private, "contains private user data"
    )
    return rows.withColumn("violation", reason).filter(F.col("violation").isNotNull())


def training_gate(rows: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """One row: may this dataset be used for training, and if not, why."""
    consent = F.coalesce("consent", F.lit("unknown"))
    private = (
        F.coalesce("contains_private_user_data", F.lit(False))
        if "contains_private_user_data" in rows.columns else F.lit(False)
    )

    def any_row(condition):
        return F.coalesce(F.bool_or(condition), F.lit(False))

    facts = rows.agg(
        any_row(~F.coalesce("privacy_status", F.lit("")).isin(*allowed)).alias("forbidden_status"),
        any_row(private).alias("contains_private_user_data"),
        any_row(~consent.isin("granted", "fixture", "not_required")).alias("consent_required"),
        *hx.content_fingerprint(*rows.columns),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("forbidden_status"), "non-exportable privacy statuses"),
            F.when(F.col("contains_private_user_data"), "contains private user data"),
            F.when(F.col("consent_required"), "requires consent"),
        )
    )
    return facts.withColumn("reasons", reasons).withColumn("ok", F.size("reasons") == 0)


def split_manifest(rows: DataFrame, split: str = "split") -> DataFrame:
    """Counts, distinct statuses and consents, private flag and fingerprint of each split."""
    private = (
        F.coalesce("contains_private_user_data", F.lit(False))
        if "contains_private_user_data" in rows.columns else F.lit(False)
    )
    statuses = F.collect_set(F.coalesce("redaction_status", F.lit("not_required")))
    return rows.groupBy(split).agg(
        F.array_sort(statuses).alias("redaction_statuses"),
        F.array_sort(F.collect_set(F.coalesce("consent", F.lit("not_required")))).alias("consent"),
        F.count_distinct("source_trace_hash").alias("source_count"),
        F.bool_or(private).alias("contains_private_user_data"),
        *hx.content_fingerprint("source_trace_hash"),
    )
