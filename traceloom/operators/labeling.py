"""Label, score, compress and measure single traces, and attach labels and scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom import vocab
from traceloom.functions import numeric as nx
from traceloom.functions import text as tx
from traceloom.operators.normalize import literal_map

Labeler = Callable[[], Column]


def _any_status(statuses: tuple[str, ...]) -> Column:
    found = F.exists("tests_run", lambda test: test["status"].isin(*statuses))
    return F.coalesce(found, F.lit(False))


def tests_failed() -> Column:
    return _any_status(vocab.FAILED_STATUSES)


def tests_passed() -> Column:
    return _any_status(vocab.PASSED_STATUSES)


def _verdict(label: str, confidence: float, notes: str) -> Column:
    return F.struct(
        F.lit(label).alias("label"), F.lit(confidence).alias("confidence"),
        F.lit(notes).alias("notes"),
    )


def rule_label() -> Column:
    """(label, confidence, notes) by ordered rules over the text and the tests."""
    blank = F.lit("")
    text = F.lower(
        F.concat_ws(
            " ",
            *[F.coalesce(F.col(name), blank)
              for name in ("trace_type", "prompt", "response", "normalized_text")],
        )
    )
    # Phrases, labels, confidences and notes of the rules, in order.
    rules = (
        (tx.contains_any(text, ("unsafe", "policy blocked")),
         ("unsafe_or_policy_blocked", 0.9, "matched safety or policy language")),
        (tests_failed(), ("failed_tests", 0.95, "one or more tests failed")),
        (tx.contains_any(text, ("hallucinat", "fabricated")),
         ("hallucinated", 0.85, "matched hallucination/fabrication language")),
        (tx.contains_any(text, ("verification failed", "failed verification")),
         ("failed_verification", 0.9, "matched verification failure language")),
        (tx.contains_any(text, ("too expensive", "over budget")),
         ("too_expensive", 0.8, "matched cost failure language")),
        (tx.contains_any(text, ("too slow", "timeout")),
         ("too_slow", 0.8, "matched latency failure language")),
        (F.col("trace_type").isin("failure_trace", "correction_trace"),
         ("useful_negative_example", 0.75,
          "failure/correction traces are useful negatives by default")),
        (tests_passed(), ("accepted", 0.9, "tests passed")),
        (tx.contains_any(text, ("accepted", "verified")),
         ("accepted", 0.8, "matched accepted/verified language")),
    )
    chain = reduce(
        lambda acc, rule: acc.when(rule[0], _verdict(*rule[1])),
        rules[1:],
        F.when(rules[0][0], _verdict(*rules[0][1])),
    )
    return chain.otherwise(_verdict("inconclusive", 0.5, "no strong rule matched"))


def keyword_label(columns: list[str]) -> Column:
    """Fallback labeller for inconclusive traces: keywords over the trace as JSON."""
    text = F.lower(F.to_json(F.struct(*columns)))
    return (
        F.when(
            tx.contains_any(text, ("rescued", "stronger model")),
            _verdict("rescued_by_stronger_model", 0.82,
                     "local keyword model matched rescue language"),
        )
        .when(
            text.contains("training candidate"),
            _verdict("good_training_candidate", 0.78,
                     "local keyword model matched training value"),
        )
        .otherwise(_verdict("inconclusive", 0.51, "local keyword model had no stronger match"))
    )


def label_run(
    traces: DataFrame,
    overrides: DataFrame | None = None,
    fallback: Labeler | None = None,
    source: str = "rule_based",
) -> DataFrame:
    """Label rows: human override by trace id, then by task id, then rules, then fallback.

    ``overrides`` has ``override_key`` and ``override_label``. ``fallback`` returns a struct
    column and is used only where the rules are inconclusive; it may wrap a model behind an
    Arrow ``pandas_udf``.
    """
    rows = traces.withColumn("__rule", rule_label())
    if overrides is not None:
        keyed = overrides.dropDuplicates(["override_key"])
        by_trace = keyed.select(
            F.col("override_key").alias("__trace_key"),
            F.col("override_label").alias("__by_trace"),
        )
        by_task = keyed.select(
            F.col("override_key").alias("__task_key"), F.col("override_label").alias("__by_task")
        )
        rows = (
            rows.join(by_trace, F.col("trace_id").cast("string") == F.col("__trace_key"), "left")
            .join(by_task, F.col("task_id") == F.col("__task_key"), "left")
            .withColumn("__override", tx.first_text("__by_trace", "__by_task"))
        )
    else:
        rows = rows.withColumn("__override", F.lit(None).cast("string"))
    human = F.col("__override").isNotNull()
    use_fallback = F.lit(False)
    verdict = F.col("__rule")
    if fallback is not None:
        use_fallback = F.col("__rule.label") == "inconclusive"
        verdict = F.when(use_fallback, fallback()).otherwise(verdict)
    rows = rows.withColumn("__verdict", verdict)
    return rows.select(
        "trace_id",
        F.coalesce("__override", "__verdict.label").alias("label"),
        F.when(human, F.lit(1.0)).otherwise(F.col("__verdict.confidence")).alias("confidence"),
        F.when(human, "human_review").when(use_fallback, "local_model").otherwise(F.lit(source))
        .alias("source"),
        F.when(human, "human review override").otherwise(F.col("__verdict.notes")).alias("notes"),
    )


def latest_label(labels: DataFrame) -> DataFrame:
    """One label per trace: the newest, ties by label id."""
    newest = F.max_by(
        F.struct("label", "confidence", "source"), F.struct("created_at", "label_id")
    )
    return labels.groupBy("trace_id").agg(newest.alias("__l")).select("trace_id", "__l.*")


def attach_labels_scores(
    traces: DataFrame, labels: DataFrame, scores: DataFrame, fanout: bool = False
) -> DataFrame:
    """Left join labels and scores; ``fanout`` keeps one row per label as stored."""
    picked = labels.select("trace_id", "label") if fanout else (
        latest_label(labels).select("trace_id", "label")
    )
    return traces.join(picked, "trace_id", "left").join(scores, "trace_id", "left")


def score_columns(label: str = "label") -> dict[str, Column]:
    """The eight scores of a trace; every one is in [0, 1]."""
    tag = F.coalesce(F.col(label), F.lit(""))
    good = tag.isin("accepted", "good_training_candidate") | tests_passed()
    bad = (
        tag.isin("failed_tests", "failed_verification", "hallucinated", "unsafe_or_policy_blocked")
        | tests_failed()
    )
    correctness = F.when(bad, 0.0).when(good, 1.0).otherwise(0.5)
    cost = F.coalesce("cost_usd", F.lit(0.0))
    latency = F.coalesce("latency_ms", F.lit(0.0))
    safety = F.when(tag == "unsafe_or_policy_blocked", 0.0).otherwise(1.0)
    cost_score = nx.clamp(1.0 - F.least(cost, F.lit(1.0)))
    latency_score = F.when(latency == 0, F.lit(0.8)).otherwise(
        nx.clamp(1.0 - F.least(latency / 60000.0, F.lit(1.0)))
    )
    novelty = F.when(tag == "duplicated", 0.35).otherwise(0.75)
    rescued = (tag == "rescued_by_stronger_model") | F.coalesce(
        F.lower("normalized_text").contains("rescued"), F.lit(False)
    )
    rescue = nx.flag(rescued)
    quality = nx.clamp(
        correctness * 0.6 + safety * 0.2 + latency_score * 0.1 + cost_score * 0.1
    )
    negative = F.when(tag == "useful_negative_example", 0.2).otherwise(0.0)
    training = nx.clamp(quality * 0.65 + negative + novelty * 0.1 + rescue * 0.05)
    return {
        "quality_score": quality,
        "correctness_score": correctness,
        "cost_score": cost_score,
        "latency_score": latency_score,
        "novelty_score": novelty,
        "escalation_rescue_score": rescue,
        "safety_score": safety,
        "training_value_score": training,
    }


def score_run(traces: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every trace under its newest label."""
    rows = traces.join(latest_label(labels).select("trace_id", "label"), "trace_id", "left")
    return rows.select(
        "trace_id", *[column.alias(name) for name, column in score_columns().items()]
    )


def extractive_summary(label: str = "label") -> Column:
    """First 160 characters of the prompt and 200 of the response, whitespace squeezed."""
    blank = F.lit("")
    parts = [
        tx.text_or_null(F.substring(tx.squeeze(F.coalesce(name, blank)), 1, size))
        for name, size in (("prompt", 160), ("response", 200))
    ]
    return tx.first_text(F.concat_ws(" ", *parts), F.col(label), F.lit("trace"))


def key_fact_retention(summary: Column) -> Column:
    """Share of task id, type, provider and model that the summary still names."""
    facts = F.filter(
        F.array(*[F.lower(F.coalesce(name, F.lit("")))
                  for name in ("task_id", "trace_type", "provider", "model")]),
        lambda fact: fact != "",
    )
    kept = F.size(F.filter(facts, lambda fact: F.contains(F.lower(summary), fact)))
    return F.when(F.size(facts) == 0, F.lit(1.0)).otherwise(kept / F.size(facts))


def compress_traces(
    labelled: DataFrame, label: str = "label", summarizer: Labeler | None = None
) -> DataFrame:
    """Short summary, implied failure type, retention and token reduction of each trace.

    ``summarizer`` returns a string column and replaces the first-sentence summary.
    """
    blank = F.lit("")
    prompt = tx.first_sentence("prompt", 180)
    response = tx.first_sentence("response", 220)
    joined = F.concat_ws(
        " ",
        F.when(prompt != "", F.concat(F.lit("Prompt: "), prompt)),
        F.when(response != "", F.concat(F.lit("Response: "), response)),
    )
    base = tx.first_text(
        summarizer() if summarizer is not None else joined,
        tx.first_sentence("normalized_text", 260),
        F.lit("Trace contained structured tool/test data."),
    )
    rows = labelled.withColumn("__base", base)
    names_task = F.contains(F.lower("__base"), F.lower("task_id"))
    needs_task = tx.text_or_null("task_id").isNotNull() & ~F.coalesce(names_task, F.lit(True))
    rows = rows.withColumn(
        "summary",
        F.when(needs_task, F.concat(F.lit("Task "), "task_id", F.lit(": "), "__base"))
        .otherwise(F.col("__base")),
    )
    before = F.greatest(tx.word_count(F.coalesce("normalized_text", blank)), F.lit(1))
    after = F.greatest(tx.word_count("summary"), F.lit(1))
    failure = F.try_element_at(literal_map(vocab.FAILURE_BY_LABEL), F.col(label))
    return rows.select(
        "trace_id",
        "summary",
        failure.alias("failure_type"),
        F.when(
            failure.isNotNull(),
            "Useful as a negative/evaluator example with preserved failure signal.",
        ).otherwise("Useful as a compact accepted/inconclusive trace summary.").alias("why_useful"),
        key_fact_retention(F.col("summary")).alias("key_fact_retention"),
        F.greatest(F.lit(0.0), 1.0 - after / before).alias("token_reduction_ratio"),
    )


def measured(rows: DataFrame) -> DataFrame:
    """Measured cost, latency, correctness, safety and flags of labelled, scored traces."""
    good = F.col("label").isin("accepted", "good_training_candidate")
    correctness = F.coalesce(F.col("correctness_score"), nx.flag(good))
    blocked = F.coalesce(
        F.col("label").isin("hallucinated", "unsafe_or_policy_blocked"), F.lit(False)
    )
    return rows.withColumns(
        {
            "measured_cost_usd": F.coalesce("cost_usd", F.lit(0.0)),
            "measured_latency_ms": F.coalesce("latency_ms", F.lit(0.0)),
            "measured_correctness": correctness,
            "measured_safety": F.coalesce("safety_score", F.lit(1.0)),
            "measured_verified": nx.flag((correctness >= 1.0) & ~blocked),
            "measured_hallucinated": nx.flag(F.col("label") == "hallucinated"),
        }
    )


def score_weights(task: Column | str) -> Column:
    """Weight struct for a task type by keyword; the last profile is the default."""
    names = ("quality", "robustness", "verifier_agreement", "cost", "latency", "failure_rate")
    text = F.lower(F.coalesce(tx.as_col(task), F.lit("")))

    def profile(weights):
        return F.struct(*[F.lit(w).alias(n) for n, w in zip(names, weights)])

    *keyed, (_, default) = vocab.SCORE_PROFILES
    chain = F.when(F.lit(False), profile(default))
    for words, weights in keyed:
        chain = chain.when(tx.contains_any(text, words), profile(weights))
    return chain.otherwise(profile(default))


def composite_score(weights: Column) -> Column:
    """Weighted gains minus capped cost, latency and failure rate."""
    def value(name):
        return F.coalesce(F.col(name), F.lit(0.0))

    gains = sum(
        (weights[name] * nx.clamp(value(name))
         for name in ("quality", "robustness", "verifier_agreement")),
        F.lit(0.0),
    )
    cost = nx.clamp(F.greatest(value("cost"), F.lit(0.0)) / vocab.COST_CAP)
    latency = nx.clamp(F.greatest(value("latency"), F.lit(0.0)) / vocab.LATENCY_CAP_MS)
    return (
        gains
        - weights["cost"] * cost
        - weights["latency"] * latency
        - weights["failure_rate"] * nx.clamp(value("failure_rate"))
    )


def upsert_by_trace(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows with the fresh ones in place of those with the same trace id."""
    return stored.join(fresh.select("trace_id"), "trace_id", "left_anti").unionByName(fresh)


def latest_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of every key as one aggregate, so a hot key is combined before the shuffle."""
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return newest.select("r.*")

