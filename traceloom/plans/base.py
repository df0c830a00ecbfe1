"""Query registration and the views that read the given tables as trace data.

A view is a set of expressions valid in both engines, so that the plan and its SQL start
from the same rows; the operators themselves are written separately for each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom import vocab
from traceloom.session import ensure_checkpoint_dir, spread, with_position

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

# Whitespace and token classes in SQL text, equal to those of the text functions.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def query(name: str, sql: str | None = None):
    def wrap(plan):
        QUERIES[name] = (plan, sql)
        return plan

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def with_sql(body: str, *views: str) -> str:
    """SQL with the named views in front of it."""
    return "WITH " + ",\n".join(SQL_VIEWS[name] for name in views) + "\n" + body


def _columns(expressions: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in expressions.items())


def _select(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(text).alias(name) for name, text in expressions.items()])


def _choice(index: str, values) -> str:
    cases = " ".join(f"WHEN {i} THEN '{value}'" for i, value in enumerate(values))
    return f"CASE {index} {cases} END"


# ---------------------------------------------------------------- traces

_T = {
    "trace_id": "conv_id * 16 + turn",
    "run_id": "conv_id % 7",
    "task_id": "'conv-' || conv_id",
    "agent_id": "'agent-' || (conv_id % 5)",
    "provider": _choice("conv_id % 4", ("alpha", "beta", "gamma", "delta")),
    "model": "'model-' || (conv_id % 6)",
    "trace_type": _choice("(conv_id + turn) % 12", vocab.TRACE_TYPES),
    "objective": "CASE WHEN conv_id % 3 = 0 THEN 'handle conversation ' || (conv_id % 10) END",
    "prompt": "prompt",
    "response": "response",
    "test_status": "CASE (conv_id * 3 + turn) % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'passed' END",
    "cost_usd": "CAST(length(prompt) + length(response) AS DOUBLE) / CAST(10000 AS DOUBLE)",
    "latency_ms": "CASE WHEN conv_id % 5 = 0 THEN CAST(0 AS DOUBLE) "
                  "ELSE CAST(length(response) * 20 AS DOUBLE) END",
    "failure_type": "CASE (conv_id + turn) % 9 WHEN 0 THEN 'bad_router_assignment' "
                    "WHEN 1 THEN 'format_failure' WHEN 2 THEN 'duplicated_work' END",
    "privacy_status": _choice("conv_id % 3", vocab.PRIVACY_STATUS.values()),
    "notes": "CASE WHEN conv_id % 11 = 0 THEN 'Confused by the format' ELSE '' END",
}


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows, as traces."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    told = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    rows = _select(asked.join(told, ["conv_id", "turn"]), _T)
    from traceloom.functions import hashing as hx
    from traceloom.functions import text as tx

    tests = F.when(
        F.col("test_status").isNotNull(),
        F.array(
            F.struct(F.lit("t").alias("name"), F.lit("run").alias("command"),
                     F.col("test_status").alias("status"))
        ),
    ).otherwise(F.array().cast("array<struct<name:string,command:string,status:string>>"))
    text = F.lower(tx.squeeze(F.concat_ws(" ", "trace_type", "prompt", "response")))
    return (
        rows.withColumns({"tests_run": tests, "normalized_text": text, "ordinal": F.col("trace_id")})
        .withColumn("content_hash", hx.sha("normalized_text"))
        .drop("test_status")
    )


_LABEL_SQL = """CASE
  WHEN contains(txt, 'unsafe') OR contains(txt, 'policy blocked') THEN 'unsafe_or_policy_blocked'
  WHEN test_status = 'failed' THEN 'failed_tests'
  WHEN contains(txt, 'hallucinat') OR contains(txt, 'fabricated') THEN 'hallucinated'
  WHEN contains(txt, 'verification failed') OR contains(txt, 'failed verification')
    THEN 'failed_verification'
  WHEN contains(txt, 'too expensive') OR contains(txt, 'over budget') THEN 'too_expensive'
  WHEN contains(txt, 'too slow') OR contains(txt, 'timeout') THEN 'too_slow'
  WHEN trace_type IN ('failure_trace', 'correction_trace') THEN 'useful_negative_example'
  WHEN test_status = 'passed' THEN 'accepted'
  WHEN contains(txt, 'accepted') OR contains(txt, 'verified') THEN 'accepted'
  ELSE 'inconclusive' END"""

SQL_VIEWS: dict[str, str] = {
    "t": f"""pairs AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
t0 AS (SELECT {_columns(_T)} FROM pairs),
t1 AS (SELECT *, lower(trim(regexp_replace(concat_ws(' ', trace_type, prompt, response),
    '{WS}', ' ', 'g'))) AS normalized_text FROM t0),
t AS (SELECT *, sha256(normalized_text) AS content_hash,
    lower(concat_ws(' ', trace_type, prompt, response, normalized_text)) AS txt FROM t1)""",
    "tl": f"tl AS (SELECT *, {_LABEL_SQL} AS label FROM t)",
    "ts": """ts0 AS (SELECT *,
  CASE WHEN label IN ('failed_tests', 'failed_verification', 'hallucinated',
      'unsafe_or_policy_blocked') OR coalesce(test_status, '') = 'failed' THEN 0.0::DOUBLE
    WHEN label IN ('accepted', 'good_training_candidate')
      OR coalesce(test_status, '') = 'passed' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END
    AS correctness_score,
  CASE WHEN label = 'unsafe_or_policy_blocked' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END
    AS safety_score,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - least(cost_usd, 1.0::DOUBLE))) AS cost_score,
  CASE WHEN latency_ms = 0 THEN 0.8::DOUBLE ELSE greatest(0.0::DOUBLE,
    least(1.0::DOUBLE, 1 - least(latency_ms / 60000.0::DOUBLE, 1.0::DOUBLE))) END
    AS latency_score,
  CASE WHEN label = 'duplicated' THEN 0.35::DOUBLE ELSE 0.75::DOUBLE END AS novelty_score,
  CASE WHEN label = 'rescued_by_stronger_model' OR contains(normalized_text, 'rescued')
    THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS escalation_rescue_score
  FROM tl),
ts1 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, correctness_score * 0.6::DOUBLE
  + safety_score * 0.2::DOUBLE + latency_score * 0.1::DOUBLE + cost_score * 0.1::DOUBLE))
  AS quality_score FROM ts0),
ts AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, quality_score * 0.65::DOUBLE
  + CASE WHEN label = 'useful_negative_example' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
  + novelty_score * 0.1::DOUBLE + escalation_rescue_score * 0.05::DOUBLE))
  AS training_value_score FROM ts1)""",
    "tm": """tm AS (SELECT *, cost_usd AS measured_cost_usd, latency_ms AS measured_latency_ms,
  correctness_score AS measured_correctness, safety_score AS measured_safety,
  CASE WHEN correctness_score >= 1 AND label NOT IN ('hallucinated', 'unsafe_or_policy_blocked')
    THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS measured_verified,
  CASE WHEN label = 'hallucinated' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS measured_hallucinated
  FROM ts)""",
}


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces with their rule label."""
    from traceloom.operators.labeling import rule_label

    return traces(spark, sf_dir).withColumn("label", rule_label()["label"])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceloom.operators.labeling import score_columns

    return labelled(spark, sf_dir).withColumns(score_columns())


def measured_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceloom.operators.labeling import measured

    return measured(scored(spark, sf_dir))


# ---------------------------------------------------------------- documents as traces

_D = {
    "trace_id": "doc_id", "ordinal": "doc_id", "task_id": "CAST(NULL AS STRING)",
    "prompt": "text", "response": "''", "provider": "source", "model": "lang",
    "trace_type": "'worker_trace'",
}


def document_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "documents"), _D)


# ---------------------------------------------------------------- events: samples, logs

_S = {
    "event_id": "event_id",
    "task_id": "'task-' || user_id",
    "cell_id": "'cell-' || (event_id % 20)",
    "source": _choice("event_id % 3", ("verifier", "adjudication", "trap")),
    "confidence": "CAST((event_id * 7919) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE)",
    "verification_result": "CASE event_type WHEN 'click' THEN 'passed' WHEN 'view' THEN 'Passed' "
                           "WHEN 'purchase' THEN 'accepted' WHEN 'signup' THEN 'failed' "
                           "ELSE 'rejected' END",
    "should_escalate": "event_id % 4 = 0",
    "escalated": "event_id % 8 = 0",
    "answer": "CASE WHEN event_id % 5 = 0 THEN 'Escalate: unclear' ELSE 'done' END",
    "failure_type": "CASE event_id % 10 WHEN 0 THEN 'overconfident_failure' "
                    "WHEN 1 THEN 'unfaithful_hedge' WHEN 2 THEN 'hidden_trap_failure' "
                    "WHEN 3 THEN 'missed_escalation' END",
    "confidence_faithfulness": "CASE WHEN event_id % 7 <> 0 "
                               "THEN CAST(event_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END",
    "source_trace_hash": "'h-' || event_id",
}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as confidence samples with a verification result."""
    return _select(table(spark, sf_dir, "events"), _S)


SQL_VIEWS["s"] = f"""s0 AS (SELECT {_columns(_S)} FROM events),
s AS (SELECT *, lower(verification_result) IN ('accepted', 'pass', 'passed', 'correct', 'success')
  AS passed, escalated OR starts_with(lower(answer), 'escalate') AS esc FROM s0)"""

_H = {
    "job_id": "'job-' || user_id",
    "ts": "ts",
    "event_id": "event_id",
    "kl_divergence": "value / CAST(100 AS DOUBLE)",
    "zero_variance_group": "CASE WHEN event_type = 'error' THEN CAST(1 AS DOUBLE) "
                           "ELSE CAST(0 AS DOUBLE) END",
    "completion_diversity": "CAST(10 AS DOUBLE) / (CAST(10 AS DOUBLE) + value)",
    "hard_limit_fraction": "least(value / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE))",
    "mean_task_reward": "value / CAST(200 AS DOUBLE)",
    "generated_tokens": "event_id % 50 + 10",
    "gradient_norm": "value",
    "task_family": "event_type",
    "heldout_accuracy": "CASE WHEN event_id % 5 = 0 "
                        "THEN CAST(event_id % 97 AS DOUBLE) / CAST(97 AS DOUBLE) END",
}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for a query that writes what it reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def health_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training updates of one job per user."""
    rows = _select(table(spark, sf_dir, "events"), _H)
    return with_position(rows, ["job_id"], "ts", "event_id", name="update")


SQL_VIEWS["h"] = f"""h0 AS (SELECT {_columns(_H)} FROM events),
h AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) - 1 AS update
  FROM h0)"""

_E = {
    "session_id": "'session-' || user_id",
    "workflow_id": "'wf-' || (user_id % 6)",
    "event_id": "event_id",
    "ts": "ts",
    "kind": "CASE WHEN event_type = 'purchase' THEN 'observation' ELSE 'action' END",
    "accepted": "event_type IN ('click', 'view')",
    "event_type": "CASE event_type WHEN 'click' THEN 'PROPOSAL' WHEN 'view' THEN 'TOOL_CALL' "
                  "WHEN 'purchase' THEN 'OBSERVATION' WHEN 'error' THEN 'VIOLATION' "
                  "ELSE 'SIGNUP' END",
    "violation": "CASE event_type WHEN 'error' THEN 'step_order_violation' "
                 "WHEN 'signup' THEN 'tool_not_allowed' END",
    "state_after": "CASE WHEN event_id % 50 = 0 THEN 'COMPLETED' "
                   "WHEN event_id % 70 = 0 THEN 'ESCALATED' ELSE 'READY' END",
    "teacher_correction": "CASE WHEN event_id % 9 = 0 THEN 'redo step ' || (event_id % 7) END",
    "verifier": "CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 "
                "THEN 'checked ' || event_id END",
    "expected_action": "'step ' || (event_id % 7)",
    "latency_ms": "value - CAST(1 AS DOUBLE)",
    "cost_usd": "value / CAST(1000 AS DOUBLE)",
}


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as workflow execution logs, one session per user."""
    rows = _select(table(spark, sf_dir, "events"), _E)
    placed = with_position(rows, ["session_id"], "ts", "event_id", name="event_index")
    violations = F.array_compact(F.array("violation"))
    return placed.withColumns({"violations": violations, "sequence": F.col("event_index")})


def raw_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log without positions, for operators that need none."""
    rows = _select(table(spark, sf_dir, "events"), _E)
    return rows.withColumn("violations", F.array_compact(F.array("violation")))


SQL_VIEWS["e"] = f"""e0 AS (SELECT {_columns(_E)} FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1
  AS event_index FROM e0)"""

# ---------------------------------------------------------------- orders: outcomes

_ZERO = "'" + "0" * 64 + "'"
_O = {
    "outcome_id": "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey",
    "experiment_id": "'exp-1'",
    "counterfactual_group_id": "'cf-' || l_orderkey",
    "task_id": "'order-' || l_orderkey",
    "task_group": "'g-' || l_orderkey",
    "subtask_id": "'main'",
    **{name: _ZERO for name in (
        "subtask_hash", "plan_hash", "decision_hash", "usage_receipt_hash", "catalog_hash",
        "pricing_hash", "policy_hash", "candidate_set_hash", "source_evidence_hash",
        "model_revision")},
    "teacher_option_id": "'opt-0'",
    "classifier_option_id": "'opt-' || (l_suppkey % 7)",
    "executed_option_id": "'opt-' || l_suppkey",
    "model_id": "'m-' || (l_suppkey % 7)",
    "model_family": "'family-' || (l_suppkey % 3)",
    "cost_unit": "'usd'",
    "arm": _choice("l_linenumber % 3", vocab.ARMS),
    "assignment_mechanism": "CASE WHEN l_orderkey % 11 = 0 THEN 'observational' "
                            "ELSE 'randomized' END",
    "risk": _choice("l_linenumber % 4", vocab.RISKS),
    "reasoning_effort": _choice("l_partkey % 3", ("low", "medium", "high")),
    "capability": "CASE WHEN l_partkey % 2 = 0 THEN 'code' END",
    "estimated_input_tokens": "CAST(l_quantity * 800 AS BIGINT)",
    "classifier_confidence": "CASE WHEN l_partkey % 17 <> 0 "
                             "THEN CAST(90 + l_partkey % 11 AS DOUBLE) / CAST(100 AS DOUBLE) END",
    "verifier_score": "CAST(1 AS DOUBLE) - l_discount",
    "quality_floor": "CASE WHEN l_suppkey % 3 = 0 THEN CAST(0.93 AS DOUBLE) "
                     "ELSE CAST(0.5 AS DOUBLE) END",
    "verified": "l_tax < CAST(0.08 AS DOUBLE)",
    "independent_verifier": "l_linenumber <> 7",
    "success": "l_partkey % 101 <> 0",
    "severity": "CASE WHEN l_partkey % 997 = 0 THEN 'Critical' WHEN l_partkey % 7 = 0 THEN 'low' END",
    "cost_amount": "l_extendedprice",
    "latency_ms": "l_quantity * CAST(10 AS DOUBLE)",
    "retries": "l_linenumber",
    "cheaper_option_tested": "l_orderkey % 13 <> 0",
}


def raw_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as execution outcomes: the order is the group, the supplier the option."""
    rows = _select(
        table(spark, sf_dir, "lineitem"),
        {**_O, "completed_at": "CAST(datediff(l_shipdate, DATE '1970-01-01') AS BIGINT)"},
    )
    violation = F.when(
        F.col("severity").isNotNull(),
        F.array(F.struct(F.lit("v").alias("code"), F.col("severity").alias("severity"))),
    ).otherwise(F.array().cast("array<struct<code:string,severity:string>>"))
    return rows.withColumns(
        {
            "required_capabilities": F.array_compact(F.array("capability")),
            "safety_violations": violation,
            "policy_violations": F.array().cast("array<struct<code:string,severity:string>>"),
            "tool_failures": F.array().cast("array<string>"),
        }
    ).drop("capability", "severity")


SQL_VIEWS["o"] = f"""o0 AS (SELECT {_columns(_O)},
  date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS completed_at FROM lineitem),
o1 AS (SELECT *, concat_ws('|', coalesce(capability, 'general'), risk,
    CASE WHEN estimated_input_tokens < 8000 THEN 'lt8k' WHEN estimated_input_tokens <= 32000
      THEN '8k-32k' ELSE 'gt32k' END, model_family, reasoning_effort) AS descriptor,
  verified AND independent_verifier AND success AND verifier_score >= quality_floor
    AND coalesce(severity, '') <> 'Critical' AS acceptable FROM o0),
o AS (SELECT *, 'cell_' || substr(sha256(descriptor), 1, 20) || ':' || descriptor
  AS capability_cell_id FROM o1)"""


def sound_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes with cell and acceptability, for operators behind the validation."""
    from traceloom.operators.outcomes import cell_id, is_acceptable

    rows = raw_outcomes(spark, sf_dir).withColumn(
        "safety_violations",
        F.transform("safety_violations", lambda v: F.struct(
            v["code"].alias("code"), F.lower(v["severity"]).alias("severity"))),
    )
    return rows.withColumns(
        {
            "capability_cell_id": cell_id(*[F.col(n) for n in (
                "required_capabilities", "risk", "estimated_input_tokens", "model_family",
                "reasoning_effort")]),
            "acceptable": is_acceptable(),
            "record_hash": F.col("outcome_id"),
        }
    )


# ---------------------------------------------------------------- nations: catalog, tasks

_M = {
    "model_id": "n_name",
    "provider": "'region-' || n_regionkey",
    "revision": "CASE WHEN n_nationkey % 5 = 0 THEN 'r1' END",
    "enabled": "n_nationkey % 8 <> 7",
    "hidden": "n_nationkey % 12 = 11",
    "availability": "CASE WHEN n_nationkey % 2 = 0 THEN 'listed' ELSE 'configured_verified' END",
    "default_reasoning_effort": "'medium'",
    "context_window": "CAST(8000 * (1 + n_nationkey % 6) AS BIGINT)",
    "latency_p50_ms": "CAST(100 * n_nationkey AS DOUBLE)",
    "input_price": "CASE WHEN n_nationkey % 9 <> 8 "
                   "THEN CAST(1 + n_nationkey % 7 AS DOUBLE) / CAST(2 AS DOUBLE) END",
    "output_price": "CASE WHEN n_nationkey % 9 <> 8 "
                    "THEN CAST(2 + n_nationkey % 7 AS DOUBLE) * CAST(2 AS DOUBLE) END",
    "n_nationkey": "n_nationkey",
}
CATALOG = "catalog-1"


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as catalog models. The nation table has 25 rows at every scale."""
    rows = _select(table(spark, sf_dir, "nation"), _M)
    key = F.col("n_nationkey")

    def some(*pairs):
        return F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in pairs]))

    return rows.select(
        *[c for c in rows.columns if c != "n_nationkey"],
        some((F.lit(True), "reasoning"), (key % 2 == 0, "code"), (key % 3 == 0, "security"),
             (key % 5 != 0, "search")).alias("capabilities"),
        some((F.lit(True), "medium"), (F.lit(True), "low"), (key % 2 == 0, "high"),
             (key % 4 == 0, "xhigh")).alias("supported_reasoning_efforts"),
        F.when(key % 4 == 3, F.array().cast("array<string>")).otherwise(
            some((F.lit(True), "low"), (F.lit(True), "medium"), (key % 3 == 0, "high"),
                 (key % 6 == 0, "critical"))).alias("risk_tiers"),
        F.lit(CATALOG).alias("catalog_hash"),
    )


def sound_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceloom.operators.routing import normalize_models

    return normalize_models(models(spark, sf_dir)).drop("problem")


SQL_VIEWS["m"] = f"""m0 AS (SELECT {_columns(_M)} FROM nation),
m AS (SELECT *,
  list_filter([ 'reasoning', CASE WHEN n_nationkey % 2 = 0 THEN 'code' END,
    CASE WHEN n_nationkey % 3 = 0 THEN 'security' END,
    CASE WHEN n_nationkey % 5 <> 0 THEN 'search' END], lambda x: x IS NOT NULL) AS capabilities,
  list_filter(['low', 'medium', CASE WHEN n_nationkey % 2 = 0 THEN 'high' END,
    CASE WHEN n_nationkey % 4 = 0 THEN 'xhigh' END], lambda x: x IS NOT NULL) AS efforts,
  CASE WHEN n_nationkey % 4 = 3 THEN [] ELSE list_filter(['low', 'medium',
    CASE WHEN n_nationkey % 3 = 0 THEN 'high' END,
    CASE WHEN n_nationkey % 6 = 0 THEN 'critical' END], lambda x: x IS NOT NULL) END AS risk_tiers
  FROM m0 WHERE NOT hidden)"""

_B = {
    "task_id": "'order-' || l_orderkey",
    "task_group": "'customer-' || (l_orderkey % 500)",
    "subtask_id": "l_linenumber || '-' || l_partkey || '-' || l_suppkey",
    "objective": "CASE l_partkey % 3 WHEN 0 THEN 'Review security of part ' || l_partkey "
                 "WHEN 1 THEN 'Plan migration of part ' || l_partkey "
                 "ELSE 'Price part ' || l_partkey END",
    "capability": "CASE l_suppkey % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'search' END",
    "risk": "CASE WHEN l_linenumber <= 3 THEN 'low' WHEN l_linenumber <= 5 THEN 'medium' "
            "WHEN l_linenumber = 6 THEN 'high' ELSE 'critical' END",
    "estimated_input_tokens": "CAST(l_quantity * 900 AS BIGINT)",
    "nation": "'NATION_' || (l_suppkey % 25)",
    "effort": _choice("l_linenumber % 3", ("low", "medium", "high")),
}


def subtasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as subtasks of their order, one row each."""
    rows = _select(table(spark, sf_dir, "lineitem"), _B)
    none = F.array().cast("array<string>")
    return rows.select(
        "task_id", "task_group", F.concat(F.lit("Fulfil "), "task_id").alias("task"),
        "subtask_id", "objective", none.alias("depends_on"),
        F.array_compact(F.array("capability")).alias("required_capabilities"),
        "risk", "estimated_input_tokens", F.lit(CATALOG).alias("catalog_hash"),
    )


def sound_subtasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtasks without those whose id repeats inside their task."""
    return without_repeats(subtasks(spark, sf_dir))


def without_repeats(rows: DataFrame) -> DataFrame:
    from traceloom.operators.routing import mark_repeats

    return mark_repeats(rows).filter("problem is null").drop("problem")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _select(table(spark, sf_dir, "lineitem"), _B)
    return rows.select(
        "task_id", "subtask_id", F.col("nation").alias("model_id"),
        F.col("effort").alias("reasoning_effort"),
    )


def sound_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments of subtasks whose id does not repeat inside their task."""
    from traceloom.operators.routing import mark_repeats

    return mark_repeats(assignments(spark, sf_dir)).filter("problem is null").drop("problem")


SQL_VIEWS["b"] = f"""b AS (SELECT {_columns(_B)}, 'Fulfil order-' || l_orderkey AS task
  FROM lineitem)"""

# Without subtasks whose id repeats inside their task.
SQL_VIEWS["sb"] = """sb AS (SELECT b.* FROM b JOIN (SELECT task_id, subtask_id FROM b
    GROUP BY task_id, subtask_id HAVING count(*) = 1) USING (task_id, subtask_id))"""

POLICY = {
    "model_strength_order": [f"NATION_{i}" for i in range(25)],
    "risk_verification_tiers": {
        "low": "none", "medium": "standard", "high": "strong", "critical": "independent"},
    "semantic_verifier_risk_tiers": ["critical", "high"],
    "semantic_verifier_confidence_threshold": 0.65,
    "trusted_boundary_required_for": ["critical"],
}


def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known boundary states: a third of the models are trusted for code in small contexts."""
    rows = table(spark, sf_dir, "nation").filter("n_nationkey % 3 = 0")
    cells = F.array(*[F.lit(f"{c}:{r}:{s}") for c in ("code", "search", "general")
                      for r in vocab.RISKS for s in ("small", "medium")])
    revision = F.when(F.col("n_nationkey") % 5 == 0, "r1").otherwise("unversioned")
    return rows.withColumn("cell", F.explode(cells)).select(
        F.concat("n_name", F.lit("@"), revision, F.lit(":"), "cell").alias("state_key"),
        F.when(F.col("n_nationkey") % 2 == 0, "trusted").otherwise("conditional").alias("state"),
    )


# Options of every subtask, as SQL: constraints, boundary state, cost, rank inputs.
SQL_VIEWS["opt"] = """c0 AS (SELECT b.*, m.model_id, m.revision, m.efforts,
    strpos(m.model_id, '_') AS p, m.n_nationkey AS strength_rank, m.input_price, m.output_price,
    CASE WHEN b.capability IS NOT NULL AND NOT list_contains(m.capabilities, b.capability)
        THEN 'capability'
      WHEN b.estimated_input_tokens > m.context_window THEN 'context'
      WHEN len(m.risk_tiers) > 0 AND NOT list_contains(m.risk_tiers, b.risk) THEN 'risk' END
      AS hard_reason,
    CASE WHEN m.n_nationkey % 3 = 0 AND b.estimated_input_tokens <= 32000
      THEN CASE WHEN m.n_nationkey % 2 = 0 THEN 'trusted' ELSE 'conditional' END
      ELSE 'unmapped' END AS boundary_state
  FROM sb b CROSS JOIN m WHERE m.enabled),
c1 AS (SELECT *, coalesce(hard_reason, CASE WHEN risk = 'critical'
    AND boundary_state <> 'trusted' THEN 'boundary' END) AS reason FROM c0),
opt AS (SELECT *, 'opt_' || substr(sha256('catalog-1:' || model_id || ':' || option_effort), 1, 12)
    AS option_id,
    CASE option_effort WHEN 'low' THEN 1.0::DOUBLE WHEN 'medium' THEN 2.0::DOUBLE
      WHEN 'high' THEN 3.0::DOUBLE ELSE 4.0::DOUBLE END AS effort_level,
    CASE WHEN input_price IS NULL THEN 1e12::DOUBLE ELSE round((estimated_input_tokens * input_price
      + greatest(64, least(4096, estimated_input_tokens // 8)) * output_price) / 1e6::DOUBLE, 12)
      END AS estimated_unit_cost
  FROM (SELECT *, unnest(efforts) AS option_effort FROM c1 WHERE reason IS NULL))"""
