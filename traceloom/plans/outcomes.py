"""Queries over execution outcomes: validation, cells, targets, rollout, trials, leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import numeric as nx
from traceloom.operators import outcomes as oc
from traceloom.plans import base
from traceloom.plans.base import query, table, with_sql


@query(
    "val_16_outcomes",
    with_sql("""SELECT outcome_id, CASE WHEN problem IS NULL THEN capability_cell_id END AS capability_cell_id,
  CASE WHEN problem IS NULL THEN acceptable END AS acceptable, problem
FROM (SELECT *, CASE WHEN l % 97 = 0 THEN 'invalid risk'
    WHEN l % 89 = 0 THEN 'verifier_score must be between 0 and 1'
    WHEN times > 1 THEN 'duplicate outcome_id' END AS problem
  FROM (SELECT *, CAST(string_split(outcome_id, '-')[3] AS BIGINT) AS l,
    count(*) OVER (PARTITION BY outcome_id) AS times FROM o))""",
             "o"),
)
def _(spark, sf_dir):
    part = F.split("outcome_id", "-")[2].cast("long")
    raw = base.raw_outcomes(spark, sf_dir).withColumns(
        {
            "risk": F.when(part % 97 == 0, "extreme").otherwise(F.col("risk")),
            "verifier_score": F.when((part % 89 == 0), 1.5).otherwise(F.col("verifier_score")),
        }
    ).withColumnRenamed("outcome_id", "outcomeId")
    rows = oc.normalize_outcomes(raw)
    ok = F.col("problem").isNull()
    return rows.select(
        "outcome_id", F.when(ok, F.col("capability_cell_id")).alias("capability_cell_id"),
        F.when(ok, F.col("acceptable")).alias("acceptable"), "problem")


@query("val_17_acceptable", with_sql("SELECT outcome_id, acceptable FROM o", "o"))
def _(spark, sf_dir):
    return base.sound_outcomes(spark, sf_dir).select("outcome_id", "acceptable")


@query("row_14_outcome_cells", with_sql("SELECT capability_cell_id, count(*) AS n FROM o GROUP BY 1", "o"))
def _(spark, sf_dir):
    return base.sound_outcomes(spark, sf_dir).groupBy("capability_cell_id").agg(
        F.count(F.lit(1)).alias("n"))


_INDEPENDENT = """ind AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capability_cell_id,
  task_group ORDER BY completed_at DESC, outcome_id DESC) AS r FROM o) WHERE r = 1)"""


@query("win_01_independent_rows",
       with_sql("", "o").rstrip() + f", {_INDEPENDENT} SELECT capability_cell_id, outcome_id FROM ind")
def _(spark, sf_dir):
    rows = base.sound_outcomes(spark, sf_dir).select(
        "capability_cell_id", "task_group", "completed_at", "outcome_id")
    return oc.independent_rows(rows).select("capability_cell_id", "outcome_id")


_TREND = """ver AS (SELECT * FROM ind WHERE verified AND independent_verifier),
hv AS (SELECT capability_cell_id, acceptable, row_number() OVER (PARTITION BY capability_cell_id
    ORDER BY completed_at, outcome_id) - 1 AS i, count(*) OVER (PARTITION BY capability_cell_id) AS n
  FROM ver),
trend AS (SELECT capability_cell_id, CASE WHEN max(n) < 40 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE,
    avg(CASE WHEN acceptable THEN 1.0::DOUBLE ELSE 0 END) FILTER (i < n // 2)
    - avg(CASE WHEN acceptable THEN 1.0::DOUBLE ELSE 0 END) FILTER (i >= n // 2)) END AS reg
  FROM hv GROUP BY 1)"""


@query("win_02_recent_regression",
       with_sql("", "o").rstrip() + f""", {_INDEPENDENT}, {_TREND}
SELECT capability_cell_id, round(reg, 9) AS recent_regression FROM trend""")
def _(spark, sf_dir):
    outcomes = base.sound_outcomes(spark, sf_dir).select(
        "capability_cell_id", "task_group", "completed_at", "outcome_id", "verified",
        "independent_verifier", "acceptable")
    rows = oc.independent_rows(outcomes).filter("verified and independent_verifier")
    return oc.recent_regression(rows).withColumn("recent_regression", F.round("recent_regression", 9))


_CELLS = """st AS (SELECT capability_cell_id, any_value(risk) AS risk,
    count(*) FILTER (verified AND independent_verifier) AS n,
    count(*) FILTER (verified AND independent_verifier AND acceptable) AS k,
    sum(CASE WHEN verified AND independent_verifier AND classifier_confidence IS NOT NULL
      THEN pow(round(classifier_confidence * 100) - CASE WHEN acceptable THEN 100 ELSE 0 END, 2) END)
      / 10000 / count(*) FILTER (verified AND independent_verifier AND classifier_confidence IS NOT NULL)
      AS brier,
    count(*) FILTER (severity = 'Critical') AS serious FROM ind GROUP BY 1),
w AS (SELECT st.*, coalesce(reg, 0) AS reg, CASE WHEN n > 0 THEN k::DOUBLE / n ELSE 0 END AS p,
    CASE WHEN n = 0 THEN 0 ELSE (k::DOUBLE / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((k::DOUBLE / n
      * (1 - k::DOUBLE / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n) END AS wilson
  FROM st LEFT JOIN trend USING (capability_cell_id)),
why AS (SELECT *, list_filter([CASE WHEN n < 20 THEN 'insufficient-independent-verified-samples' END,
    CASE WHEN p < 0.9 THEN 'precision-below-floor' END,
    CASE WHEN wilson < 0.85 THEN 'wilson-lower-bound-below-floor' END,
    CASE WHEN serious > 0 THEN 'serious-safety-or-policy-failure' END,
    CASE WHEN brier IS NULL OR brier > 0.10 THEN 'confidence-not-calibrated' END,
    CASE WHEN reg > 0.05 THEN 'recent-regression' END], lambda x: x IS NOT NULL) AS reasons FROM w),
cells AS (SELECT *, CASE WHEN len(reasons) > 0 THEN 'exploration-only' WHEN risk IN ('low', 'medium')
    THEN 'trusted' ELSE 'conditional' END AS state FROM why)"""

_LIMITS = dict(minimum_verified=20, minimum_precision=0.9, minimum_wilson_lower_bound=0.85,
               maximum_recent_regression=0.05)


@query(
    "agg_09_cell_report",
    with_sql("", "o").rstrip() + f""", {_INDEPENDENT}, {_TREND}, {_CELLS}
SELECT capability_cell_id, risk, state, n AS independent_verified_samples, k AS accepted_samples,
  round(p, 6) AS selective_precision, round(wilson, 6) AS wilson_lower_bound,
  round(brier, 6) AS brier_score, round(reg, 6) AS recent_regression,
  serious AS serious_failure_count, array_to_string(CASE WHEN state = 'conditional'
    THEN ['high-risk-cells-remain-conditional'] ELSE reasons END, ',') AS reasons FROM cells""",
)
def _(spark, sf_dir):
    cells = oc.cell_report(base.sound_outcomes(spark, sf_dir), **_LIMITS)
    return cells.select(
        "capability_cell_id", "risk", "state", "independent_verified_samples", "accepted_samples",
        "selective_precision", "wilson_lower_bound", "brier_score", "recent_regression",
        "serious_failure_count", F.array_join("reasons", ",").alias("reasons"))


@query(
    "agg_10_wilson_bound",
    """WITH c AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders
  GROUP BY 1)
SELECT o_custkey, round((k::DOUBLE / n + 3.8416 / (2 * n) - 1.96 * sqrt((k::DOUBLE / n
  * (1 - k::DOUBLE / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 8) AS bound FROM c""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    return rows.select("o_custkey", F.round(nx.wilson_lower(F.col("k"), F.col("n")), 8).alias("bound"))


@query(
    "agg_11_rollout",
    with_sql("", "o").rstrip() + f""", {_INDEPENDENT}, {_TREND}, {_CELLS}
SELECT count(*) FILTER (state = 'trusted') AS trusted_cell_count,
  CASE WHEN count(*) FILTER (state = 'trusted') > 0 THEN 'limited' ELSE 'shadow' END AS authorized_stage,
  CASE WHEN count(*) FILTER (state = 'trusted') > 0 THEN 0.25 ELSE 0.0 END AS maximum_classifier_coverage
FROM cells""",
)
def _(spark, sf_dir):
    cells = oc.cell_report(base.sound_outcomes(spark, sf_dir), **_LIMITS)
    return oc.rollout(oc.cell_totals(cells), 4).select(
        "trusted_cell_count", "authorized_stage", "maximum_classifier_coverage")


@query(
    "agg_12_outcome_job",
    with_sql("", "o").rstrip() + """
,
od AS (SELECT *, count(*) OVER (PARTITION BY outcome_id) AS times FROM o)
SELECT 'outcomes' AS part, count(*) AS n FROM od WHERE times = 1 UNION ALL
SELECT 'cells', count(DISTINCT capability_cell_id) FROM od WHERE times = 1 UNION ALL
SELECT 'problems', count(*) FROM od WHERE times > 1""",
)
def _(spark, sf_dir):
    job = oc.outcome_job(base.raw_outcomes(spark, sf_dir))
    cells = job["cells"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("cells").alias("part"), "n")
    return job["counts"].unionByName(cells)


@query(
    "top_06_cheapest_acceptable",
    with_sql("", "o").rstrip() + """,
g AS (SELECT counterfactual_group_id, count(*) AS n, bool_and(assignment_mechanism = 'randomized') AS rnd,
    bool_and(cheaper_option_tested) AS tested, count(DISTINCT executed_option_id) AS opts,
    count(*) FILTER (acceptable) AS good, count(DISTINCT executed_option_id) FILTER (acceptable) AS good_opts
  FROM o GROUP BY 1),
p AS (SELECT *, row_number() OVER (PARTITION BY counterfactual_group_id
    ORDER BY cost_amount, latency_ms, executed_option_id) AS r FROM o WHERE acceptable)
SELECT counterfactual_group_id, p.task_group, p.capability_cell_id, p.executed_option_id
  AS chosen_option_id, g.opts AS observed, g.good_opts AS accepted
FROM g JOIN p USING (counterfactual_group_id)
WHERE p.r = 1 AND g.n >= 2 AND rnd AND tested AND opts >= 2 AND good > 0""",
)
def _(spark, sf_dir):
    rows = oc.cheapest_acceptable(base.sound_outcomes(spark, sf_dir))
    return rows.select(
        "counterfactual_group_id", "task_group", "capability_cell_id", "chosen_option_id",
        F.size("observed_options").alias("observed"), F.size("acceptable_option_ids").alias("accepted"))


def ranked_orders(spark, sf_dir):
    """Orders as ranking rows: their lines are options priced by extended price."""
    option = F.struct(
        F.concat_ws("-", F.lit("opt"), "l_linenumber", "l_suppkey", "l_partkey").alias("option_id"),
        F.col("l_extendedprice").alias("estimated_unit_cost"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(option).alias("eligible_options"),
        F.max_by(option["option_id"], F.struct("l_linenumber", "l_suppkey", "l_partkey")).alias(
            "chosen_option_id"))
    key = F.col("l_orderkey")
    return lines.select(
        F.concat(F.lit("order-"), key).alias("task_id"), F.concat(F.lit("g-"), key).alias("task_group"),
        F.lit("main").alias("subtask_id"), F.when(key % 4 == 0, "high").otherwise("low").alias("risk"),
        F.when(key % 7 == 0, F.array(F.lit("security"))).otherwise(
            F.array().cast("array<string>")).alias("required_capabilities"),
        F.struct((key % 11 == 0).alias("migration"), F.lit(False).alias("security")).alias("signals"),
        "eligible_options", "chosen_option_id", F.lit("c").alias("catalog_hash"),
        F.lit("p").alias("policy_hash"), F.lit("s").alias("candidate_set_hash"))


@query(
    "top_07_trial_plan",
    """WITH op AS (SELECT l_orderkey AS k, 'opt-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS option_id,
    l_extendedprice AS cost, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC,
      l_suppkey DESC, l_partkey DESC) AS r FROM lineitem),
te AS (SELECT k, option_id, min(cost) AS dummy FROM op WHERE r = 1 GROUP BY 1, 2),
ch AS (SELECT te.k, te.option_id AS teacher_option_id, op.option_id, op.cost, t0.cost AS teacher_cost,
    row_number() OVER (PARTITION BY te.k ORDER BY op.cost, op.option_id) AS r
  FROM te JOIN op USING (k) JOIN op t0 ON t0.k = te.k AND t0.r = 1 WHERE op.cost < t0.cost)
SELECT 'order-' || k AS task_id, teacher_option_id, option_id AS candidate_option_id,
  cost AS candidate_estimated_unit_cost, 'cf_' || substr(sha256('exp:1701:g-' || k || ':main'), 1, 20)
  AS counterfactual_group_id
FROM ch WHERE r = 1 AND k % 4 <> 0 AND k % 7 <> 0 AND k % 11 <> 0
  AND ('0x' || substr(sha256('1701:g-' || k || ':main'), 1, 16))::UBIGINT::DOUBLE
    / 18446744073709551615::DOUBLE < 0.3""",
)
def _(spark, sf_dir):
    rows = oc.plan_trials(ranked_orders(spark, sf_dir), "exp", sample_rate=0.3)
    return rows.select("task_id", "teacher_option_id", "candidate_option_id",
                       "candidate_estimated_unit_cost", "counterfactual_group_id")


def feature_rows(spark, sf_dir):
    """Documents as classifier rows with a feature document, split by source."""
    key = F.col("doc_id")
    features = F.to_json(
        F.struct(
            F.col("lang").alias("risk"), F.col("n_chars").alias("estimated_input_tokens"),
            F.col("text").alias("task_text"),
            F.struct((key % 2 == 0).alias("security"),
                     F.when(key % 50 == 0, F.lit(True)).alias("chosen_option_seen")).alias("signals"),
            F.when(key % 70 == 0, F.concat(F.lit("opt-"), key % 9)).alias("hint"),
        )
    )
    return table(spark, sf_dir, "documents").select(
        F.when(key % 5 == 0, "eval").otherwise("train").alias("split"), key.alias("id"),
        F.concat(F.lit("group-"), key % 40).alias("task_group"), features.alias("features"),
        F.concat(F.lit("opt-"), key % 9).alias("chosen_option_id"),
        F.lit("C1").alias("chosen_choice_id"), F.lit("").alias("completion"))


_LEAK = """f AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'eval' ELSE 'train' END AS split,
  doc_id % 40 AS grp, concat_ws('|', lang, n_chars, doc_id % 2 = 0, doc_id % 50 = 0,
    CASE WHEN doc_id % 70 = 0 THEN doc_id % 9 END) AS s, text FROM documents)"""


@query(
    "join_22_leakage_findings",
    """SELECT CASE WHEN doc_id % 5 = 0 THEN 'eval' ELSE 'train' END AS split, doc_id AS id,
  'features.signals.chosen_option_seen' AS path, 'target-derived-key' AS reason FROM documents
WHERE doc_id % 50 = 0 UNION ALL SELECT CASE WHEN doc_id % 5 = 0 THEN 'eval' ELSE 'train' END, doc_id,
  'features.hint', 'embedded-target-value' FROM documents WHERE doc_id % 70 = 0""",
)
def _(spark, sf_dir):
    return oc.leakage_findings(feature_rows(spark, sf_dir))


@query(
    "join_22_set_03_leakage_audit",
    f"""WITH {_LEAK} SELECT count(*) FILTER (split = 'train') AS train_rows,
  count(*) FILTER (split = 'eval') AS eval_rows,
  (SELECT count(*) FROM (SELECT grp FROM f GROUP BY grp HAVING count(DISTINCT split) = 2))
    AS overlapping_task_groups,
  (SELECT count(*) FROM f WHERE id % 50 = 0) AS prohibited_feature_paths,
  (SELECT count(*) FROM f WHERE id % 70 = 0) AS embedded_target_values,
  (SELECT count(*) FROM (SELECT 1 FROM f GROUP BY s, text HAVING count(DISTINCT split) = 2))
    AS exact_feature_overlap_count,
  (SELECT count(*) FROM (SELECT 1 FROM f GROUP BY s HAVING count(DISTINCT split) = 2))
    AS structural_feature_overlap_count,
  FALSE AS safe_for_teacher_imitation FROM f""",
)
def _(spark, sf_dir):
    audit = oc.leakage_audit(feature_rows(spark, sf_dir))
    return audit.select(
        "train_rows", "eval_rows", "overlapping_task_groups", "prohibited_feature_paths",
        "embedded_target_values", "exact_feature_overlap_count", "structural_feature_overlap_count",
        "safe_for_teacher_imitation")
