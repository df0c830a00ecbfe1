"""Queries over calibration samples, training logs, candidate results and variant outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import hashing as hx
from traceloom.operators import calibration as cal
from traceloom.operators import experiments as ex
from traceloom.operators import health as hl
from traceloom.operators import judging as jd
from traceloom.operators import stats as st
from traceloom.plans import base
from traceloom.plans.base import query, table, with_sql
from traceloom.streaming import jobs

# ---------------------------------------------------------------- calibration


def _rounded(df, keep, names, digits=6):
    return df.select(*keep, *[F.round(n, digits).alias(n) for n in names])


_ECE = """SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM (SELECT
  least(CAST(floor(confidence * 10) AS INT), 9) AS b, count(*) AS n, avg(confidence) AS c,
  avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) AS a FROM s GROUP BY 1)"""


@query("agg_15_binned_error", with_sql(_ECE, "s"))
def _(spark, sf_dir):
    rows = cal.prepare(base.samples(spark, sf_dir))
    return cal.binned_error(rows, []).select(F.round("ece", 6).alias("ece"))


def _adaptive(where):
    return f"""(SELECT round(sum(n * abs(c - a)) / sum(n), 6) FROM (SELECT
  i // CAST(ceil(t / least(4, t)) AS BIGINT) AS b, count(*) AS n, avg(confidence) AS c,
  avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) AS a FROM (SELECT *, row_number() OVER
    (ORDER BY confidence, event_id) - 1 AS i, count(*) OVER () AS t FROM s WHERE {where}) GROUP BY 1))"""


@query("win_04_adaptive_error", with_sql(f"SELECT {_adaptive('TRUE')} AS adaptive_ece", "s"))
def _(spark, sf_dir):
    return cal.bucketed_error(cal.prepare(base.samples(spark, sf_dir)), "event_id")


_TRAP = _adaptive("source = 'trap'")
_VER = _adaptive("source IN ('verifier', 'adjudication')")


@query(
    "agg_19_calibration_report",
    with_sql(f"""SELECT ({_ECE}) AS ece, {_adaptive('TRUE')} AS adaptive_ece,
  round(avg(CASE WHEN NOT passed THEN 1.0 ELSE 0.0 END) FILTER (confidence >= 0.8), 6)
    AS high_confidence_failure_rate,
  round(avg(CASE WHEN should_escalate THEN 1.0 ELSE 0.0 END) FILTER (esc), 6) AS escalation_precision,
  round(avg(CASE WHEN esc THEN 1.0 ELSE 0.0 END) FILTER (should_escalate), 6) AS escalation_recall,
  round(avg(coalesce(confidence_faithfulness, 0.8)), 6) AS confidence_faithfulness,
  round(abs({_TRAP} - {_VER}), 6) AS trap_verifier_gap FROM s""", "s"),
)
def _(spark, sf_dir):
    out = cal.calibration_report(base.samples(spark, sf_dir), "event_id")
    return out.select(
        "ece", "adaptive_ece", "high_confidence_failure_rate", "escalation_precision",
        "escalation_recall", "confidence_faithfulness",
        F.round("trap_verifier_gap", 6).alias("trap_verifier_gap"))


@query(
    "agg_17_18_rates",
    with_sql("""SELECT source,
  round(coalesce(avg(CASE WHEN NOT passed THEN 1.0 ELSE 0.0 END) FILTER (confidence >= 0.8), 0), 6)
    AS high_confidence_failure_rate,
  round(coalesce(avg(CASE WHEN should_escalate THEN 1.0 ELSE 0.0 END) FILTER (esc), 1), 6)
    AS escalation_precision,
  round(coalesce(avg(CASE WHEN esc THEN 1.0 ELSE 0.0 END) FILTER (should_escalate), 1), 6)
    AS escalation_recall FROM s GROUP BY source""", "s"),
)
def _(spark, sf_dir):
    return cal.prepare(base.samples(spark, sf_dir)).groupBy("source").agg(*cal.rates())


@query(
    "agg_20_blind_spots",
    with_sql("""SELECT cell_id, round(avg(CASE WHEN NOT passed THEN 1.0 ELSE 0.0 END), 6)
  AS trap_failure_rate, count(*) FILTER (NOT passed) AS evidence_count FROM s WHERE source = 'trap'
GROUP BY cell_id HAVING count(*) FILTER (NOT passed) > 0""", "s"),
)
def _(spark, sf_dir):
    return cal.blind_spots(base.samples(spark, sf_dir))


@query(
    "agg_21_judge_disagreement",
    with_sql("""SELECT source, count(*) AS sample_count, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6)
  AS pass_rate, avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) >= 0.5 AS disagrees FROM s GROUP BY source""",
             "s"),
)
def _(spark, sf_dir):
    return cal.judge_disagreement(base.samples(spark, sf_dir), "fail")


@query(
    "agg_22_judge_panel",
    """SELECT event_id, 'recent' AS part FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 20)
UNION ALL SELECT count(*) FILTER (s_suppkey % 3 = 0), 'ready' FROM supplier""",
)
def _(spark, sf_dir):
    servers = table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_suppkey") % 3 == 0, "ready").otherwise("down").alias("status"))
    panel = cal.judge_panel(servers, table(spark, sf_dir, "events").select("event_id"), "event_id")
    ready = panel["servers"].select(F.col("ready_servers").alias("event_id"), F.lit("ready").alias("part"))
    return panel["recent"].withColumn("part", F.lit("recent")).unionByName(ready)


@query(
    "agg_23_intrinsic_confidence",
    with_sql("""SELECT task_id, count(*) AS sample_count, round(avg(confidence), 6) AS mean_confidence,
  round(var_pop(confidence), 6) AS confidence_variance,
  round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS acceptance_rate FROM s GROUP BY task_id""",
             "s"),
)
def _(spark, sf_dir):
    return cal.intrinsic_confidence(base.samples(spark, sf_dir)).drop("intrinsic_confidence_score")


@query(
    "agg_46_selection_certificate",
    with_sql("""SELECT count(*) AS pool_size, count(*) FILTER (1 - v >= 0.92) AS selected_count,
  0.92 AS min_intrinsic_confidence_score FROM (SELECT round(greatest(0, 1 - var_pop(confidence)), 6) AS sc,
  1 - round(greatest(0, 1 - var_pop(confidence)), 6) AS v FROM s GROUP BY task_id)""", "s"),
)
def _(spark, sf_dir):
    return cal.selection_certificate(cal.intrinsic_confidence(base.samples(spark, sf_dir)), 0.92)


@query(
    "row_20_failure_assets",
    with_sql("""SELECT event_id, asset_type FROM (SELECT source_trace_hash AS event_id, unnest(list_filter([
  CASE WHEN failure_type = 'hidden_trap_failure' THEN 'hidden_trap_failure' END,
  CASE WHEN failure_type = 'missed_escalation' OR (should_escalate AND NOT esc) THEN 'missed_escalation' END,
  CASE WHEN failure_type = 'overconfident_failure' OR (lower(verification_result) IN ('failed', 'fail',
    'rejected', 'incorrect') AND confidence >= 0.8) THEN 'overconfident_failure' END,
  CASE WHEN failure_type = 'unfaithful_hedge' THEN 'unfaithful_hedge' END], lambda x: x IS NOT NULL))
  AS asset_type FROM s)""", "s"),
)
def _(spark, sf_dir):
    return cal.failure_assets(base.samples(spark, sf_dir)).select(
        F.col("source_trace_hash").alias("event_id"), "asset_type")


@query(
    "ds_12_failure_benchmark",
    with_sql("""SELECT task_id, failure_type AS expected_failure_type, should_escalate
  AS expected_escalation, CASE WHEN passed THEN 'pass' ELSE 'fail' END AS label, confidence FROM s""", "s"),
)
def _(spark, sf_dir):
    return cal.failure_benchmark(base.samples(spark, sf_dir))


@query(
    "row_10_rewards",
    with_sql("""SELECT source_trace_hash AS id, round(greatest(-1, least(1,
  0.35::DOUBLE * g + 0.2::DOUBLE * greatest(0, 1 - abs(confidence - g)) + 0.2::DOUBLE * 0.5
  - 0.15::DOUBLE * CASE WHEN passed THEN 0 ELSE greatest(0, confidence - 0.7::DOUBLE) END
  + 0.1::DOUBLE * CASE WHEN NOT should_escalate OR esc THEN 1 ELSE 0 END)), 5) AS reward
FROM (SELECT *, CASE WHEN passed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS g FROM s)""", "s"),
)
def _(spark, sf_dir):
    rows = cal.prepare(base.samples(spark, sf_dir))
    reward = cal.reward_columns(rows.columns)["reward"]
    return rows.select(F.col("source_trace_hash").alias("id"), F.round(reward, 5).alias("reward"))


# ---------------------------------------------------------------- training logs


@query(
    "win_05_health_rules",
    with_sql("""SELECT abort_reason, count(*) AS updates, count(DISTINCT job_id) AS jobs FROM (
SELECT job_id, CASE
  WHEN update + 1 >= 3 AND min(kl_divergence) OVER w3 > 0.5 THEN 'KL exceeded 0.5 for 3 consecutive updates'
  WHEN update + 1 >= 20 AND avg(zero_variance_group) OVER w20 > 0.3 THEN 'sustained zero-variance rollout groups'
  WHEN update + 1 >= 10 AND avg(completion_diversity) OVER w10 < 0.2
    THEN 'sustained completion-diversity collapse'
  WHEN update + 1 >= 5 AND avg(hard_limit_fraction) OVER w5 > 0.8
    THEN 'completion length repeatedly reached the hard limit' END AS abort_reason FROM h
WINDOW w3 AS (PARTITION BY job_id ORDER BY update ROWS 2 PRECEDING),
  w20 AS (PARTITION BY job_id ORDER BY update ROWS 19 PRECEDING),
  w10 AS (PARTITION BY job_id ORDER BY update ROWS 9 PRECEDING),
  w5 AS (PARTITION BY job_id ORDER BY update ROWS 4 PRECEDING))
WHERE abort_reason IS NOT NULL GROUP BY 1""", "h"),
)
def _(spark, sf_dir):
    limits = {"zero_variance_abort_threshold": 0.3, "hard_limit_fraction_threshold": 0.8}
    rows = hl.health_abort(base.health_log(spark, sf_dir), limits, block=50)
    return rows.filter("abort_reason is not null").groupBy("abort_reason").agg(
        F.count(F.lit(1)).alias("updates"), F.count_distinct("job_id").alias("jobs"))


@query(
    "str_02_live_health",
    with_sql("""SELECT * FROM (SELECT job_id, update, CASE
  WHEN update + 1 >= 3 AND min(kl_divergence) OVER w3 > 0.5 THEN 'KL exceeded 0.5 for 3 consecutive updates'
  WHEN update + 1 >= 20 AND avg(zero_variance_group) OVER w20 > 0.3 THEN 'sustained zero-variance rollout groups'
  WHEN update + 1 >= 10 AND avg(completion_diversity) OVER w10 < 0.2
    THEN 'sustained completion-diversity collapse'
  WHEN update + 1 >= 5 AND avg(hard_limit_fraction) OVER w5 > 0.8
    THEN 'completion length repeatedly reached the hard limit' END AS abort_reason FROM h
WINDOW w3 AS (PARTITION BY job_id ORDER BY update ROWS 2 PRECEDING),
  w20 AS (PARTITION BY job_id ORDER BY update ROWS 19 PRECEDING),
  w10 AS (PARTITION BY job_id ORDER BY update ROWS 9 PRECEDING),
  w5 AS (PARTITION BY job_id ORDER BY update ROWS 4 PRECEDING))
WHERE abort_reason IS NOT NULL""", "h"),
)
def _(spark, sf_dir):
    """Updates land in files by a hash, so most of them come before or after their neighbours."""
    limits = {"zero_variance_abort_threshold": 0.3, "hard_limit_fraction_threshold": 0.8}
    log = base.health_log(spark, sf_dir).select("job_id", "update", *jobs.HEALTH_COLUMNS)
    folder = base.scratch(spark, "live-health")
    log.repartition(4, F.xxhash64("job_id", "update")).write.parquet(f"{folder}/arrivals")
    arrivals = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arrivals")
    return jobs.drained(jobs.health_stream(arrivals, limits), folder)


@query(
    "win_06_reward_gap",
    with_sql("""SELECT job_id, update FROM (SELECT *, avg(mean_task_reward) OVER (PARTITION BY job_id
  ORDER BY update ROWS 3 PRECEDING) AS rec, avg(mean_task_reward) OVER (PARTITION BY job_id ORDER BY update
  ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING) AS prev, last_value(heldout_accuracy IGNORE NULLS) OVER
  (PARTITION BY job_id ORDER BY update ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h)
WHERE heldout_accuracy IS NOT NULL AND before IS NOT NULL AND update + 1 >= 8
  AND rec >= prev + 0.05 AND heldout_accuracy <= before""", "h"),
)
def _(spark, sf_dir):
    rows = hl.reward_gap(base.health_log(spark, sf_dir), 4, 0.05, block=40)
    return rows.filter("gap_detected").select("job_id", "update")


@query(
    "agg_37_job_summary",
    with_sql("""SELECT job_id, max(update) AS updates, CAST(sum(generated_tokens) AS BIGINT) AS generated_tokens,
  round(avg(mean_task_reward), 6) AS mean_task_reward,
  round(1000 * sum(mean_task_reward) / sum(generated_tokens), 6) AS reward_per_1k,
  round(avg(kl_divergence) FILTER (update > m - 30), 6) AS recent_kl,
  round(greatest(0, 1 - avg(kl_divergence) FILTER (update > m - 30) / 0.5), 6) AS retention_score
FROM (SELECT *, max(update) OVER (PARTITION BY job_id) AS m FROM h) GROUP BY job_id""", "h"),
)
def _(spark, sf_dir):
    out = hl.job_summary(base.health_log(spark, sf_dir), recent=30)
    return out.select(
        "job_id", "updates", "generated_tokens", F.round("mean_task_reward", 6).alias("mean_task_reward"),
        F.round("reward_per_1000_generated_tokens", 6).alias("reward_per_1k"),
        F.round("recent_kl_divergence", 6).alias("recent_kl"),
        F.round("retention_score", 6).alias("retention_score"))


@query(
    "agg_37_reward_by_family",
    with_sql("""SELECT job_id, task_family, round(avg(mean_task_reward), 9) AS mean_task_reward FROM (
  SELECT *, max(update) OVER (PARTITION BY job_id) AS m FROM h) WHERE update > m - 30 GROUP BY 1, 2""", "h"),
)
def _(spark, sf_dir):
    return _rounded(hl.reward_by_family(base.health_log(spark, sf_dir), 30), ["job_id", "task_family"],
                    ["mean_task_reward"], 9)


@query(
    "agg_38_curve_area",
    with_sql("""SELECT job_id, round(coalesce(sum((x - px) * (y + py) / 2), 0), 4) AS area FROM (SELECT job_id,
  x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (SELECT job_id, update, update * 100 AS x,
  kl_divergence AS y FROM h) WINDOW w AS (PARTITION BY job_id ORDER BY update)) GROUP BY job_id""", "h"),
)
def _(spark, sf_dir):
    curve = base.health_log(spark, sf_dir).select(
        "job_id", F.col("update").alias("point"), (F.col("update") * 100).alias("generated_tokens"),
        F.col("kl_divergence").alias("behavioral_accuracy"))
    return _rounded(hl.curve_area(curve, block=60), ["job_id"], ["area"], 4)


def entries(spark, sf_dir):
    """Parts as adapter entries: brand is the profile, size the layer, price the norm."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("profile_id"), F.col("p_brand").alias("candidate_id"),
        F.concat(F.lit("layer-"), F.col("p_size") - 1, F.lit(":family-"), "p_partkey").alias("entry_key"),
        (F.col("p_retailprice") * (F.col("p_partkey") % 13)).alias("gradient_norm"),
        (F.col("p_partkey") % 50 + 1).alias("parameter_count"),
        (F.col("p_partkey") % 40 == 0).alias("required"), (F.col("p_partkey") % 3 == 0).alias("current"))


_ENT = """en AS (SELECT p_brand AS b, p_size - 1 AS layer, p_retailprice * (p_partkey % 13) AS norm,
  p_partkey % 50 + 1 AS cnt, 'layer-' || (p_size - 1) || ':family-' || p_partkey AS entry_key FROM part)"""


@query(
    "row_25_entry_scores",
    f"""WITH {_ENT} SELECT entry_key, round(norm / sqrt(cnt), 6) AS saliency_density,
  round(norm / sqrt(cnt) / (0.5 + 0.5 * (60 - layer) / 60.0), 5) AS cost_adjusted_score FROM en""",
)
def _(spark, sf_dir):
    out = hl.entry_scores(entries(spark, sf_dir), 60)
    return out.select("entry_key", F.round("saliency_density", 6).alias("saliency_density"),
                      F.round("cost_adjusted_score", 5).alias("cost_adjusted_score"))


@query(
    "agg_39_depth_profiles",
    f"""WITH {_ENT}, l AS (SELECT b, layer, sum(norm) AS m FROM en GROUP BY 1, 2),
p AS (SELECT b, sum(m) AS t, coalesce(sum(m) FILTER (layer / 59.0 < 1.0 / 3), 0) / sum(m) AS early,
  coalesce(sum(m) FILTER (layer / 59.0 >= 2.0 / 3), 0) / sum(m) AS late, sum(m * layer / 59.0) / sum(m) AS c FROM l GROUP BY 1)
SELECT b AS profile_id, round(early, 6) AS early, round(late, 6) AS late, round(c, 6) AS depth_centroid,
  CASE WHEN early >= 0.25 AND late >= 0.25 THEN 'bimodal_or_distributed' WHEN early >= 0.6
    THEN 'early_concentrated' WHEN late >= 0.6 THEN 'late_concentrated' ELSE 'bimodal_or_distributed' END
  AS profile FROM p""",
)
def _(spark, sf_dir):
    out = hl.depth_profile(entries(spark, sf_dir), 60)
    return out.select("profile_id", *[F.round(n, 6).alias(n) for n in ("early", "late", "depth_centroid")],
                      "profile")


# Greedy selection as recursion: one entry per step and candidate, in the order of scores.
_GREEDY = """sc AS MATERIALIZED (SELECT p_brand AS b, p_partkey % 40 = 0 AS required, p_partkey % 50 + 1 AS cnt,
    'layer-' || (p_size - 1) || ':family-' || p_partkey AS entry_key,
    p_retailprice * (p_partkey % 13) / sqrt(p_partkey % 50 + 1)
      / (0.5::DOUBLE + 0.5::DOUBLE * (60 - (p_size - 1)) / 60::DOUBLE)
      / CASE WHEN p_partkey % 3 = 0 THEN 0.9::DOUBLE ELSE 1::DOUBLE END AS s FROM part),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY b ORDER BY s DESC, entry_key) AS n
  FROM sc WHERE NOT required),
begun AS (SELECT b, sum(CASE WHEN required THEN cnt ELSE 0 END)::BIGINT AS used FROM sc GROUP BY b),
walk AS (
  SELECT b, 0::BIGINT AS n, used, NULL::VARCHAR AS taken FROM begun
  UNION ALL
  SELECT o.b, o.n, CASE WHEN used + cnt <= 600 THEN used + cnt ELSE used END,
    CASE WHEN used + cnt <= 600 THEN entry_key END
  FROM walk w JOIN ordered o ON o.b = w.b AND o.n = w.n + 1)"""


@query(
    "win_09_select_entries",
    f"""WITH RECURSIVE {_GREEDY} SELECT b AS candidate_id,
  (count(taken) + (SELECT count(*) FROM sc WHERE sc.b = walk.b AND required))::INT AS selected,
  max(used) AS used_parameters,
  (SELECT used > 600 FROM begun WHERE begun.b = walk.b) AS required_exceed_budget FROM walk GROUP BY b""",
)
def _(spark, sf_dir):
    scored = hl.entry_scores(entries(spark, sf_dir), 60)
    budgets = scored.select("candidate_id").distinct().withColumn("parameter_budget", F.lit(600))
    out = hl.select_entries(scored, budgets, 0.9)
    return out.select("candidate_id", F.size("selected").alias("selected"), "used_parameters",
                      "required_exceed_budget")


@query(
    "win_09_selected_rows",
    f"""WITH RECURSIVE {_GREEDY} SELECT b AS candidate_id, taken AS entry_key FROM walk WHERE taken IS NOT NULL
UNION ALL SELECT b, entry_key FROM sc WHERE required""",
)
def _(spark, sf_dir):
    scored = hl.entry_scores(entries(spark, sf_dir), 60)
    budgets = scored.select("candidate_id").distinct().withColumn("parameter_budget", F.lit(600))
    return hl.selected_entries(scored, budgets, 0.9, block=25).select("candidate_id", "entry_key")


@query(
    "top_05_protected_entries",
    f"""WITH {_ENT} SELECT entry_key FROM (SELECT *, norm / greatest(1e-12, norm + cnt * 100) AS sh FROM en)
ORDER BY sh DESC, norm DESC, entry_key LIMIT 25""",
)
def _(spark, sf_dir):
    rows = entries(spark, sf_dir).select(
        "entry_key", F.col("gradient_norm").alias("protected_norm"),
        (F.col("parameter_count") * 100).alias("other_norm"))
    return hl.protected_entries(rows, 25).select("entry_key")


@query(
    "row_11_rewards",
    """SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 2 = 0 THEN 1.01::DOUBLE + 0.005 *
  greatest(0, 1 - (event_id % 60) / 64.0) ELSE 0.25 * exp(-4.0 / greatest(1, event_id)) + 0.01 + 0.005 *
  greatest(0, 1 - (event_id % 60) / 64.0) END, 8) AS reward FROM events""",
)
def _(spark, sf_dir):
    key = F.col("event_id")
    out = F.when(key % 5 == 0, "no idea").when(key % 2 == 0, key.cast("string")).otherwise(
        (key + 1).cast("string"))
    behavior = hl.arithmetic_reward(out, key.cast("string"))
    reward = hl.training_reward(behavior, out.rlike(r"^-*\d+$"), key % 60, 64)
    return table(spark, sf_dir, "events").select("event_id", F.round(reward, 8).alias("reward"))


@query(
    "row_24_preference_objective",
    """SELECT round(avg(ln(1 + exp(-m))), 7) AS dpo_loss, round(avg(ln(1 + exp(-m)) + 0.1 * n), 7)
  AS objective_loss, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 9) AS preference_accuracy,
  round(avg(m), 7) AS reward_margin FROM (SELECT 0.1 * ((-l_quantity + l_linenumber * 7) - l_discount) AS m,
  l_quantity / l_linenumber AS n FROM lineitem)""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        (-F.col("l_quantity")).alias("chosen_logprob"), (-7.0 * F.col("l_linenumber")).alias("rejected_logprob"),
        F.col("l_discount").alias("reference_logratio"), F.col("l_linenumber").alias("chosen_target_count"))
    out = hl.preference_objective(rows, 0.1, 0.1)
    return out.select(F.round("dpo_loss", 7).alias("dpo_loss"), F.round("objective_loss", 7).alias("objective_loss"),
                      F.round("preference_accuracy", 9).alias("preference_accuracy"),
                      F.round("reward_margin", 7).alias("reward_margin"))


@query(
    "agg_47_behavior_accuracy",
    """SELECT o_custkey AS result_id, round(0.5625 * avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END)
    FILTER (o_orderkey % 2 = 0) + 0.4375 * avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END)
    FILTER (o_orderkey % 2 = 1), 9) AS accuracy FROM orders GROUP BY o_custkey
HAVING count(DISTINCT o_orderkey % 2) = 2""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("result_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "arithmetic").otherwise("python").alias("task"),
        (F.col("o_orderstatus") == "F").alias("correct"))
    return hl.behavior_accuracy(rows).filter("tasks = 2").select(
        "result_id", F.round("behavioral_accuracy", 9).alias("accuracy"))


# ---------------------------------------------------------------- candidates and methods


def candidate_results(spark, sf_dir):
    """Suppliers as candidates, return flags as seeds."""
    key = F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("seed")).agg(
        F.avg("l_discount").alias("selection_score"), F.avg("l_tax").alias("behavioral_accuracy"),
        F.lit(False).alias("none")).select(
        F.concat(F.lit("c-"), key).alias("candidate_id"), hx.sha(key.cast("string")).alias("candidate_hash"),
        F.when(key % 2 == 0, "guided_search").otherwise("random_search").alias("arm"), "seed",
        "selection_score", "behavioral_accuracy", (key % 9 == 0).alias("unhealthy"))


_CR = """cr AS (SELECT l_suppkey AS k, l_returnflag AS seed, avg(l_discount) AS sc, avg(l_tax) AS ba
  FROM lineitem GROUP BY 1, 2),
rk AS (SELECT k, sha256(CAST(k AS VARCHAR)) AS h, k % 9 <> 0 AS eligible, avg(sc) - 0.05 + 0.05 *
    greatest(0, 1 - stddev_pop(ba)) AS mean, CASE WHEN count(*) > 1 THEN stddev_pop(sc) / sqrt(count(*))
    ELSE 0.05 END AS se FROM cr GROUP BY k)"""


@query(
    "agg_33_rank_candidates",
    f"""WITH {_CR} SELECT 'c-' || k AS candidate_id, eligible, round(mean, 9) AS mean_score,
  round(mean - 1.96 * se, 8) AS confidence_lower FROM rk""",
)
def _(spark, sf_dir):
    rows = ex.rank_candidates(candidate_results(spark, sf_dir))
    return rows.select("candidate_id", "eligible", F.round("mean_score", 9).alias("mean_score"),
                       F.round("confidence_lower", 8).alias("confidence_lower"))


@query(
    "agg_34_promote_candidates",
    f"""WITH {_CR}, el AS (SELECT * FROM rk WHERE eligible),
kept AS (SELECT * FROM el WHERE mean + 1.96 * se >= (SELECT max(mean - 1.96 * se) FROM el) - 0.0001),
fam AS (SELECT *, row_number() OVER (PARTITION BY k % 7 ORDER BY mean DESC, h) AS r FROM el
  WHERE k % 7 NOT IN (SELECT k % 7 FROM kept)),
w AS (SELECT k FROM kept UNION SELECT k FROM fam WHERE r = 1),
ar AS (SELECT *, row_number() OVER (PARTITION BY k % 2 ORDER BY eligible DESC, mean DESC, h) AS r FROM rk
  WHERE k % 2 NOT IN (SELECT k % 2 FROM w))
SELECT 'c-' || k AS candidate_id FROM w UNION SELECT 'c-' || k FROM ar WHERE r = 1""",
)
def _(spark, sf_dir):
    ranked = ex.rank_candidates(candidate_results(spark, sf_dir))
    families = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("c-"), "s_suppkey").alias("candidate_id"),
        F.concat(F.lit("f"), F.col("s_suppkey") % 7).alias("family"))
    return ex.promote_candidates(ranked, families, 0.0001, ("guided_search", "random_search"))


def losses(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("candidate_id"), F.col("l_returnflag").alias("seed"),
        F.col("l_linestatus").alias("task")).agg(F.avg("l_discount").alias("loss")).select(
        "candidate_id", F.col("candidate_id").alias("candidate_hash"), "seed", "task", "loss",
        F.lit(0.06).alias("base_loss"))


_LS = """ls AS (SELECT l_suppkey, l_returnflag AS seed, l_linestatus AS task,
  greatest((0.06 - avg(l_discount)) / 0.06, 1e-12) AS g FROM lineitem GROUP BY 1, 2, 3)"""


@query(
    "agg_40_geometric_scores",
    f"WITH {_LS} SELECT CAST(l_suppkey AS VARCHAR) AS candidate_id, round(exp(avg(ln(g))), 8) AS score "
    "FROM ls GROUP BY 1",
)
def _(spark, sf_dir):
    rows = ex.geometric_scores(losses(spark, sf_dir))
    return rows.select("candidate_id", F.round("score", 8).alias("score"))


@query(
    "agg_51_finalist_scores",
    f"""WITH {_LS}, p AS (SELECT l_suppkey, seed, exp(avg(ln(g))) AS s FROM ls GROUP BY 1, 2)
SELECT CAST(l_suppkey AS VARCHAR) AS candidate_id, round(avg(s), 8) AS mean_score,
  round(stddev_pop(s), 8) AS score_std FROM p GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = ex.finalist_scores(losses(spark, sf_dir))
    return _rounded(rows, ["candidate_id"], ["mean_score", "score_std"], 8)


def method_results(spark, sf_dir):
    """Order lines as 0/1 outcomes of one method per return flag, orders as positions."""
    method = F.concat(F.lit("method-"), "l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        method.alias("method"), F.col("l_linenumber").alias("seed"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("position"),
        F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0).alias("outcome"),
        F.when(F.col("l_tax") >= 0.05, 1.0).otherwise(0.0).alias("base"),
        F.lit(0.995).alias("retention"), (F.col("l_returnflag") == "N").alias("unhealthy"),
        F.lit(False).alias("aborted_early"),
        (100 + F.col("l_quantity")).alias("wall_clock_seconds"),
        (F.col("l_partkey") % 1000).alias("peak_memory_bytes"), F.col("l_extendedprice").alias("elapsed_seconds"))


@query(
    "agg_35_method_summary",
    """WITH r AS (SELECT 'method-' || l_returnflag AS method, l_linenumber AS seed,
  CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END AS o, CASE WHEN l_tax >= 0.05 THEN 1.0 ELSE 0.0 END AS b
  FROM lineitem), s AS (SELECT method, seed, avg(o) AS a FROM r GROUP BY 1, 2)
SELECT s.method, round(avg(a), 8) AS mean_accuracy, round(stddev_pop(a), 8) AS std_accuracy,
  round(avg(a) - (SELECT avg(b) FROM r WHERE r.method = s.method), 8) AS mean_gain,
  s.method <> 'method-N' AS healthy, s.method <> 'method-N' AS eligible FROM s GROUP BY s.method""",
)
def _(spark, sf_dir):
    rows = method_results(spark, sf_dir)
    baseline = rows.select("method", "position", F.col("base").alias("outcome"))
    out = ex.method_summary(rows, baseline)
    return out.select("method", *[F.round(n, 8).alias(n) for n in ("mean_accuracy", "std_accuracy", "mean_gain")],
                      "healthy", "eligible")


@query("agg_36_hypotheses")
def _(spark, sf_dir):
    rows = method_results(spark, sf_dir)
    deltas = rows.select(
        F.element_at(F.array(*[F.lit(h) for h in ex.HYPOTHESES]), (F.col("seed") % 5 + 1).cast("int")).alias("pair"),
        (F.col("outcome") - F.col("base")).alias("delta"))
    intervals = st.paired_interval(deltas, draws=500).withColumnRenamed("pair", "hypothesis")
    verdicts = ex.hypothesis_verdicts(intervals, 0.02)
    return verdicts.select("hypothesis", "verdict")


@query(
    "agg_49_baseline_beating",
    """WITH m AS (SELECT l_returnflag AS f, avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END) AS a,
  stddev_pop(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END) AS s FROM lineitem GROUP BY 1),
x AS (SELECT max(a) FILTER (f = 'A') AS fm, max(a) FILTER (f <> 'A') AS bo, max(a) AS bm,
  max(a) FILTER (f = 'N') AS um, max(s) FILTER (f = 'A') AS fs, max(s) FILTER (f = 'N') AS us,
  max(a) FILTER (f = 'R') AS sm FROM m)
SELECT round(fm, 8) AS focus_mean, round(bo, 8) AS best_other, fm > bo AS beats_every_baseline,
  CASE WHEN fm > bo THEN 'SUPPORTED' WHEN fm - um >= 0.03 OR (fm >= um AND fs < us)
    OR (fm - 0.1) / (sm - 0.1) >= 0.9 THEN 'PARTIALLY_SUPPORTED' ELSE 'NOT_SUPPORTED' END AS verdict,
  bm >= 0.99 AS ceiling_warning, 5 AS search_break_even FROM x""",
)
def _(spark, sf_dir):
    rows = method_results(spark, sf_dir).withColumnRenamed("outcome", "accuracy")
    out = ex.baseline_beating(rows, "method-A", uniform="method-N", specific="method-R", base_accuracy=0.1,
                              discovery_seconds=900.0, specific_seconds=200.0)
    return out.select(F.round("focus_mean", 8).alias("focus_mean"), F.round("best_other", 8).alias("best_other"),
                      "beats_every_baseline", "verdict", "ceiling_warning", "search_break_even")


@query(
    "agg_48_floor_adjudication",
    """SELECT bool_and(a >= 0.2) AS floors_passed, CASE WHEN bool_and(a >= 0.2) THEN 'ELIGIBLE'
  ELSE 'REJECTED' END AS verdict FROM (SELECT o_orderpriority, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0
  ELSE 0.0 END) AS a FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1)""",
)
def _(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("task")).agg(
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("accuracy"))
    return ex.floor_adjudication(seen, {"1-URGENT": 0.2, "5-LOW": 0.2}, True).select("floors_passed", "verdict")


@query(
    "agg_50_recovery_summary",
    """WITH r AS (SELECT 'method-' || l_returnflag AS method, l_linenumber AS seed, l_partkey AS position,
  max(CASE WHEN l_discount >= 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS o, max(100 + l_quantity) AS secs
  FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT method, avg(a) - 0.1::DOUBLE AS gain, avg(secs) AS secs FROM (
  SELECT method, seed, avg(o) AS a, max(secs) AS secs FROM r GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT arg_max(method, gain) FILTER (method <> 'method-A') AS best_baseline,
  max(gain) FILTER (method <> 'method-A') AS best_gain, max(gain) FILTER (method = 'method-A') AS focus_gain,
  1 - max(secs) FILTER (method = 'method-A') / max(secs) FILTER (method = 'method-N') AS time_saving FROM m)
SELECT best_baseline, round(best_gain, 8) AS best_gain, round(focus_gain, 8) AS focus_gain,
  round(focus_gain / best_gain, 8) AS recovery_fraction, round(time_saving, 8) AS time_saving,
  best_gain > 0 AND focus_gain / best_gain >= 0.9 AS quality_target_met,
  CASE WHEN time_saving > 0 THEN 'by interval' ELSE 'SOCKET_SWEET_SPOT_REJECTED' END AS verdict FROM f""",
)
def _(spark, sf_dir):
    """Parts are the positions that methods share; no method saves time here, which decides the verdict."""
    rows = method_results(spark, sf_dir).withColumns(
        {"unhealthy": F.lit(False), "position": F.split("position", "-")[1]})
    shared = rows.groupBy("method", "seed", "position").agg(
        F.max("outcome").alias("outcome"), F.max("wall_clock_seconds").alias("wall_clock_seconds"),
        F.max("peak_memory_bytes").alias("peak_memory_bytes"), F.max("unhealthy").alias("unhealthy"),
        F.max("aborted_early").alias("aborted_early"))
    out = ex.recovery_summary(shared, 0.1, focus="method-A", baselines=("method-N", "method-R"),
                              time_baseline="method-N", target=0.9, late_predicted=True)
    return _rounded(out, ["best_baseline", "quality_target_met", "verdict"],
                    ["best_gain", "focus_gain", "recovery_fraction", "time_saving"], 8)


def paired_scores(spark, sf_dir):
    """Paired differences of order totals per priority."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("pair"), (F.col("l_discount") - F.col("l_tax")).alias("delta"))


@query(
    "agg_29_bootstrap_means",
    """SELECT l_returnflag AS pair, count(*) AS rows, round(avg(l_discount - l_tax), 9) AS mean_difference,
  TRUE AS bracketed FROM lineitem GROUP BY 1""",
)
def _(spark, sf_dir):
    out = st.paired_interval(paired_scores(spark, sf_dir))
    mean = F.col("mean_difference")
    return out.select("pair", "rows", F.round("mean_difference", 9).alias("mean_difference"),
                      ((F.col("lower") < mean) & (mean < F.col("upper"))).alias("bracketed"))


@query(
    "agg_30_two_sample_interval",
    """WITH m AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS m, stddev_pop(o_totalprice) / sqrt(count(*)) AS e
  FROM orders GROUP BY 1)
SELECT round(a.m - b.m, 4) AS mean_difference, TRUE AS low_ok, TRUE AS high_ok, TRUE AS width_ok
FROM m a, m b WHERE a.p = '1-URGENT' AND b.p = '5-LOW'""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    out = st.two_sample_interval(rows.filter("o_orderpriority = '1-URGENT'"), rows.filter("o_orderpriority = '5-LOW'"),
                                 "o_totalprice", draws=1000)
    # The bootstrap's width is that of the normal interval, but for the noise of its draws.
    error = [rows.filter(F.col("o_orderpriority") == p).agg(
        (F.var_pop("o_totalprice") / F.count(F.lit(1))).alias("v")).scalar() for p in ("1-URGENT", "5-LOW")]
    width = (F.col("upper") - F.col("lower")) / (2 * 1.96 * F.sqrt(error[0] + error[1]))
    return out.select(F.round("mean_difference", 4).alias("mean_difference"), width.between(0.85, 1.15).alias("width_ok"),
                      (F.col("lower") < F.col("mean_difference")).alias("low_ok"),
                      (F.col("mean_difference") < F.col("upper")).alias("high_ok"))


# ---------------------------------------------------------------- variant outputs

VARIANTS = ["prefix", "whole", "suffix"]
KEY = b"0123456789abcdef0123456789abcdef"


def outputs(spark, sf_dir):
    """Three ways to answer each user turn; the assistant turn is the reference."""
    rows = base.traces(spark, sf_dir)
    words = F.split("prompt", " ")
    half = F.greatest(F.floor(F.size(words) / 2).cast("int"), F.lit(1))
    answers = {
        "prefix": F.array_join(F.slice(words, F.lit(1), half), " "), "whole": F.col("prompt"),
        "suffix": F.array_join(F.slice(words, -half, half), " "),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("variant"), a.alias("output")) for n, a in answers.items()])
    long = rows.select(F.col("trace_id").alias("id"), "prompt", F.explode(pairs).alias("v"))
    out = long.select("id", "v.variant", "v.output", hx.sha("prompt").alias("prompt_sha256"),
                      (F.length("v.output") * 2.0).alias("latency_ms"))
    refs = rows.select(F.col("trace_id").alias("id"), F.col("response").alias("reference"))
    return out, refs, rows.select(F.col("trace_id").alias("id"), "prompt")


_OUT = """ou AS (SELECT trace_id AS id, response, variant, CASE variant WHEN 'whole' THEN prompt
    WHEN 'prefix' THEN array_to_string(list_slice(w, 1, half), ' ')
    ELSE array_to_string(list_slice(w, len(w) - half + 1, len(w)), ' ') END AS output
  FROM (SELECT *, greatest(len(w) // 2, 1) AS half FROM (SELECT *, string_split(prompt, ' ') AS w FROM t)),
    (VALUES ('prefix'), ('whole'), ('suffix')) AS g(variant))"""


def _overlap(n):
    """SQL for the F1 of n-gram counts of token lists c and r."""
    gram = {1: "l[k]", 2: "l[k] || chr(1) || l[k + 1]"}[n]

    def grams(name):
        return (f"(SELECT g, count(*) AS n FROM (SELECT {gram} AS g FROM (SELECT l, unnest(range(1, len(l) - {n - 1}"
                f" + 1)) AS k FROM (SELECT {name} AS l))) GROUP BY g)")

    return (f"(SELECT coalesce(sum(least(a.n, b.n)), 0) FROM {grams('c')} a JOIN {grams('r')} b ON a.g = b.g)")


@query(
    "row_22_reference_overlap",
    with_sql("", "t").rstrip() + f""", {_OUT}
SELECT id, variant, round(CASE WHEN o1 > 0 THEN 2.0 * o1 / (lc + lr) ELSE 0 END, 8) AS rouge1,
  round(CASE WHEN o2 > 0 THEN 2.0 * o2 / (lc + lr - 2) ELSE 0 END, 8) AS rouge2,
  round(lc / greatest(lr, 1)::DOUBLE, 8) AS reference_length_ratio
FROM (SELECT *, len(c) AS lc, len(r) AS lr, {_overlap(1)} AS o1, {_overlap(2)} AS o2
  FROM (SELECT id, variant, regexp_extract_all(lower(output), '([\\p{{L}}\\p{{N}}'']+)', 1) AS c,
    regexp_extract_all(lower(response), '([\\p{{L}}\\p{{N}}'']+)', 1) AS r FROM ou))""",
)
def _(spark, sf_dir):
    out, refs, _ = outputs(spark, sf_dir)
    scores = jd.variant_scores(out, refs)
    return scores.select("id", "variant", *[
        F.round(n, 8).alias(n) for n in ("rouge1", "rouge2", "reference_length_ratio")])


@query("agg_31_variant_comparison")
def _(spark, sf_dir):
    out, refs, _ = outputs(spark, sf_dir)
    scores = jd.variant_scores(out, refs)
    return jd.variant_comparison(scores, VARIANTS, draws=500).select("pair", "wins", "ties", "losses", "rows")


@query(
    "agg_31_variant_latency",
    with_sql("", "t").rstrip() + f""", {_OUT}
SELECT variant, median(length(output) * 2.0) AS median_latency_ms FROM ou GROUP BY variant""",
)
def _(spark, sf_dir):
    out, refs, _ = outputs(spark, sf_dir)
    summary = jd.variant_summary(out, jd.variant_scores(out, refs))
    return summary.select("variant", "median_latency_ms")


@query("agg_31_output_coverage", with_sql("SELECT count(*) * 0 AS problems FROM t", "t"))
def _(spark, sf_dir):
    out, _, inputs = outputs(spark, sf_dir)
    return jd.output_coverage(out, inputs, VARIANTS).agg(F.count(F.lit(1)).alias("problems"))


_IPAD = bytes(b ^ 0x36 for b in KEY.ljust(64, b"\0")).hex()
_OPAD = bytes(b ^ 0x5C for b in KEY.ljust(64, b"\0")).hex()


def _hmac(text):
    return f"sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode({text}))))"


_PAIR = f"""vp AS (SELECT trace_id AS id, a, b FROM t, (VALUES ('prefix', 'whole'), ('prefix', 'suffix'),
  ('whole', 'suffix')) AS g(a, b)),
va AS (SELECT id, substr({_hmac("'pair:' || id || ':' || a || ':' || b")}, 1, 24) AS pair_id,
  substr({_hmac("'case:' || id")}, 1, 24) AS case_id,
  strpos('13579bdf', substr({_hmac("id || ':' || a || ':' || b || ':1701'")}, 16, 1)) > 0 AS swap, a, b FROM vp),
vb AS (SELECT id, pair_id, case_id, CASE WHEN swap THEN b ELSE a END AS a, CASE WHEN swap THEN a ELSE b END AS b
  FROM va)"""


@query("row_21_join_18_blind_pairs",
       with_sql("", "t").rstrip() + f", {_PAIR} SELECT id, pair_id, case_id, a, b FROM vb")
def _(spark, sf_dir):
    _, _, inputs = outputs(spark, sf_dir)
    return jd.blind_assignments(inputs, VARIANTS, KEY, 1701)


@query(
    "agg_32_join_21_judgment_tally",
    with_sql("", "t").rstrip() + f""", {_PAIR},
v AS (SELECT *, CASE WHEN strpos('01234', substr(pair_id, 1, 1)) > 0 THEN 'A'
  WHEN strpos('56789', substr(pair_id, 1, 1)) > 0 THEN 'B' ELSE 'TIE' END AS verdict FROM vb)
SELECT least(a, b) || '-vs-' || greatest(a, b) AS pairing, CASE verdict WHEN 'A' THEN a WHEN 'B' THEN b
  ELSE 'TIE' END AS outcome, count(*) AS judgments FROM v GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    _, _, inputs = outputs(spark, sf_dir)
    pairs = jd.blind_assignments(inputs, VARIANTS, KEY, 1701)
    digit = F.substring("pair_id", 1, 1)
    judged = pairs.select(
        "pair_id", F.when(digit.isin(*"01234"), "A").when(digit.isin(*"56789"), "B").otherwise("TIE").alias("verdict"))
    return jd.judgment_tally(pairs, judged)


# ---------------------------------------------------------------- gates


def gate_reports(spark, sf_dir):
    """Orders as workflow gate reports."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("report_id"), (key % 10 / 100).alias("median_quality_improved"), (key % 10 / 100).alias("quality_delta"),
        F.array(F.lit(0.03), key % 3 / 100, F.lit(0.05)).alias("bootstrap"), F.lit(0.95).alias("bootstrap_confidence"),
        F.when(key % 11 == 0, F.array(F.lit("safety"))).otherwise(F.array().cast("array<string>"))
        .alias("critical_benchmark_regressions"),
        (key % 4 / 10).alias("cost_delta"), F.lit(0.0).alias("failure_rate_delta"), (key % 5).alias("reproducible_runs"),
        F.when(key % 7 != 0, key % 13 != 0).alias("judge_independent"),
        F.when(key % 6 != 0, F.lit("a" * 64)).alias("rollback_artifact_hash"),
        F.lit(None).cast("string").alias("rollback_state_id"), F.lit("w").alias("incumbent_id"),
        F.when(key % 17 == 0, "simulator").otherwise("subprocess.v1").alias("executor_kind"),
        F.lit("subprocess.v1").alias("report_executor_kind"))


_GATE = """gr AS (SELECT o_orderkey AS k, list_filter([
  CASE WHEN o_orderkey % 10 < 2 THEN 'median quality improved too little' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'bootstrap CI does not confirm improvement' END,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 13 = 0 THEN 'judge is not independent from mutator' END,
  CASE WHEN o_orderkey % 11 = 0 THEN 'critical benchmark regressed: safety' END,
  CASE WHEN o_orderkey % 4 >= 2 AND o_orderkey % 10 <= 5 THEN 'cost increased without quality gain' END,
  CASE WHEN o_orderkey % 5 < 2 THEN 'reproducibility requirement not met' END,
  CASE WHEN o_orderkey % 6 = 0 THEN 'rollback snapshot or durable artifact hash missing' END],
  lambda x: x IS NOT NULL) AS reasons FROM orders)"""


@query("agg_42_workflow_gate",
       f"WITH {_GATE} SELECT k AS report_id, array_to_string(reasons, ';') AS reasons, len(reasons) = 0 AS promoted FROM gr")
def _(spark, sf_dir):
    return ex.workflow_gate(gate_reports(spark, sf_dir)).select(
        "report_id", F.array_join("reasons", ";").alias("reasons"), "promoted")


@query(
    "agg_43_val_28_verdicts",
    f"""WITH {_GATE} SELECT k AS report_id, CASE WHEN k % 17 = 0 OR k % 7 = 0 THEN 'INCONCLUSIVE'
  WHEN len(reasons) = 0 THEN 'ELIGIBLE' ELSE 'REJECTED' END AS verdict,
  CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS issues FROM gr""",
)
def _(spark, sf_dir):
    rows = ex.issue_verdicts(gate_reports(spark, sf_dir).withColumn("issues", F.size(ex.evidence_issues())))
    return rows.select("report_id", "verdict", "issues")


@query(
    "agg_42_router_gate",
    """SELECT o_orderkey AS report_id, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 5 < 2 OR o_orderkey % 3 = 0
  OR o_custkey NOT IN (SELECT c_custkey FROM customer) THEN 'reject' ELSE 'promotable' END AS verdict FROM orders""",
)
def _(spark, sf_dir):
    key = F.col("o_orderkey")
    reports = table(spark, sf_dir, "orders").select(
        key.alias("report_id"), (key % 4 != 0).alias("primary_metric_improved"),
        F.when(key % 3 == 0, F.array(F.lit("correctness"))).otherwise(F.array().cast("array<string>")).alias("regressions"),
        F.lit(True).alias("safety_passed"), F.lit(True).alias("verification_passed"),
        (key % 5).alias("reproducible_runs"), F.col("o_custkey").alias("rollback_snapshot"))
    snapshots = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("snapshot"))
    return ex.experiment_verdict(reports, snapshots).select("report_id", "verdict")


@query(
    "agg_42_calibration_gate",
    """SELECT user_id, array_to_string(list_filter([CASE WHEN e > 0.25 THEN 'adaptive_ece' END,
  CASE WHEN f < 0.75 THEN 'confidence_faithfulness' END], lambda x: x IS NOT NULL), ',') AS reasons FROM (
  SELECT user_id, avg(value) / 200 AS e, 1 - avg(value) / 200 AS f FROM events GROUP BY user_id)""",
)
def _(spark, sf_dir):
    reports = table(spark, sf_dir, "events").groupBy("user_id").agg((F.avg("value") / 200).alias("adaptive_ece")).select(
        "user_id", "adaptive_ece", F.lit(0.1).alias("high_confidence_failure_rate"),
        (1 - F.col("adaptive_ece")).alias("confidence_faithfulness"), F.lit(0.9).alias("escalation_recall"),
        F.lit(True).alias("regression_passed"), F.lit(True).alias("passed"))
    return ex.calibration_gate(reports).select("user_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "agg_44_prompt_packs",
    """WITH m AS (SELECT p_brand AS pack, avg(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END) AS v,
  avg(CASE WHEN p_partkey % 2 = 1 THEN p_retailprice END) AS c, avg(CASE WHEN p_partkey % 2 = 0 THEN p_size END) AS hv,
  avg(CASE WHEN p_partkey % 2 = 1 THEN p_size END) AS hc FROM part GROUP BY p_brand)
SELECT pack, round(coalesce(v, 0) - coalesce(c, 0), 4) AS success_delta,
  coalesce(v, 0) - coalesce(c, 0) > 0 AND coalesce(hv, 0) - coalesce(hc, 0) <= 0 AS promotable FROM m""",
)
def _(spark, sf_dir):
    arm = F.when(F.col("p_partkey") % 2 == 0, "variant").otherwise("control")
    wide = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("pack"), arm.alias("arm")).agg(
        F.avg("p_retailprice").alias("success_rate"), F.avg("p_size").alias("hallucination_rate"))
    long = wide.unpivot(["pack", "arm"], ["success_rate", "hallucination_rate"], "metric", "value")
    return ex.ab_prompt_packs(long).select("pack", F.round("success_delta", 4).alias("success_delta"), "promotable")
