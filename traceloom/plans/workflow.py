"""Queries over execution logs, workflow registries and benchmark runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import jsonx as jx
from traceloom.operators import routing as rt
from traceloom.operators import workflow as wf
from traceloom.plans import base
from traceloom.plans.base import query, table, with_sql
from traceloom.sources import registry


@query(
    "val_27_event_problems",
    with_sql("""SELECT event_id, CASE WHEN event_type = 'SIGNUP' THEN 'event_type is not known'
  ELSE 'latency_ms must be a non-negative number' END AS problem FROM e0
WHERE event_type = 'SIGNUP' OR latency_ms < 0""", "e"),
)
def _(spark, sf_dir):
    return wf.event_problems(base.raw_event_log(spark, sf_dir)).select("event_id", "problem")


@query(
    "win_11_session_contiguity",
    with_sql("SELECT session_id, count(*) AS events, bool_and(user_ok) AS contiguous FROM "
             "(SELECT session_id, TRUE AS user_ok FROM e) GROUP BY session_id", "e"),
)
def _(spark, sf_dir):
    return wf.session_contiguity(base.event_log(spark, sf_dir))


@query(
    "val_27_replay_hashes",
    with_sql("SELECT count(DISTINCT session_id) AS sessions, TRUE AS clock_free FROM e", "e"),
)
def _(spark, sf_dir):
    log = base.event_log(spark, sf_dir)
    one = wf.replay_hashes(log, block=32)
    later = log.withColumns({"latency_ms": F.col("latency_ms") + 5, "cost_usd": F.lit(0.0)})
    two = wf.replay_hashes(later, block=32).withColumnRenamed("replay_hash", "again")
    return one.join(two, "session_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.bool_and(F.col("replay_hash") == F.col("again")).alias("clock_free"))


@query(
    "agg_24_execution_metrics",
    with_sql("""SELECT workflow_id, count(DISTINCT session_id) AS session_count,
  count(*) FILTER (kind = 'action') AS action_proposal_count,
  round(count(*) FILTER (kind = 'action' AND accepted)::DOUBLE / count(*) FILTER (kind = 'action'), 9) AS step_adherence,
  round(1 - count(*) FILTER (violation = 'step_order_violation')::DOUBLE / count(*) FILTER (kind = 'action'), 9)
    AS order_adherence,
  round(count(*) FILTER (violation IS NOT NULL)::DOUBLE / count(*) FILTER (kind = 'action'), 9) AS invariant_violation_rate,
  round(count(DISTINCT session_id) FILTER (state_after = 'COMPLETED')::DOUBLE / count(DISTINCT session_id), 9)
    AS long_horizon_completion_rate,
  count(teacher_correction) AS teacher_correction_count FROM e GROUP BY workflow_id""", "e"),
)
def _(spark, sf_dir):
    out = wf.execution_metrics(base.raw_event_log(spark, sf_dir), ["workflow_id"])
    rates = ("step_adherence", "order_adherence", "invariant_violation_rate", "long_horizon_completion_rate")
    return out.select("workflow_id", "session_count", "action_proposal_count", "teacher_correction_count",
                      *[F.round(n, 9).alias(n) for n in rates])


@query(
    "win_07_next_action_examples",
    with_sql("""SELECT a.event_id, coalesce(a.teacher_correction, a.expected_action) AS next_action,
  a.teacher_correction IS NOT NULL AS teacher_corrected, o.verifier FROM e a LEFT JOIN (
  SELECT session_id, verifier, last_action FROM (SELECT *, max(CASE WHEN kind = 'action' AND accepted
      THEN event_index END) OVER w AS last_action, max(CASE WHEN kind = 'observation' THEN event_index END) OVER w
      AS last_obs FROM e WINDOW w AS (PARTITION BY session_id ORDER BY event_index
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    WHERE kind = 'observation' AND verifier IS NOT NULL AND last_action > coalesce(last_obs, -1)) o
  ON o.session_id = a.session_id AND o.last_action = a.event_index WHERE a.kind = 'action'""", "e"),
)
def _(spark, sf_dir):
    rows = wf.next_action_examples(base.event_log(spark, sf_dir))
    return rows.select("event_id", "next_action", "teacher_corrected", "verifier")


@query(
    "snk_08_export_summary",
    with_sql("""SELECT count(*) AS row_count, bool_or(NOT accepted) AS includes_negative_examples,
  bool_or(teacher_correction IS NOT NULL) AS includes_teacher_corrections FROM e WHERE kind = 'action'""", "e"),
)
def _(spark, sf_dir):
    out = wf.export_summary(wf.next_action_examples(base.event_log(spark, sf_dir)))
    return out.select("row_count", "includes_negative_examples", "includes_teacher_corrections")


@query(
    "snk_11_append_index",
    with_sql("""SELECT event_id, coalesce(m, -1) + row_number() OVER (PARTITION BY session_id ORDER BY event_id)
  AS event_index FROM e0 LEFT JOIN (SELECT session_id, count(*) - 1 AS m FROM e0 WHERE event_type = 'TOOL_CALL'
  GROUP BY 1) USING (session_id) WHERE event_type <> 'TOOL_CALL'""", "e"),
)
def _(spark, sf_dir):
    log = base.raw_event_log(spark, sf_dir)
    old = log.filter("event_type = 'TOOL_CALL'")
    stored = old.groupBy("session_id").agg((F.count(F.lit(1)) - 1).alias("event_index"))
    fresh = log.filter("event_type <> 'TOOL_CALL'").select("session_id", "event_id")
    return wf.append_indexed(stored, fresh, "event_id").select("event_id", "event_index")


@query(
    "src_09_event_read",
    """SELECT event_id, replace(props, ' ', '') AS proposal, '[]' AS violations FROM events WHERE user_id = 7""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("session-"), "user_id").alias("session_id"), F.col("props").alias("proposal"),
        F.lit("{broken").alias("violations"))
    out = registry.execution_events(rows, "session-7")
    return out.select("event_id", F.to_json("proposal").alias("proposal"), F.to_json("violations").alias("violations"))


def workflows(spark, sf_dir):
    """Parts as workflow versions of their brand, triggers from type and name."""
    words = F.split("p_name", " ")
    key = F.col("p_partkey")

    def when(condition, value):
        return F.array_compact(F.array(F.when(condition, value)))

    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("workflow_id"), key.alias("version"), F.col("p_type").alias("category"),
        F.when(F.substring("p_brand", -1, 1) == "7", "retired").otherwise("active").alias("status"),
        when(key % 2 == 0, F.lower("p_type")).alias("task_types"), when(F.lit(True), F.upper(words[0])).alias("languages"),
        F.array().cast("array<string>").alias("error_classes"), when(key % 3 == 0, words[1]).alias("required_tools"),
        when(key % 5 == 0, F.lit("high")).alias("risk_levels"), when(key % 4 == 0, F.lit("src/")).alias("repository_paths"),
        F.array(words[1]).alias("keywords"))


def workflow_tasks(spark, sf_dir):
    words = F.split("p_name", " ")
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("task_id"), F.lower("p_type").alias("task_type"), words[0].alias("language"),
        F.lit("none").alias("error_class"), F.array(F.upper(words[1])).alias("required_tools"),
        F.when(key % 7 == 0, "high").otherwise("low").alias("risk_level"),
        F.array(F.when(key % 2 == 0, "src/a.py").otherwise("doc/a.md")).alias("repository_paths"),
        F.concat(F.lit("Fix the "), "p_name").alias("text"))


@query(
    "src_10_win_03_newest_versions",
    "SELECT p_brand AS workflow_id, max(p_partkey) AS version FROM part GROUP BY 1",
)
def _(spark, sf_dir):
    newest = registry.newest_version(registry.workflow_versions(workflows(spark, sf_dir)))
    return newest.select("workflow_id", "version")


@query(
    "join_19_top_02_workflow_routes",
    """WITH nw AS (SELECT p.*, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2 FROM part p
  WHERE p_partkey IN (SELECT max(p_partkey) FROM part GROUP BY p_brand) AND right(p_brand, 1) <> '7'),
tk AS (SELECT p.*, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2 FROM part p),
sc AS (SELECT tk.p_partkey AS task_id, nw.p_brand AS wid,
  6.0 * CAST(nw.p_partkey % 2 = 0 AND nw.p_type = tk.p_type AS INT) + 3.0 * CAST(nw.w1 = tk.w1 AS INT)
  + 2.0 * CAST(nw.p_partkey % 3 = 0 AND nw.w2 = tk.w2 AS INT)
  + 2.0 * CAST(nw.p_partkey % 5 = 0 AND tk.p_partkey % 7 = 0 AS INT)
  + 4.0 * CAST(nw.p_partkey % 4 = 0 AND tk.p_partkey % 2 = 0 AS INT)
  + 1.0 * CAST(contains('fix the ' || tk.p_name, nw.w2) AS INT) AS score FROM tk CROSS JOIN nw),
rk AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, wid) AS r FROM sc WHERE score > 0),
ag AS (SELECT task_id, string_agg(wid || '=' || CAST(CAST(score AS INT) AS VARCHAR), ',' ORDER BY r) AS top,
  max(score) FILTER (r = 1) AS s1, max(score) FILTER (r = 2) AS s2, sum(score) AS t FROM rk WHERE r <= 3 GROUP BY 1)
SELECT p_partkey AS task_id, coalesce(top, '') AS top, round(coalesce(s1 / t, 0), 6) AS confidence,
  p_partkey % 7 = 0 OR top IS NULL OR s1 / t < 0.55 OR coalesce(s1 - s2 < 1, FALSE) AS teacher_required
FROM part LEFT JOIN ag ON ag.task_id = p_partkey""",
)
def _(spark, sf_dir):
    out = rt.workflow_routes(workflow_tasks(spark, sf_dir), workflows(spark, sf_dir))
    shown = F.transform("candidates", lambda c: F.concat_ws("=", c["workflow_id"], c["score"].cast("int").cast("string")))
    return out.select("task_id", F.array_join(shown, ",").alias("top"), F.round("confidence", 6).alias("confidence"),
                      "teacher_required")


def audited(spark, sf_dir):
    """Events as proposals against a one-step-per-workflow registry."""
    key = F.col("event_id")
    none = F.array().cast("array<string>")
    log = base.raw_event_log(spark, sf_dir).select(
        "session_id", key.alias("sequence"), "workflow_id", F.lit("s1").alias("expected_step_id"),
        F.when(key % 5 == 0, "s2").otherwise("s1").alias("step_id"), F.lit("tool").alias("action_type"),
        F.when(key % 7 == 0, "shell").otherwise("edit").alias("tool"),
        F.when(key % 3 == 0, F.create_map(F.lit("path"), F.lit("etc/x")))
        .when(key % 3 == 1, F.create_map(F.lit("path"), F.lit("src/x"), F.lit("mode"), F.lit("w")))
        .otherwise(F.create_map(F.lit("path"), F.lit("src/../x"), F.lit("mode"), F.lit("r"))).alias("arguments"),
        F.when(key % 2 == 0, F.array(F.lit("planned"))).otherwise(none).alias("flags"), none.alias("evidence"),
        F.lit("READY").alias("status"), (key % 40).alias("action_count"))
    ids = log.select("workflow_id").distinct()
    steps = ids.select("workflow_id", F.lit("s1").alias("expected_step_id"), F.lit("tool").alias("want_action_type"),
                       F.lit("edit").alias("want_tool"), F.array(F.lit("planned")).alias("requires"),
                       F.create_map(F.lit("mode"), F.lit("w")).alias("want_arguments"))
    rules = ids.select("workflow_id", F.array(F.lit("edit")).alias("allowed_tools"),
                       F.array(F.lit("src/")).alias("path_prefixes"), none.alias("required_evidence"),
                       F.lit(38).alias("max_actions"),
                       F.create_map(F.lit("shell"), F.array(F.lit("approved"))).alias("tool_requirements"))
    return wf.conformance(log, steps, rules)


@query(
    "val_29_conformance",
    """SELECT event_id AS sequence, array_to_string(list_filter([
  CASE WHEN event_id % 40 >= 38 THEN 'action_budget_exhausted' END,
  CASE WHEN event_id % 5 = 0 THEN 'step_order_violation' END,
  CASE WHEN event_id % 2 = 1 THEN 'missing_step_requirements:planned' END,
  CASE WHEN event_id % 7 = 0 THEN 'tool_selection_violation' END,
  CASE WHEN event_id % 7 = 0 THEN 'tool_not_allowed' END,
  CASE WHEN event_id % 7 = 0 THEN 'tool_guard_violation:approved' END,
  CASE event_id % 3 WHEN 0 THEN 'argument_missing:mode' WHEN 2 THEN 'argument_constraint_violation:mode' END,
  CASE WHEN event_id % 3 <> 1 THEN 'path_not_allowed:path' END], lambda x: x IS NOT NULL), ';') AS violations
FROM events""",
)
def _(spark, sf_dir):
    return audited(spark, sf_dir).select("sequence", F.array_join("violations", ";").alias("violations"))


def case_results(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (key % 4).alias("run_index"), F.col("o_orderpriority").alias("category"),
        (F.col("o_orderstatus") != "F").alias("passed"), (key % 5 != 0).alias("verifier_succeeded"),
        F.col("o_totalprice").alias("latency_ms"), (key % 3 + 1).alias("attempts"))


@query(
    "agg_25_run_rollup",
    """WITH c AS (SELECT o_orderkey % 4 AS run_index, CASE WHEN o_orderstatus <> 'F' THEN 1.0 ELSE 0.0 END AS ok,
  CASE WHEN o_orderkey % 5 <> 0 THEN 1.0 ELSE 0.0 END AS v, o_totalprice AS l, o_orderkey % 3 > 0 AS retried FROM orders)
SELECT run_index, round(avg(ok), 9) AS quality, round(avg(v), 9) AS verifier_agreement, round(avg(l), 4) AS latency,
  round((SELECT avg(ok) FROM c WHERE retried), 9) AS robustness FROM c GROUP BY run_index""",
)
def _(spark, sf_dir):
    runs, _ = wf.benchmark_rollup(case_results(spark, sf_dir))
    return runs.select("run_index", F.round("quality", 9).alias("quality"),
                       F.round("verifier_agreement", 9).alias("verifier_agreement"),
                       F.round("latency", 4).alias("latency"), F.round("robustness", 9).alias("robustness"))


@query(
    "agg_25_category_rollup",
    """SELECT lower(o_orderpriority) AS category, round(avg(CASE WHEN o_orderstatus <> 'F' THEN 1.0 ELSE 0.0 END), 9)
  AS quality, count(*) AS case_count FROM orders GROUP BY 1""",
)
def _(spark, sf_dir):
    _, categories = wf.benchmark_rollup(case_results(spark, sf_dir))
    return categories.select("category", F.round("quality", 9).alias("quality"), "case_count")


@query(
    "agg_26_median_delta",
    """SELECT o_custkey AS task_id, round(median(o_totalprice) FILTER (o_orderkey % 2 = 1)
  - median(o_totalprice) FILTER (o_orderkey % 2 = 0), 4) AS median_quality_delta FROM orders GROUP BY 1""",
)
def _(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task_id"), F.when(F.col("o_orderkey") % 2 == 1, "challenger").otherwise("incumbent")
        .alias("side"), F.col("o_totalprice").alias("quality"))
    return wf.median_delta(runs).withColumn("median_quality_delta", F.round("median_quality_delta", 4))


@query(
    "agg_27_critical_regressions",
    """SELECT p_brand AS category, round(a - b, 6) AS drop FROM (SELECT p_brand,
  avg(p_size) FILTER (p_partkey % 2 = 0) AS a, avg(p_size) FILTER (p_partkey % 2 = 1) AS b FROM part GROUP BY 1)
WHERE a - b > 1""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), "p_partkey", "p_size")
    side = lambda rest: rows.filter(F.col("p_partkey") % 2 == rest).groupBy("category").agg(F.avg("p_size").alias("quality"))
    return wf.critical_regressions(side(0), side(1), 1.0).withColumn("drop", F.round("drop", 6))


@query(
    "agg_28_best_candidate",
    """SELECT l_partkey || '-' || l_orderkey || '-' || l_suppkey AS candidate_id, l_quantity AS score FROM lineitem
ORDER BY l_quantity DESC, l_extendedprice, l_partkey LIMIT 1""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_partkey", "l_orderkey", "l_suppkey").alias("candidate_id"),
        F.col("l_quantity").alias("score"), F.col("l_extendedprice").alias("cost"))
    return wf.best_candidate(rows)


@query(
    "agg_07_reproducible_runs",
    """SELECT 'latency_ms' AS metric, count(*) AS reproducible_runs FROM (SELECT o_custkey, avg(o_totalprice)
  FILTER (o_orderkey % 2 = 0) AS c, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS v FROM orders GROUP BY 1)
WHERE v <= c""",
)
def _(spark, sf_dir):
    from traceloom.operators.metrics import reproducible_runs

    long = table(spark, sf_dir, "orders").groupBy(
        "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "control").otherwise("variant").alias("arm")).agg(
        F.avg("o_totalprice").alias("value")).withColumn("metric", F.lit("latency_ms"))
    return reproducible_runs(long, "o_custkey")


@query("val_27_payload_fields", "SELECT event_id, TRUE AS object FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", jx.is_object(jx.parse("props")).alias("object"))
