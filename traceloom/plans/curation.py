"""Queries over datasets: builders, synthetic rows, splits, registry tables, suite checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import hashing as hx
from traceloom.functions import jsonx as jx
from traceloom.functions import text as tx
from traceloom.operators import calibration, datasets, health, labeling
from traceloom.plans import base
from traceloom.plans.base import WS, query, table, with_sql
from traceloom.plans.traces import REDACT
from traceloom.sources import registry

# ---------------------------------------------------------------- builders

_TYPES = ("critic", "local-recipe-verifier", "failure-classifier", "local-critic", "prompt")


@query(
    "ds_01_typed_rows",
    with_sql("", "t", "tl", "ts").rstrip() + """,
n AS (SELECT *, row_number() OVER (ORDER BY trace_id) AS i FROM ts),
y AS (SELECT * FROM (VALUES ('critic', 'critic', 'critique_trace_quality'),
  ('local-recipe-verifier', 'local_recipe_verifier', 'verify_dataset_recipe'),
  ('failure-classifier', 'failure_classifier', 'classify_trace_outcome'),
  ('local-critic', 'local_critic', NULL), ('prompt', 'prompt', 'improve_prompt'))
  AS g(dataset_type, slug, target))
SELECT slug || '_' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0')
    ELSE CAST(i AS VARCHAR) END AS id, dataset_type,
  trace_id AS source_trace_id, CASE WHEN run_id = 0 THEN '0' ELSE CAST(run_id AS VARCHAR) END
  AS source_run_id, privacy_status, prompt AS input, response AS output, label,
  round(quality_score, 9) AS score, target FROM n CROSS JOIN y""",
)
def _(spark, sf_dir):
    rows = datasets.typed_rows(base.scored(spark, sf_dir), list(_TYPES))
    return rows.withColumn("score", F.round("score", 9))


@query(
    "ds_02_local_training",
    with_sql("SELECT 42 * count(*) AS n, 42 AS dataset_types FROM t", "t"),
)
def _(spark, sf_dir):
    rows = datasets.local_training_rows(base.scored(spark, sf_dir), opt_in=True)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dataset_type").alias("dataset_types"))


@query(
    "ds_03_router_rows",
    with_sql("", "t", "tl", "ts").rstrip() + """
SELECT CAST(trace_id AS VARCHAR) AS source_trace_id, coalesce(objective, prompt) AS task,
  agent_id AS worker, provider, model, label, cost_usd, CAST(trunc(latency_ms) AS BIGINT)
  AS latency_ms, privacy_status, trace_type FROM ts""",
)
def _(spark, sf_dir):
    rows = datasets.router_rows(base.scored(spark, sf_dir))
    return rows.select(
        "source_trace_id", "task", F.col("output.worker").alias("worker"), "provider", "model",
        "label", "cost_usd", "latency_ms", "privacy_status",
        F.col("provenance.trace_type").alias("trace_type"))


@query(
    "ds_04_performance_rows",
    with_sql("""SELECT coalesce(objective, prompt) AS task, model AS selected_model, provider,
  label AS result, round(quality_score, 9) AS score, cost_usd, latency_ms FROM ts""",
             "t", "tl", "ts"),
)
def _(spark, sf_dir):
    from traceloom.operators.metrics import performance_rows

    return performance_rows(base.scored(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(
    "ds_05_training_candidates",
    with_sql(f"""SELECT 'candidate_' || trace_id AS id, {REDACT.format('task_id')} AS task,
  {REDACT.format('prompt')} AS input, label, round(training_value_score, 9) AS score,
  replace(trace_type, '_trace', '') AS use_for,
  CASE WHEN label <> 'accepted' THEN label END AS failure_notes FROM ts""", "t", "tl", "ts"),
)
def _(spark, sf_dir):
    rows = datasets.training_candidates(base.scored(spark, sf_dir))
    return rows.select("id", "task", "input", "label", F.round("score", 9).alias("score"),
                       F.col("use_for")[0].alias("use_for"), "failure_notes")


@query(
    "ds_10_output_preferences",
    """WITH u AS (SELECT conv_id * 16 + turn AS id, conv_id, turn, text FROM conversations),
w AS (SELECT *, array_to_string(regexp_extract_all(lower(text), '([\\p{L}\\p{N}'']+)', 1), ' ') AS k
  FROM u)
SELECT a.id AS pair_id, CASE WHEN trim(b.text) = '' THEN 'output is empty' END AS problem
FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.k <> b.k OR trim(b.text) = ''""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    ident = F.col("conv_id") * 16 + F.col("turn")
    after = rows.select(ident.alias("id") - 1, F.col("text").alias("output"))
    after = after.withColumnRenamed(after.columns[0], "id")
    prompts = rows.select(
        ident.alias("id"), F.concat(F.lit("Q "), "role").alias("prompt"),
        F.col("text").alias("completion")).join(after.select("id"), "id", "left_semi")
    outputs = after.join(prompts.select("id", "prompt"), "id").select(
        "id", hx.sha("prompt").alias("prompt_sha256"), "output")
    return datasets.output_preferences(prompts, outputs).select("pair_id", "problem")


@query(
    "ds_11_metacognitive_rows",
    with_sql("""SELECT task_id, prompt AS task, response AS answer, confidence, label
  AS verification_result, 'Satisfy the task request and pass verification.' AS criteria,
  CASE WHEN confidence > 1 THEN 'scores must be between 0 and 1' END AS problem
FROM (SELECT *, CASE WHEN trace_id % 10 = 0 THEN 1.5::DOUBLE ELSE 0.7::DOUBLE END AS confidence
  FROM tl)""", "t", "tl"),
)
def _(spark, sf_dir):
    rows = base.labelled(spark, sf_dir).withColumn(
        "confidence", F.when(F.col("trace_id") % 10 == 0, 1.5).otherwise(0.7))
    return datasets.metacognitive_rows(rows).select(
        "task_id", "task", "answer", "confidence", "verification_result",
        F.array_join("acceptance_criteria", ";").alias("criteria"), "problem")


@query(
    "val_21_acceptance_criteria",
    f"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split_regex(
  regexp_replace(text, '^{WS}', '', 'g'), '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85]'),
  lambda x: regexp_replace(regexp_replace(x, '^(?:[-*.]|\\p{{Nd}}|{WS})+', ''), '^{WS}|{WS}$', '', 'g')),
  lambda x: x <> ''), '|') AS criteria FROM conversations""",
)
def _(spark, sf_dir):
    prompt = F.concat(F.lit("Do it.\nAcceptance Criteria:\n"), "text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.array_join(
            calibration.acceptance_criteria(F.lit(None).cast("array<string>"), [prompt]), "|"
        ).alias("criteria"))


@query(
    "ds_13_benchmark_items",
    """SELECT 'verifier_case_' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0')
  ELSE CAST(i AS VARCHAR) END AS id, text AS task, 'accepted' AS expected
FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS i FROM benchmark)""",
)
def _(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("task"))
    return datasets.benchmark_items(items, "verifier", "item_id").select("id", "task", "expected")


@query(
    "ds_14_summary_rows",
    f"""SELECT 'f' || (conv_id * 16 + turn) AS id,
  'Summarize this dialogue in one concise paragraph.' || chr(10) || chr(10) || 'Dialogue:' || chr(10)
  || regexp_replace(prompt, '^{WS}|{WS}$', '', 'g') || chr(10) || chr(10) || 'Summary:' AS prompt,
  regexp_replace(response, '^{WS}|{WS}$', '', 'g') AS completion,
  CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END AS reference_count
FROM (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')""",
)
def _(spark, sf_dir):
    rows = base.traces(spark, sf_dir).select(
        F.concat(F.lit("f"), "trace_id").alias("fname"), F.col("prompt").alias("dialogue"),
        F.lit(None).cast("string").alias("summary"), F.col("response").alias("summary1"),
        F.when(F.floor(F.col("trace_id") / 16) % 2 == 0, F.lit(" x ")).alias("summary2"))
    return datasets.summary_rows(rows).select(
        "id", "prompt", "completion", F.size("references").alias("reference_count"))


@query(
    "val_35_supervised_text",
    """WITH m AS (SELECT conv_id, max(turn) FILTER (role = 'assistant' ) AS last FROM conversations
  GROUP BY conv_id),
x AS (SELECT c.conv_id, string_agg(c.role || ': ' || c.text, chr(10) ORDER BY c.turn)
    FILTER (c.turn < m.last) AS prefix, max(c.text) FILTER (c.turn = m.last) AS target, m.last
  FROM conversations c JOIN m USING (conv_id) GROUP BY c.conv_id, m.last)
SELECT conv_id, CASE WHEN last IS NULL OR trim(target) = '' THEN ''
    ELSE coalesce(prefix, '') || chr(10) || 'assistant: ' END AS prefix,
  CASE WHEN last IS NULL OR trim(target) = '' THEN '' ELSE target END AS target FROM x""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ).alias("messages"))
    out = datasets.supervised_text(rows)
    return out.select("conv_id", "prefix", F.expr("substr(full_text, length(prefix) + 1)").alias("target"))


@query(
    "val_36_preference_rows",
    """SELECT conv_id * 16 + turn AS k, CASE WHEN turn = 3 THEN 'chosen and rejected must differ'
  WHEN turn = 5 THEN 'prompt, chosen and rejected must not be empty' END AS problem,
  sha256('Q') AS prompt_group FROM conversations""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 16 + F.col("turn")).alias("k"),
        F.lit(" Q ").alias("prompt"),
        F.concat(F.lit("a"), "conv_id", F.lit("-"), "turn").alias("chosen"), "turn", "conv_id",
    ).withColumn(
        "rejected",
        F.when(F.col("turn") == 3, F.concat(F.col("chosen"), F.lit(" ")))
        .when(F.col("turn") == 5, " ").otherwise("b"))
    return datasets.preference_rows(rows).select("k", "problem", "prompt_group")


_SYN = """syn AS (SELECT 'corrected_failure' AS generation_method, trace_id, 'correction_trace'
    AS trace_type, 'Corrected response for failure type ' || coalesce(failure_type, label) || '.'
    AS body FROM tl WHERE failure_type IS NOT NULL OR starts_with(label, 'failed')
UNION ALL SELECT 'alternate_task_decomposition', trace_id, 'planner_trace', coalesce(objective, prompt)
  FROM tl
UNION ALL SELECT 'better_router_decision', trace_id, 'router_trace', coalesce(objective, prompt) FROM tl
  WHERE failure_type = 'bad_router_assignment' OR label IN ('too_expensive', 'rescued_by_stronger_model')
UNION ALL SELECT 'hard_negative', trace_id, 'critic_trace', 'plausible but wrong variant' FROM tl
UNION ALL SELECT 'adversarial_verifier', trace_id, 'verification_trace', 'reject unsupported claim' FROM tl
UNION ALL SELECT 'prompt_variant', trace_id, 'planner_trace',
  'Be explicit and verifiable: ' || prompt FROM tl
UNION ALL SELECT 'synthetic_benchmark_task', trace_id, 'benchmark_trace', label FROM tl)"""


@query(
    "ds_15_set_01_synthetic_rows",
    with_sql("", "t", "tl").rstrip() + f""", {_SYN}
SELECT generation_method, trace_id AS source_trace_id, trace_type, body, 0.8 AS score FROM syn""",
)
def _(spark, sf_dir):
    rows = datasets.synthetic_rows(base.labelled(spark, sf_dir))
    body = (
        F.when(F.col("generation_method") == "prompt_variant", F.col("prompt"))
        .when(F.col("generation_method") == "corrected_failure", F.col("response"))
        .when(F.col("generation_method") == "hard_negative", F.col("failure_notes"))
        .when(F.col("expected").isNotNull(), F.col("expected")).otherwise(F.col("task"))
    )
    return rows.select("generation_method", "source_trace_id", "trace_type", body.alias("body"),
                       F.col("synthetic_quality_score").alias("score"))


@query(
    "val_32_keep_synthetic",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.6 ELSE 0.8 END AS score
FROM events WHERE event_id % 2 = 0 AND event_id % 5 <> 0""",
)
def _(spark, sf_dir):
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", (key % 2 == 0).alias("synthetic"), (key % 5 == 0).alias("measured"),
        F.when(key % 3 != 0, key).alias("source_trace_id"))
    return datasets.keep_synthetic(rows).select("event_id", F.col("synthetic_quality_score").alias("score"))


@query(
    "val_31_weak_opportunities",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'NO_IDEA' ELSE 'proposed' END AS status
FROM events""",
)
def _(spark, sf_dir):
    from traceloom.operators.experiments import mark_weak

    rows = table(spark, sf_dir, "events").select(
        "event_id", F.lit("o").alias("observation"), F.lit("h").alias("hypothesis"),
        F.when(F.col("event_id") % 3 != 0, "m").otherwise("").alias("expected_metric"),
        F.lit("proposed").alias("status"))
    return mark_weak(rows).select("event_id", "status")


@query(
    "ds_17_prompt_packs",
    """SELECT p_brand AS pack, r AS role, CASE WHEN r IN ('manager', 'critic') THEN 'Act for ' || p_brand
  ELSE '' END || chr(10) || 'Return verifiable, concise output with explicit evidence.' AS prompt
FROM (SELECT DISTINCT p_brand FROM part), (VALUES ('manager'), ('worker'), ('critic'), ('verifier')) AS g(r)""",
)
def _(spark, sf_dir):
    text = F.concat(F.lit("Act for "), "p_brand")
    packs = table(spark, sf_dir, "part").select("p_brand").distinct().select(
        F.col("p_brand").alias("pack"),
        F.create_map(F.lit("manager"), text, F.lit("critic"), text).alias("prompts"))
    return datasets.prompt_pack_variants(packs)


# The draws come from xxhash64, which the SQL engine does not share: SQL says what must hold of all.
@query("ds_16_arithmetic_tasks", "SELECT TRUE AS answer_right, count(*) AS n FROM orders")
def _(spark, sf_dir):
    rows = datasets.arithmetic_tasks(table(spark, sf_dir, "orders"), "o_orderkey", 1701)
    words = F.regexp_extract_all("prompt", F.lit(r"(\d+)"), F.lit(1))
    n = [words[i].cast("long") for i in range(3)]
    want = F.when(F.col("prompt").contains("pens"), n[0] - n[1] + n[2]).otherwise(n[0] + n[1] - n[2])
    return rows.groupBy((want == F.col("answer").cast("long")).alias("answer_right")).agg(
        F.count(F.lit(1)).alias("n"))


@query(
    "ds_16_confidence_tasks",
    """SELECT 'calibration-test-' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'YES' ELSE 'NO' END
  AS answer, 'The evidence is ' || CASE WHEN o_orderkey % 2 = 0 THEN 'VERIFIED' ELSE 'UNVERIFIED' END
  || '. Should confidence be claimed? Reply YES for VERIFIED and NO for UNVERIFIED.' AS prompt
FROM orders""",
)
def _(spark, sf_dir):
    return datasets.confidence_tasks(table(spark, sf_dir, "orders"), "o_orderkey", "test").select(
        "id", "answer", "prompt")


@query("ds_16_record_tasks", "SELECT TRUE AS names_order, count(*) AS n FROM orders")
def _(spark, sf_dir):
    rows = datasets.record_tasks(table(spark, sf_dir, "orders"), "o_orderkey", 1701)
    inside = F.contains("prompt", jx.get(jx.parse("completion"), "$.order_id"))
    return rows.groupBy(inside.alias("names_order")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "ds_16_addition_tasks",
    """SELECT 'addition-train-' || o_orderkey AS id, TRUE AS answer_right, TRUE AS small FROM orders""",
)
def _(spark, sf_dir):
    rows = datasets.addition_tasks(table(spark, sf_dir, "orders"), "o_orderkey", 4403)
    words = F.regexp_extract_all("prompt", F.lit(r"(\d+)"), F.lit(1))
    a, b = words[0].cast("long"), words[1].cast("long")
    return rows.select("id", (a + b == F.col("answer").cast("long")).alias("answer_right"),
                       (F.greatest(a, b) <= 4).alias("small"))


# ---------------------------------------------------------------- splits


@query(
    "spl_02_prompt_group_split",
    """WITH g AS (SELECT DISTINCT 'p-' || (doc_id % 37) AS task_group FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY sha256('7:' || task_group), task_group) - 1 AS n,
  count(*) OVER () AS c FROM g)
SELECT d.doc_id, CASE WHEN r.n < greatest(1, least(r.c - 1, round_even(r.c * 0.2::DOUBLE, 0)))
  THEN 'eval' ELSE 'train' END AS split
FROM documents d JOIN r ON r.task_group = 'p-' || (d.doc_id % 37)""",
)
def _(spark, sf_dir):
    from traceloom.operators.routing import group_split

    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("p-"), F.col("doc_id") % 37).alias("task_group"))
    return group_split(rows, rows, 0.2, 7).select("doc_id", "split")


@query(
    "spl_03_positional_split",
    """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS c
  FROM documents), k AS (SELECT *, greatest(1, least(2, c // 5)) AS t FROM n)
SELECT doc_id, CASE WHEN i >= c - t THEN 'test' WHEN i >= c - 2 * t THEN 'valid' ELSE 'train' END
  AS split FROM k""",
)
def _(spark, sf_dir):
    return datasets.positional_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    "spl_04_sample_partitions",
    """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('1701:' || doc_id), doc_id) - 1 AS i
  FROM documents)
SELECT doc_id, 'selection' AS partition FROM n WHERE i < 50
UNION ALL SELECT doc_id, 'sft_train' FROM n WHERE i < 100
UNION ALL SELECT doc_id, 'preference_prompts' FROM n WHERE i >= 100 AND i < 140""",
)
def _(spark, sf_dir):
    return datasets.sample_partitions(
        table(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=1701, selection=50,
        train=100, preference=40)


@query(
    "spl_05_mixed_curriculum",
    """SELECT task_set, k, sha256('2201:' || task_set || ':' || k) AS mix_order FROM (
  SELECT 'docs' AS task_set, doc_id AS k FROM documents UNION ALL
  SELECT 'bench', item_id FROM benchmark)""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"))
    return datasets.mixed_curriculum({"docs": docs, "bench": items}, "k", 2201).select(
        "task_set", "k", "mix_order")


@query(
    "spl_06_source_mix",
    """WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
  ORDER BY sha256('5:' || doc_id), doc_id) AS i FROM documents)
SELECT doc_id, lang FROM n WHERE i <= CASE lang WHEN 'en' THEN 60 WHEN 'fr' THEN 25
  WHEN 'de' THEN 10 WHEN 'es' THEN 5 END""",
)
def _(spark, sf_dir):
    shares = {"en": 0.60, "fr": 0.25, "de": 0.10, "es": 0.05}
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return datasets.source_mix(rows, "lang", "doc_id", 100, 5, shares)


# ---------------------------------------------------------------- gates over rows


@query(
    "val_09_public_gate",
    with_sql("SELECT count(*) AS blocked FROM t WHERE privacy_status <> 'public_benchmark'", "t"),
)
def _(spark, sf_dir):
    rows = calibration.public_violations(base.traces(spark, sf_dir), ("public_benchmark",))
    return rows.agg(F.count(F.lit(1)).alias("blocked"))


@query(
    "val_10_training_gate",
    with_sql("""SELECT count(*) AS row_count, TRUE AS forbidden_status, FALSE AS contains_private_user_data,
  bool_or(trace_id % 4 = 0) AS consent_required, FALSE AS ok FROM t""", "t"),
)
def _(spark, sf_dir):
    rows = base.traces(spark, sf_dir).select(
        "trace_id", "privacy_status",
        F.when(F.col("trace_id") % 4 == 0, "unknown").otherwise("granted").alias("consent"))
    return calibration.training_gate(rows, ("public_benchmark", "redacted_public")).select(
        "row_count", "forbidden_status", "contains_private_user_data", "consent_required", "ok")


@query(
    "agg_45_split_manifest",
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
  CASE WHEN doc_id % 3 = 0 THEN 'redacted' END AS st FROM documents)
SELECT split, count(*) AS row_count, count(DISTINCT doc_id) AS source_count,
  string_agg(DISTINCT coalesce(st, 'not_required'), ',' ORDER BY coalesce(st, 'not_required'))
  AS redaction_statuses, bool_or(doc_id = 7) AS contains_private_user_data FROM r GROUP BY split""",
)
def _(spark, sf_dir):
    key = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        F.when(key % 5 == 0, "test").otherwise("train").alias("split"),
        F.when(key % 3 == 0, "redacted").alias("redaction_status"),
        F.lit("granted").alias("consent"), (key == 7).alias("contains_private_user_data"),
        key.cast("string").alias("source_trace_hash"))
    return calibration.split_manifest(rows).select(
        "split", "row_count", "source_count",
        F.array_join("redaction_statuses", ",").alias("redaction_statuses"),
        "contains_private_user_data")


@query(
    "snk_02_manifest",
    with_sql("""SELECT 'd' AS name, count(*) AS item_count, 64 AS hash_length,
  string_agg(DISTINCT CAST(run_id AS VARCHAR), ',' ORDER BY CAST(run_id AS VARCHAR)) AS provenance
FROM t""", "t"),
)
def _(spark, sf_dir):
    rows = datasets.typed_rows(base.scored(spark, sf_dir), ["router"])
    out = datasets.manifest(rows, "d", "router", "v0", "private-local-only")
    return out.select("name", "item_count", F.length("content_hash").alias("hash_length"),
                      F.array_join("provenance", ",").alias("provenance"))


# ---------------------------------------------------------------- registry tables


def members(spark, sf_dir):
    """Parts as workflow members of a task each (the part type), one flag per 50."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), F.concat(F.lit("m-"), "p_partkey").alias("member_id"),
        F.col("p_type").alias("task_id"), (F.col("p_partkey") % 50 == 0).alias("is_incumbent"))


@query(
    "src_12_incumbents",
    """SELECT p_type AS task_id, 'm-' || max(p_partkey) AS member_id, max(p_partkey) AS row_id FROM part
WHERE p_partkey % 50 = 0 GROUP BY p_type""",
)
def _(spark, sf_dir):
    return registry.incumbents(members(spark, sf_dir))


@query(
    "snk_12_set_incumbents",
    """SELECT p_partkey AS row_id, CASE WHEN p_partkey % 333 = 0 THEN TRUE
  WHEN p_type IN (SELECT p_type FROM part WHERE p_partkey % 333 = 0) THEN FALSE
  ELSE p_partkey % 50 = 0 END AS is_incumbent FROM part""",
)
def _(spark, sf_dir):
    rows = members(spark, sf_dir)
    chosen = rows.filter("row_id % 333 = 0").select("task_id", "member_id")
    return registry.set_incumbents(rows, chosen).select("row_id", "is_incumbent")


@query(
    "src_11_lineage",
    """SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN
  (SELECT p_partkey FROM part WHERE p_type = 'PROMO')""",
)
def _(spark, sf_dir):
    lineage = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.concat(F.lit("m-"), "l_partkey").alias("member_id"))
    return registry.lineage_of_task(lineage, members(spark, sf_dir), "PROMO").select(
        "l_orderkey", "l_partkey")


@query(
    "snk_07_upsert",
    with_sql("""SELECT trace_id, CASE WHEN trace_id % 3 = 0 THEN 1.0::DOUBLE
  ELSE round(quality_score, 9) END AS quality_score FROM ts""", "t", "tl", "ts"),
)
def _(spark, sf_dir):
    stored = base.scored(spark, sf_dir).select("trace_id", F.round("quality_score", 9).alias("quality_score"))
    fresh = stored.filter("trace_id % 3 = 0").select("trace_id", F.lit(1.0).alias("quality_score"))
    return labeling.upsert_by_trace(stored, fresh)


@query(
    "snk_09_first_wins",
    """SELECT k, min(o_orderkey) AS ordinal FROM (SELECT o_custkey AS k, o_orderkey FROM orders)
WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY k""",
)
def _(spark, sf_dir):
    fresh = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ordinal"))
    stored = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("k"))
    return registry.insert_first_wins(stored, fresh, "k")


@query(
    "snk_10_immutable_insert",
    """WITH f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE 'h' END AS h
  FROM customer), s AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0)
SELECT CASE WHEN k IN (SELECT k FROM s) THEN 'conflict' ELSE 'append' END AS outcome, count(*) AS n
FROM f WHERE k NOT IN (SELECT k FROM s) OR h = 'new' GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    fresh = rows.withColumn("content_hash", F.when(F.col("k") % 10 == 0, "new").otherwise("h"))
    stored = rows.filter("k % 2 = 0").withColumn("content_hash", F.lit("h"))
    append, conflicts = registry.insert_immutable(stored, fresh, "k")
    parts = [
        part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("outcome"), "n")
        for name, part in (("append", append), ("conflict", conflicts))
    ]
    return parts[0].unionByName(parts[1]).filter("n > 0")


@query(
    "snk_06_comparison_rows",
    """SELECT l_orderkey AS experiment_id, 'status ' || l_linestatus AS metric,
  round(sum(l_quantity), 4) AS control_value, round(sum(l_extendedprice), 4) AS variant_value,
  CASE WHEN l_orderkey % 2 = 0 THEN 'improved' ELSE 'reject' END AS verdict
FROM lineitem GROUP BY l_orderkey, l_linestatus""",
)
def _(spark, sf_dir):
    value = F.struct(F.col("q").alias("control"), F.col("p").alias("variant"),
                     (F.col("p") - F.col("q")).alias("delta"))
    reports = (
        table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 4).alias("q"), F.round(F.sum("l_extendedprice"), 4).alias("p"))
        .groupBy(F.col("l_orderkey").alias("experiment_id"))
        .agg(F.map_from_entries(F.collect_list(F.struct(
            F.concat(F.lit("status "), "l_linestatus").alias("k"), value.alias("v")))).alias("comparison"))
        .withColumn("primary_metric_improved", F.col("experiment_id") % 2 == 0)
    )
    return registry.comparison_rows(reports).drop("delta")


@query(
    "snk_06_promotions",
    """SELECT c_custkey, max(o_orderkey) AS experiment_id FROM customer JOIN orders
  ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey""",
)
def _(spark, sf_dir):
    experiments = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("experiment_id"), F.col("o_custkey").alias("control_version"),
        F.col("o_orderpriority").alias("variant_version"))
    promotions = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_custkey").alias("control_version"),
        F.lit("1-URGENT").alias("variant_version"))
    return registry.registered_promotions(promotions, experiments).select("c_custkey", "experiment_id")


@query(
    "snk_05_join_23_item_lineage",
    with_sql("""SELECT d.doc_id, t.trace_id FROM documents d LEFT JOIN t ON t.trace_id = d.doc_id""", "t"),
)
def _(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("source_trace_id"))
    return datasets.item_lineage(items, base.traces(spark, sf_dir)).select("doc_id", "trace_id")


# ---------------------------------------------------------------- answers and suites


@query(
    "val_20_judge_outputs",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'maybe'
  ELSE '' END AS verdict, CASE event_id % 4 WHEN 2 THEN 'verdict must be one of pass, fail, or review'
  WHEN 3 THEN 'invalid JSON' ELSE CASE WHEN value / 100 > 1 THEN 'judge scores must be between 0 and 1'
  END END AS problem FROM events""",
)
def _(spark, sf_dir):
    key = F.col("event_id") % 4
    verdict = F.when(key == 0, "PASS").when(key == 1, "fail").otherwise("maybe")
    body = F.concat(F.lit('{"verdict":"'), verdict, F.lit('","confidence_faithfulness":'),
                    F.format_string("%.6f", F.col("value") / 100), F.lit("}"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(key == 3, "{oops").otherwise(body).alias("value"))
    return calibration.parse_judge(rows).select("event_id", "verdict", "problem")


@query(
    "val_22_blind_verdicts",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'TIE' ELSE 'INVALID' END AS verdict
FROM events""",
)
def _(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(x) for x in (" a. ", "Tie !", "A or B", "AB")]),
                       (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", health.exact_verdict(raw).alias("verdict"))


@query(
    "val_23_answers",
    """SELECT event_id, CAST(event_id % 50 AS VARCHAR) AS number, event_id % 3 <> 1 AS right,
  CASE event_id % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' WHEN 2 THEN 'ABSTAIN'
    ELSE CAST(event_id % 50 AS VARCHAR) END AS label FROM events""",
)
def _(spark, sf_dir):
    key, n = F.col("event_id"), (F.col("event_id") % 50).cast("string")
    text = F.concat(F.lit("It was 3.5 then "), n, F.lit(" of them"))
    said = F.element_at(
        F.array(F.lit("well yes"), F.lit("No, 5"), F.lit("yes or no: abstain"), text),
        (key % 4 + 1).cast("int"))
    want = F.when(key % 3 == 1, F.lit("-1")).otherwise(n)
    found = health.first_integer(text)
    return table(spark, sf_dir, "events").select(
        "event_id", found.alias("number"), (found == want).alias("right"),
        health.calibration_answer(said).alias("label"))


@query(
    "val_24_public_checks",
    """SELECT event_id, event_id % 100 < 10 AS one_digit, event_id % 3 = 0 AS sound_records FROM events""",
)
def _(spark, sf_dir):
    key = F.col("event_id")
    out = F.concat(F.lit(" "), key % 100, F.lit(" "))
    records = (
        F.when(key % 3 == 0, '[{"name":"a","n":1},{"name":"b","n":2}]')
        .when(key % 3 == 1, '[{"name":"b","n":1},{"name":"a","n":2}]')
        .otherwise('[{"name":"a","n":"1"}]'))
    return table(spark, sf_dir, "events").select(
        "event_id", datasets.public_regex_check(out, F.lit(r"\d")).alias("one_digit"),
        datasets.records_check(records, {"name": "str", "n": "int"}, "name").alias("sound_records"))


@query(
    "val_25_hidden_checks",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id % 6 <> 0 ELSE event_id % 3 = 0 END AS passed
FROM events""",
)
def _(spark, sf_dir):
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events")
    cases = rows.select(
        "event_id", F.concat(F.lit("ref"), key).alias("hidden_ref"),
        F.when(key % 2 == 0, "arithmetic").otherwise("json_extraction").alias("family"),
        F.when(key % 2 == 0, F.when(key % 6 == 0, F.lit("12 x")).otherwise(F.concat(F.lit(" "), key)))
        .when(key % 3 == 0, '[{"b":2, "a":1}]').otherwise('[{"a":1}]').alias("output"))
    hidden = rows.select(
        F.concat(F.lit("ref"), key).alias("hidden_ref"), key.alias("expected_answer"),
        F.lit('[{"a":1,"b":2}]').alias("expected_records"))
    return datasets.hidden_check(cases, hidden).select("event_id", "passed")


@query(
    "val_26_suite_problems",
    """SELECT id, problem FROM (SELECT CAST(conv_id AS VARCHAR) AS id, CASE
  WHEN contains(text, substr(text, 5, 12)) AND turn = 0 AND length(text) > 16
    THEN 'prompt leaks the hidden answer' END AS problem FROM conversations) WHERE problem IS NOT NULL
UNION ALL SELECT CAST(conv_id AS VARCHAR), 'duplicate case id' FROM conversations GROUP BY conv_id
  HAVING count(*) > 1
UNION ALL SELECT f, 'wrong number of cases in family' FROM (VALUES ('user', 3), ('system', 5),
  ('assistant', 3)) AS g(f, w)
  WHERE w <> (SELECT count(*) FROM conversations WHERE role = f)""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    ref = F.concat(F.lit("r"), F.col("conv_id") * 16 + F.col("turn"))
    cases = rows.select(
        F.col("conv_id").cast("string").alias("id"), F.col("role").alias("family"),
        F.lit("c").alias("category"),
        F.when(tx.trimmed_or_null("text").isNull(), F.lit(".")).otherwise(F.col("text")).alias("prompt"),
        F.lit("{}").alias("public_checks"), ref.alias("hidden_ref"))
    leak = (F.col("turn") == 0) & (F.length("text") > 16)
    hidden = rows.select(
        ref.alias("hidden_ref"),
        F.when(leak, F.expr("substr(text, 5, 12)")).otherwise("\u0001none").alias("marker"))
    return datasets.suite_problems(cases, hidden, {"user": 3, "system": 5, "assistant": 3})


@query(
    "row_23_record_match",
    """SELECT count(*) AS rows, round(avg(CASE WHEN event_id % 4 <> 3 THEN 1.0 ELSE 0.0 END), 9)
  AS valid_json_rate, round(avg(CASE WHEN event_id % 4 IN (0, 1) THEN 1.0 ELSE 0.0 END), 9)
  AS schema_valid_rate, round(sum(CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END)
  / (2.0 * count(*)), 9) AS exact_field_accuracy,
  round(avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0.0 END), 9) AS complete_record_accuracy
FROM events""",
)
def _(spark, sf_dir):
    key = F.col("event_id") % 4
    out = (
        F.when(key == 0, 'Sure: {"a": 1, "b": "x"} done').when(key == 1, '{"a": 1, "b": "y"}')
        .when(key == 2, '{"a": 1}').otherwise("none"))
    flags = table(spark, sf_dir, "events").select(
        *[c.alias(n) for n, c in health.record_match(out, F.lit('{"b":"x","a":1}')).items()])
    rates = health.record_rates(flags)
    return rates.select("rows", *[F.round(c, 9).alias(c) for c in rates.columns if c != "rows"])


@query(
    "ds_18_lineage_records",
    """SELECT 'm-' || l_partkey AS member_id, count(*) AS records, count(DISTINCT l_orderkey) AS experiments
FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) GROUP BY l_partkey""",
)
def _(spark, sf_dir):
    chosen = table(spark, sf_dir, "part").filter("p_size > 40").select(
        F.concat(F.lit("m-"), "p_partkey").alias("member_id"))
    lineage = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.concat(F.lit("m-"), "l_partkey").alias("member_id"))
    return registry.lineage_of_tasks(lineage, chosen).groupBy("member_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("l_orderkey").alias("experiments"))


