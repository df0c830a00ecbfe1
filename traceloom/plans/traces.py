"""Queries over traces: scans, validation, redaction, duplicates, labels, scores, routing metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom import vocab
from traceloom.functions import hashing as hx
from traceloom.functions import jsonx as jx
from traceloom.functions import text as tx
from traceloom.operators import dedup, experiments, labeling, metrics, normalize
from traceloom.plans import base
from traceloom.plans.base import WS, query, table, with_sql
from traceloom.session import with_row_index
from traceloom.sources import documents, logs, registry
from traceloom.streaming import jobs

# ---------------------------------------------------------------- scans

# Redaction in SQL; its word borders are ASCII, which gives the same text on these tables.
REDACT = """regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
  '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}\\b', '[REDACTED_EMAIL]', 'g'),
  '(?i)\\bBearer\\s+[A-Za-z0-9._~+/=-]{{12,}}', 'Bearer [REDACTED_TOKEN]', 'g'),
  '(?i)\\b(api[_-]?key|token|secret|password|passwd|authorization|bearer)\\b\\s*[:=]\\s*[''"]?([^''"\\s,;]+)',
  '\\1=[REDACTED_SECRET]', 'g'),
  '\\b(?:sk-[A-Za-z0-9_-]{{12,}}|[A-Za-z0-9_-]{{20,}}\\.[A-Za-z0-9_-]{{20,}}\\.[A-Za-z0-9_-]{{20,}}|[A-Za-z0-9_-]{{32,}})\\b',
  '[REDACTED_KEY]', 'g')"""

_LABELS = ("Tests-Failed", "success", "bogus label", "slow", "inconclusive")


def trace_lines(spark, sf_dir):
    """Conversation turns as JSON lines, some cut off, some with unknown types."""
    rows = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("conv_id") % 13 == 0, "unknown_trace").otherwise("worker_trace")
    label = F.element_at(
        F.array(*[F.lit(x) for x in _LABELS]), (F.col("turn") % 5 + 1).cast("int")
    )
    body = F.to_json(
        F.struct(
            kind.alias("type"),
            F.concat(F.lit(" conv-"), "conv_id").alias("task_id"),
            F.when(F.col("conv_id") % 2 == 0, "OpenLab").otherwise("").alias("provider"),
            F.col("text").alias("input"),
            label.alias("label"),
        )
    )
    cut = F.when(F.col("conv_id") % 17 == 0, F.substring(body, 1, 20)).otherwise(body)
    blank = F.when(F.col("conv_id") % 19 == 1, "  ").otherwise(cut)
    return rows.select(
        (F.col("conv_id") * 16 + F.col("turn")).alias("ordinal"), blank.alias("value")
    )


_LINES = f"""l0 AS (SELECT conv_id * 16 + turn AS ordinal, conv_id, turn, text,
  CASE turn % 5 WHEN 0 THEN 'failed_tests' WHEN 1 THEN 'accepted' WHEN 3 THEN 'too_slow'
    WHEN 4 THEN 'inconclusive' END AS outcome FROM conversations WHERE conv_id % 19 <> 1),
l AS (SELECT *, CASE WHEN conv_id % 17 = 0 THEN 'malformed'
    WHEN conv_id % 13 = 0 THEN 'rejected' WHEN turn % 5 = 2 THEN 'rejected'
    WHEN regexp_replace(text, '^{WS}|{WS}$', '', 'g') = '' THEN 'rejected'
    ELSE 'valid' END AS status FROM l0)"""


@query(
    "src_01_trace_scan",
    f"""WITH {_LINES} SELECT ordinal, status, 'conv-' || conv_id AS task_id,
  CASE WHEN conv_id % 2 = 0 THEN 'openlab' END AS provider, outcome,
  {REDACT.format(f"regexp_replace(text, '^{WS}|{WS}$', '', 'g')")} AS prompt
FROM l WHERE status = 'valid'
UNION ALL SELECT ordinal, status, NULL, NULL, NULL, NULL FROM l WHERE status <> 'valid'""",
)
def _(spark, sf_dir):
    rows = logs.classify_lines(trace_lines(spark, sf_dir))
    ok = F.col("status") == "valid"
    return rows.select(
        "ordinal", "status",
        *[F.when(ok, F.col(c)).alias(c) for c in ("task_id", "provider", "outcome", "prompt")],
    )


@query(
    "src_02_ingest_report_exact",
    f"""WITH {_LINES},
v AS (SELECT ordinal, lower(regexp_replace(concat_ws(' ', 'conv-' || conv_id,
    CASE WHEN conv_id % 2 = 0 THEN 'openlab' END, text), '{WS}', ' ', 'g')) AS k
  FROM l WHERE status = 'valid')
SELECT count(DISTINCT k) AS accepted, count(*) - count(DISTINCT k) AS duplicates,
  (SELECT count(*) FROM l WHERE status = 'rejected') AS rejected,
  (SELECT count(*) FROM l WHERE status = 'malformed') AS malformed FROM v""",
)
def _(spark, sf_dir):
    rows = logs.ingest(trace_lines(spark, sf_dir), near_threshold=None)
    return logs.ingest_report(rows).drop("run_id")


def streamed_lines(spark, sf_dir, files=3):
    """The lines of ``trace_lines`` as text files that hold them in order, and a folder for results."""
    folder = base.scratch(spark, "ingest")
    lines = trace_lines(spark, sf_dir)
    bounds = lines.agg(F.min("ordinal"), F.max("ordinal")).first()
    if bounds[0] is not None:
        step = (bounds[1] - bounds[0]) // files + 1
        for k in range(files):
            low = bounds[0] + k * step
            part = lines.filter(F.col("ordinal").between(low, low + step - 1)).coalesce(1)
            part.sortWithinPartitions("ordinal").select("value").write.mode("append").text(f"{folder}/in")
    return folder


@query(
    "str_01_incremental_ingest",
    f"""WITH {_LINES},
v AS (SELECT row_number() OVER (PARTITION BY k ORDER BY ordinal) AS r FROM (
  SELECT ordinal, lower(regexp_replace(concat_ws(' ', 'conv-' || conv_id,
    CASE WHEN conv_id % 2 = 0 THEN 'openlab' END, text), '{WS}', ' ', 'g')) AS k
  FROM l WHERE status = 'valid'))
SELECT status, count(*) AS rows FROM (SELECT status FROM l WHERE status <> 'valid'
  UNION ALL SELECT CASE WHEN r = 1 THEN 'accepted' ELSE 'duplicate' END FROM v) GROUP BY status""",
)
def _(spark, sf_dir):
    folder = streamed_lines(spark, sf_dir)
    jobs.ingest_stream(
        spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", near_threshold=None,
        files_per_batch=1,
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


def run_documents(spark, sf_dir, array):
    """Conversations as run documents with one array of traces each."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(F.struct("turn", F.col("role").alias("type"), F.col("text").alias("input")))
        ).alias(array)
    )
    return turns.select("conv_id", F.to_json(F.struct(array)).alias("value"))


_DOC_SQL = """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1
  AS position, role AS trace_type, text AS prompt FROM conversations"""


@query("src_03_run_documents", _DOC_SQL)
def _(spark, sf_dir):
    rows = documents.document_traces(run_documents(spark, sf_dir, "tasks"), "run")
    return rows.select("conv_id", "position", "trace_type", "prompt")


@query("src_04_scientific_documents", _DOC_SQL)
def _(spark, sf_dir):
    rows = documents.document_traces(
        run_documents(spark, sf_dir, "verification_traces"), "scientific")
    return rows.select("conv_id", "position", "trace_type", "prompt")


@query(
    "src_05_router_decisions",
    """SELECT o_orderkey, 'router_trace' AS trace_type, o_orderpriority AS provider,
  'm' || (o_custkey % 3) AS model,
  '{"provider":"' || o_orderpriority || '","model":"m' || (o_custkey % 3) || '"}' AS router_decision
FROM orders""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.to_json(
            F.struct(
                F.array(
                    F.struct(
                        F.col("o_orderpriority").alias("provider"),
                        F.concat(F.lit("m"), F.col("o_custkey") % 3).alias("model"),
                    )
                ).alias("decisions")
            )
        ).alias("value"),
    )
    rows = documents.document_traces(docs, "router")
    return rows.select("o_orderkey", "trace_type", "provider", "model", "router_decision")


@query(
    "src_06_worker_reports",
    """SELECT o_orderkey AS report_key, 'task-' || o_custkey AS task_id,
  lower(o_orderpriority) AS provider, 'Order ' || o_orderkey AS objective,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'accepted' END AS outcome,
  CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS changed_file_count, 1 AS test_count,
  CASE WHEN o_orderkey % 2 = 0 THEN 'a.py,b.py' ELSE 'one.py' END AS files,
  'run ' || (o_orderkey % 9) AS test_command FROM orders""",
)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    files = F.when(F.col("o_orderkey") % 2 == 0, F.lit('["a.py","b.py"]')).otherwise('"one.py"')
    value = F.concat(
        F.lit('{"task":{"id":"task-'), "o_custkey", F.lit('","title":"Order '), "o_orderkey",
        F.lit('"},"client":"'), "o_orderpriority", F.lit('","files":'), files,
        F.lit(',"tests":["run '), F.col("o_orderkey") % 9, F.lit('"]'),
        F.when(F.col("o_orderstatus") == "F", ',"status":"failed"').otherwise(""),
        F.when(F.col("o_orderstatus") == "P", ',"verification":{"passed":true}').otherwise(""),
        F.lit("}"),
    )
    rows = documents.worker_reports(o.select(F.col("o_orderkey").alias("report_key"), value.alias("value")))
    return rows.select(
        "report_key", "task_id", "provider", "objective", "outcome", "changed_file_count",
        "test_count", F.array_join("files_changed", ",").alias("files"),
        F.col("tests_run")[0]["command"].alias("test_command"),
    )


@query(
    "src_07_provider_metadata",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'hub' ELSE lower(o_orderpriority) END
  AS provider, 'm' || (o_custkey % 5) AS model,
  CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 1e8::DOUBLE
    ELSE (o_totalprice / 1e9::DOUBLE) + 0.0005::DOUBLE END AS cost_usd,
  CASE WHEN o_orderkey % 4 = 0 THEN 250 ELSE 100 END AS latency_ms,
  CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 1e8::DOUBLE
    ELSE (o_totalprice / 1e9::DOUBLE) + 0.0005::DOUBLE END <= 0.001 AS free_or_cheap FROM orders""",
)
def _(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 3 == 0, F.lit("My-Hub-2")).otherwise(F.col("o_orderpriority")).alias("provider"),
        F.lit("").alias("model"),
        F.concat(F.lit("m"), F.col("o_custkey") % 5).alias("model_slug"),
        F.when(key % 2 == 0, F.col("o_totalprice") / 1e8).alias("cost_usd"),
        (F.col("o_totalprice") / 1e9).alias("prompt_cost_usd"),
        F.lit(0.0005).alias("completion_cost_usd"),
        F.when(key % 4 == 0, 0).otherwise(100).alias("latency_ms"),
        F.lit(250).alias("duration_ms"),
    )
    return documents.provider_metadata(rows, gateway="hub").select(
        "o_orderkey", "provider", "model", "cost_usd", "latency_ms", "free_or_cheap"
    )


def stored_labels(spark, sf_dir):
    """Two label versions of most traces, as appended by repeated label runs."""
    rows = base.labelled(spark, sf_dir).select("trace_id", "label")
    version = F.explode(
        F.when(F.col("trace_id") % 5 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    )
    return rows.select("trace_id", "label", version.alias("label_id")).select(
        "trace_id", "label_id", F.col("label_id").alias("created_at"),
        F.when(F.col("label_id") == 2, F.col("label")).otherwise("rejected").alias("label"),
        F.lit(0.5).alias("confidence"), F.lit("rule_based").alias("source"),
    )


_STORED = """lab AS (SELECT trace_id, v AS label_id, CASE WHEN v = 2 THEN label ELSE 'rejected' END
  AS label FROM tl, (VALUES (1), (2)) AS g(v) WHERE v = 1 OR trace_id % 5 <> 0)"""


@query(
    "src_08_trace_rows",
    with_sql("", "t", "tl", "ts").rstrip() + f""", {_STORED}
SELECT ts.trace_id, ts.provider, lab.label, round(ts.quality_score, 9) AS score
FROM ts JOIN lab USING (trace_id) ORDER BY ts.trace_id DESC, lab.label DESC LIMIT 50""",
)
def _(spark, sf_dir):
    scores = base.scored(spark, sf_dir).select("trace_id", "quality_score")
    rows = registry.trace_rows(
        base.traces(spark, sf_dir), stored_labels(spark, sf_dir), scores, selector="last_50"
    )
    return rows.select("trace_id", "provider", "label", F.round("score", 9).alias("score"))


@query(
    "src_13_evolution_context",
    with_sql("", "t", "tl", "ts").rstrip() + f""", {_STORED}
SELECT 'traces' AS part, count(*) AS n FROM t WHERE run_id = 3
UNION ALL SELECT 'labels', count(*) FROM lab UNION ALL SELECT 'scores', count(*) FROM ts""",
)
def _(spark, sf_dir):
    context = registry.evolution_context(
        base.traces(spark, sf_dir), stored_labels(spark, sf_dir),
        base.scored(spark, sf_dir).select("trace_id", "quality_score"),
        table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "labels"), run_id=3,
    )
    counted = [
        context[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        for name in ("traces", "labels", "scores")
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query(
    "src_14_artifact_keywords",
    """SELECT w AS keyword, CAST(page_id AS VARCHAR) AS path FROM pages,
  (VALUES ('cost'), ('quality'), ('safety'), ('title')) AS g(w) WHERE contains(lower(html), w)""",
)
def _(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    return registry.artifact_keywords(files, ("cost", "quality", "safety", "title"))


@query(
    "src_16_unique_ids",
    """SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS rows,
  'repeated_id' AS violation FROM conversations GROUP BY conv_id HAVING count(*) > 1""",
)
def _(spark, sf_dir):
    return dedup.unique_id_violations(table(spark, sf_dir, "conversations"), "conv_id")


# ---------------------------------------------------------------- validation and text


@query(
    "val_03_outcome_labels",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'failed_tests'
  WHEN 2 THEN 'too_expensive' WHEN 3 THEN NULL WHEN 4 THEN 'unsafe_or_policy_blocked'
  ELSE 'rescued_by_stronger_model' END AS outcome FROM orders""",
)
def _(spark, sf_dir):
    raw = F.element_at(
        F.array(*[F.lit(x) for x in (" Passed ", "tests failed", "EXPENSIVE", "whatever", "Unsafe",
                                     "Rescued-By stronger_model")]),
        (F.col("o_orderkey") % 6 + 1).cast("int"),
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", normalize.outcome_label(raw).alias("outcome"))


@query(
    "val_04_task_types",
    """WITH w AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE
  CASE p_partkey % 5 WHEN 1 THEN 'Bug-fix ' WHEN 2 THEN 'readme ' WHEN 3 THEN 'Route ' ELSE '' END
  || p_type || ' ' || p_name END AS raw FROM part),
x AS (SELECT p_partkey, CASE WHEN raw = '' THEN 'unknown'
  ELSE replace(replace(lower(trim(raw)), '-', '_'), ' ', '_') END AS txt FROM w)
SELECT p_partkey, CASE
  WHEN regexp_matches(txt, 'doc|literature|readme|guide') THEN 'documentation'
  WHEN regexp_matches(txt, 'code|test|bug|refactor') THEN 'coding'
  WHEN regexp_matches(txt, 'science|protocol|bio|verify') THEN 'scientific'
  WHEN contains(txt, 'route') THEN 'routing' ELSE txt END AS task_type FROM x""",
)
def _(spark, sf_dir):
    key = F.col("p_partkey") % 5
    lead = F.when(key == 1, "Bug-fix ").when(key == 2, "readme ").when(key == 3, "Route ").otherwise("")
    raw = F.when(key == 0, "").otherwise(F.concat(lead, "p_type", F.lit(" "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", normalize.task_type(raw).alias("task_type"))


@query(
    "val_05_list_coercion",
    """SELECT event_id, event_id % 4 IN (0, 3) AS sound,
  CASE WHEN event_id % 4 = 3 THEN 0 WHEN event_id % 4 = 0 THEN 2 END AS parts FROM events""",
)
def _(spark, sf_dir):
    key = F.col("event_id") % 4
    raw = (
        F.when(key == 0, F.concat(F.lit('{"files_changed":["a",'), "event_id", F.lit("]}")))
        .when(key == 1, '{"files_changed":"a"}').when(key == 2, '{"tool_calls":["x"]}')
        .otherwise('{"prompt":"p"}')
    )
    lines = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit('{"type":"tool_trace","objective":"o",'),
                             F.substr(raw, F.lit(2), F.length(raw))).alias("value"))
    rows = normalize.normalize_traces(lines)
    ok = F.col("status") == "valid"
    return rows.select("event_id", ok.alias("sound"),
                       F.when(ok, F.size("files_changed")).alias("parts"))


@query("val_06_redact_text", f"SELECT doc_id, {REDACT.format('text')} AS redacted FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.redact_text("text").alias("redacted"))


@query(
    "val_07_redact_structure",
    f"""SELECT doc_id, '[REDACTED_SECRET]' AS secret, {REDACT.format('text')} AS inner_text,
  {REDACT.format('text')} AS map_text FROM documents""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.to_json(F.struct(F.struct(F.array("text").alias("list"), F.col("text").alias("api_key"))
                           .alias("outer"))).alias("open"),
        F.create_map(F.lit("note"), "text", F.lit("My_Password"), "text").alias("pairs"),
    ).select("doc_id", jx.parse(jx.redact_json("open")).alias("v"), tx.redact_map("pairs").alias("m"))
    return rows.select(
        "doc_id", jx.get(F.col("v"), "$.outer.api_key").alias("secret"),
        jx.get(F.col("v"), "$.outer.list[0]").alias("inner_text"), F.col("m")["note"].alias("map_text"),
    )


@query(
    "val_08_privacy_status",
    """SELECT privacy_status, privacy_status = 'public_benchmark' AS exportable, count(*) AS n
FROM (SELECT CASE conv_id % 4 WHEN 1 THEN 'anonymous_learning' WHEN 2 THEN 'public_benchmark'
  ELSE 'local_only' END AS privacy_status FROM conversations) GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    key = (F.col("conv_id") % 4).cast("int") + 1
    mode = F.element_at(F.array(*[F.lit(m) for m in (*vocab.PRIVACY_STATUS, "other")]), key)
    rows = table(spark, sf_dir, "conversations").select(normalize.privacy_status(mode).alias("privacy_status"))
    return rows.groupBy("privacy_status", normalize.can_export("privacy_status").alias("exportable")).agg(
        F.count(F.lit(1)).alias("n"))


@query(
    "fn_01_text_functions",
    f"""SELECT doc_id, trim(regexp_replace(text, '{WS}', ' ', 'g')) AS squeezed,
  len(list_distinct(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}]{{3,}})', 1))) AS token_count,
  array_to_string(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}'']+)', 1), ' ') AS words
FROM documents""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.squeeze("text").alias("squeezed"),
        F.size(tx.token_set("text")).alias("token_count"),
        tx.normalized_words("text").alias("words"))


@query("fn_02_payload_hash", "SELECT event_id, sha256('{\"a\":' || (event_id % 7) || ',\"k\":' || "
       "json_extract_string(props, '$.k') || '}') AS payload_hash FROM events")
def _(spark, sf_dir):
    k = jx.get(jx.parse("props"), "$.k")
    text = F.concat(F.lit('{ "k": '), k, F.lit(', "a":'), F.col("event_id") % 7, F.lit(" }"))
    return table(spark, sf_dir, "events").select("event_id", hx.json_hash(text).alias("payload_hash"))


@query(
    "fn_03_json_default",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '[]' ELSE
  replace(props, ' ', '') END AS parsed FROM events""",
)
def _(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(jx.parse_or(raw, "[]")).alias("parsed"))


# ---------------------------------------------------------------- duplicates


@query(
    "join_01_exact_clusters",
    """WITH n AS (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS h
  FROM documents)
SELECT h AS content_hash, min(doc_id) AS canonical_trace_id, count(*) - 1 AS duplicate_count,
  min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM n GROUP BY h""",
)
def _(spark, sf_dir):
    rows = base.document_traces(spark, sf_dir).withColumn(
        "content_hash", hx.sha(F.lower(tx.squeeze("prompt"))))
    return dedup.exact_clusters(rows)


@query(
    "join_01_first_rows",
    """SELECT count(*) AS kept, count(DISTINCT content_hash) AS hashes FROM (
  SELECT sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS content_hash, doc_id,
  row_number() OVER (PARTITION BY sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))
    ORDER BY doc_id) AS r FROM documents) WHERE r = 1""",
)
def _(spark, sf_dir):
    rows = base.document_traces(spark, sf_dir).withColumn(
        "content_hash", hx.sha(F.lower(tx.squeeze("prompt"))))
    kept = dedup.first_by_hash(rows)
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.count_distinct("content_hash").alias("hashes"))


_TOKENS = """list_sort(list_distinct(regexp_extract_all(lower({0}), '([\\p{{L}}\\p{{N}}]{{3,}})', 1)))"""
_SIM = """CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0::DOUBLE ELSE
  len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END"""

# Copies collapse to one row per equal token sets, as in the plan; then all pairs are scored.
_NEAR = f"""k AS (SELECT trace_id, {_TOKENS.format('prompt')} AS p, {_TOKENS.format('response')} AS r,
    {_TOKENS.format('task')} AS q FROM src),
g AS (SELECT p, r, q, min(trace_id) AS id, count(*) AS copies FROM k GROUP BY p, r, q),
pairs AS (SELECT a.id AS left_id, b.id AS right_id, a.copies * b.copies AS row_pairs,
  {_SIM.format('a.p', 'b.p')} AS ps, {_SIM.format('a.r', 'b.r')} AS rs,
  {_SIM.format('a.q', 'b.q')} AS qs
  FROM g a JOIN g b ON a.id < b.id
    AND least(len(a.p), len(b.p)) >= 0.59 * greatest(len(a.p), len(b.p)))
SELECT left_id, right_id, row_pairs,
  round(ps * 0.45::DOUBLE + rs * 0.25::DOUBLE + qs * 0.30::DOUBLE, 4) AS score FROM pairs
WHERE round(ps * 0.45::DOUBLE + rs * 0.25::DOUBLE + qs * 0.30::DOUBLE, 4) >= 0.82
UNION ALL SELECT id, id, copies * (copies - 1) // 2, 1.0 FROM g WHERE copies > 1"""


@query(
    "join_05_near_duplicates",
    f"""WITH src AS (SELECT doc_id AS trace_id, text AS prompt, '' AS response, text AS task
  FROM documents), {_NEAR}""",
)
def _(spark, sf_dir):
    return dedup.near_duplicates(base.document_traces(spark, sf_dir)).select(
        "left_id", "right_id", "row_pairs", "score")


@query(
    "join_03_similarity",
    f"""WITH src AS (SELECT conv_id, turn, role, {_TOKENS.format('text')} AS k FROM conversations)
SELECT a.conv_id, a.turn, round({_SIM.format('a.k', 'b.k')}, 9) AS similarity
FROM src a JOIN src b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.token_set("text").alias("k"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("k").alias("k2"))
    return rows.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(tx.jaccard(F.col("k"), F.col("k2")), 9).alias("similarity"))


# Scores of rows without responses: the task is the prompt, or the same for both rows.
_PROMPT = "CASE WHEN ap + bp = 0 THEN 1.0::DOUBLE ELSE common::DOUBLE / (ap + bp - common) END"
_SAME_TASK = f"({_PROMPT}) * 0.45::DOUBLE + 1.0::DOUBLE * 0.25::DOUBLE + ({_PROMPT}) * 0.30::DOUBLE"
_PLAIN_TASK = f"({_PROMPT}) * 0.45::DOUBLE + 1.0::DOUBLE * 0.25::DOUBLE + 1.0::DOUBLE * 0.30::DOUBLE"

# A scan in order as recursion: the state is the list of accepted rows. ``src`` has n (from 1, dense),
# trace_id, k (identity), task_id, p, r and q (token lists).
_WALK = """scored AS (SELECT n, {{'s': round({0}, 4), 'n': an, 'i': ai}} AS m FROM (
  SELECT b.n, a.n AS an, a.trace_id AS ai, len(a.p) AS ap, len(b.p) AS bp, a.q AS aq, b.q AS bq,
    len(list_intersect(a.p, b.p)) AS common
  FROM src a JOIN src b ON a.n < b.n AND {1}
    AND least(len(a.p), len(b.p)) >= {2} * greatest(len(a.p), len(b.p)))),
near AS MATERIALIZED (SELECT n, list_sort(list(m), 'DESC') AS near FROM scored WHERE m.s >= 0.82 GROUP BY n),
same AS (SELECT n, list(n) OVER (PARTITION BY k ORDER BY n) AS same FROM src),
steps AS MATERIALIZED (SELECT src.n, trace_id, same, coalesce(near, []) AS near
  FROM src JOIN same USING (n) LEFT JOIN near USING (n)),
walk AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS trace_id, []::BIGINT[] AS kept, NULL::VARCHAR AS decision,
    NULL::STRUCT(s DOUBLE, n BIGINT, i BIGINT) AS best, NULL::BIGINT AS owner
  UNION ALL
  SELECT n, trace_id, CASE WHEN decision = 'accepted' THEN list_append(kept, n) ELSE kept END,
    decision, CASE WHEN decision = 'near_duplicate' THEN best END,
    CASE decision WHEN 'exact_duplicate' THEN copy WHEN 'near_duplicate' THEN best.n ELSE n END
  FROM (SELECT *, CASE WHEN copy IS NOT NULL THEN 'exact_duplicate'
      WHEN best IS NOT NULL THEN 'near_duplicate' ELSE 'accepted' END AS decision
    FROM (SELECT t.n, t.trace_id, kept, list_intersect(same, kept)[1] AS copy,
        list_filter(near, lambda x: list_contains(kept[-500:], x.n))[1] AS best
      FROM walk JOIN steps t ON t.n = walk.n + 1))),
decided AS (SELECT w.n - 1 AS ordinal, w.trace_id, w.decision, w.best.i AS match_id,
    w.best.s AS match_score, o.trace_id AS cluster_id
  FROM walk w JOIN walk o ON o.n = w.owner WHERE w.n > 0)"""


@query(
    "src_02_ingest_report_near",
    f"""WITH RECURSIVE {_LINES},
src AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ordinal) AS n, ordinal AS trace_id, k, conv_id,
    {_TOKENS.format('x')} AS p, []::VARCHAR[] AS r, {_TOKENS.format("'conv-' || conv_id")} AS q
  FROM (SELECT ordinal, conv_id, {REDACT.format("text")} AS x,
    lower(regexp_replace(concat_ws(' ', 'conv-' || conv_id,
      CASE WHEN conv_id % 2 = 0 THEN 'openlab' END, text), '{WS}', ' ', 'g')) AS k
    FROM l WHERE status = 'valid')),
{_WALK.format(_PLAIN_TASK, 'a.conv_id = b.conv_id', 0.59)}
SELECT count(*) FILTER (decision = 'accepted') AS accepted,
  count(*) FILTER (decision <> 'accepted') AS duplicates,
  (SELECT count(*) FROM l WHERE status = 'rejected') AS rejected,
  (SELECT count(*) FROM l WHERE status = 'malformed') AS malformed FROM decided""",
)
def _(spark, sf_dir):
    return logs.ingest_report(logs.ingest(trace_lines(spark, sf_dir), chunk_rows=1000)).drop("run_id")


_DOC_WALK = f"""WITH RECURSIVE src AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id AS trace_id,
    sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS k, {_TOKENS.format('text')} AS p,
    []::VARCHAR[] AS r, {_TOKENS.format('text')} AS q FROM documents),
{_WALK.format(_SAME_TASK, 'true', 0.75)}"""


def decided_documents(spark, sf_dir, chunk_rows=300):
    """Documents decided in order; chunks are small here, so that several meet at every scale."""
    rows = base.document_traces(spark, sf_dir).withColumn(
        "content_hash", hx.sha(F.lower(tx.squeeze("prompt"))))
    dense = with_row_index(rows.drop("ordinal"), "trace_id", name="ordinal")
    return dedup.accept_in_order(dense, chunk_rows=chunk_rows)


@query("join_06_accept_in_order", f"{_DOC_WALK} SELECT * FROM decided")
def _(spark, sf_dir):
    return decided_documents(spark, sf_dir).select(
        "ordinal", "trace_id", "decision", "match_id", "match_score", "cluster_id")


@query(
    "join_06_clusters",
    f"""{_DOC_WALK} SELECT cluster_id AS canonical_trace_id,
  count(*) FILTER (decision = 'exact_duplicate') AS exact_copies,
  count(*) FILTER (decision = 'near_duplicate') AS near_copies, count(*) - 1 AS duplicate_count,
  min(ordinal) AS first_seen, max(ordinal) AS last_seen FROM decided GROUP BY cluster_id""",
)
def _(spark, sf_dir):
    return dedup.decided_clusters(decided_documents(spark, sf_dir)).drop("content_hash")


@query(
    "join_06_events",
    f"""{_DOC_WALK} SELECT cluster_id AS canonical_trace_id, trace_id, ordinal, decision AS kind,
  match_score FROM decided WHERE decision <> 'accepted'""",
)
def _(spark, sf_dir):
    return dedup.decided_events(decided_documents(spark, sf_dir))


_SPLITS = f"""sp AS (SELECT ordinal, split, txt,
  array_to_string(regexp_extract_all(lower(txt), '([\\p{{L}}\\p{{N}}'']+)', 1), ' ') AS k FROM (
  SELECT doc_id AS ordinal, text AS txt, CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split
  FROM documents UNION ALL
  SELECT 10000000000 + item_id, text, 'test' FROM benchmark))"""


def split_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ordinal"), F.col("text").alias("txt"),
        F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("train").alias("split"))
    held = table(spark, sf_dir, "benchmark").select(
        (F.lit(10_000_000_000) + F.col("item_id")).alias("ordinal"), F.col("text").alias("txt"),
        F.lit("test").alias("split"))
    return docs.unionByName(held)


@query(
    "join_10_clean_splits",
    f"""WITH {_SPLITS},
r AS (SELECT *, row_number() OVER (PARTITION BY split, k ORDER BY ordinal) AS n FROM sp),
u AS (SELECT * FROM r WHERE n = 1),
te AS (SELECT * FROM u WHERE split = 'test'),
de AS (SELECT * FROM u WHERE split = 'dev' AND k NOT IN (SELECT k FROM te)),
tr AS (SELECT * FROM u WHERE split = 'train' AND k NOT IN (SELECT k FROM te)
  AND k NOT IN (SELECT k FROM de))
SELECT split, ordinal FROM te UNION ALL SELECT split, ordinal FROM de
UNION ALL SELECT split, ordinal FROM tr""",
)
def _(spark, sf_dir):
    return dedup.clean_splits(split_rows(spark, sf_dir), "txt").select("split", "ordinal")


@query(
    "join_10_split_report",
    f"""WITH {_SPLITS}, c AS (SELECT k, count(*) FILTER (split = 'train') AS a,
  count(*) FILTER (split = 'dev') AS d, count(*) FILTER (split = 'test') AS t FROM sp GROUP BY k)
SELECT CAST(sum(greatest(a - 1, 0)) AS BIGINT) AS train_internal_duplicates_removed,
  CAST(sum(greatest(d - 1, 0)) AS BIGINT) AS dev_internal_duplicates_removed,
  CAST(sum(greatest(t - 1, 0)) AS BIGINT) AS test_internal_duplicates_removed,
  count(*) FILTER (d > 0 AND t > 0) AS dev_rows_overlapping_test_removed,
  count(*) FILTER (a > 0 AND (d > 0 OR t > 0)) AS train_rows_overlapping_dev_or_test_removed FROM c""",
)
def _(spark, sf_dir):
    return dedup.split_report(split_rows(spark, sf_dir), "txt")


@query(
    "join_11_split_violations",
    f"""WITH {_SPLITS}, c AS (SELECT k, count(*) AS n, count(DISTINCT split) AS s FROM sp GROUP BY k)
SELECT 'missing_text' AS violation, count(*) AS n FROM sp WHERE trim(txt) = ''
UNION ALL SELECT 'duplicate_in_split', count(*) FROM c WHERE n > s
UNION ALL SELECT 'overlap_across_splits', count(*) FROM c WHERE s > 1""",
)
def _(spark, sf_dir):
    return dedup.split_violations(split_rows(spark, sf_dir), "txt")


# ---------------------------------------------------------------- labels and scores


@query("row_01_rule_labels", with_sql("SELECT trace_id, label FROM tl", "t", "tl"))
def _(spark, sf_dir):
    return base.labelled(spark, sf_dir).select("trace_id", "label")


def overrides(spark, sf_dir):
    """Human quality labels as overrides by trace id, and by task id for some."""
    rows = table(spark, sf_dir, "labels")
    verdict = F.when(F.col("quality") == 1, "accepted").otherwise("rejected")
    by_task = F.concat(F.lit("conv-"), "doc_id")
    key = F.when(F.col("doc_id") % 2 == 0, by_task).otherwise(F.col("doc_id").cast("string"))
    return rows.select(key.alias("override_key"), verdict.alias("override_label"))


@query(
    "row_02_label_run",
    with_sql("", "t", "tl").rstrip() + """,
ov AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'conv-' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS k,
  CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS v FROM labels)
SELECT tl.trace_id, coalesce(a.v, b.v, CASE WHEN tl.label = 'inconclusive' THEN
    CASE WHEN contains(txt, 'rescued') OR contains(txt, 'stronger model')
      THEN 'rescued_by_stronger_model' WHEN contains(txt, 'training candidate')
      THEN 'good_training_candidate' ELSE 'inconclusive' END ELSE tl.label END) AS label,
  CASE WHEN coalesce(a.v, b.v) IS NOT NULL THEN 'human_review'
    WHEN tl.label = 'inconclusive' THEN 'local_model' ELSE 'rule_based' END AS source
FROM tl LEFT JOIN ov a ON a.k = CAST(tl.trace_id AS VARCHAR) LEFT JOIN ov b ON b.k = tl.task_id""",
)
def _(spark, sf_dir):
    names = ["trace_type", "prompt", "response", "normalized_text"]
    rows = labeling.label_run(
        base.traces(spark, sf_dir), overrides(spark, sf_dir),
        fallback=lambda: labeling.keyword_label(names))
    return rows.select("trace_id", "label", "source")


@query(
    "join_07_label_fanout",
    with_sql("", "t", "tl").rstrip() + f""", {_STORED}
SELECT tl.provider, lab.label, count(*) AS n FROM tl JOIN lab USING (trace_id) GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    scores = base.scored(spark, sf_dir).select("trace_id", "quality_score")
    rows = labeling.attach_labels_scores(
        base.traces(spark, sf_dir), stored_labels(spark, sf_dir), scores, fanout=True)
    return rows.groupBy("provider", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "join_08_latest_label",
    with_sql("", "t", "tl").rstrip() + f""", {_STORED}
SELECT trace_id, label FROM (SELECT *, row_number() OVER (PARTITION BY trace_id
  ORDER BY label_id DESC) AS r FROM lab) WHERE r = 1""",
)
def _(spark, sf_dir):
    return labeling.latest_label(stored_labels(spark, sf_dir)).select("trace_id", "label")


@query(
    "row_04_scores",
    with_sql("""SELECT trace_id, round(quality_score, 9) AS quality_score, correctness_score,
  round(cost_score, 9) AS cost_score, round(latency_score, 9) AS latency_score, novelty_score,
  escalation_rescue_score, safety_score, round(training_value_score, 9) AS training_value_score
FROM ts""", "t", "tl", "ts"),
)
def _(spark, sf_dir):
    rounded = ("quality_score", "cost_score", "latency_score", "training_value_score")
    return base.scored(spark, sf_dir).select(
        "trace_id", "correctness_score", "novelty_score", "escalation_rescue_score", "safety_score",
        *[F.round(c, 9).alias(c) for c in rounded])


_SENTENCE = """rtrim(substr(CASE WHEN strpos({0}, '. ') > 1
  THEN substr({0}, 1, strpos({0}, '. ')) ELSE {0} END, 1, {1}))"""


@query(
    "row_05_compression",
    with_sql("", "t", "tl").rstrip() + f""",
c0 AS (SELECT *, trim(regexp_replace(prompt, '{WS}', ' ', 'g')) AS fp,
  trim(regexp_replace(response, '{WS}', ' ', 'g')) AS fr FROM tl),
c1 AS (SELECT *, {_SENTENCE.format('fp', 180)} AS sp, {_SENTENCE.format('fr', 220)} AS sr FROM c0),
c2 AS (SELECT *, concat_ws(' ', CASE WHEN sp <> '' THEN 'Prompt: ' || sp END,
  CASE WHEN sr <> '' THEN 'Response: ' || sr END) AS base FROM c1),
c3 AS (SELECT *, CASE WHEN contains(lower(base), lower(task_id)) THEN base
  ELSE 'Task ' || task_id || ': ' || base END AS summary FROM c2)
SELECT trace_id, summary, CASE label WHEN 'failed_tests' THEN 'failed_code_tests'
  WHEN 'failed_verification' THEN 'weak_evidence' WHEN 'hallucinated' THEN 'hallucinated_citation'
  WHEN 'unsafe_or_policy_blocked' THEN 'unsafe_output' WHEN 'too_expensive'
  THEN 'overused_frontier_model' WHEN 'too_slow' THEN 'format_failure' END AS failure_type,
  round(CAST(list_sum([CASE WHEN contains(lower(summary), lower(f)) THEN 1 ELSE 0 END
    FOR f IN [task_id, trace_type, provider, model]]) AS DOUBLE) / 4, 9) AS key_fact_retention,
  round(greatest(0, 1 - CAST(len(string_split(trim(regexp_replace(summary, '{WS}', ' ', 'g')), ' '))
    AS DOUBLE) / len(string_split(normalized_text, ' '))), 9) AS token_reduction_ratio FROM c3""",
)
def _(spark, sf_dir):
    rows = labeling.compress_traces(base.labelled(spark, sf_dir))
    return rows.select(
        "trace_id", "summary", "failure_type",
        F.round("key_fact_retention", 9).alias("key_fact_retention"),
        F.round("token_reduction_ratio", 9).alias("token_reduction_ratio"))


@query(
    "row_06_extractive_summary",
    with_sql(f"""SELECT trace_id, concat_ws(' ',
  nullif(substr(trim(regexp_replace(prompt, '{WS}', ' ', 'g')), 1, 160), ''),
  nullif(substr(trim(regexp_replace(response, '{WS}', ' ', 'g')), 1, 200), '')) AS summary FROM t""",
             "t"),
)
def _(spark, sf_dir):
    return base.labelled(spark, sf_dir).select("trace_id", labeling.extractive_summary().alias("summary"))


_PROFILES = """CASE WHEN regexp_matches(k, 'medical|safety|clinical') THEN 1
  WHEN regexp_matches(k, 'code|coding|software') THEN 2
  WHEN regexp_matches(k, 'support|chat|fast|realtime') THEN 3 ELSE 4 END"""


@query(
    "row_09_composite_score",
    f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber % 4 WHEN 0 THEN 'Clinical' WHEN 1 THEN 'coding' WHEN 2 THEN 'Chat'
    ELSE 'other' END AS task, 1 - l_discount AS q, 1 - l_tax AS r, l_quantity / 50 AS va,
  l_extendedprice / 100000 AS c, ln(l_quantity + 1) * 100 AS l, l_discount AS f FROM lineitem),
w AS (SELECT *, {_PROFILES.replace('k,', 'lower(task),')} AS w FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(
  [0.42, 0.40, 0.30, 0.34][w]::DOUBLE * least(greatest(q, 0), 1)
  + [0.22, 0.24, 0.16, 0.20][w]::DOUBLE * least(greatest(r, 0), 1)
  + [0.20, 0.14, 0.10, 0.16][w]::DOUBLE * least(greatest(va, 0), 1)
  - [0.05, 0.06, 0.12, 0.10][w]::DOUBLE * least(c, 1)
  - [0.03, 0.04, 0.22, 0.06][w]::DOUBLE * least(l / 4000, 1)
  - [0.08, 0.12, 0.10, 0.14][w]::DOUBLE * f, 8) AS score FROM w""",
)
def _(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    task = F.when(n == 0, "Clinical").when(n == 1, "coding").when(n == 2, "Chat").otherwise("other")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", task.alias("task"),
        (1 - F.col("l_discount")).alias("quality"), (1 - F.col("l_tax")).alias("robustness"),
        (F.col("l_quantity") / 50).alias("verifier_agreement"),
        (F.col("l_extendedprice") / 100000).alias("cost"),
        (F.ln(F.col("l_quantity") + 1) * 100).alias("latency"), F.col("l_discount").alias("failure_rate"),
    ).withColumn("w", labeling.score_weights("task"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(labeling.composite_score(F.col("w")), 8).alias("score"))


@query(
    "row_12_measured_metrics",
    with_sql("""SELECT trace_id, round(measured_cost_usd, 9) AS cost, measured_latency_ms AS latency,
  measured_correctness AS correctness, measured_verified AS verified,
  measured_hallucinated AS hallucinated FROM tm""", "t", "tl", "ts", "tm"),
)
def _(spark, sf_dir):
    return base.measured_traces(spark, sf_dir).select(
        "trace_id", F.round("measured_cost_usd", 9).alias("cost"),
        F.col("measured_latency_ms").alias("latency"),
        F.col("measured_correctness").alias("correctness"),
        F.col("measured_verified").alias("verified"),
        F.col("measured_hallucinated").alias("hallucinated"))


# ---------------------------------------------------------------- provider and router metrics


@query(
    "row_08_agg_01_provider_quality",
    with_sql("""SELECT provider,
  round(avg(CASE WHEN label IN ('accepted', 'good_training_candidate', 'success') THEN 1.0 ELSE 0.0
    END), 9) AS success_rate, count(*) AS row_count,
  round(avg(quality_score / greatest(cost_usd, 0.001::DOUBLE)), 6) AS cost_normalized_quality
FROM ts GROUP BY provider""", "t", "tl", "ts"),
)
def _(spark, sf_dir):
    rows = metrics.performance_rows(base.scored(spark, sf_dir))
    rates = metrics.provider_success_rate(rows)
    quality = rows.groupBy("provider").agg(
        F.round(F.avg(metrics.cost_normalized_quality()), 6).alias("cost_normalized_quality"))
    return rates.join(quality, "provider").withColumn("success_rate", F.round("success_rate", 9))


@query(
    "agg_02_rescue_rate",
    with_sql("""SELECT coalesce(avg(CASE WHEN trace_id % 9 = 0 THEN 1.0 ELSE 0.0 END), 0.0)
  AS rescue_rate FROM t""", "t"),
)
def _(spark, sf_dir):
    rows = metrics.performance_rows(base.labelled(spark, sf_dir).withColumn(
        "label", F.when(F.col("trace_id") % 9 == 0, "rescued_by_stronger_model").otherwise(F.col("label"))))
    return metrics.escalation_rescue_rate(rows)


@query(
    "agg_03_candidate_policy",
    with_sql("""SELECT 'router_policy_candidate_v1' AS version, string_agg(provider, ','
  ORDER BY r DESC, provider) AS preferred, 0.8 AS min_success_rate FROM (
  SELECT provider, avg(CASE WHEN label = 'accepted' THEN 1.0 ELSE 0.0 END) AS r FROM tl
  GROUP BY provider)""", "t", "tl"),
)
def _(spark, sf_dir):
    policy = metrics.candidate_policy(metrics.performance_rows(base.labelled(spark, sf_dir)))
    return policy.select("version", F.array_join("preferred_providers", ",").alias("preferred"),
                         "min_success_rate")


_METRICS = """sum(measured_cost_usd) / nullif(sum(measured_verified), 0) AS cost_per_verified_task,
  avg(measured_correctness) AS correctness,
  sum(measured_verified) / count(*) AS verification_pass_rate, avg(measured_safety) AS safety_score,
  avg(measured_latency_ms) AS latency_ms, avg(measured_hallucinated) AS hallucination_rate,
  sum(measured_cost_usd) / count(*) AS avg_cost_usd"""


@query(
    "agg_04_router_metrics",
    with_sql(f"""SELECT model, round(coalesce(cost_per_verified_task, 'inf'::DOUBLE), 6)
  AS cost_per_verified_task, round(correctness, 9) AS correctness,
  round(verification_pass_rate, 9) AS verification_pass_rate, round(latency_ms, 6) AS latency_ms,
  round(avg_cost_usd, 9) AS avg_cost_usd
FROM (SELECT model, {_METRICS} FROM tm GROUP BY model)""", "t", "tl", "ts", "tm"),
)
def _(spark, sf_dir):
    rows = base.measured_traces(spark, sf_dir).groupBy("model").agg(*metrics.router_metrics())
    return rows.select(
        "model", F.round("cost_per_verified_task", 6).alias("cost_per_verified_task"),
        F.round("correctness", 9).alias("correctness"),
        F.round("verification_pass_rate", 9).alias("verification_pass_rate"),
        F.round("latency_ms", 6).alias("latency_ms"), F.round("avg_cost_usd", 9).alias("avg_cost_usd"))


@query(
    "agg_05_provider_profile",
    with_sql(f"""SELECT 'Beta' AS provider, n AS sample_count, round(correctness, 9) AS correctness,
  round(latency_ms, 6) AS latency_ms FROM (SELECT count(*) AS n, {_METRICS} FROM tm
  WHERE provider = 'beta')""", "t", "tl", "ts", "tm"),
)
def _(spark, sf_dir):
    return metrics.provider_profile(base.measured_traces(spark, sf_dir), "Beta").select(
        "provider", "sample_count", F.round("correctness", 9).alias("correctness"),
        F.round("latency_ms", 6).alias("latency_ms"))


_ELIGIBLE = """provider <> 'beta' AND label NOT IN ('failed_tests', 'failed_verification',
  'hallucinated', 'unsafe_or_policy_blocked', 'rescued_by_stronger_model')
  AND NOT regexp_matches(lower(concat_ws(' ', trace_type, task_id, prompt, response)),
    'unsafe|clinical|diagnosis|legal|payment|secret')
  AND trace_type IN ('router_trace', 'coding_trace', 'planner_trace', 'verification_trace',
    'worker_trace')"""

_REPLAY = f"""prof AS (SELECT {_METRICS} FROM tm WHERE provider = 'beta'),
cases AS (SELECT *, row_number() OVER (ORDER BY trace_id) - 1 AS i, {_ELIGIBLE} AS elig FROM tm),
arms AS (SELECT 'control' AS arm, i % 2 AS chunk, measured_cost_usd, measured_latency_ms,
    measured_correctness, measured_verified, measured_safety, measured_hallucinated FROM cases
  UNION ALL SELECT 'variant', i % 2,
    CASE WHEN elig THEN prof.avg_cost_usd ELSE measured_cost_usd END,
    CASE WHEN elig THEN prof.latency_ms ELSE measured_latency_ms END,
    CASE WHEN elig THEN prof.correctness ELSE measured_correctness END,
    CASE WHEN elig THEN prof.verification_pass_rate ELSE measured_verified END,
    CASE WHEN elig THEN prof.safety_score ELSE measured_safety END,
    CASE WHEN elig THEN prof.hallucination_rate ELSE measured_hallucinated END
  FROM cases CROSS JOIN prof),
wide AS (SELECT arm, chunk, coalesce(cost_per_verified_task, 'Infinity'::DOUBLE) AS cost_per_verified_task,
  correctness, verification_pass_rate, safety_score, latency_ms, hallucination_rate, avg_cost_usd
  FROM (SELECT arm, chunk, {_METRICS} FROM arms GROUP BY arm, chunk)),
lng AS (UNPIVOT wide ON cost_per_verified_task, correctness, verification_pass_rate, safety_score,
  latency_ms, hallucination_rate, avg_cost_usd INTO NAME metric VALUE value),
cmp AS (SELECT metric, avg(value) FILTER (arm = 'control') AS control,
  avg(value) FILTER (arm = 'variant') AS variant FROM lng GROUP BY metric)"""


@query(
    "val_30_eligibility",
    with_sql(f"SELECT trace_id, {_ELIGIBLE} AS eligible FROM tl", "t", "tl"),
)
def _(spark, sf_dir):
    return base.labelled(spark, sf_dir).select(
        "trace_id", metrics.eligible_for_variant("beta").alias("eligible"))


@query(
    "agg_06_compare_arms",
    with_sql("", "t", "tl", "ts", "tm").rstrip() + f""", {_REPLAY}
SELECT metric, round(control, 6) AS control, round(variant, 6) AS variant,
  round(variant - control, 6) AS delta FROM cmp""",
)
def _(spark, sf_dir):
    rows = base.measured_traces(spark, sf_dir)
    cases = metrics.benchmark_cases(rows, "beta")
    arms = metrics.chunk_metrics(metrics.replay(cases, metrics.provider_profile(rows, "beta"), "beta"))
    table_ = metrics.compare_arms(metrics.long_metrics(arms, ["arm", "chunk"], list(metrics.METRICS)))
    return table_.select("metric", *[F.round(c, 6).alias(c) for c in ("control", "variant", "delta")])


@query(
    "agg_08_measured_experiment",
    with_sql("", "t", "tl", "ts", "tm").rstrip() + f""", {_REPLAY},
x AS (SELECT metric, control, variant, metric IN ('cost_per_verified_task', 'latency_ms',
  'hallucination_rate') AS lower FROM cmp),
y AS (SELECT metric, CASE WHEN lower THEN variant > control ELSE variant < control END AS worse,
  control, variant FROM x),
rep AS (SELECT count(*) AS n FROM wide a JOIN wide b ON a.chunk = b.chunk AND a.arm = 'control'
  AND b.arm = 'variant' WHERE b.cost_per_verified_task <= a.cost_per_verified_task)
SELECT 'cost_per_verified_task' AS primary_metric,
  (SELECT variant <= control * 0.95::DOUBLE FROM x WHERE metric = 'cost_per_verified_task')
    AS primary_metric_improved,
  (SELECT coalesce(string_agg(metric, ',' ORDER BY metric), '') FROM y WHERE worse
    AND metric IN ('correctness', 'verification_pass_rate')) AS regressions,
  (SELECT NOT worse FROM y WHERE metric = 'safety_score') AS safety_passed,
  (SELECT NOT worse FROM y WHERE metric = 'verification_pass_rate') AS verification_passed,
  (SELECT n FROM rep) AS reproducible_runs, 'ready_for_gate' AS status,
  (SELECT count(*) FROM cases) AS case_count,
  (SELECT count(*) FROM cases WHERE elig) AS eligible_variant_cases""",
)
def _(spark, sf_dir):
    report = metrics.measured_router_experiment(base.measured_traces(spark, sf_dir), "beta")
    return report.select(
        "primary_metric", "primary_metric_improved",
        F.array_join("regressions", ",").alias("regressions"), "safety_passed",
        "verification_passed", F.col("reproducible_runs").cast("long").alias("reproducible_runs"),
        "status", "case_count", "eligible_variant_cases")


@query(
    "win_08_round_robin",
    with_sql("SELECT trace_id, (row_number() OVER (ORDER BY trace_id) - 1) % 3 AS chunk FROM t", "t"),
)
def _(spark, sf_dir):
    rows = with_row_index(base.traces(spark, sf_dir), "trace_id", name="n")
    return rows.select("trace_id", (F.col("n") % 3).alias("chunk"))


@query(
    "agg_41_opportunities",
    with_sql("", "t", "tl").rstrip() + """,
rep AS (SELECT failure_type FROM tl WHERE failure_type IS NOT NULL
  AND failure_type <> 'duplicated_work' GROUP BY 1 HAVING count(*) >= 2),
same AS (SELECT objective FROM tl WHERE objective IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)
SELECT category, matched, risk_level FROM (
SELECT 'router_mistake' AS category, count(*) AS matched, 'medium' AS risk_level FROM tl
  WHERE failure_type = 'bad_router_assignment' OR label = 'rescued_by_stronger_model'
UNION ALL SELECT 'repeated_failure', CASE WHEN (SELECT count(*) FROM rep) > 0
  THEN (SELECT count(*) FROM tl) ELSE 0 END, 'low'
UNION ALL SELECT 'expensive_success', count(*), 'low' FROM tl
  WHERE label = 'accepted' AND cost_usd > 0.05
UNION ALL SELECT 'duplicate_effort', CASE WHEN (SELECT count(*) FROM same) > 0
  OR (SELECT count(*) FROM tl WHERE failure_type = 'duplicated_work') > 0
  THEN (SELECT count(*) FROM tl) ELSE 0 END, 'low'
UNION ALL SELECT 'missing_benchmark', CASE WHEN (SELECT count(*) FROM tl
    WHERE trace_type = 'benchmark_trace') = 0 THEN (SELECT count(*) FROM tl
    WHERE failure_type IS NOT NULL OR starts_with(label, 'failed')) ELSE 0 END, 'low'
UNION ALL SELECT 'prompt_confusion', count(*), 'medium' FROM tl
  WHERE failure_type IN ('format_failure', 'context_loss') OR contains(lower(notes), 'confus')
) WHERE matched > 0""",
)
def _(spark, sf_dir):
    rows = experiments.mark_weak(experiments.opportunities(base.labelled(spark, sf_dir)))
    return rows.filter("status = 'proposed'").select("category", "matched", "risk_level")


@query(
    "agg_41_opportunity_traces",
    with_sql("""SELECT 'router_mistake' AS category, trace_id FROM tl
  WHERE failure_type = 'bad_router_assignment' OR label = 'rescued_by_stronger_model'
UNION ALL SELECT 'expensive_success', trace_id FROM tl WHERE label = 'accepted' AND cost_usd > 0.05
UNION ALL SELECT 'missing_benchmark', trace_id FROM tl
  WHERE failure_type IS NOT NULL OR starts_with(label, 'failed')
UNION ALL SELECT 'prompt_confusion', trace_id FROM tl
  WHERE failure_type IN ('format_failure', 'context_loss') OR contains(lower(notes), 'confus')""",
             "t", "tl"),
)
def _(spark, sf_dir):
    return experiments.opportunity_traces(base.labelled(spark, sf_dir))
