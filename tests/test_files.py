"""File sources and sinks, and the streaming ingest."""

import hashlib
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from traceloom.functions import text as tx
from traceloom.operators import datasets, labeling
from traceloom.sources import logs, sinks
from traceloom.streaming import jobs

GOOD = {"trace_type": "coding_trace", "prompt": "Fix the parser for me@example.org please now", "response": "done",
        "tests_run": [{"name": "unit", "status": "passed"}], "metadata": {"api_key": "x", "note": "token=abc"}}
FAILING = {**GOOD, "prompt": "Entirely different request about charts", "response": "broke",
           "tests_run": [{"status": "failed"}]}
UNKNOWN = {**GOOD, "trace_type": "mystery"}


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_ingest_counts_labels_and_redaction(spark, tmp_path):
    path = write(tmp_path / "t.jsonl", [GOOD, GOOD, "", FAILING, UNKNOWN, "{bad"])
    rows = logs.ingest(logs.read_lines(spark, path)).cache()
    report = logs.ingest_report(rows).first()
    assert (report["accepted"], report["duplicates"], report["rejected"], report["malformed"]) == (2, 1, 1, 1)
    kept = rows.filter("status = 'accepted'").withColumn("trace_id", F.col("ordinal"))
    labels = [r["label"] for r in labeling.label_run(kept).orderBy("trace_id").collect()]
    assert labels == ["accepted", "failed_tests"]
    first = kept.orderBy("ordinal").first()
    assert "[REDACTED_EMAIL]" in first["prompt"]
    assert json.loads(first["metadata"]) == {"api_key": "[REDACTED_SECRET]", "note": "token=[REDACTED_SECRET]"}
    errors = [r["text"] for r in logs.ingest_messages(rows).filter("kind = 'error'").orderBy("ordinal").collect()]
    assert errors[0].startswith("line 5: trace_type") and errors[1].startswith("line 6: invalid JSON")


def test_near_copy_of_same_task_is_not_stored(spark, tmp_path):
    base = {"type": "worker_trace", "task_id": "t-1", "output": "same answer here",
            "input": " ".join(f"word{i}" for i in range(20))}
    path = write(tmp_path / "n.jsonl", [base, {**base, "input": base["input"] + " extra"},
                                        {**base, "task_id": "t-2"}])
    rows = logs.ingest(logs.read_lines(spark, path)).orderBy("ordinal").collect()
    assert [r["status"] for r in rows] == ["accepted", "duplicate", "accepted"]
    assert rows[1]["duplicate_mark"].startswith("near:0:0.9")


def test_unique_and_pinned_files(spark, tmp_path):
    path = write(tmp_path / "u.jsonl", [{"id": "a"}, {"id": "b"}])
    assert logs.read_unique(spark, path, "id").count() == 2
    digest = hashlib.sha256((tmp_path / "u.jsonl").read_bytes()).hexdigest()
    assert logs.verified_dataset(spark, path, digest).count() == 2
    with pytest.raises(logs.SourceError):
        logs.verified_dataset(spark, path, "0" * 64)
    with pytest.raises(logs.SourceError):
        logs.read_unique(spark, write(tmp_path / "d.jsonl", [{"id": "a"}, {"id": "a"}]), "id")
    document = write(tmp_path / "c.json", [{"cases": [{"id": 1}, {"id": 2}]}])
    assert logs.benchmark_case_lines(spark, document).count() == 2
    assert logs.benchmark_case_lines(spark, path).count() == 2


def test_frozen_and_write_once(spark, tmp_path):
    rows = spark.range(10).withColumn("v", F.col("id") * 2)
    path = str(tmp_path / "bench")
    sinks.freeze(rows, path, name="b")
    with pytest.raises(sinks.FrozenError):
        sinks.freeze(rows, path, name="b")
    sinks.verify_frozen(spark, path)
    rows.filter("id > 3").write.mode("overwrite").parquet(f"{path}/data")
    with pytest.raises(sinks.FrozenError):
        sinks.verify_frozen(spark, path)
    once = str(tmp_path / "once")
    assert sinks.write_once(rows, once) == "written"
    assert sinks.write_once(rows.repartition(7), once) == "unchanged"
    with pytest.raises(sinks.FrozenError):
        sinks.write_once(rows.filter("id > 1"), once)


def test_dataset_sink_and_public_gate(spark, tmp_path):
    traces = spark.createDataFrame(
        [(1, "worker_trace", "p", "r", "local_only"), (2, "worker_trace", "q", "s", "public_benchmark")],
        "trace_id long, trace_type string, prompt string, response string, privacy_status string")
    rows = datasets.typed_rows(traces, ["router"])
    manifest = sinks.write_dataset(rows, str(tmp_path / "d"), name="router", dataset_type="router")
    assert manifest.first()["item_count"] == 2
    with pytest.raises(datasets.ExportBlocked):
        datasets.require_public(traces)
    with pytest.raises(PermissionError):
        datasets.local_training_rows(traces, opt_in=False)
    assert datasets.require_public(traces.filter("trace_id = 2")).count() == 1


def test_streaming_ingest_remembers_earlier_batches(spark, tmp_path):
    source, out, check = (tmp_path / n for n in ("in", "out", "check"))
    source.mkdir()
    write(source / "a.jsonl", [GOOD, FAILING])
    for step in range(2):
        query = jobs.ingest_stream(spark, str(source), str(out), str(check), near_threshold=0.82)
        query.awaitTermination(120)
        assert query.exception() is None
        if step == 0:
            write(source / "b.jsonl", [GOOD, {**GOOD, "prompt": "Something new about graphs and trees"}])
    rows = spark.read.parquet(str(out)).groupBy("batch", "status").count().collect()
    assert {(r["batch"], r["status"]): r["count"] for r in rows} == {
        (0, "accepted"): 2, (1, "duplicate"): 1, (1, "accepted"): 1}


def test_live_health_and_conformance(spark, tmp_path):
    log = spark.createDataFrame(
        [("j", i, 0.9 if i >= 4 else 0.1, 0.0, 0.8, 0.0) for i in range(8)],
        "job_id string, update long, kl_divergence double, zero_variance_group double, "
        "completion_diversity double, hard_limit_fraction double")
    log.write.parquet(str(tmp_path / "log"))
    stream = jobs.health_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")))
    query = stream.writeStream.format("memory").queryName("aborts").option(
        "checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r["update"] for r in spark.table("aborts").orderBy("update").collect()] == [6, 7]
    events = spark.createDataFrame(
        [("w", "action", True, "2024-01-01 00:00:00"), ("w", "action", False, "2024-01-01 00:01:00")],
        "workflow_id string, kind string, accepted boolean, at string").select(
        "workflow_id", "kind", "accepted", F.to_timestamp("at").alias("created_at"),
        F.when(F.col("accepted"), F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("violations"))
    events.write.parquet(str(tmp_path / "ev"))
    live = jobs.conformance_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    query = live.writeStream.format("memory").queryName("live").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("live").first()["step_adherence"] == 0.5


def test_live_mean_kl_is_the_batch_rule(spark, tmp_path):
    from traceloom.operators import health

    log = spark.createDataFrame(
        [(job, i, 0.1 if i % 3 == 0 else high, 0.0, 0.8, 0.0) for job, high in (("a", 1.0), ("b", 0.6))
         for i in range(40)],
        "job_id string, update long, kl_divergence double, zero_variance_group double, "
        "completion_diversity double, hard_limit_fraction double")
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    limits = {"kl_abort_window": 25}  # deeper than every other window
    stream = jobs.health_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), limits)
    query = stream.writeStream.format("memory").queryName("mean_kl").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = health.health_abort(log, limits).filter("abort_reason is not null").select("job_id", "update", "abort_reason")
    got = sorted(map(tuple, spark.table("mean_kl").collect()))
    assert got == sorted(map(tuple, want.collect()))
    assert got[0] == ("a", 24, "mean KL exceeded 0.5 over 25 updates") and len(got) == 16


def test_updates_that_come_late_are_judged_in_order(spark, tmp_path):
    from traceloom.operators import health

    log = spark.createDataFrame(
        [(job, i, 0.9 if i % 7 < 4 else 0.1, float(i % 3 > 0), 0.8, 0.0) for job in "ab" for i in range(60)],
        "job_id string, update long, kl_divergence double, zero_variance_group double, "
        "completion_diversity double, hard_limit_fraction double").orderBy(F.xxhash64("job_id", "update"))
    for part in log.randomSplit([1.0] * 5, 3):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log.limit(30).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))  # some come twice
    arrivals = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = jobs.drained(jobs.health_stream(arrivals), str(tmp_path / "out"))
    want = health.health_abort(log, None).filter("abort_reason is not null").select("job_id", "update", "abort_reason")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20


def test_no_update_is_given_up_however_many_wait(spark, tmp_path):
    from traceloom.operators import health

    log = spark.range(12_000).select(
        F.lit("j").alias("job_id"), F.col("id").alias("update"),
        F.when((F.col("id") < 5) | (F.col("id") % 997 < 40), 0.9).otherwise(0.1).alias("kl_divergence"),
        (F.col("id") % 1000 > 975).cast("double").alias("zero_variance_group"),
        F.lit(0.8).alias("completion_diversity"), F.lit(0.0).alias("hard_limit_fraction"))
    for part in ("update > 0", "update = 0"):  # all others wait for the first
        log.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    arrivals = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = sorted(map(tuple, jobs.drained(jobs.health_stream(arrivals), str(tmp_path / "out")).collect()))
    want = health.health_abort(log, None).filter("abort_reason is not null").select("job_id", "update", "abort_reason")
    assert got == sorted(map(tuple, want.collect()))
    assert [row[1] for row in got[:3]] == [2, 3, 4] and len({row[2] for row in got}) == 2


def test_redaction_edges(spark):
    texts = ["mail a.b@c.org", "Authorization: Bearer abcdefghijklmnop", "api_key='s3cret'", "x" * 40, "sk-" + "a" * 14]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(tx.redact_text("t")).collect()]
    assert got == ["mail [REDACTED_EMAIL]", "Authorization=[REDACTED_SECRET] [REDACTED_TOKEN]",
                   "api_key=[REDACTED_SECRET]'", "[REDACTED_KEY]", "[REDACTED_KEY]"]


def test_a_job_costs_one_read_and_one_write_of_state_a_batch():
    class Held:
        value, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, name, schema, ttlDurationMs=None):
            return Held()

    judge = jobs.HealthProcessor()
    judge.init(Handle())
    row = Row("job_id", "update", *jobs.HEALTH_COLUMNS)
    late = [row("j", i, 0.9, 0.0, 0.8, 0.0) for i in range(300, 0, -1)]
    assert list(judge.handleInputRows(("j",), iter(late), None)) == []  # all wait for update 0
    found = list(judge.handleInputRows(("j",), iter([row("j", 0, 0.9, 0.0, 0.8, 0.0)]), None))
    assert [r["update"] for r in found] == list(range(2, 301))
    assert Held.calls == ["get", "update"] * 2


def test_live_rules_skip_nulls_as_the_batch_rules_do(spark, tmp_path):
    from traceloom.operators import health

    log = spark.createDataFrame(
        [("j", i, None if i % 3 == 0 else 0.9, None if i % 2 else 1.0, None if i < 30 else 0.1, None)
         for i in range(60)] + [("k", i, None, None, None, None if i % 4 else 1.0) for i in range(20)],
        "job_id string, update long, kl_divergence double, zero_variance_group double, "
        "completion_diversity double, hard_limit_fraction double")
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    arrivals = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    for name, limits in (("least", {}), ("mean", {"kl_abort_window": 25})):
        got = jobs.drained(jobs.health_stream(arrivals, limits), str(tmp_path / name))
        want = health.health_abort(log, limits).filter("abort_reason is not null")
        rows = sorted(map(tuple, got.collect()))
        assert rows == sorted(map(tuple, want.select("job_id", "update", "abort_reason").collect()))
        assert {r[0] for r in rows} == {"j", "k"}


_EDGE = tx._EDGE
RULES = (  # as they read when every position is tried in full
    (rf"(?iu){_EDGE}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{_EDGE}", "[REDACTED_EMAIL]"),
    (rf"(?iu){_EDGE}Bearer{tx.SPACE}+[A-Za-z0-9._~+/=-]{{12,}}", "Bearer [REDACTED_TOKEN]"),
    (rf"(?iu){_EDGE}(api[_-]?key|token|secret|password|passwd|authorization|bearer){_EDGE}"
     rf"{tx.SPACE}*[:=]{tx.SPACE}*['\"]?([^'\"\s\x0B\x1C-\x1F\x85\p{{Z}},;]+)", "$1=[REDACTED_SECRET]"),
    (rf"{_EDGE}(?:sk-[A-Za-z0-9_-]{{12,}}|[A-Za-z0-9_-]{{20,}}\.[A-Za-z0-9_-]{{20,}}\.[A-Za-z0-9_-]{{20,}}"
     rf"|[A-Za-z0-9_-]{{32,}}){_EDGE}", "[REDACTED_KEY]"),
)


def in_full(value):
    for rule, replacement in RULES:
        value = F.regexp_replace(value, rule, replacement)
    return value


def odd_texts(count):
    import random

    parts = ["api", "apı", "_", "-", "key", "toKen", "ſecret", "SECRET", "paſsword", "passwd", "authorızation",
             "AUTHORİZATION", "Bearer", "bearer", " ", "\x1c", "\n", ":", "=", "'", "@", "a@b.co", "x.y+z@",
             "K@mail.org", ".", ",", "é", "é", "中", "𝒜", "sk-", "abcdefghijkl", "a" * 20, "B" * 32,
             "-" * 15, "9" * 19, "/", "~", "i̇", "." + "q" * 20 + "." + "r" * 20, "task-"]
    draw = random.Random(11)
    return ["".join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for _ in range(count)]


def test_redaction_is_that_of_the_rules_in_full(spark):
    from traceloom.functions import jsonx as jx

    texts = odd_texts(20_000)
    rows = spark.createDataFrame([(t,) for t in [None, "", *texts]], "t string")
    both = rows.select("t", tx.redact_text("t").alias("a"), in_full(F.col("t")).alias("b"))
    assert both.filter("not (a <=> b)").count() == 0 and both.filter("a <> t").count() > 1000
    for text in texts:
        plain = text
        for rule, replacement in jx._PY_RULES:
            plain = rule.sub(replacement, plain)
        assert jx._clean(text) == plain


def test_redaction_passes_over_plain_prose_cheaply(spark):
    import time

    from traceloom.functions import jsonx as jx

    prose = "The quiet garden behind the station, where nothing is kept, was described twice. " * 400
    rows = spark.range(640).select(F.concat(F.lit(prose), F.col("id").cast("string")).alias("t")).persist()
    assert rows.count() == 640

    def least(run):
        taken = []
        for _ in range(4):
            start = time.perf_counter()
            run()
            taken.append(time.perf_counter() - start)
        return min(taken)

    def read(value):
        return lambda: rows.select(F.sum(F.length(value))).first()

    def all_rules():
        for rule, replacement in jx._PY_RULES:
            rule.sub(replacement, prose)

    spent, full = least(read(tx.redact_text("t"))), least(read(in_full(F.col("t"))))
    rows.unpersist()
    assert spent < 0.7 * full, (spent, full)
    spent, full = least(lambda: jx._clean(prose)), least(all_rules)
    assert spent < 0.7 * full, (spent, full)
