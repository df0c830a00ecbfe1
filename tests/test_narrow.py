"""What is stored or shuffled on the way stays narrow, and results stay the same."""

from pyspark.sql import functions as F

from traceloom.operators import outcomes as oc
from traceloom.plans import base

SF = "/root/testdata/sf0.001"


def test_outcome_job_stores_no_wide_rows(spark, monkeypatch):
    stored = []
    kept = oc.durable
    monkeypatch.setattr(oc, "durable", lambda df: stored.append(set(df.columns)) or kept(df))
    job = oc.outcome_job(base.raw_outcomes(spark, SF))
    wide = {*oc.HASHES, "record_hash", "safety_violations"}
    assert stored and not any(wide & columns for columns in stored)
    assert wide < set(job["outcomes"].columns)
    total = base.raw_outcomes(spark, SF).count()
    assert job["outcomes"].count() + job["problems"].count() == total


def test_outcome_texts_are_required_without_outer_space(spark):
    rows = base.raw_outcomes(spark, SF).limit(6).withColumn("n", F.row_number().over(
        base_window())).withColumn("task_id", F.element_at(
            F.array(F.lit("a b"), F.lit(" a"), F.lit("a\n"), F.lit(" "), F.lit(""), F.lit(None)), F.col("n")))
    found = {r["n"]: r["problem"] for r in oc.normalize_outcomes(rows).collect()}
    assert found[1] is None
    assert [found[n] for n in range(2, 7)] == ["task_id is required"] * 5


def base_window():
    from pyspark.sql import Window

    return Window.orderBy("outcome_id")


def shuffled_columns(frame):
    """Names of all columns that pass through an exchange by key."""
    query = frame._jdf.queryExecution()
    text = frame.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(query, "formatted")
    blocks = [b for b in text.split("\n\n") if ") Exchange" in b.split("\n")[0]]
    return {c.strip().rsplit("#", 1)[0] for b in blocks for line in b.split("\n") if line.startswith("Input")
            for c in line.split(": [", 1)[-1].rstrip("]").split(",")}


def test_option_lists_are_not_shuffled(spark):
    from traceloom.plans import registry

    for name in ("val_34_route_violations", "ds_09_join_14_ranking_rows", "top_04_compile_routes",
                 "join_12_set_hashes", "agg_14_ranking_evaluation"):
        moved = shuffled_columns(registry()[name][0](spark, SF))
        assert moved and not moved & {"candidates", "ranked_option_ids", "o"}, (name, moved)


def test_lists_are_the_same_for_few_and_many_needs(spark, monkeypatch):
    from traceloom.operators import routing as rt
    from traceloom.plans import routing

    few = {tuple(r) for r in routing.sets(spark, SF, False).select("task_id", "subtask_id", "list_hash").collect()}
    monkeypatch.setattr(rt, "_SHARED_NEEDS", 0)
    many = {tuple(r) for r in routing.sets(spark, SF, False).select("task_id", "subtask_id", "list_hash").collect()}
    assert few == many and few


def test_violations_of_lists_are_those_of_long_options(spark):
    from traceloom.operators import routing as rt
    from traceloom.plans import routing

    key = F.crc32(F.concat("task_id", "subtask_id")) % 5
    routes = routing.compiled(spark, SF).filter(key != 0).withColumns({
        "option_id": F.when(key == 1, "opt_x").otherwise(F.col("option_id")),
        "fallback_option_id": F.when(key == 2, "opt_y").otherwise(F.col("fallback_option_id")),
        "task_id": F.when(key == 3, F.concat("task_id", F.lit("-no"))).otherwise(F.col("task_id")),
    }).select("task_id", "subtask_id", "option_id", "fallback_option_id", "verification_tier")
    tasks = base.sound_subtasks(spark, SF)
    sets = routing.sets(spark, SF, False)
    long = rt.route_violations(routes, rt.options_of(sets), tasks, base.POLICY)
    listed = rt.listed_violations(
        routing.sets(spark, SF, False, rt.route_subtasks(routes, tasks)), base.POLICY)
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, listed.collect()))


def test_stored_classifier_rows_hold_no_option_lists(spark):
    from traceloom.plans import learning

    rows = learning.labelled_rows(spark, SF)
    assert "candidates" not in rows.columns
    assert learning.with_options(spark, SF, rows).filter("size(candidates) < 2").count() == 0


def test_decided_rows_and_token_sets_are_stored_narrow(spark, monkeypatch):
    from traceloom.operators import dedup
    from traceloom.plans import traces

    stored = []
    kept = dedup.durable
    monkeypatch.setattr(dedup, "durable", lambda df: stored.append(kept(df)) or stored[-1])
    traces.decided_documents(spark, SF, 100)
    results = [df for df in stored if "decision" in df.columns]
    assert results
    for df in results:
        assert df.schema["prompt_tokens"].dataType.elementType.typeName() == "long"
        assert df.filter("kind = 'row' and prompt_tokens is not null").count() == 0
    assert stored[0].filter("task_tokens is not null").count() == 0


def test_postings_of_pairs_hold_no_other_tokens(spark):
    from traceloom.operators import pairs

    rows = spark.range(200).select(
        "id", F.lit(0).alias("kind"), F.array().cast("array<boolean>").alias("flags"),
        F.array(F.lit("a"), F.concat(F.lit("b"), F.col("id") % 50), F.lit("c"), F.lit("d")).alias("t"))
    found = pairs.overlap_candidates(rows, "t", 0.7, False, 16, hot=40)
    assert not {"prefix", "ordered"} & shuffled_columns(found)
    exact = {(i, j) for i in range(200) for j in range(i + 1, 200) if i % 50 == j % 50}
    assert exact <= {tuple(r) for r in found.collect()}


def test_selection_rounds_follow_what_is_taken(spark, monkeypatch):
    from traceloom.operators import health

    stored = []
    kept = health.durable
    monkeypatch.setattr(health, "durable", lambda df: stored.append(1) or kept(df))
    rows = spark.range(1200).select(
        F.concat(F.lit("c"), F.col("id") % 3).alias("candidate_id"), F.format_string("e%04d", "id").alias("entry_key"),
        ((F.col("id") * 7919) % 1009).cast("double").alias("cost_adjusted_score"),
        F.when((F.col("id") % 3 == 2) & (F.col("id") % 10 == 0), -2).otherwise(F.col("id") % 29 + 1)
        .cast("long").alias("parameter_count"),
        (F.col("id") % 300 == 0).alias("required"), F.lit(False).alias("current"))
    budgets = spark.createDataFrame([("c0", 40), ("c1", 90), ("c2", 60)], "candidate_id string, parameter_budget long")
    want = set()
    data = [r.asDict() for r in rows.collect()]
    for candidate, budget in (("c0", 40), ("c1", 90), ("c2", 60)):
        own = [r for r in data if r["candidate_id"] == candidate]
        used = sum(r["parameter_count"] for r in own if r["required"])
        want |= {r["entry_key"] for r in own if r["required"]}
        for r in sorted((r for r in own if not r["required"]), key=lambda r: (-r["cost_adjusted_score"], r["entry_key"])):
            if used + r["parameter_count"] <= budget:
                used += r["parameter_count"]
                want.add(r["entry_key"])
    assert {r.entry_key for r in health.selected_entries(rows, budgets, 0.9, block=50).collect()} == want
    few = rows.filter("candidate_id <> 'c2'")
    stored.clear()
    got = {r.entry_key for r in health.selected_entries(few, budgets, 0.9, block=5).collect()}
    assert got == {k for k in want if int(k[1:]) % 3 != 2}
    assert len(stored) < 20


def exchanges(frame):
    """Names of the columns of each exchange by key."""
    query = frame._jdf.queryExecution()
    text = frame.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(query, "formatted")
    blocks = [b for b in text.split("\n\n") if ") Exchange" in b.split("\n")[0]]
    return [{c.strip().rsplit("#", 1)[0] for line in b.split("\n") if line.startswith("Input")
             for c in line.split(": [", 1)[-1].rstrip("]").split(",")} for b in blocks]


def test_workflow_matches_are_shuffled_without_values(spark, monkeypatch):
    from traceloom.operators import routing as rt
    from traceloom.plans import workflow

    def routes():
        tasks = workflow.workflow_tasks(spark, SF)
        odd = tasks.filter("task_id < 4").withColumns({
            "task_id": F.col("task_id") + 1_000_000, "text": F.lit(None).cast("string"),
            "required_tools": F.lit(None).cast("array<string>"),
            "repository_paths": F.array(F.lit(None).cast("string"), F.lit("src/b.py"))})
        return rt.workflow_routes(tasks.unionByName(odd), workflow.workflows(spark, SF))

    few = routes()
    moved = exchanges(few)
    assert any({"task_id", "workflow_id"} <= columns for columns in moved)
    assert not any("task_id" in columns and columns & {"gram", "text", "value"} for columns in moved)
    monkeypatch.setattr(rt, "_SENT_TRIGGERS", 0)
    many = routes()
    key = lambda r: r["task_id"]
    assert sorted(few.collect(), key=key) == sorted(many.collect(), key=key)


def test_outcomes_are_not_shuffled_by_method(spark, monkeypatch):
    from traceloom.operators import stats as st

    # As large tables are planned: no side is sent because it looks small.
    size = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "-1")
    try:
        deltas = outcome_deltas(spark, st)
        assert not any("method" in columns for columns in exchanges(deltas))
    finally:
        spark.conf.set(size, before)
    assert {tuple(r) for r in deltas.select("position", "delta").collect()} == {(i, -1.0) for i in range(200)}


def outcome_deltas(spark, st):
    rows = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("method"),
        F.floor(F.col("id") / 2).alias("position"), F.col("id").cast("double").alias("value"))
    pairs = spark.createDataFrame([("a-b", "a", "b")], "pair string, left_method string, right_method string")
    return st.paired_deltas(rows, pairs, ["position"])


def test_small_tasks_are_peeled_without_rounds(spark, monkeypatch):
    from traceloom.operators import routing as rt
    from traceloom.plans import routing

    stored = []
    kept = rt.durable
    monkeypatch.setattr(rt, "durable", lambda df: stored.append(1) or kept(df))
    rows = rt.normalize_subtasks(routing.task_documents(spark, SF, cyclic=True))
    small = sorted(map(tuple, rt.cyclic_subtasks(rows).collect()))
    assert len(stored) <= 2
    for most in (0, 3):
        monkeypatch.setattr(rt, "_ROW_EDGES", most)
        assert sorted(map(tuple, rt.cyclic_subtasks(rows).collect())) == small
    assert small


def test_feedback_rows_are_shuffled_once(spark):
    from traceloom.operators import routing as rt
    from traceloom.plans import routing

    records, _ = rt.normalize_feedback(routing.feedback_raw(spark, SF))
    assert sum("outcome_id" in columns for columns in exchanges(records)) == 1
    raw = routing.feedback_raw(spark, SF).limit(2).withColumn("outcome_id", F.lit(None).cast("string"))
    assert rt.normalize_feedback(raw.union(raw))[0].count() == 2


def test_rows_stay_where_they_are_while_repeats_are_few(spark):
    from traceloom.operators import routing as rt

    size = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "-1")
    try:
        marked = rt.mark_repeats(base.subtasks(spark, SF))
        assert not any("objective" in columns or "task_id" in columns for columns in exchanges(marked))
        checked = oc.normalize_outcomes(base.raw_outcomes(spark, SF))
        assert not any("outcome_id" in columns for columns in exchanges(checked))
    finally:
        spark.conf.set(size, before)
    twice = base.subtasks(spark, SF).union(base.subtasks(spark, SF).limit(5))
    assert rt.mark_repeats(twice).filter("problem = 'duplicate subtask_id'").count() >= 10


def test_tokens_of_one_set_are_not_filed_and_rare_ones_come_first(spark, monkeypatch):
    """60,000 tokens, more than hashed counts of a few thousand cells tell apart: each set has 30 of its
    own, 30 that a third of the sets hold and a copy but for two tokens in every twentieth case."""
    import random

    from traceloom.operators import pairs

    pick, sets = random.Random(2), []
    for i in range(2000):
        sets.append((i, [i * 30 + k for k in range(30)] + [10**6 + k for k in pick.sample(range(90), 30)]))
    sets += [(10_000 + i, [*sets[i][1][2:], 10**7 + i]) for i in range(0, 2000, 20)]
    rows = spark.createDataFrame(sets, "id long, t array<bigint>").select(
        "id", F.lit(0).alias("kind"), F.array().cast("array<boolean>").alias("flags"), "t")
    filed, tiled = [], pairs._tiled
    monkeypatch.setattr(pairs, "_tiled", lambda keyed, *rest: (filed.append(keyed.count()), tiled(keyed, *rest))[1])
    found = pairs.overlap_candidates(rows, "t", 0.76, False, 512)
    assert {tuple(r) for r in found.collect()} == {(i, 10_000 + i) for i in range(0, 2000, 20)}
    assert filed[0] < 2 * 100 * 40, filed  # only the copies and what they copy; 63,000 before


def test_texts_of_a_list_are_made_once_per_list(spark, monkeypatch):
    from traceloom.operators import routing as rt
    from traceloom.plans import routing

    def rows():
        return routing.ranking(spark, SF)

    once = rows().select("row_id", "prompt", "candidates", "boundary_states", "chosen_choice_id", "rejected_choice_id")
    assert "format_string" not in once._jdf.queryExecution().executedPlan().toString()
    few = sorted(map(str, once.collect()))
    monkeypatch.setattr(rt, "_SHARED_NEEDS", 0)  # every row prices and writes its own list
    each = rows().select(*once.columns)
    assert "format_string" in each._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, each.collect())) == few


def test_ranking_metrics_read_the_rows_once(spark):
    from traceloom.operators import calibration, routing as rt
    from traceloom.plans import routing

    rows = routing.ranking_predictions(spark, SF)
    out = rt.ranking_metrics(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__one" not in plan
    outcomes = rt.ranked_outcomes(rows)
    want = outcomes.agg(F.count("*"), F.avg(F.col("passed").cast("double")), F.avg("conf"), F.avg("score_margin")).first()
    got = out.first()
    assert [got["rows"], *(round(got[n], 12) for n in ("option_accuracy", "mean_confidence", "mean_score_margin"))] == [
        want[0], *(round(x, 12) for x in want[1:])]
    assert abs(got["ece"] - calibration.binned_error(outcomes, []).first()["ece"]) < 1e-12
    none = rt.ranking_metrics(rows.limit(0)).first()
    assert none["rows"] == 0 and none["ece"] == 0 and none["option_accuracy"] is None


def test_labelled_rows_are_made_once(spark):
    """The split reads the groups, then the rows; neither makes the option lists again."""
    from traceloom.plans import learning

    rows = learning.labelled_rows(spark, SF)
    assert "candidates" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() > 0 and {r[0] for r in rows.select("split").distinct().collect()} == {"train", "eval"}


def test_sound_and_refused_outcomes_are_counted_in_one_reading(spark):
    raw = base.raw_outcomes(spark, SF)
    job = oc.outcome_job(raw.union(raw.limit(3)))
    counts = {r["part"]: r["n"] for r in job["counts"].collect()}
    assert counts == {name: job[name].count() for name in ("outcomes", "problems")} and counts["problems"] > 3
    plan = job["counts"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
