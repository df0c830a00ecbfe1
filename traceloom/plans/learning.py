"""Queries that fit and evaluate route classifiers."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from traceloom.operators import learning as ml
from traceloom.operators import routing as rt
from traceloom.plans.base import query, table, with_sql
from traceloom.plans.routing import _CHOSEN, _SETS, ranking, sets
from traceloom.session import durable

FAMILIES = {f"NATION_{i}": ("small", "mid", "top")[i % 3] for i in range(25)}


def labelled_rows(spark, sf_dir):
    """Ranking rows with their features and labels, split by task group.

    Option lists are left out, as these rows are stored; :func:`with_options` gives them back.
    """
    rows = ranking(spark, sf_dir).filter("problem is null")
    signals = F.create_map(*[x for s in ("security", "migration") for x in (F.lit(s), F.col(f"signals.{s}"))])
    family = F.element_at(F.create_map(*[F.lit(x) for p in FAMILIES.items() for x in p]), F.col("chosen_model_id"))
    # Stored before the split, which reads the groups first and would make every ranking row twice.
    rows = durable(rows.select(
        F.concat_ws("/", "task_id", "subtask_id").alias("row_id"), "catalog_hash", "task_group", "risk", "verification_floor", "estimated_input_tokens", "dependency_count",
        F.lit(1).alias("subtask_count"), "eligible_option_count", "required_capabilities", "boundary_states",
        signals.alias("signals"), "chosen_option_id", "chosen_model_id", "chosen_effort",
        family.alias("family"), F.col("chosen_effort").alias("effort"),
        ml.exact_label(F.col("chosen_model_id"), F.col("chosen_effort")).alias("label")))
    features = ml.feature_columns(rows).drop("verification_floor", "boundary_states", "signals")
    return rt.group_split(features, rows.select("task_group"))


def with_options(spark, sf_dir, rows):
    """Rows of :func:`labelled_rows` with the options of their requirements."""
    return sets(spark, sf_dir, subtasks=rows).drop("cell", "rejected_models", "list_hash", "problem")


_LABELLED = f"""{_SETS}, {_CHOSEN},
lb AS (SELECT ch.* FROM ch WHERE n >= 2),
lg AS (SELECT DISTINCT task_group FROM lb),
lr AS (SELECT *, row_number() OVER (ORDER BY sha256('1701:' || task_group), task_group) - 1 AS place,
  count(*) OVER () AS c FROM lg),
le AS (SELECT lb.* FROM lb JOIN lr USING (task_group)
  WHERE place < greatest(1, least(c - 1, round_even(c * 0.2::DOUBLE, 0))))"""


@query(
    "ml_01_flat_classifier",
    with_sql("", "m", "b", "sb", "opt").rstrip() + f""", {_LABELLED}
SELECT count(*) AS rows, TRUE AS ordered FROM le""",
)
def _(spark, sf_dir):
    rows = durable(labelled_rows(spark, sf_dir))
    model = ml.fit(rows.filter("split = 'train'"), LogisticRegression(maxIter=20))
    predicted = ml.predict(model, rows.filter("split = 'eval'"))
    judged = ml.judge(with_options(spark, sf_dir, predicted))
    return rt.prediction_metrics(judged).select(
        "rows", (F.col("option_accuracy") <= F.col("model_accuracy")).alias("ordered"))


@query("ml_02_two_level_classifier")
def _(spark, sf_dir):
    rows = durable(labelled_rows(spark, sf_dir))
    model = ml.fit_two_level(rows.filter("split = 'train'"))
    predicted = with_options(
        spark, sf_dir, ml.predict_two_level(model, rows.filter("split = 'eval'")))
    option = ml.resolve_family(F.col("candidates"), FAMILIES, F.col("p_family"), F.col("p_effort"))
    return predicted.select(
        (F.col("confidence") <= F.col("family_confidence") + 1e-9).alias("bounded"),
        option.isNotNull().alias("valid")).groupBy("bounded", "valid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ml_03_label_resolve",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber % 3 <> 1 AS valid FROM lineitem",
)
def _(spark, sf_dir):
    option = F.struct(F.concat(F.lit("m"), "l_suppkey").alias("model_id"), F.lit("low").alias("reasoning_effort"),
                      F.lit("o").alias("option_id"))
    effort = F.when(F.col("l_linenumber") % 3 == 1, "high").otherwise("low")
    picked = ml.resolve_option(F.array(option), F.concat(F.lit("m"), "l_suppkey"), effort)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", picked.isNotNull().alias("valid"))


@query("ml_04_vector_classifier")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.concat(F.lit("f"), F.col("label") % 3).alias("family"),
        F.concat(F.lit("e"), F.col("label") % 2).alias("effort"))
    rows = durable(ml.with_vector(rows, "embedding"))
    model = ml.fit_two_level(rows.filter("vec_id % 5 <> 0"), scale=True, vectors="vector")
    predicted = ml.predict_two_level(model, rows.filter("vec_id % 5 = 0"))
    return predicted.groupBy((F.col("p_family") == F.col("family")).alias("family_right")).agg(
        F.count(F.lit(1)).alias("n"))
