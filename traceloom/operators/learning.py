"""Route classifiers with ``pyspark.ml``: flat models, two-level models, option resolve."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import CountVectorizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ("tokens_log", "dependency_count", "subtask_count", "eligible_option_count")


def feature_columns(rows: DataFrame) -> DataFrame:
    """One-hot words and numbers of a ranking row, ready for the vectoriser.

    Rows have risk, verification_floor, estimated_input_tokens, dependency_count,
    subtask_count, eligible_option_count, required_capabilities, boundary_states, signals.
    """
    signals = F.transform(
        F.map_entries(F.map_filter("signals", lambda _, on: on)),
        lambda e: F.concat(F.lit("signal="), e["key"]),
    )
    words = F.concat(
        F.array(F.concat(F.lit("risk="), "risk"),
                F.concat(F.lit("verification="), "verification_floor")),
        F.transform("required_capabilities", lambda c: F.concat(F.lit("capability="), c)),
        F.transform("boundary_states", lambda s: F.concat(F.lit("boundary="), s)),
        signals,
    )
    return rows.withColumns(
        {
            "words": words,
            "tokens_log": F.log1p(F.col("estimated_input_tokens").cast("double")),
            **{n: F.col(n).cast("double") for n in NUMBERS[1:]},
        }
    )


def exact_label(model: Column, effort: Column) -> Column:
    return F.concat_ws("|", model, effort)


def resolve_option(candidates: Column, model: Column, effort: Column) -> Column:
    """The eligible option of a predicted model and effort, else null (an invalid pick)."""
    return F.get(
        F.filter(
            candidates, lambda o: (o["model_id"] == model) & (o["reasoning_effort"] == effort)
        ),
        F.lit(0),
    )


def resolve_family(candidates: Column, families: dict[str, str], family: Column, effort: Column) -> Column:
    """First eligible option of a model family with the predicted effort."""
    member = F.create_map(*[F.lit(x) for pair in families.items() for x in pair])
    return F.get(
        F.filter(
            candidates,
            lambda o: (F.try_element_at(member, o["model_id"]) == family)
            & (o["reasoning_effort"] == effort),
        ),
        F.lit(0),
    )


def _stages(label: str, estimator, scale: bool) -> list:
    vectors = VectorAssembler(inputCols=["bag", *NUMBERS], outputCol="assembled")
    features = "scaled" if scale else "assembled"
    stages = [
        StringIndexer(inputCol=label, outputCol="target", handleInvalid="skip"),
        CountVectorizer(inputCol="words", outputCol="bag", binary=True),
        vectors,
    ]
    if scale:
        stages.append(StandardScaler(inputCol="assembled", outputCol="scaled", withMean=False))
    return [*stages, estimator.copy().setFeaturesCol(features).setLabelCol("target")]


def estimators(seed: int = 1701, trees: int = 100, rounds: int = 20) -> dict:
    """The three compared learners. Boosting is binary, so it is fitted one against the rest."""
    return {
        "tabular_logistic": LogisticRegression(maxIter=100),
        "tabular_random_forest": RandomForestClassifier(
            numTrees=trees, minInstancesPerNode=2, seed=seed
        ),
        "tabular_gradient_boosting": OneVsRest(
            classifier=GBTClassifier(maxIter=rounds, stepSize=0.06, maxDepth=4, seed=seed)
        ),
    }


def fit(train: DataFrame, estimator, label: str = "label", scale: bool = True) -> PipelineModel:
    return Pipeline(stages=_stages(label, estimator, scale)).fit(train)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``predicted_label`` and ``confidence`` (1 where a learner gives no probability)."""
    labels = next(s for s in model.stages if hasattr(s, "labels")).labels
    without = rows.drop("target")
    scored = model.transform(without)
    names = F.array(*[F.lit(name) for name in labels])
    confidence = (
        F.array_max(vector_to_array("probability")) if "probability" in scored.columns
        else F.lit(1.0)
    )
    return scored.select(
        *without.columns,
        F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted_label"),
        confidence.alias("confidence"),
    )


def judge(predicted: DataFrame) -> DataFrame:
    """Compare exact-label predictions with the chosen option of each row."""
    parts = F.split("predicted_label", r"\|", 2)
    rows = predicted.withColumn(
        "__o", resolve_option(F.col("candidates"), parts[0], parts[1])
    )
    return rows.select(
        "row_id",
        "risk",
        F.coalesce(F.col("__o.option_id") == F.col("chosen_option_id"), F.lit(False)).alias("correct"),
        F.col("__o").isNotNull().alias("valid"),
        "confidence",
        (parts[0] == F.col("chosen_model_id")).alias("model_correct"),
        (parts[1] == F.col("chosen_effort")).alias("effort_correct"),
    )


def fit_two_level(train: DataFrame, scale: bool = False, vectors: str | None = None) -> dict:
    """A family model, and one effort model per family (a constant for a single effort).

    Families are a handful of names; only their distinct pairs reach the driver.
    """
    def learner(rows, label):
        estimator = LogisticRegression(maxIter=100)
        if vectors is None:
            return fit(rows, estimator, label, scale)
        stages = [StringIndexer(inputCol=label, outputCol="target", handleInvalid="skip")]
        source = vectors
        if scale:
            stages.append(StandardScaler(inputCol=vectors, outputCol="scaled", withMean=False))
            source = "scaled"
        stages.append(estimator.setFeaturesCol(source).setLabelCol("target"))
        return Pipeline(stages=stages).fit(rows)

    pairs = train.select("family", "effort").distinct().collect()
    by_family: dict[str, set] = {}
    for row in pairs:
        by_family.setdefault(row["family"], set()).add(row["effort"])
    heads = {}
    for family in sorted(by_family):
        efforts = by_family[family]
        heads[family] = (
            {"constant": next(iter(efforts))} if len(efforts) == 1
            else {"model": learner(train.filter(F.col("family") == family), "effort")}
        )
    top = (
        {"constant": next(iter(by_family))} if len(by_family) == 1
        else {"model": learner(train, "family")}
    )
    return {"family": top, "efforts": heads}


def predict_two_level(model: dict, rows: DataFrame) -> DataFrame:
    """Family, effort and the product of both confidences, row by row."""
    if "constant" in model["family"]:
        staged = rows.withColumns(
            {"p_family": F.lit(model["family"]["constant"]), "family_confidence": F.lit(1.0)}
        )
    else:
        staged = predict(model["family"]["model"], rows).withColumnsRenamed(
            {"predicted_label": "p_family", "confidence": "family_confidence"}
        )
    done = None
    for family, head in model["efforts"].items():
        part = staged.filter(F.col("p_family") == family)
        if "constant" in head:
            part = part.withColumns(
                {"p_effort": F.lit(head["constant"]), "effort_confidence": F.lit(1.0)}
            )
        else:
            part = predict(head["model"], part).withColumnsRenamed(
                {"predicted_label": "p_effort", "confidence": "effort_confidence"}
            )
        done = part if done is None else done.unionByName(part)
    return done.withColumn("confidence", F.col("family_confidence") * F.col("effort_confidence"))


def with_vector(rows: DataFrame, array: str, name: str = "vector") -> DataFrame:
    """Supplied float arrays as ML vectors."""
    return rows.withColumn(name, array_to_vector(F.col(array).cast("array<double>")))
