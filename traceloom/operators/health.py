"""Training logs: rolling health rules, reward gaps, summaries, learning curves, depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions import numeric as nx
from traceloom.functions import text as tx
from traceloom.operators.normalize import literal_map
from traceloom.session import durable, with_position

# Windows and limits of the health rules.
HEALTH_DEFAULTS = {
    "kl_threshold": 0.5,
    "kl_abort_consecutive": 3,
    "zero_variance_window": 20,
    "zero_variance_abort_threshold": 0.90,
    "diversity_window": 10,
    "diversity_abort_threshold": 0.20,
    "hard_limit_window": 5,
    "hard_limit_fraction_threshold": 0.5,
}


def framed(rows: DataFrame, keys: list[str], order: str, depth: int, columns: dict,
           block: int = 50_000) -> DataFrame:
    """Window columns over the last ``depth`` rows, without gathering a whole key.

    ``order`` is the dense position inside the key. Rows are cut into blocks of positions and
    each block is given copies of the ``depth`` rows before it, so a key of any length is
    spread over many tasks.
    """
    size = max(block, depth)
    own = rows.withColumns(
        {"__b": F.floor(F.col(order) / size), "__own": F.lit(True)}
    )
    halo = (
        rows.filter(F.pmod(F.col(order), F.lit(size)) >= size - depth)
        .withColumns({"__b": F.floor(F.col(order) / size) + 1, "__own": F.lit(False)})
    )
    window = Window.partitionBy(*keys, "__b").orderBy(order)
    computed = own.unionByName(halo).withColumns(
        {name: make(window) for name, make in columns.items()}
    )
    return computed.filter("__own").drop("__b", "__own")


def health_abort(log: DataFrame, limits: dict | None = None, block: int = 50_000) -> DataFrame:
    """First health rule that each update breaks, by rolling windows over the job's log.

    A rule needs its full window of rows. ``update`` is the dense position in the job.
    """
    limit = {**HEALTH_DEFAULTS, **(limits or {})}
    mean_kl = limit.get("kl_abort_window")
    kl_rows = int(mean_kl or limit["kl_abort_consecutive"])
    depth = max(kl_rows, limit["zero_variance_window"], limit["diversity_window"],
                limit["hard_limit_window"])

    def over(column, rows, how):
        return lambda w: how(column).over(w.rowsBetween(-(rows - 1), 0))

    columns = {
        "__kl": over("kl_divergence", kl_rows, F.avg if mean_kl else F.min),
        "__zero": over("zero_variance_group", limit["zero_variance_window"], F.avg),
        "__div": over("completion_diversity", limit["diversity_window"], F.avg),
        "__hard": over("hard_limit_fraction", limit["hard_limit_window"], F.avg),
    }
    rolled = framed(log, ["job_id"], "update", depth, columns, block)
    seen = F.col("update") + 1
    kl_text = (
        f"mean KL exceeded {limit['kl_threshold']} over {kl_rows} updates" if mean_kl
        else f"KL exceeded {limit['kl_threshold']} for {kl_rows} consecutive updates"
    )
    reason = F.coalesce(
        F.when((seen >= kl_rows) & (F.col("__kl") > limit["kl_threshold"]), F.lit(kl_text)),
        F.when(
            (seen >= limit["zero_variance_window"])
            & (F.col("__zero") > limit["zero_variance_abort_threshold"]),
            "sustained zero-variance rollout groups",
        ),
        F.when(
            (seen >= limit["diversity_window"])
            & (F.col("__div") < limit["diversity_abort_threshold"]),
            "sustained completion-diversity collapse",
        ),
        F.when(
            (seen >= limit["hard_limit_window"])
            & (F.col("__hard") > limit["hard_limit_fraction_threshold"]),
            "completion length repeatedly reached the hard limit",
        ),
    )
    return rolled.withColumn("abort_reason", reason).drop("__kl", "__zero", "__div", "__hard")


def first_abort(log: DataFrame, limits: dict | None = None) -> DataFrame:
    """Update and reason at which each job first had to stop."""
    broken = health_abort(log, limits).filter(F.col("abort_reason").isNotNull())
    return broken.groupBy("job_id").agg(
        F.min("update").alias("update"), F.min_by("abort_reason", "update").alias("abort_reason")
    )


def reward_gap(log: DataFrame, window: int, least_gain: float, block: int = 50_000) -> DataFrame:
    """Updates where the reward rose but the held-out accuracy did not.

    ``heldout_accuracy`` is null on updates without an evaluation. The accuracy before is
    that of the last earlier evaluation: evaluations are numbered and looked up by number,
    so no unbounded frame is needed.
    """
    columns = {
        "__recent": lambda w: F.avg("mean_task_reward").over(w.rowsBetween(-(window - 1), 0)),
        "__previous": lambda w: F.avg("mean_task_reward").over(
            w.rowsBetween(-(2 * window - 1), -window)
        ),
    }
    from traceloom.operators.workflow import segment_fill

    rolled = framed(log, ["job_id"], "update", 2 * window, columns, block)
    filled = segment_fill(
        rolled, ["job_id"], "update", F.col("heldout_accuracy"), F.lit(False), "__before", block
    )
    gap = (
        F.col("heldout_accuracy").isNotNull()
        & F.col("__before").isNotNull()
        & (F.col("update") + 1 >= 2 * window)
        & (F.col("__recent") >= F.col("__previous") + least_gain)
        & (F.col("heldout_accuracy") <= F.col("__before"))
    )
    return filled.withColumn("gap_detected", gap).drop("__recent", "__previous", "__before")


def job_summary(log: DataFrame, recent: int = 100, kl_threshold: float = 0.5,
                zero_variance_limit: float = 0.9) -> DataFrame:
    """Means of the last ``recent`` updates of each job, overall reward and token totals."""
    last = log.groupBy("job_id").agg(F.max("update").alias("__last"))
    rows = log.join(last, "job_id")
    tail = F.col("update") > F.col("__last") - recent

    def mean(name):
        return F.avg(F.when(tail, F.col(name)))

    zero = mean("zero_variance_group")
    names = ("zero_variance_group", "completion_diversity", "kl_divergence", "gradient_norm")
    bad = F.bool_or(F.when(tail, F.isnan("gradient_norm") | (F.col("gradient_norm") == float("inf"))))
    return rows.groupBy("job_id").agg(
        F.max("update").alias("updates"),
        F.sum("generated_tokens").alias("generated_tokens"),
        F.avg("mean_task_reward").alias("mean_task_reward"),
        (1000.0 * F.sum("mean_task_reward") / F.greatest(F.sum("generated_tokens"), F.lit(1)))
        .alias("reward_per_1000_generated_tokens"),
        F.greatest(F.lit(0.0), 1.0 - mean("kl_divergence") / max(1e-8, kl_threshold)).alias(
            "retention_score"
        ),
        *[mean(name).alias(f"recent_{name}") for name in names],
        (F.coalesce(bad, F.lit(False)) | (zero > zero_variance_limit)).alias("unhealthy"),
    )


def reward_by_family(log: DataFrame, recent: int = 100) -> DataFrame:
    last = log.groupBy("job_id").agg(F.max("update").alias("__last"))
    rows = log.join(last, "job_id").filter(F.col("update") > F.col("__last") - recent)
    return rows.groupBy("job_id", F.coalesce("task_family", F.lit("unknown")).alias("task_family")).agg(
        F.avg("mean_task_reward").alias("mean_task_reward")
    )


def norm_by_entry(log: DataFrame, recent: int = 100) -> DataFrame:
    """Mean gradient norm of each adapter entry over the last updates."""
    last = log.groupBy("job_id").agg(F.max("update").alias("__last"))
    rows = log.join(last, "job_id").filter(F.col("update") > F.col("__last") - recent)
    return (
        rows.select("job_id", F.explode("norms").alias("entry_key", "norm"))
        .groupBy("job_id", "entry_key")
        .agg(F.avg("norm").alias("mean_norm"))
    )


def curve_area(curve: DataFrame, block: int = 50_000) -> DataFrame:
    """Trapezoid area of accuracy over generated tokens per job; zero under two points."""
    columns = {
        "__x": lambda w: F.lag("generated_tokens").over(w),
        "__y": lambda w: F.lag("behavioral_accuracy").over(w),
    }
    stepped = framed(curve, ["job_id"], "point", 1, columns, block)
    width = F.col("generated_tokens") - F.col("__x")
    piece = width * (F.col("behavioral_accuracy") + F.col("__y")) / 2
    return stepped.groupBy("job_id").agg(F.coalesce(F.sum(piece), F.lit(0.0)).alias("area"))


# ---------------------------------------------------------------- depth profiles


def entry_layer(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"^layer-(\d+):family-", 1), F.lit("")).cast("int")


def step_cost(layer: Column, layers: int, fixed: float = 0.5) -> Column:
    return F.lit(fixed) + F.lit(1.0 - fixed) * (F.lit(layers) - layer) / F.lit(layers)


def entry_scores(entries: DataFrame, layers: int, fixed: float = 0.5, weight: float = 1.0) -> DataFrame:
    """Saliency density of adapter entries, divided by the cost of reaching their depth."""
    layer = entry_layer(F.col("entry_key"))
    density = F.col("gradient_norm") / F.sqrt("parameter_count")
    cost = step_cost(F.col("layer"), layers, fixed)
    return (
        entries.withColumn("layer", layer)
        .withColumns(
            {
                "normalized_depth": F.col("layer") / F.lit(layers - 1),
                "saliency_density": density,
                "estimated_step_cost": cost,
            }
        )
        .withColumn(
            "cost_adjusted_score",
            F.col("saliency_density") / F.pow("estimated_step_cost", F.lit(weight)),
        )
    )


def depth_profile(
    entries: DataFrame, layers: int, concentration: float = 0.60, lobe: float = 0.25
) -> DataFrame:
    """Share of saliency in early, middle and late layers, and the profile it makes."""
    mass = (
        entries.withColumn("layer", entry_layer(F.col("entry_key")))
        .groupBy("profile_id", "layer")
        .agg(F.sum(F.greatest("gradient_norm", F.lit(0.0))).alias("mass"))
    )
    depth = F.col("layer") / F.lit(layers - 1)
    total = F.sum("mass")

    def band(condition):
        return F.sum(F.when(condition, F.col("mass")).otherwise(0.0)) / total

    stats = mass.groupBy("profile_id").agg(
        band(depth < 1 / 3).alias("early"),
        band((depth >= 1 / 3) & (depth < 2 / 3)).alias("middle"),
        band(depth >= 2 / 3).alias("late"),
        (F.sum(depth * F.col("mass")) / total).alias("depth_centroid"),
        F.max_by("layer", F.struct("mass", (-F.col("layer")).alias("l"))).alias("dominant_layer"),
        (F.max("mass") / total).alias("dominant_layer_mass"),
        total.alias("total_mass"),
    ).filter("total_mass > 0")
    spread = (F.col("early") >= lobe) & (F.col("late") >= lobe)
    profile = (
        F.when(spread, "bimodal_or_distributed")
        .when(F.col("early") >= concentration, "early_concentrated")
        .when(F.col("late") >= concentration, "late_concentrated")
        .otherwise("bimodal_or_distributed")
    )
    return stats.withColumn("profile", profile).withColumns(
        {
            "profile_confident": F.col("profile") != "bimodal_or_distributed",
            "reserve_policy": F.when(
                F.col("profile") == "bimodal_or_distributed", "depth_bands"
            ).otherwise("none"),
        }
    )


def select_entries(scored: DataFrame, budgets: DataFrame, hysteresis: float) -> DataFrame:
    """Entries each candidate keeps under its parameter budget.

    Required entries come first; the others are taken by score while they still fit, skipping
    those that do not. Entries in use count for more by ``1 / hysteresis``. A candidate has
    one entry per adapter matrix (hundreds), so the fold runs on one sorted array per row.
    """
    score = F.when(F.col("current"), F.col("cost_adjusted_score") / hysteresis).otherwise(
        F.col("cost_adjusted_score")
    )
    packed = scored.groupBy("candidate_id").agg(
        F.array_sort(
            F.collect_list(
                F.when(
                    ~F.col("required"),
                    F.struct((-score).alias("s"), "entry_key", "parameter_count"),
                )
            )
        ).alias("optional"),
        F.sum(F.when(F.col("required"), F.col("parameter_count")).otherwise(0)).alias("used"),
        F.collect_list(F.when(F.col("required"), F.col("entry_key"))).alias("kept"),
    )
    folded = F.aggregate(
        "optional",
        F.struct(
            F.col("used").cast("long").alias("used"),
            F.col("kept").cast("array<string>").alias("keys"),
        ),
        lambda acc, e: F.when(
            acc["used"] + e["parameter_count"] <= F.col("parameter_budget"),
            F.struct(
                (acc["used"] + e["parameter_count"]).alias("used"),
                F.concat(acc["keys"], F.array(e["entry_key"])).alias("keys"),
            ),
        ).otherwise(acc),
    )
    rows = packed.join(budgets, "candidate_id").withColumn("__f", folded)
    return rows.select(
        "candidate_id",
        F.array_sort("__f.keys").alias("selected"),
        F.col("__f.used").alias("used_parameters"),
        (F.col("used") > F.col("parameter_budget")).alias("required_exceed_budget"),
    )


def selected_entries(
    scored: DataFrame, budgets: DataFrame, hysteresis: float, block: int = 50_000
) -> DataFrame:
    """The rows of the entries each candidate keeps, by the rule of :func:`select_entries`.

    A candidate may have any number of entries. What is left of a budget only shrinks, so an entry that
    does not fit once never will: a round leaves such entries out and folds the next ``block`` of the
    others, for all candidates side by side. A candidate ends when nothing that is left fits, so the
    rounds follow what is taken, not the length of the list. Where counts are negative a budget may grow
    again, and every entry waits for its turn. Equal scores go by entry key.
    """
    score = F.when(F.col("current"), F.col("cost_adjusted_score") / hysteresis).otherwise(
        F.col("cost_adjusted_score")
    )
    rows = scored.join(budgets, "candidate_id")
    required = rows.filter("required")
    state = durable(rows.groupBy("candidate_id").agg(
        F.first("parameter_budget").alias("__budget"),
        F.sum(F.when(F.col("required"), F.col("parameter_count")).otherwise(0)).cast("long").alias("__used"),
        F.coalesce(F.min("parameter_count") < 0, F.lit(False)).alias("__refills"),
        F.lit(-1).cast("long").alias("__seen"),
    ))
    may_fit = F.col("__refills") | (F.col("__used") + F.col("parameter_count") <= F.col("__budget"))

    def still(entries: DataFrame) -> DataFrame:
        return entries.join(state, "candidate_id").filter(may_fit)

    optional = durable(with_position(
        still(rows.filter("NOT required").withColumn("__s", -score)).select(*rows.columns, "__s"),
        ["candidate_id"], "__s", "entry_key", "parameter_count", name="__n",
    ))
    narrow = optional.select("candidate_id", "__n", "parameter_count")
    next_ones = Window.partitionBy("candidate_id").orderBy("__n")
    taken = []
    while True:
        packed = (
            still(narrow).filter(F.col("__n") > F.col("__seen"))
            .withColumn("__turn", F.row_number().over(next_ones)).filter(F.col("__turn") <= block)
            .groupBy("candidate_id").agg(
                F.array_sort(F.collect_list(F.struct("__n", "parameter_count"))).alias("__block"))
        )
        fold = F.aggregate(
            "__block",
            F.struct(F.col("__used").alias("used"), F.array().cast("array<bigint>").alias("kept")),
            lambda acc, e: F.when(
                acc["used"] + e["parameter_count"] <= F.col("__budget"),
                F.struct(
                    (acc["used"] + e["parameter_count"]).cast("long").alias("used"),
                    F.concat(acc["kept"], F.array(e["__n"])).alias("kept"),
                ),
            ).otherwise(acc),
        )
        # A candidate without entries in this round has none in later ones either.
        done = durable(state.join(packed, "candidate_id").select(
            "candidate_id", "__budget", "__refills", fold.alias("__f"),
            F.element_at("__block", -1)["__n"].alias("__seen")))
        if taken and done.isEmpty():
            break
        taken.append(done.select("candidate_id", F.explode("__f.kept").alias("__n")))
        state = done.select("candidate_id", "__budget", F.col("__f.used").alias("__used"), "__refills", "__seen")
    chosen = optional.join(reduce(DataFrame.unionByName, taken), ["candidate_id", "__n"], "left_semi")
    return chosen.select(required.columns).unionByName(required)


def protected_entries(norms: DataFrame, count: int) -> DataFrame:
    """Entries most specific to the protected task: by share of norm, then by norm."""
    share = F.col("protected_norm") / F.greatest(
        F.lit(1e-12), F.col("protected_norm") + F.col("other_norm")
    )
    return norms.withColumn("share", share).orderBy(
        F.col("share").desc(), F.col("protected_norm").desc(), "entry_key"
    ).limit(count)


# ---------------------------------------------------------------- answer checks and rewards


def first_integer(value: Column | str) -> Column:
    """First integer of a text that touches neither digits nor dots; null without one."""
    return tx.text_or_null(
        F.regexp_extract(tx.strip(value), r"(?<![\d.])-?\d+(?![\d.])", 0)
    )


def calibration_answer(value: Column | str) -> Column:
    """YES or NO when only one occurs, else ABSTAIN, else the first integer."""
    text = tx.strip(value)

    def has(word):
        return text.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])")

    return (
        F.when(has("YES") & ~has("NO"), "YES")
        .when(has("NO") & ~has("YES"), "NO")
        .when(has("ABSTAIN"), "ABSTAIN")
        .otherwise(first_integer(text))
    )


def arithmetic_reward(output: Column, expected: Column) -> Column:
    """1 for the right integer, else a quarter shrinking with the relative error."""
    seen = first_integer(output).cast("double")
    target = expected.cast("double")
    error = F.abs(seen - target) / F.greatest(F.lit(1.0), F.abs(target))
    return (
        F.when(seen.isNull(), 0.0).when(seen == target, 1.0)
        .otherwise(0.25 * F.exp(-4.0 * error))
    )


def training_reward(
    behavioral: Column, well_formed: Column, length: Column, hard_limit: int
) -> Column:
    """Behaviour plus a small bonus for format and brevity; nothing without behaviour."""
    brevity = 0.005 * F.greatest(F.lit(0.0), 1.0 - length / max(1, hard_limit))
    bonus = F.when(well_formed, 0.01).otherwise(0.0) + F.least(F.lit(0.005), brevity)
    return F.when(behavioral <= 0, 0.0).otherwise(behavioral + bonus)


def exact_verdict(raw: Column | str) -> Column:
    """A, B or TIE with an optional end mark, else INVALID."""
    found = F.regexp_extract(
        F.upper(tx.as_col(raw)), rf"^{tx.SPACE}*(TIE|A|B){tx.SPACE}*[.!]?{tx.SPACE}*$", 1
    )
    return tx.first_text(found, F.lit("INVALID"))


def record_match(output: Column, expected: Column) -> dict[str, Column]:
    """Flags of an output holding a JSON record against the expected one.

    The first brace-to-brace run is parsed; field values compare as JSON.
    """
    text = F.regexp_extract(output, r"(?s)\{.*?\}", 0)
    got = F.from_json(F.to_json(F.try_parse_json(tx.text_or_null(text))), "map<string,string>")
    want = F.from_json(F.to_json(F.try_parse_json(expected)), "map<string,string>")
    keys = F.map_keys(want)
    matching = F.filter(
        keys,
        lambda k: F.map_contains_key(got, k)
        & F.try_element_at(got, k).eqNullSafe(F.try_element_at(want, k)),
    )
    parsed = got.isNotNull()
    same_keys = parsed & (F.array_sort(F.map_keys(got)) == F.array_sort(keys))
    return {
        "parsed": parsed,
        "schema_valid": F.coalesce(same_keys, F.lit(False)),
        "matching_fields": F.when(parsed, F.size(matching)).otherwise(0),
        "field_total": F.size(keys),
        "complete": F.coalesce(same_keys & (F.size(matching) == F.size(keys)), F.lit(False)),
    }


def record_rates(flags: DataFrame) -> DataFrame:
    return flags.agg(
        F.count(F.lit(1)).alias("rows"),
        nx.share(F.col("parsed")).alias("valid_json_rate"),
        nx.share(F.col("schema_valid")).alias("schema_valid_rate"),
        (F.sum("matching_fields") / F.nullif(F.sum("field_total"), F.lit(0))).alias(
            "exact_field_accuracy"
        ),
        nx.share(F.col("complete")).alias("complete_record_accuracy"),
    )


def preference_objective(rows: DataFrame, beta: float = 0.1, sft: float = 0.0) -> DataFrame:
    """Means of the preference loss over given log-probabilities."""
    policy = F.col("chosen_logprob") - F.col("rejected_logprob")
    margin = beta * (policy - F.col("reference_logratio"))
    loss = nx.softplus_negative(margin)
    nll = -F.col("chosen_logprob") / F.col("chosen_target_count")
    return rows.agg(
        F.avg(loss + sft * nll).alias("objective_loss"),
        F.avg(loss).alias("dpo_loss"),
        nx.share(margin > 0).alias("preference_accuracy"),
        F.avg(margin).alias("reward_margin"),
        F.avg(policy).alias("policy_logratio"),
        F.avg("reference_logratio").alias("reference_logratio"),
        F.avg(nll).alias("chosen_nll"),
    )


def behavior_accuracy(rows: DataFrame) -> DataFrame:
    """Accuracy per task and the mix of two tasks (9/16 and 7/16), else their plain mean.

    ``rows``: result_id, task, correct. The first task in ``task`` order gets 9/16.
    """
    per_task = rows.groupBy("result_id", "task").agg(
        nx.share(F.col("correct")).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )
    pair = literal_map({"arithmetic": 0.5625, "python": 0.4375})
    only_pair = F.bool_and(F.col("task").isin("arithmetic", "python")) & (F.count(F.lit(1)) == 2)
    mixed = F.sum(F.try_element_at(pair, F.col("task")) * F.col("accuracy"))
    return per_task.groupBy("result_id").agg(
        F.when(only_pair, mixed).otherwise(F.avg("accuracy")).alias("behavioral_accuracy"),
        F.count(F.lit(1)).alias("tasks"),
    )


def prompt_scores(rows: DataFrame) -> DataFrame:
    """Outcomes weighted 9/8 and 7/8 for paired tests over both tasks."""
    weight = literal_map({"arithmetic": 1.125, "python": 0.875})
    return rows.withColumn(
        "score",
        nx.flag(F.col("correct")) * F.coalesce(F.try_element_at(weight, F.col("task")), F.lit(1.0)),
    )
