"""Training, preference, benchmark and synthetic datasets, and their splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom import vocab
from traceloom.functions import hashing as hx
from traceloom.functions import jsonx as jx
from traceloom.functions import text as tx
from traceloom.session import with_position, with_row_index


def _pick(rows: DataFrame, *names: str) -> list[str]:
    return [name for name in names if name in rows.columns]


def _first(rows: DataFrame, *names: str, default: str | None = None) -> Column:
    found = [F.col(name).cast("string") for name in _pick(rows, *names)]
    if default is not None:
        found.append(F.lit(default))
    return tx.first_text(*found) if found else F.lit(None).cast("string")


def _number(rows: DataFrame, *names: str) -> Column:
    return F.coalesce(
        *[tx.number_or_null(F.col(name).cast("double")) for name in _pick(rows, *names)],
        F.lit(0.0),
    )


def typed_rows(traces: DataFrame, dataset_types: list[str], order: str = "trace_id") -> DataFrame:
    """Dataset rows of the given types; the target of a type is found once, in plan building.

    Numbering by ``order`` is shared by all types, so it is computed once before the rows
    are copied per type.
    """
    unknown = sorted(set(dataset_types) - set(vocab.DATASET_TYPES))
    if unknown:
        raise ValueError(f"unknown dataset type: {unknown}")
    numbered = with_row_index(traces, order, name="__n")
    base = numbered.select(
        F.col("__n"),
        F.col("trace_id").alias("source_trace_id"),
        _first(traces, "run_id", "external_run_id", default="unknown").alias("source_run_id"),
        (F.coalesce("privacy_status", F.lit("local_only")) if "privacy_status" in traces.columns
         else F.lit("local_only")).alias("privacy_status"),
        _first(traces, "prompt", "objective", "task").alias("input"),
        _first(traces, "response", "label", "failure_type").alias("output"),
        _first(traces, "label", "outcome", default="inconclusive").alias("label"),
        _number(traces, "score", "quality_score").alias("score"),
    )
    types = F.array(
        *[
            F.struct(
                F.lit(name).alias("dataset_type"),
                F.lit(name.replace("-", "_")).alias("slug"),
                F.lit(vocab.dataset_target(name)).cast("string").alias("target"),
            )
            for name in dataset_types
        ]
    )
    return base.withColumn("__t", F.explode(types)).select(
        F.format_string("%s_%03d", F.col("__t.slug"), F.col("__n") + 1).alias("id"),
        "__t.dataset_type",
        *[name for name in base.columns if name != "__n"],
        "__t.target",
    )


def local_training_rows(traces: DataFrame, opt_in: bool, order: str = "trace_id") -> DataFrame:
    """Rows of all local specialist datasets, for one write partitioned by dataset type."""
    if not opt_in:
        raise PermissionError("local training data export requires explicit opt-in")
    return typed_rows(traces, sorted(f"local-{name}" for name in vocab.SPECIALISTS), order)


def router_rows(traces: DataFrame, order: str = "trace_id") -> DataFrame:
    """Nested router training candidates."""
    numbered = with_row_index(traces, order, name="__n")
    names = set(traces.columns)

    def decided(field: str, *others: str) -> Column:
        parts = [F.col(f"decision.{field}")] if "decision" in names else []
        return F.coalesce(*parts, *[F.col(n) for n in others if n in names],
                          F.lit(None).cast("string"))

    provider, model = decided("provider", "provider"), decided("model", "model")
    score = F.coalesce(*[F.col(n).cast("double") for n in _pick(traces, "score", "quality")],
                       F.lit(0.0))
    return numbered.select(
        F.format_string("router_candidate_%03d", F.col("__n") + 1).alias("id"),
        F.col("trace_id").cast("string").alias("source_trace_id"),
        _first(traces, "run_id", "external_run_id", default="unknown_run").alias("source_run_id"),
        _first(traces, "task", "objective", "prompt", default="Unspecified router task").alias(
            "task"),
        F.struct(_first(traces, "task_type", default="unknown").alias("task_type")).alias("input"),
        F.struct(
            decided("worker", "worker", "agent_id").alias("worker"),
            provider.alias("provider"),
            model.alias("model"),
            decided("reason", "why_good", "notes").alias("reason"),
        ).alias("output"),
        _first(traces, "label", "outcome", default="inconclusive").alias("label"),
        score.alias("score"),
        F.array(F.lit("router")).alias("use_for"),
        provider.alias("provider"),
        model.alias("model"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.coalesce("latency_ms", F.lit(0)).cast("long").alias("latency_ms"),
        _first(traces, "privacy_status", default="local_only").alias("privacy_status"),
        F.struct(
            _first(traces, "source_system", default="unknown").alias("source_system"),
            _first(traces, "trace_type", default="router_trace").alias("trace_type"),
        ).alias("provenance"),
    )


def training_candidates(traces: DataFrame) -> DataFrame:
    """Redacted candidates with the use they are good for."""
    label = _first(traces, "label", "outcome", default="inconclusive")
    score = _number(traces, "training_value_score", "quality_score", "score")
    return traces.select(
        F.concat(F.lit("candidate_"), F.col("trace_id").cast("string")).alias("id"),
        _first(traces, "run_id").alias("source_run_id"),
        tx.redact_text(_first(traces, "task_id", "trace_type")).alias("task"),
        tx.redact_text("prompt").alias("input"),
        tx.redact_text("response").alias("output"),
        label.alias("label"),
        score.alias("score"),
        F.array(F.regexp_replace("trace_type", "_trace", "")).alias("use_for"),
        tx.redact_text("provider").alias("provider"),
        tx.redact_text("model").alias("model"),
        "privacy_status",
        F.lit("Rule-scored training candidate.").alias("why_good"),
        F.when(label != "accepted", label).alias("failure_notes"),
    )


class ExportBlocked(PermissionError):
    """A row that must stay private was about to leave."""


def require_public(rows: DataFrame) -> DataFrame:
    """Blocking export gate: any row that is not public fails the whole export."""
    public = F.coalesce(F.col("privacy_status") == "public_benchmark", F.lit(False))
    if not rows.filter(~public).isEmpty():
        raise ExportBlocked("private or anonymous traces cannot be exported as public benchmarks")
    return rows


def sft_rows(prompts: DataFrame) -> DataFrame:
    """Prompt and canonical completion with a content-derived id, one row each."""
    rows = prompts.withColumn("completion", hx.canonical_json("route"))
    ident = hx.row_hash("catalog_hash", "task_group", "prompt", "completion")
    return rows.select(
        F.concat(F.lit("route_sft_"), F.substring(ident, 1, 24)).alias("id"),
        "task_id", "task_group", "catalog_hash", "prompt", "completion",
        (F.coalesce("source", F.lit("task_decomposition")) if "source" in prompts.columns
         else F.lit("task_decomposition")).alias("source"),
    )


def route_preference_rows(rows: DataFrame) -> DataFrame:
    """Chosen against rejected routes; ``problem`` marks equal routes and broken JSON.

    Rows may bring a ``pair_id`` (prebuilt pairs); otherwise it is derived from the content.
    """
    chosen, rejected = hx.canonical_json("chosen"), hx.canonical_json("rejected")
    made = F.concat(
        F.lit("route_pref_"),
        F.substring(hx.row_hash("catalog_hash", "task_group", "prompt", "chosen", "rejected"), 1, 24),
    )
    own = [tx.text_or_null("pair_id")] if "pair_id" in rows.columns else []
    columns = rows.withColumns({"chosen": chosen, "rejected": rejected})
    problem = F.coalesce(
        F.when(F.col("chosen").isNull() | F.col("rejected").isNull(), "routes must be JSON objects"),
        F.when(F.col("chosen") == F.col("rejected"), "chosen and rejected routes must differ"),
    )
    return columns.withColumns({"pair_id": F.coalesce(*own, made), "problem": problem})


def preference_rows(rows: DataFrame) -> DataFrame:
    """Text preference pairs: non-empty, different, with id and prompt group."""
    def blank(name):
        return F.coalesce(tx.trimmed_or_null(name).isNull(), F.lit(True))

    own = [tx.text_or_null("pair_id")] if "pair_id" in rows.columns else []
    keyed = rows.withColumns(
        {
            "pair_id": F.coalesce(*own, hx.row_hash("prompt", "chosen", "rejected")),
            "prompt_group": hx.sha(tx.strip("prompt")),
        }
    )
    repeated = (
        keyed.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("pair_id", F.lit("duplicate pair_id").alias("__repeat"))
    )
    problem = F.coalesce(
        F.when(blank("prompt") | blank("chosen") | blank("rejected"),
               "prompt, chosen and rejected must not be empty"),
        F.when(tx.strip("chosen") == tx.strip("rejected"), "chosen and rejected must differ"),
        F.col("__repeat"),
    )
    return keyed.join(repeated, "pair_id", "left").withColumn("problem", problem).drop("__repeat")


def output_preferences(prompts: DataFrame, outputs: DataFrame) -> DataFrame:
    """Reference answer over model output, where they differ after normalising.

    ``problem`` marks missing and extra ids, changed prompts and empty outputs.
    """
    joined = prompts.select("id", "prompt", "completion", F.lit(True).alias("__p")).join(
        outputs.select("id", "prompt_sha256", "output", F.lit(True).alias("__o")), "id", "full_outer"
    )
    problem = F.coalesce(
        F.when(F.col("__o").isNull(), "output is missing"),
        F.when(F.col("__p").isNull(), "output has no prompt"),
        F.when(~F.col("prompt_sha256").eqNullSafe(hx.sha("prompt")), "prompt hash mismatch"),
        F.when(tx.trimmed_or_null("output").isNull(), "output is empty"),
    )
    same = tx.normalized_words("completion") == tx.normalized_words("output")
    rows = joined.withColumn("problem", problem)
    return rows.filter(F.col("problem").isNotNull() | ~same).select(
        F.col("id").alias("pair_id"), "prompt",
        tx.strip("completion").alias("chosen"), tx.strip("output").alias("rejected"), "problem",
    )


def metacognitive_rows(traces: DataFrame) -> DataFrame:
    """Answer, confidence and verification rows with a source hash."""
    from traceloom.operators.calibration import acceptance_criteria

    source = _first(traces, "id", "trace_id")
    confidence = F.coalesce(
        *[F.col(n) for n in _pick(traces, "confidence")], F.lit(0.5)
    )
    judged = F.coalesce(
        *[F.col(n) for n in _pick(traces, "self_judged_success_probability",
                                  "self_judged_success")], confidence
    )
    criteria = (
        F.col("acceptance_criteria") if "acceptance_criteria" in traces.columns
        else F.lit(None).cast("array<string>")
    )
    texts = [F.col(n) for n in _pick(traces, "prompt", "task", "description")]
    rows = traces.select(
        F.coalesce(_first(traces, "task_id"), source).alias("task_id"),
        F.coalesce(_first(traces, "prompt", "task", "input"), F.lit("")).alias("task"),
        F.coalesce(_first(traces, "answer", "response", "output"), F.lit("")).alias("answer"),
        F.coalesce(_first(traces, "reasoning_summary", "summary"), F.lit("")).alias(
            "reasoning_summary"),
        confidence.alias("confidence"),
        judged.alias("self_judged_success_probability"),
        _first(traces, "verification_result", "label", default="unknown").alias(
            "verification_result"),
        _first(traces, "failure_type").alias("failure_type"),
        acceptance_criteria(criteria, texts or [F.lit("")]).alias("acceptance_criteria"),
        _first(traces, "privacy_status", default="local_only").alias("privacy_status"),
        _first(traces, "redaction_status", default="unknown").alias("redaction_status"),
        _first(traces, "consent", default="unknown").alias("consent"),
        source.alias("source_trace_id"),
    )
    problem = F.when(
        ~F.col("confidence").between(0.0, 1.0)
        | ~F.col("self_judged_success_probability").between(0.0, 1.0),
        "scores must be between 0 and 1",
    )
    return rows.withColumns(
        {
            "source_trace_hash": hx.row_hash(
                "source_trace_id", "task", "answer", "verification_result"
            ),
            "problem": problem,
        }
    )


def benchmark_items(items: DataFrame, benchmark_type: str, order: str) -> DataFrame:
    """Typed benchmark items with defaults."""
    if benchmark_type not in vocab.BENCHMARK_TYPES:
        raise ValueError(f"unknown benchmark type: {benchmark_type}")
    numbered = with_row_index(items, order, name="__n")
    made = F.format_string(f"{benchmark_type}_case_%03d", F.col("__n") + 1)
    return numbered.select(
        F.coalesce(_first(items, "id"), made).alias("id"),
        F.lit(benchmark_type).alias("benchmark_type"),
        _first(items, "task", "objective", "prompt", default="benchmark task").alias("task"),
        _first(items, "expected", "label", "outcome", default="accepted").alias("expected"),
        F.array(F.lit("safety_score"), F.lit("verification_pass_rate")).alias(
            "non_regression_metrics"),
    )


# Prompt of a dialogue summary.
SUMMARY_PROMPT = "Summarize this dialogue in one concise paragraph.\n\nDialogue:\n%s\n\nSummary:"


def summary_rows(rows: DataFrame) -> DataFrame:
    """Prompt, completion and the non-empty references of dialogue summary rows."""
    names = _pick(rows, "summary", "summary1", "summary2", "summary3")
    references = F.filter(
        F.transform(F.array(*names), lambda s: tx.strip(s)), lambda s: F.coalesce(s != "", F.lit(False))
    )
    return rows.select(
        F.col("fname").alias("id"),
        F.format_string(SUMMARY_PROMPT, tx.strip("dialogue")).alias("prompt"),
        tx.strip(F.coalesce(_first(rows, "summary", "summary1"), F.lit(""))).alias("completion"),
        references.alias("references"),
    )


def supervised_text(rows: DataFrame) -> DataFrame:
    """Prefix and full text of chat or instruction rows; the last assistant turn is the target."""
    names = set(rows.columns)
    prompt = F.coalesce(_first(rows, "prompt", "input", "instruction"), F.lit(""))
    answer = F.coalesce(_first(rows, "completion", "output", "response"), F.lit(""))
    plain_prefix = F.when(prompt != "", F.concat(prompt, F.lit("\n"))).otherwise("")
    prefix, full = plain_prefix, F.concat(plain_prefix, answer)
    if "messages" in names:
        roles = F.transform("messages", lambda m: tx.first_text(m["role"], F.lit("user")))
        last = F.size("messages") - F.array_position(F.reverse(roles), "assistant").cast("int") + 1
        has = F.array_contains(roles, "assistant")
        target = F.try_element_at("messages", last)["content"]
        lines = F.transform(
            F.slice("messages", F.lit(1), F.greatest(last - 1, F.lit(0))),
            lambda m: F.concat(tx.first_text(m["role"], F.lit("user")), F.lit(": "),
                               F.coalesce(m["content"], F.lit(""))),
        )
        chat = F.coalesce(has & tx.trimmed_or_null(target).isNotNull(), F.lit(False))
        chat_prefix = F.concat(F.array_join(lines, "\n"), F.lit("\nassistant: "))
        prefix = F.when(chat, chat_prefix).otherwise(prefix)
        full = F.when(chat, F.concat(chat_prefix, target)).otherwise(full)
    return rows.withColumns(
        {
            "prefix": prefix,
            "full_text": full,
            "prompt_completion": tx.strip(F.concat(prompt, F.lit("\n"), answer)),
        }
    )


# ---------------------------------------------------------------- synthetic rows


def _synthetic(traces: DataFrame, kind: str, trace_type: str, **fields: Column) -> DataFrame:
    names = ("prompt", "response", "task", "label", "provider", "model", "expected",
             "failure_notes")
    none = F.lit(None).cast("string")
    return traces.select(
        F.lit(kind).alias("generation_method"),
        F.lit(trace_type).alias("trace_type"),
        *[fields.get(name, none).cast("string").alias(name) for name in names],
        fields.get("steps", F.lit(None)).cast("array<string>").alias("steps"),
        F.lit(True).alias("synthetic"),
        F.lit(False).alias("measured"),
        F.col("trace_id").alias("source_trace_id"),
        F.struct(
            _first(traces, "run_id", "external_run_id").alias("source_run_id"),
            F.col("trace_type").alias("source_trace_type"),
        ).alias("provenance"),
    )


# Texts of the seven synthetic generators.
def corrected_failures(traces: DataFrame) -> DataFrame:
    failure = tx.text_or_null("failure_type") if "failure_type" in traces.columns else (
        F.lit(None).cast("string"))
    label = F.coalesce("label", F.lit(""))
    rows = traces.filter(failure.isNotNull() | label.startswith("failed"))
    return _synthetic(
        rows, "corrected_failure", "correction_trace", prompt=F.col("prompt"),
        response=F.concat(F.lit("Corrected response for failure type "),
                          F.coalesce(failure, F.col("label")), F.lit(".")),
        label=F.lit("good_training_candidate"),
    )


def alternate_decompositions(traces: DataFrame) -> DataFrame:
    return _synthetic(
        traces, "alternate_task_decomposition", "planner_trace",
        task=_first(traces, "task", "objective", "prompt"),
        steps=F.array(*[F.lit(s) for s in ("clarify objective", "choose worker", "verify result")]),
    )


def better_router_decisions(traces: DataFrame, provider: str, model: str) -> DataFrame:
    failure = F.coalesce("failure_type", F.lit("")) if "failure_type" in traces.columns else F.lit("")
    wanted = (failure == "bad_router_assignment") | F.coalesce(
        F.col("label").isin("too_expensive", "rescued_by_stronger_model"), F.lit(False)
    )
    return _synthetic(
        traces.filter(wanted), "better_router_decision", "router_trace",
        task=_first(traces, "task", "objective", "prompt"), provider=F.lit(provider),
        model=F.lit(model), label=F.lit("good_training_candidate"),
    )


def hard_negatives(traces: DataFrame) -> DataFrame:
    return _synthetic(
        traces, "hard_negative", "critic_trace", label=F.lit("useful_negative_example"),
        failure_notes=F.lit("plausible but wrong variant"),
    )


def adversarial_verifier_rows(traces: DataFrame) -> DataFrame:
    return _synthetic(traces, "adversarial_verifier", "verification_trace",
                      expected=F.lit("reject unsupported claim"))


def prompt_variant_rows(traces: DataFrame) -> DataFrame:
    return _synthetic(
        traces, "prompt_variant", "planner_trace",
        prompt=F.concat(F.lit("Be explicit and verifiable: "),
                        F.coalesce(_first(traces, "prompt", "task"), F.lit(""))),
    )


def synthetic_benchmark_rows(traces: DataFrame) -> DataFrame:
    return _synthetic(
        traces, "synthetic_benchmark_task", "benchmark_trace",
        task=_first(traces, "task", "prompt"),
        expected=_first(traces, "label", default="accepted"),
    )


def keep_synthetic(rows: DataFrame) -> DataFrame:
    """Synthetic, unmeasured rows with their quality score."""
    keep = F.coalesce("synthetic", F.lit(False)) & ~F.coalesce("measured", F.lit(False))
    score = F.when(F.col("source_trace_id").isNotNull(), 0.8).otherwise(0.6)
    return rows.filter(keep).withColumn("synthetic_quality_score", score)


def synthetic_rows(
    traces: DataFrame, provider: str = "openrouter", model: str = "free-or-cheap-verified"
) -> DataFrame:
    """Union of the seven generators, filtered and scored."""
    parts = [
        corrected_failures(traces), alternate_decompositions(traces),
        better_router_decisions(traces, provider, model), hard_negatives(traces),
        adversarial_verifier_rows(traces), prompt_variant_rows(traces),
        synthetic_benchmark_rows(traces),
    ]
    return keep_synthetic(reduce(DataFrame.unionByName, parts))


def prompt_pack_variants(packs: DataFrame) -> DataFrame:
    """Every role of every pack with the evidence instruction appended."""
    roles = F.array(*[F.lit(role) for role in vocab.PROMPT_ROLES])
    # The appended instruction.
    tail = "\nReturn verifiable, concise output with explicit evidence."
    return packs.select("pack", F.explode(roles).alias("role"), "prompts").select(
        "pack", "role",
        F.concat(F.coalesce(F.try_element_at("prompts", F.col("role")), F.lit("")), F.lit(tail))
        .alias("prompt"),
    )


# ---------------------------------------------------------------- parametric tasks


def arithmetic_tasks(rows: DataFrame, key: str, seed: int, split: str = "train") -> DataFrame:
    """Word problems with known answers; numbers come from a hash of (seed, split, key)."""
    def draw(name, low, high):
        code = F.xxhash64(F.lit(f"{seed}:{split}:{name}"), F.col(key))
        return (F.lit(low) + F.pmod(code, F.lit(high - low + 1))).cast("long")

    # Templates of the word problems.
    first = "A shop had %d pens, sold %d, then received %d. How many pens are there?"
    second = "Nora collected %d shells and %d more, then gave away %d. How many remain?"
    lead = "Solve the problem. Return only the integer answer.\n"
    numbered = rows.select(
        F.col(key), (draw("a", 3, 80) + F.pmod(F.col(key), F.lit(17))).alias("a"),
        draw("b", 2, 30).alias("b"), draw("c", 1, 15).alias("c"), draw("t", 0, 1).alias("t"),
    )
    text = F.when(F.col("t") == 0, F.format_string(first, "a", "b", "c")).otherwise(
        F.format_string(second, "a", "b", "c"))
    answer = F.when(F.col("t") == 0, F.col("a") - F.col("b") + F.col("c")).otherwise(
        F.col("a") + F.col("b") - F.col("c"))
    return numbered.select(
        F.concat(F.lit(f"arithmetic-{split}-"), F.col(key).cast("string")).alias("id"),
        F.concat(F.lit(lead), text).alias("prompt"),
        answer.cast("string").alias("answer"),
    )


def addition_tasks(rows: DataFrame, key: str, seed: int, split: str = "train") -> DataFrame:
    """Small-integer sums (operands 0 to 4)."""
    # Prompts by split.
    prompts = {
        "train": "Calculate the sum. Return only the integer answer.\n%d + %d = ?",
        "valid": "Solve the problem. Return only the integer answer.\nWhat is %d + %d?",
        "test": "Compute %d plus %d. Answer with one integer.",
    }
    def digit(name):
        return F.pmod(F.xxhash64(F.lit(f"{seed}:{split}:{name}"), F.col(key)), F.lit(5))

    return rows.select(F.col(key), digit("a").alias("a"), digit("b").alias("b")).select(
        F.concat(F.lit(f"addition-{split}-"), F.col(key).cast("string")).alias("id"),
        F.lit("small_integer_addition").alias("family"),
        F.format_string(prompts[split], "a", "b").alias("prompt"),
        (F.col("a") + F.col("b")).cast("string").alias("answer"),
    )


def confidence_tasks(rows: DataFrame, key: str, split: str = "train") -> DataFrame:
    """Confidence gating: verified evidence asks for YES, unverified for NO."""
    # Prompts by split.
    prompts = {
        "train": "The evidence is %s. Should the agent claim confidence? "
                 "Reply YES for VERIFIED and NO for UNVERIFIED.",
        "valid": "The evidence status is %s. Should the agent claim confidence? "
                 "Reply YES for VERIFIED and NO for UNVERIFIED.",
        "test": "The evidence is %s. Should confidence be claimed? "
                "Reply YES for VERIFIED and NO for UNVERIFIED.",
    }
    verified = F.pmod(F.col(key), F.lit(2)) == 0
    status = F.when(verified, "VERIFIED").otherwise("UNVERIFIED")
    return rows.select(
        F.concat(F.lit(f"calibration-{split}-"), F.col(key).cast("string")).alias("id"),
        F.when(verified, "calibration_verified").otherwise("calibration_unverified").alias("family"),
        F.format_string(prompts[split], status).alias("prompt"),
        F.when(verified, "YES").otherwise("NO").alias("answer"),
    )


def record_tasks(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Order texts with the JSON record to extract from them."""
    # Words of the records.
    firsts = ("Maria", "Aiden", "Priya", "Jonas", "Elena", "Omar", "Lina", "Theo")
    lasts = ("Chen", "Rivera", "Patel", "Meyer", "Silva", "Hassan", "Kim", "Brown")
    colors = ("blue", "red", "green", "black", "white")
    things = ("cables", "folders", "lamps", "notebooks", "adapters")
    months = ("May", "June", "July", "August", "September")
    k = F.col(key)

    def at(words, index):
        return F.element_at(F.array(*[F.lit(w) for w in words]), (index + 1).cast("int"))

    def shift(name):
        return F.pmod(F.xxhash64(F.lit(f"{seed}:{name}"), k), F.lit(8))

    fields = rows.select(
        k,
        F.concat_ws(" ", at(firsts, F.pmod(k + shift("f"), F.lit(8))),
                    at(lasts, F.pmod(k * 3 + shift("l"), F.lit(8)))).alias("customer"),
        (F.pmod(k, F.lit(9)) + 1).alias("quantity"),
        F.concat_ws(" ", at(colors, F.pmod(k, F.lit(5))), at(things, F.pmod(k, F.lit(5)))).alias(
            "item"),
        F.format_string("%s %d", at(months, F.pmod(k, F.lit(5))), F.pmod(k * 7, F.lit(28)) + 1)
        .alias("date"),
        F.concat(
            F.chr(F.pmod(k, F.lit(26)) + 65), F.chr(F.pmod(F.floor(k / 7), F.lit(26)) + 65),
            F.lit("-"), (k + 100).cast("string"),
        ).alias("order_id"),
    )
    lead = ("Extract the record. Return only valid JSON with keys customer, quantity, item, "
            "date, order_id.\n")
    text = F.format_string("%s ordered %d %s on %s. The order number is %s.", "customer",
                           "quantity", "item", "date", "order_id")
    return fields.select(
        F.concat(F.lit("record-"), k.cast("string")).alias("id"),
        F.concat(F.lit(lead), text).alias("prompt"),
        F.to_json(F.struct("customer", "quantity", "item", "date", "order_id")).alias("completion"),
    )


# ---------------------------------------------------------------- splits


def positional_split(rows: DataFrame, order: str, most: int = 2) -> DataFrame:
    """Train, then valid and test from the tail: a fifth, but one row at least and ``most`` at most.

    Fewer than three rows cannot fill three splits and raise.
    """
    numbered = with_row_index(rows, order, name="__n")
    total = numbered.agg(F.count(F.lit(1)).alias("n")).scalar()
    tail = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(total / 5)))
    few = F.raise_error(F.lit("a split into train, valid and test needs three rows")).cast("string")
    return numbered.withColumn(
        "split",
        F.when(total < 3, few).when(F.col("__n") >= total - tail, "test")
        .when(F.col("__n") >= total - 2 * tail, "valid").otherwise("train"),
    ).drop("__n")


def sample_partitions(
    rows: DataFrame, key: str, *, seed: int, selection: int, train: int, preference: int
) -> DataFrame:
    """Hash-ordered sample: selection and train from the front, preference rows after train.

    A row can be in selection and train at once, as two output rows.
    """
    ordered = with_row_index(
        rows.withColumn("__h", hx.sha(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))),
        "__h", key, name="__n",
    )
    n = F.col("__n")
    parts = F.array_compact(
        F.array(
            F.when(n < selection, "selection"),
            F.when(n < train, "sft_train"),
            F.when((n >= train) & (n < train + preference), "preference_prompts"),
        )
    )
    return ordered.withColumn("partition", F.explode(parts)).drop("__h", "__n")


def mixed_curriculum(parts: dict[str, DataFrame], key: str, seed: int) -> DataFrame:
    """Union of task sets in a stable hash order (``mix_order`` sorts it)."""
    named = [rows.withColumn("task_set", F.lit(name)) for name, rows in parts.items()]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return union.withColumn(
        "mix_order", hx.sha(F.concat_ws(":", F.lit(seed), "task_set", F.col(key).cast("string")))
    )


# Recommended shares of a training mix, with and without native rows.
MIX = {"native": 0.60, "public": 0.25, "synthetic": 0.10, "negative": 0.05}
MIX_WITHOUT_NATIVE = {"public": 0.70, "synthetic": 0.30}


def source_mix(
    rows: DataFrame, source: str, key: str, total: int, seed: int, shares: dict | None = None
) -> DataFrame:
    """Up to ``share * total`` rows of every source, chosen by hash.

    Quotas are the feature here; the position inside a source is found without one window
    over a large source.
    """
    shares = shares or MIX
    placed = with_position(
        rows.filter(F.col(source).isin(*shares)).withColumn(
            "__h", hx.sha(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
        ),
        [source], "__h", key, name="__n",
    )
    quota = F.create_map(
        *[F.lit(x) for name, part in shares.items() for x in (name, int(part * total))]
    )
    return placed.filter(F.col("__n") < F.element_at(quota, F.col(source))).drop("__h", "__n")


def item_lineage(items: DataFrame, traces: DataFrame) -> DataFrame:
    """Dataset items with their trace id, null when the trace is not a source."""
    known = traces.select(
        F.col("trace_id").cast("string").alias("source_trace_id"), F.col("trace_id")
    ).dropDuplicates(["source_trace_id"])
    return items.withColumn("source_trace_id", F.col("source_trace_id").cast("string")).join(
        known, "source_trace_id", "left"
    )


def manifest(rows: DataFrame, name: str, dataset_type: str, version: str, privacy_mode: str) -> DataFrame:
    """One manifest row: count, order-free content hash, distinct source runs."""
    content = [c for c in rows.columns if c not in ("dataset_type",)]
    return rows.agg(
        *hx.content_fingerprint(*content),
        F.array_sort(F.collect_set(F.coalesce(F.col("source_run_id").cast("string"), F.lit("unknown"))))
        .alias("provenance"),
    ).select(
        F.lit(name).alias("name"), F.lit(dataset_type).alias("dataset_type"),
        F.lit(version).alias("version"), F.lit(privacy_mode).alias("privacy_mode"),
        F.col("row_count").alias("item_count"),
        hx.sha(F.concat_ws(":", "row_count", "hash_sum", "hash_xor")).alias("content_hash"),
        "provenance",
    )


def public_regex_check(output: Column, pattern: Column) -> Column:
    """The whole trimmed output matches the pattern."""
    return F.regexp_like(tx.strip(output), F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z")))


def records_check(output: Column, keys: dict[str, str], sort_key: str) -> Column:
    """Output is a JSON list of records with exactly these typed keys, sorted by one of them."""
    v = jx.parse(output)
    rows = jx.get(v, "$", "array<variant>")
    # Type names of the checks and how the JSON types are called.
    kinds = {"str": "STRING", "string": "STRING", "int": "BIGINT", "integer": "BIGINT",
             "bool": "BOOLEAN", "float": "D", "number": "D"}
    want = F.array(*[F.lit(k) for k in sorted(keys)])

    def sound(record):
        fields = F.from_json(F.to_json(record), "map<string,string>")
        typed = reduce(
            lambda a, b: a & b,
            [
                F.schema_of_variant(F.try_variant_get(record, f"$.{name}", "variant")).startswith(
                    kinds.get(kind, kind.upper()))
                for name, kind in keys.items()
            ],
        )
        return (F.array_sort(F.map_keys(fields)) == want) & typed

    values = F.transform(rows, lambda r: F.try_variant_get(r, f"$.{sort_key}", "string"))
    numeric = keys[sort_key] in ("int", "integer", "float", "number")
    ordered = F.transform(values, lambda x: x.cast("double")) if numeric else values
    return F.coalesce(
        jx.is_array(v) & F.forall(rows, sound) & (F.array_sort(ordered) == ordered), F.lit(False)
    )


def hidden_check(cases: DataFrame, hidden: DataFrame) -> DataFrame:
    """Outputs against hidden answers: exact integer, or exact list of records."""
    joined = cases.join(hidden, "hidden_ref", "left")
    number = F.try_to_number(tx.strip("output"), F.lit("S999999999999999999"))
    same_number = F.coalesce(
        number.cast("decimal(20,0)") == F.col("expected_answer").cast("decimal(20,0)"), F.lit(False)
    )
    same_records = F.coalesce(
        hx.canonical_json("output") == hx.canonical_json("expected_records"), F.lit(False)
    )
    return joined.withColumn(
        "passed",
        F.when(F.col("family") == "arithmetic", same_number)
        .when(F.col("family") == "json_extraction", same_records),
    )


def suite_problems(cases: DataFrame, hidden: DataFrame, counts: dict[str, int]) -> DataFrame:
    """What is wrong with a benchmark suite: ids, fields, family counts, leaked answers."""
    joined = cases.join(
        hidden.select("hidden_ref", "marker", F.lit(True).alias("__found")), "hidden_ref", "left"
    )
    text = F.concat("prompt", F.coalesce("public_checks", F.lit("")))
    problem = F.coalesce(
        *[F.when(tx.trimmed_or_null(n).isNull(), f"{n} is missing")
          for n in ("id", "family", "category", "prompt", "hidden_ref")],
        F.when(~F.col("family").isin(*counts), "unknown family"),
        F.when(F.col("__found").isNull(), "hidden answer not found"),
        F.when(F.contains(text, F.col("marker")), "prompt leaks the hidden answer"),
    )
    rows = joined.select(F.col("id"), problem.alias("problem")).filter(F.col("problem").isNotNull())
    repeats = (
        cases.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("id", F.lit("duplicate case id").alias("problem"))
    )
    want = cases.sparkSession.createDataFrame(list(counts.items()), "family string, want long")
    seen = cases.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    shares = want.join(seen, "family", "left").filter(
        F.coalesce("n", F.lit(0)) != F.col("want")
    ).select("family", F.lit("wrong number of cases in family").alias("problem"))
    return rows.unionByName(repeats).unionByName(shares.withColumnRenamed("family", "id"))
