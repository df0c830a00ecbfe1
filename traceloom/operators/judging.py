"""Blind pairwise judging: pairs, opaque ids, tallies and variant comparison."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions import hashing as hx
from traceloom.functions import text as tx
from traceloom.operators.stats import paired_deltas, paired_interval, score_references, win_tie_loss
from traceloom.session import with_position


def variant_pairs(rows: DataFrame, variants: list[str]) -> DataFrame:
    """Every unordered pair of variants for every row id; variants are a handful of names."""
    pairs = F.array(
        *[F.struct(F.lit(a).alias("left_variant"), F.lit(b).alias("right_variant"))
          for a, b in combinations(variants, 2)]
    )
    return rows.select("*", F.explode(pairs).alias("__p")).select(
        *rows.columns, "__p.left_variant", "__p.right_variant"
    )


def blind_assignments(ids: DataFrame, variants: list[str], key: bytes, seed: int) -> DataFrame:
    """Opaque pair and case ids and which variant is shown as A, all from a keyed hash."""
    if len(key) < 32:
        raise ValueError("blinding key must contain at least 32 bytes")
    rid = F.col("id").cast("string")
    pairs = variant_pairs(ids.select("id").distinct(), variants)
    names = F.concat_ws(":", rid, "left_variant", "right_variant")
    order = hx.hmac_sha(key, F.concat_ws(":", names, F.lit(seed)))
    swap = F.conv(F.substring(order, 16, 1), 16, 10).cast("int") % 2 == 1
    return pairs.select(
        "id",
        F.substring(hx.hmac_sha(key, F.concat(F.lit("pair:"), names)), 1, 24).alias("pair_id"),
        F.substring(hx.hmac_sha(key, F.concat(F.lit("case:"), rid)), 1, 24).alias("case_id"),
        F.when(swap, F.col("right_variant")).otherwise(F.col("left_variant")).alias("a"),
        F.when(swap, F.col("left_variant")).otherwise(F.col("right_variant")).alias("b"),
    )


def blind_pairs(assignments: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """What a judge sees: prompt and two outputs, without names.

    ``outputs``: id, variant, output. Both sides attach by id and variant.
    """
    one = outputs.select("id", F.col("variant").alias("a"), F.col("output").alias("A"))
    two = outputs.select("id", F.col("variant").alias("b"), F.col("output").alias("B"))
    joined = assignments.join(inputs.select("id", "prompt"), "id")
    joined = joined.withColumnsRenamed({"a": "__a", "b": "__b"})
    return (
        joined.join(one.withColumnsRenamed({"a": "__a"}), ["id", "__a"])
        .join(two.withColumnsRenamed({"b": "__b"}), ["id", "__b"])
        .select("pair_id", "case_id", "prompt", "A", "B")
    )


def judgment_problems(assignments: DataFrame, judgments: DataFrame) -> DataFrame:
    """Judgments of unknown pairs, pairs without judgment, and invalid verdicts."""
    joined = assignments.select("pair_id", F.lit(True).alias("__a")).join(
        judgments.select("pair_id", "verdict", F.lit(True).alias("__j")), "pair_id", "full_outer"
    )
    problem = F.coalesce(
        F.when(F.col("__a").isNull(), "unknown pair"),
        F.when(F.col("__j").isNull(), "pair is not judged"),
        F.when(F.coalesce(~F.col("verdict").isin("A", "B", "TIE"), F.lit(True)), "invalid verdict"),
    )
    return joined.select("pair_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def judgment_tally(assignments: DataFrame, judgments: DataFrame) -> DataFrame:
    """(pairing, outcome, count): wins of each variant and ties of each pairing."""
    joined = judgments.join(assignments, "pair_id")
    pairing = F.array_join(F.array_sort(F.array("a", "b")), "-vs-")
    outcome = (
        F.when(F.col("verdict") == "A", F.col("a")).when(F.col("verdict") == "B", F.col("b"))
        .when(F.col("verdict") == "TIE", "TIE").otherwise("INVALID")
    )
    return joined.groupBy(pairing.alias("pairing"), outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("judgments")
    )


def variant_scores(outputs: DataFrame, references: DataFrame) -> DataFrame:
    return score_references(outputs.select("id", "variant", "output"), references, ["variant"])


def variant_summary(outputs: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean overlap scores, empty share and exact median latency of every variant."""
    means = scores.groupBy("variant").agg(
        *[F.avg(n).alias(n) for n in ("rouge1", "rouge2", "rougeL", "reference_length_ratio")]
    )
    empty = tx.trimmed_or_null("output").isNull()
    other = outputs.groupBy("variant").agg(
        F.avg(F.when(F.coalesce(empty, F.lit(True)), 1.0).otherwise(0.0)).alias("empty_rate"),
        F.count(F.lit(1)).alias("__rows"),
    )
    # The median from positions in the sorted latencies: no task holds all values of a variant.
    latency = outputs.select("variant", "id", F.coalesce("latency_ms", F.lit(0.0)).alias("__latency"))
    placed = with_position(latency, ["variant"], "__latency", "id", name="__n")
    middle = placed.join(other.select("variant", "__rows"), "variant").filter(
        F.col("__n").isin(F.floor((F.col("__rows") - 1) / 2), F.floor(F.col("__rows") / 2)))
    median = middle.groupBy("variant").agg(F.avg("__latency").alias("median_latency_ms"))
    return means.join(other.drop("__rows"), "variant").join(median, "variant")


def variant_deltas(scores: DataFrame, variants: list[str], metric: str = "rougeL") -> DataFrame:
    """Right minus left per id for every pair of variants."""
    pairs = scores.sparkSession.createDataFrame(
        [(f"{b}-minus-{a}", b, a) for a, b in combinations(variants, 2)],
        "pair string, left_method string, right_method string",
    )
    values = scores.select(F.col("variant").alias("method"), "id", F.col(metric).alias("value"))
    return paired_deltas(values, pairs, ["id"])


def variant_comparison(scores: DataFrame, variants: list[str], *, draws: int = 2000,
                       seed: int = 1701) -> DataFrame:
    deltas = variant_deltas(scores, variants)
    counts = deltas.groupBy("pair").agg(*win_tie_loss())
    return paired_interval(deltas, "pair", "delta", draws=draws, seed=seed).join(counts, "pair")


def output_coverage(outputs: DataFrame, inputs: DataFrame, variants: list[str]) -> DataFrame:
    """(variant, id) that are missing, extra, or answer another prompt."""
    want = inputs.select(
        "id", hx.sha("prompt").alias("__want"),
        F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"),
    )
    joined = want.join(
        outputs.select("id", "variant", "prompt_sha256", F.lit(True).alias("__o")),
        ["id", "variant"], "full_outer",
    )
    problem = F.coalesce(
        F.when(F.col("__want").isNull(), "extra"),
        F.when(F.col("__o").isNull(), "missing"),
        F.when(~F.col("prompt_sha256").eqNullSafe(F.col("__want")), "another prompt"),
    )
    return joined.select("variant", "id", problem.alias("problem")).filter(
        F.col("problem").isNotNull()
    )
