"""Resampling intervals, paired comparisons and overlap scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.functions import text as tx

VALUES_PER_TASK = 20_000
# Lists of pairs up to this length are sent to the outcomes.
_SENT_PAIRS = 10_000


def _resample(draws: int, seed: int):
    """Partial sums of one bucket of distinct values for every draw."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("value")
        bucket = int(group["bucket"].iloc[0])
        rng = np.random.default_rng([seed, bucket])
        values = group["value"].to_numpy()
        copies = group["copies"].to_numpy()
        weight = np.zeros(draws)
        total = np.zeros(draws)
        step = max(1, 2_000_000 // draws)
        for at in range(0, len(values), step):
            counts = rng.poisson(copies[at : at + step, None], size=(len(values[at : at + step]), draws))
            weight += counts.sum(axis=0)
            total += values[at : at + step] @ counts
        return pd.DataFrame(
            {
                "pair": group["pair"].iloc[0],
                "draw": np.arange(draws),
                "weight": weight,
                "total": total,
            }
        )

    return run


def resampled_means(values: DataFrame, key: str, value: str, draws: int, seed: int) -> DataFrame:
    """(key, draw, mean) of bootstrap draws.

    Rows are first collapsed to (value, copies), which for 0/1 outcomes leaves a handful of
    rows whatever the table size. Each distinct value then gets Poisson(copies) weights per
    draw, the large-sample form of drawing with replacement that needs no row positions, so
    a key with any number of values is split into buckets and summed. The weights depend on
    seed, bucket and value only, never on the layout of the data.
    """
    distinct = values.groupBy(F.col(key).cast("string").alias("pair"), F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("copies")
    )
    widths = distinct.groupBy("pair").agg(
        F.ceil(F.count(F.lit(1)) / VALUES_PER_TASK).alias("buckets")
    )
    placed = distinct.join(widths, "pair").select(
        "pair",
        F.pmod(F.xxhash64("value"), F.col("buckets")).cast("long").alias("bucket"),
        F.col("value").cast("double").alias("value"),
        "copies",
    )
    parts = placed.groupBy("pair", "bucket").applyInPandas(
        _resample(draws, seed), "pair string, draw int, weight double, total double"
    )
    return parts.groupBy("pair", "draw").agg(
        (F.sum("total") / F.greatest(F.sum("weight"), F.lit(1.0))).alias("mean")
    )


def paired_interval(
    deltas: DataFrame,
    key: str = "pair",
    value: str = "delta",
    *,
    draws: int = 2000,
    confidence: float = 0.95,
    seed: int = 17,
) -> DataFrame:
    """Mean of paired differences per key with its bootstrap interval."""
    tail = (1.0 - confidence) / 2.0
    means = resampled_means(deltas, key, value, draws, seed)
    bounds = means.groupBy("pair").agg(
        F.percentile("mean", F.lit(tail)).alias("lower"),
        F.percentile("mean", F.lit(1.0 - tail)).alias("upper"),
    )
    observed = deltas.groupBy(F.col(key).cast("string").alias("pair")).agg(
        F.avg(value).alias("mean_difference"), F.count(F.lit(1)).alias("rows")
    )
    return observed.join(bounds, "pair")


def two_sample_interval(
    left: DataFrame, right: DataFrame, value: str, *, draws: int = 10_000, seed: int = 7103
) -> DataFrame:
    """Difference of means of two independent samples with its bootstrap interval."""
    def side(rows, name, offset):
        keyed = rows.select(F.lit(name).alias("side"), F.col(value).alias("value"))
        return resampled_means(keyed, "side", "value", draws, seed + offset).select(
            "draw", F.col("mean").alias(name)
        )

    diffs = side(left, "left", 0).join(side(right, "right", 1), "draw")
    gap = F.col("left") - F.col("right")
    return diffs.agg(
        F.percentile(gap, F.lit(0.025)).alias("lower"),
        F.percentile(gap, F.lit(0.975)).alias("upper"),
    ).withColumn(
        "mean_difference",
        left.agg(F.avg(value).alias("m")).scalar() - right.agg(F.avg(value).alias("m")).scalar(),
    )


def paired_deltas(outcomes: DataFrame, pairs: DataFrame, position: list[str]) -> DataFrame:
    """Differences left minus right at equal positions for every listed pair of methods.

    ``outcomes`` has (method, *position, value), ``pairs`` (pair, left_method, right_method).
    The sum of signed values per (pair, position) replaces a join of the two sides. A method may have
    most of the rows, so the list of pairs, when short, is sent to them instead of a shuffle by method.
    """
    signed = pairs.select(
        "pair",
        F.explode(
            F.array(
                F.struct(F.col("left_method").alias("method"), F.lit(1.0).alias("sign")),
                F.struct(F.col("right_method").alias("method"), F.lit(-1.0).alias("sign")),
            )
        ).alias("s"),
    ).select("pair", "s.method", "s.sign")
    if pairs.count() <= _SENT_PAIRS:
        signed = F.broadcast(signed)
    return (
        outcomes.join(signed, "method")
        .groupBy("pair", *position)
        .agg(
            F.sum(F.col("sign") * F.col("value")).alias("delta"),
            F.count(F.lit(1)).alias("sides"),
        )
        .filter("sides = 2")
        .drop("sides")
    )


def win_tie_loss(delta: str = "delta") -> list[Column]:
    d = F.col(delta)
    return [
        F.count_if(d > 1e-12).alias("wins"),
        F.count_if(F.abs(d) <= 1e-12).alias("ties"),
        F.count_if(d < -1e-12).alias("losses"),
    ]


# ---------------------------------------------------------------- reference overlap


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a space."""
    last = F.size(tokens) - n
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.array_join(F.slice(tokens, i + 1, n), " "),
        )
    )


def _f1(overlap: Column, candidate: Column, reference: Column) -> Column:
    precision = overlap / F.greatest(candidate, F.lit(1))
    recall = overlap / F.greatest(reference, F.lit(1))
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(
        F.lit(0.0)
    )


def multiset_overlap(left: Column, right: Column) -> Column:
    """Sum over shared elements of the smaller count."""
    shared = F.array_intersect(left, right)
    return F.aggregate(
        shared,
        F.lit(0),
        lambda acc, gram: acc + F.least(
            F.size(F.filter(left, lambda x: x == gram)),
            F.size(F.filter(right, lambda x: x == gram)),
        ),
    )


def _grams(tokens, n: int) -> dict:
    counts: dict = {}
    for i in range(len(tokens) - n + 1):
        gram = tuple(tokens[i : i + n])
        counts[gram] = counts.get(gram, 0) + 1
    return counts


def _common_subsequence(left, right) -> int:
    """Length of the longest common subsequence by bit-parallel rows."""
    places: dict = {}
    for i, token in enumerate(right):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(right)) - 1
    row = full
    for token in left:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(right) - bin(row).count("1")


OVERLAP_TYPE = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("unigrams", "bigrams", "subsequence")]
)


@F.pandas_udf(OVERLAP_TYPE)
def text_overlaps(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Shared unigrams, bigrams and subsequence length of two token arrays (Arrow batches).

    Counting repeated n-grams with array functions is quadratic per row; one pass over each
    text keeps whole texts affordable.
    """
    out = []
    for a, b in zip(left, right):
        shared = []
        for n in (1, 2):
            mine, other = _grams(a, n), _grams(b, n)
            shared.append(sum(min(count, other.get(gram, 0)) for gram, count in mine.items()))
        out.append((*shared, _common_subsequence(a, b)))
    return pd.DataFrame(out, columns=["unigrams", "bigrams", "subsequence"])


def overlap_scores(candidate: str, reference: str) -> dict[str, Column]:
    """F1 of unigrams, bigrams and longest common subsequence for two token columns."""
    c, r = F.size(candidate), F.size(reference)
    o = F.col("__overlap")
    return {
        "rouge1": _f1(o["unigrams"], c, r),
        "rouge2": _f1(o["bigrams"], F.greatest(c - 1, F.lit(0)), F.greatest(r - 1, F.lit(0))),
        "rougeL": _f1(o["subsequence"], c, r),
    }


def score_references(outputs: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """Best overlap F1 over the references of each id, and the length ratio.

    ``outputs`` has (id, *keys, output); ``references`` has (id, reference), one row each.
    """
    left = outputs.withColumn("__c", tx.word_tokens("output"))
    right = references.withColumn("__r", tx.word_tokens("reference"))
    joined = left.join(right, "id").withColumn("__overlap", text_overlaps("__c", "__r"))
    columns = overlap_scores("__c", "__r")
    scored = joined.select(
        "id", *keys, F.size("__c").alias("__len"), F.greatest(F.size("__r"), F.lit(1)).alias("__ref"),
        *[column.alias(name) for name, column in columns.items()],
    )
    return scored.groupBy("id", *keys).agg(
        *[F.max(name).alias(name) for name in columns],
        (F.max("__len") / F.avg("__ref")).alias("reference_length_ratio"),
    )
