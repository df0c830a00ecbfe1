"""Mixing sources to target weights by repeating documents.

Tokens are summed per source, every source gets a target, and its repetition rate is target over
size. A document is emitted floor(rate) times, and once more if a number hashed from its id and a
seed is below the fraction: an independent Bernoulli draw that needs no order and no shared state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import attach, durable, unit_interval
from traceloom.session import with_row_index

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix"


def word_count(text: str = "text") -> Column:
    """Number of runs of other characters than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Source, source_size, weight and target from rows of (source, size).

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes.
    A target stops at ``most`` times its source's size and what is left over goes to the others by
    weight, again and again until none is above. The table has one row per source and is read once
    per turn; two sums come back to the driver.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_row_index(sums, F.col("source").asc_nulls_last(), name="__rank")
    turn = F.element_at(F.lit(list(weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    table = durable(
        ranked.select("source", "source_size", turn.cast("long").alias("weight"))
    )
    whole = table.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight = whole[0] or 0, whole[1] or 1
    cap = F.col("source_size") * most
    left, free = total, weight
    while True:
        # A source is capped where cap < left * weight / free, told in whole numbers.
        above = table.filter(cap * F.lit(free).cast("decimal(38,0)")
                             < F.col("weight") * F.lit(left).cast("decimal(38,0)"))
        held = above.agg(F.sum(cap), F.sum("weight")).first()
        after = (total - (held[0] or 0), weight - (held[1] or 0))
        if after == (left, free) or after[1] == 0:
            break
        left, free = after
    share = (F.lit(left).cast("decimal(38,0)") * F.col("weight")).cast("double") / F.lit(float(free))
    return table.withColumn("target", F.least(share, cap.cast("double")))


def planned(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """Documents with source_size, target, rate and ``copies``, the times each is emitted.

    A source without words has rate 1: its documents stay as they are.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    extra = unit_interval(seed, "doc_id") < F.col("rate") - F.floor("rate")
    return (
        attach(docs, targets.drop("weight"), "source")
        .withColumn("rate", rate)
        .withColumn("copies", (F.floor("rate") + extra.cast("int")).cast("int"))
    )


def mix_plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One narrow row per document: doc_id, source, size, source_size, target, rate, copies.

    Words are counted once and kept; texts are not moved. Null texts have size 0, null sources form
    a source of their own, rows that repeat a doc_id draw alike, an empty table gives no rows.
    """
    sized = durable(docs.select("doc_id", "source", word_count().alias("size")))
    return planned(sized, source_targets(sized, weights, most), seed)


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every document row as often as its plan says, with its own columns."""
    targets = source_targets(docs.select("source", word_count().alias("size")), weights, most)
    rows = planned(docs.select(F.struct("*").alias("__doc"), "doc_id", "source"), targets, seed)
    copy = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")
    return rows.filter("copies > 0").select("__doc", copy).select("__doc.*")
