"""Resampling bounds, overlap scores, position windows and the budget fold."""

import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import health, stats
from traceloom.session import with_position, with_row_index


def test_interval_holds_the_mean_and_ignores_layout(spark):
    rows = spark.range(2000).select(F.lit("p").alias("pair"), (F.col("id") % 2 - 0.3).alias("delta"))
    one = stats.paired_interval(rows.repartition(1), draws=300).first()
    two = stats.paired_interval(rows.repartition(16), draws=300).first()
    assert one["lower"] < one["mean_difference"] < one["upper"]
    assert (one["lower"], one["upper"]) == pytest.approx((two["lower"], two["upper"]))


def test_tied_data_straddles_zero(spark):
    rows = spark.range(100).select(F.lit("p").alias("pair"), F.lit(0.0).alias("delta"))
    row = stats.paired_interval(rows, draws=100).first()
    assert row["lower"] <= 0.0 <= row["upper"]


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_subsequence_length_matches_table():
    rng = random.Random(1)
    for _ in range(50):
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 90))]
        assert stats._common_subsequence(a, b) == lcs(a, b)


def test_row_index_is_dense_and_ordered(spark):
    rows = spark.range(1000).repartition(7).withColumn("k", F.col("id") % 3)
    got = with_row_index(rows, F.col("id").desc(), name="n").orderBy("n").collect()
    assert [r["id"] for r in got] == list(range(999, -1, -1)) and [r["n"] for r in got] == list(range(1000))
    placed = with_position(rows, ["k"], "id", name="p")
    assert placed.filter(F.col("p") != F.floor(F.col("id") / 3)).count() == 0


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame(
        [("c", "a", 9.0, 60, False, False), ("c", "b", 8.0, 50, False, False), ("c", "d", 7.0, 30, False, False),
         ("c", "r", 0.1, 10, True, False)],
        "candidate_id string, entry_key string, cost_adjusted_score double, parameter_count int, "
        "required boolean, current boolean")
    budgets = spark.createDataFrame([("c", 100)], "candidate_id string, parameter_budget int")
    row = health.select_entries(rows, budgets, 0.9).first()
    assert row["selected"] == ["a", "d", "r"] and row["used_parameters"] == 100


def test_selection_of_a_long_list_carries_what_is_used(spark):

    count = 200_000
    rows = spark.range(count).select(
        F.lit("c").alias("candidate_id"), F.format_string("e%06d", "id").alias("entry_key"),
        ((F.col("id") * 7919) % 1_000_003).cast("double").alias("cost_adjusted_score"),
        (F.col("id") % 97 + 1).alias("parameter_count"), (F.col("id") % 50_000 == 0).alias("required"),
        (F.col("id") % 3 == 0).alias("current"))
    budgets = spark.createDataFrame([("c", 60_000)], "candidate_id string, parameter_budget long")
    got = {r.entry_key for r in health.selected_entries(rows, budgets, 0.9, block=60_000).collect()}
    used, want, rest = 0, set(), []
    for k in range(count):
        if k % 50_000 == 0:
            used += k % 97 + 1
            want.add(f"e{k:06d}")
        else:
            rest.append((-(k * 7919 % 1_000_003) / (0.9 if k % 3 == 0 else 1.0), f"e{k:06d}", k % 97 + 1))
    for _, key, size in sorted(rest):
        if used + size <= 60_000:
            used += size
            want.add(key)
    assert got == want
