"""Quotas against a fold in plain Python, with small ranges so that groups span many."""

import random

import pytest
from pyspark.sql import functions as F

from rolemill.plans import leases


def fold(rows, cap):
    used, out = {}, {}
    for seq, counter, day, amount in sorted(rows):
        size = max(1, amount or 1)
        fits = used.get((counter, day), 0) + size <= cap
        out[seq] = fits
        if fits:
            used[counter, day] = used.get((counter, day), 0) + size
    return out


@pytest.mark.parametrize("seed,cap,sizes", [(1, 50, range(1, 12)), (2, 1, range(0, 3)), (3, 7, range(2, 9)), (4, 1000, range(300, 1200)), (5, 100, [60, 50, 1, 99]), (6, 10**6, range(1, 9)), (7, 63, [64, 32, 31, None])])
def test_sizes_like_a_fold_with_a_hot_counter(spark, monkeypatch, seed, cap, sizes):
    monkeypatch.setattr(leases, "RANGE_ROWS", 64)
    rng = random.Random(seed)
    rows = [(i * 3, "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.choice([1, None]), rng.choice(list(sizes))) for i in range(1200)]
    df = spark.createDataFrame(rows, "row_seq long, counter string, day int, amount int").repartition(6)
    out = {r.row_seq: r.granted for r in leases.daily_quota(df, cap, amount="amount").collect()}
    assert out == fold(rows, cap)


def test_falling_sizes_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(leases, "RANGE_ROWS", 16)
    rows = [(i, "c", 1, max(1, 200 - i // 5)) for i in range(1500)]
    df = spark.createDataFrame(rows, "row_seq long, counter string, day int, amount int")
    assert {r.row_seq: r.granted for r in leases.daily_quota(df, 777, amount="amount").collect()} == fold(rows, 777)


def test_ones_like_a_fold_and_few_rows_are_walked(spark, monkeypatch):
    monkeypatch.setattr(leases, "RANGE_ROWS", 64)
    rows = [(i, "hot" if i % 3 else None, i % 2, None) for i in range(900)]
    df = spark.createDataFrame(rows, "row_seq long, counter string, day int, amount int")
    assert {r.row_seq: r.granted for r in leases.daily_quota(df, 100).collect()} == fold(rows, 100)
    assert leases.daily_quota(df, 0, amount="amount").filter("granted").count() == 900
    many = spark.range(20_000).select(F.col("id").alias("row_seq"), F.lit("c").alias("_key"), F.floor(F.col("id") / 64).alias("_range"), (F.col("id") % 5 + 1).alias("_size"))
    assert 0 < leases._placed(many, 100).filter("_open").count() < 300


def test_few_exchanges(spark, monkeypatch):
    monkeypatch.setattr(leases, "RANGE_ROWS", 64)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(5000).selectExpr("id row_seq", "string(id % 3) counter", "int(id % 2) day", "id % 7 amount")
        for amount, most in ((None, 4), ("amount", 5)):
            out = leases.daily_quota(df, 100, amount=amount)
            out.collect()
            plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert sum("Exchange hash" in line and "Reused" not in line for line in plan.splitlines()) <= most
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
