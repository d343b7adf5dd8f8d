import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import order_stats
from assayer.operators.features import temporal_split
from assayer.operators.order_stats import quantiles, ranked_values
from assayer.operators.running import running_totals
from assayer.operators.skew import rows_of_groups


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)


SHAPES = {
    "spread": [((i * 7919) % 5003) / 3 for i in range(5003)],
    "one hot value": [5.0] * 3000 + [float(i) for i in range(1500)] + [-1.0] * 500,
    "two values": [1.0] * 2500 + [2.0] * 2500,
    "constant": [4.0] * 3000,
    "heavy tail": [1.01 ** (i % 900) for i in range(4000)],
}


@pytest.mark.parametrize("name", SHAPES)
def test_narrowing_is_exact(spark, name):
    values = SHAPES[name]
    df = frame(spark, values)
    ps = [0.0, 0.001, 0.25, 0.5, 0.995, 1.0]
    got = quantiles(df, {"v": ps}, None, driver_values=20)["v"]
    assert got == pytest.approx(list(np.quantile(values, ps)))
    ranks = [0, 1, len(values) // 3, len(values) - 1]
    picked = ranked_values(df, [("v", r, len(values)) for r in ranks], 20)
    assert picked == [sorted(values)[r] for r in ranks]
    assert ranked_values(df, [("v", r, len(values)) for r in ranks]) == picked


def test_ranks_outside_are_missing(spark):
    df = frame(spark, [1, 2])
    assert ranked_values(df, [("v", 5, 2), ("v", 0, 2)]) == [None, 1.0]
    assert ranked_values(df, [("v", 5, 2), ("v", 0, 2)], 1) == [None, 1.0]


def test_running_totals(spark):
    rows = [(g, float(i), i % 7) for g in ("a", "b", "c") for i in range(200)]
    df = spark.createDataFrame(rows, "g string, o double, n int").repartition(6)
    got = {(r["g"], r["o"]): r["cum_n"] for r in running_totals(df, [F.col("o").desc()], ["n"], ["g"]).collect()}
    for g in ("a", "b", "c"):
        total = 0
        for i in reversed(range(200)):
            total += i % 7
            assert got[g, float(i)] == total


@pytest.mark.parametrize("hot_groups", [1, 4, 10_000])
def test_hot_groups_join_like_the_others(spark, hot_groups):
    keys = ["hot"] * 400 + [f"k{i % 90}" for i in range(300)] + [None] * 50
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int").repartition(6)
    groups = df.groupBy("k").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 3")
    got = sorted(r["i"] for r in rows_of_groups(df, groups, ["k"], "copies", 750, hot_groups).collect())
    sizes = {k: keys.count(k) for k in set(keys)}
    assert got == [i for i, k in enumerate(keys) if sizes[k] > 3]


@pytest.mark.parametrize("driver_values", [20, 100_000])
def test_split_cuts_ties_by_number(spark, driver_values, monkeypatch):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 37 % 100).alias("t")).repartition(7)
    monkeypatch.setattr(order_stats.ranked_values, "__defaults__", (driver_values,))
    parts = temporal_split(df, "t", "id")
    got = [sorted((r["t"], r["id"]) for r in p.collect()) for p in parts]
    ordered = sorted((i * 37 % 100, i) for i in range(1000))
    assert got == [ordered[:600], ordered[600:800], ordered[800:]]
