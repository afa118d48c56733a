"""Selection by refined histograms against sorted values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import quantiles
from tablecraft.operators.quantiles import column_quantiles, select_ranks

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def by_hand(values, probs=PROBS):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    out = []
    for p in probs:
        rank = p * (len(values) - 1)
        low, high = values[math.floor(rank)], values[math.ceil(rank)]
        out.append(low if low == high else low + (high - low) * (rank - math.floor(rank)))
    return out


def test_columns_of_any_shape(spark):
    rng = random.Random(5)
    n = 6000
    columns = {
        "normal": [rng.gauss(0, 1) for _ in range(n)],
        "scales": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)],
        "near": [1.0 + i * 2.0 ** -52 for i in range(n)],
        "hot": [7.5 if i % 3 else rng.random() for i in range(n)],
        "constant": [3.0] * n,
        "gaps": [None if i % 2 else float(i % 97) for i in range(n)],
        "none": [None] * n,
        "ends": [rng.choice([float("inf"), float("-inf"), 0.0, -0.0, 5e-324, 1.7e308, -1.7e308]) for _ in range(n)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(7)
    got = column_quantiles(df, list(columns), PROBS, max_distinct=0)
    for name, values in columns.items():
        want = by_hand(values)
        assert (got[name] is None) == (want is None), name
        if want:
            same = [a == b or a != a and b != b or a == pytest.approx(b, rel=1e-15) for a, b in zip(got[name], want)]
            assert all(same), (name, got[name], want)


def test_nan_is_the_greatest(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),), (None,)], "x double")
    n, values = select_ranks(df, range)["x"]
    assert n == 3 and values[0] == 1.0 and values[1] == float("inf") and values[2] != values[2]


def test_two_million_distinct_values(spark):
    df = spark.range(2_000_000, numPartitions=8).select(((F.col("id") * 7919) % 2_000_000).cast("double").alias("x"), (F.col("id") ** 2).alias("y"))
    got = column_quantiles(df, ["x", "y"], [0.25, 0.5, 0.9])
    assert got["x"] == pytest.approx([1_999_999 * p for p in (0.25, 0.5, 0.9)])
    assert got["y"] == pytest.approx(by_hand([float(i) ** 2 for i in range(2_000_000)], [0.25, 0.5, 0.9]))


def test_all_columns_share_the_passes(spark, monkeypatch):
    """Six columns are read by one series of passes."""
    seen = []
    first = quantiles._by_scale

    def watch(x):
        seen.append(x)
        return first(x)

    monkeypatch.setattr(quantiles, "_by_scale", watch)
    df = spark.range(50_000, numPartitions=4).select(*[(F.col("id") * (i + 3) % 10_007).cast("double").alias(f"c{i}") for i in range(6)])
    got = column_quantiles(df, df.columns, [0.5], max_distinct=0)
    assert len(seen) == 1 and set(got) == set(df.columns)
    for i in range(6):
        assert got[f"c{i}"] == pytest.approx(by_hand([float(j * (i + 3) % 10_007) for j in range(50_000)], [0.5]))
