import math
import random

import pytest

from tallyhouse.operators.quantiles import quantiles

SHARES = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]


def plain(values, share):
    values = sorted(values)
    p = share * (len(values) - 1)
    low, high = values[math.floor(p)], values[math.ceil(p)]
    return low if low == high or p == math.floor(p) else low + (high - low) * (p - math.floor(p))


def table(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value double").repartition(5)


@pytest.mark.parametrize(
    "values",
    [
        [7.0],
        [1.0] * 50 + [2.0] * 51,
        [random.Random(1).gauss(0, 1e6) for _ in range(20_000)],
        [math.exp(random.Random(i).uniform(-300, 300)) * (-1) ** i for i in range(5_000)],
        [i * 5e-324 for i in range(3_000)],
        [1e16 + 2 * i for i in range(5_000)] + [-1.7e308, 1.7e308],
        [float("-inf"), float("inf"), 0.0, -0.0, 1.0, 2.0, 3.0, float("inf")],
    ],
)
def test_equal_to_sorted_values(spark, values):
    found = quantiles(table(spark, values), "value", SHARES)
    want = [plain(values, s) for s in SHARES]
    assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(found, want, strict=True))


def test_no_values_and_missing_ones(spark):
    assert quantiles(table(spark, [None]), "value", [0.5]) == [None]
    assert quantiles(table(spark, [None, 1.0, None, 3.0]), "value", [0.5]) == [2.0]
    assert math.isnan(quantiles(table(spark, [1.0, float("nan")]), "value", [1.0])[0])
    assert quantiles(table(spark, [1.0, 5.0, float("nan")]), "value", [0.5]) == [5.0]


def test_many_distinct_values_pass_by_counts_only(spark):
    """What comes back from a pass is bounded by the buckets, however many values there are."""
    rows = spark.range(2_000_000).selectExpr("cast(pmod(id * 7919, 2000000) as double) / 3 as value")
    assert quantiles(rows, "value", [0.25, 0.5]) == pytest.approx([1999999 * 0.25 / 3, 1999999 * 0.5 / 3], rel=1e-15)
