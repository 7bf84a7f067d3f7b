"""Exact quantiles by narrowing histograms: no task and no driver holds the values.

Each wanted rank has an interval of values that holds it. A pass over the rows
counts those of each interval in ``BUCKETS`` buckets (in order, so a bucket's
rows are a run of ranks) and keeps each bucket's least and greatest value; the
bucket that holds the rank is its next interval. A pass is one aggregate that
combines before the shuffle, and its few rows are all that comes to the driver.
The first pass has buckets of equal ratio, later ones of equal width.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


@dataclass(frozen=True)
class Interval:
    """Values from ``low`` to ``high``, both included; ``before`` values are less."""

    low: float
    high: float
    before: int


def quantiles(rows: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """The values at ``shares`` (0 to 1) of the ordered values, in proportion between two of them.

    NULLs are left out and NaN counts as the greatest value. Without values all
    are None. The rows are read once to begin with and once per pass (about six
    for doubles that are spread out, fewer for few distinct values), so pass a
    stored table.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    all_of = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    n = all_of["n"]
    if not n:
        return [None for _ in shares]
    places = [share * (n - 1) for share in shares]
    ranks = sorted({int(r) for p in places for r in (floor(p), ceil(p))})
    found = _at_ranks(values, {r: Interval(all_of["low"], all_of["high"], 0) for r in ranks})
    out = []
    for p in places:
        low, high = found[floor(p)], found[ceil(p)]
        out.append(low if low == high or p == floor(p) else low + (high - low) * (p - floor(p)))
    return out


def _at_ranks(values: DataFrame, holds: dict[int, Interval]) -> dict[int, float]:
    found: dict[int, float] = {}
    first = True
    while True:
        # NaN differs from itself: an interval of it alone is told by both ends.
        for rank, i in list(holds.items()):
            if i.low == i.high or i.low != i.low:
                found[rank] = i.low
                del holds[rank]
        if not holds:
            return found
        intervals = sorted(set(holds.values()), key=lambda i: (i.before, i.low))
        inside = [
            F.when(F.col("v").between(F.lit(i.low), F.lit(i.high)), F.struct(F.lit(k).alias("k"), _bucket(i, first).alias("b"), "v"))
            for k, i in enumerate(intervals)
        ]
        counted = (
            values.select(F.explode(F.array_compact(F.array(*inside))).alias("x"))
            .groupBy("x.k", "x.b")
            .agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("low"), F.max("x.v").alias("high"))
            .collect()
        )
        for rank, own in list(holds.items()):
            before = own.before
            for row in sorted((r for r in counted if intervals[r["k"]] == own), key=lambda r: r["b"]):
                if rank < before + row["n"]:
                    holds[rank] = Interval(row["low"], row["high"], before)
                    break
                before += row["n"]
        first = False


def _bucket(i: Interval, by_ratio: bool) -> Column:
    """Which of the buckets a value is in; never smaller for a greater value."""
    # Halves, so that the width of all doubles is one too.
    scale = (lambda c: F.signum(c) * F.log1p(F.abs(c))) if by_ratio else (lambda c: c / 2)
    low, high = scale(F.lit(i.low)), scale(F.lit(i.high))
    place = F.floor(F.try_divide(scale(F.col("v")) - low, (high - low) / BUCKETS))
    # Ends that are infinite or not a number have no width: they get buckets of their own.
    plain = F.when(place.isNull() | F.isnan(place.cast("double")), 0).otherwise(F.greatest(F.lit(0), F.least(place, F.lit(BUCKETS - 1))))
    top = F.when(F.isnan("v"), BUCKETS + 2).when(F.col("v") == F.lit(float("inf")), BUCKETS + 1)
    ends = F.when(F.col("v") == F.lit(float("-inf")), -2).when(F.col("v") == F.lit(i.high), BUCKETS).when(F.col("v") == F.lit(i.low), -1)
    return F.coalesce(top, ends, plain).cast("long")
