"""Top-n per group without gathering a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Spark prunes rows below a row_number() filter before the shuffle only up to
# spark.sql.optimizer.windowGroupLimitThreshold, 1000 unless set.
GROUP_LIMIT_DEFAULT = 1000


def keep_top(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread: Column | None = None,
    salts: int = 64,
    own_n: Column | None = None,
) -> DataFrame:
    """Rows ranked 1..n in their group under a total order. ``own_n`` may state
    a lower bound per group.

    Up to the threshold, Spark cuts each task's rows to n per group before the
    shuffle. For a larger n the same cut is made in a first salted pass, so a
    group holding most of the rows is ranked by many tasks.
    """
    limit = int(
        df.sparkSession.conf.get(
            "spark.sql.optimizer.windowGroupLimitThreshold", str(GROUP_LIMIT_DEFAULT)
        )
    )
    if n > limit and spread is not None:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
        by_salt = W.partitionBy(*group, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_rank", F.row_number().over(by_salt))
            .filter(F.col("_rank") <= n)
            .drop("_rank", "_salt")
        )
    by_group = W.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(by_group)).filter(F.col("_rank") <= n)
    if own_n is not None:
        ranked = ranked.filter(F.col("_rank") <= own_n)
    return ranked.drop("_rank")
