"""Ordering and deduplication with total orders.

``row_number() <= k`` filters are pushed below the shuffle as a window group limit, so
that each task sends at most k rows of a group: a hot group costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import written


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first ``k`` rows of each group; ``order`` must end in a unique column."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top(df, keys, order, 1, "_rn").drop("_rn")


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Global 1-based positions in ``order`` without a single-partition window.

    Rows are range-partitioned by the order, counted per partition (one row each),
    and numbered within their partition on top of the counts before it.
    """
    # Written once: range bounds are sampled, so two evaluations need not agree.
    parted = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "positions")
    sizes = parted.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parted.withColumn(name, here).join(F.broadcast(offsets), "_p").withColumn(name, F.col(name) + F.col("_before")).drop("_p", "_before")


def seeded_sample(df: DataFrame, ids: list[str], k: int, seed: int, strata: list[str]) -> DataFrame:
    """Per stratum the ``k`` rows of least seeded hash; ties by id."""
    h = F.xxhash64(F.lit(seed), *ids)
    return top(df.withColumn("_h", h), strata, [F.col("_h").asc(), *[F.col(i).asc() for i in ids]], k).drop("_h", "rn")
