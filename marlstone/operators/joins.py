"""Joins beyond equality: valid time, as-of, fallback keys, lookups, and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import size_bytes

#: A lookup table is broadcast only below this many bytes by the planner's estimate.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is within ``limit``; else as it is, for a shuffle join."""
    return F.broadcast(df) if size_bytes(df) <= limit else df


def lookup(df: DataFrame, table: DataFrame, on: str, value: str, missing: str = "__unlinked__") -> DataFrame:
    """Adds ``value`` by key; keys without entry, and null keys, get ``missing``.  ``table`` must be unique in ``on``."""
    return df.join(small(table.select(on, value)), on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(missing)))


def with_indicator(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full join with ``side``: both, left_only or right_only."""
    x, y = left.withColumn("_x", F.lit(1)), right.withColumn("_y", F.lit(1))
    side = F.when(F.col("_y").isNull(), "left_only").when(F.col("_x").isNull(), "right_only").otherwise("both")
    return x.join(y, on, "full").withColumn("side", side).drop("_x", "_y")


def valid_time(left: DataFrame, right: DataFrame, on: str, at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Rows of ``right`` whose [start, end] holds ``left[at]``; a null end is open."""
    r = right.withColumnRenamed(on, "_k")
    inside = (left[on] == r["_k"]) & (left[at] >= r[start]) & (left[at] <= F.coalesce(r[end], F.lit("9999-12-31").cast("timestamp_ntz")))
    return left.join(r, inside, how).drop("_k")


def still_current(left: DataFrame, right: DataFrame, on: str, at: str, start: str, end: str) -> DataFrame:
    """As :func:`valid_time`, where an interval that reaches the last end on record counts as current for ever."""
    vintage = right.agg(F.max(end).alias("_vintage"))
    r = right.join(F.broadcast(vintage)).withColumnRenamed(on, "_k")
    inside = (left[on] == r["_k"]) & (left[at] >= r[start]) & ((left[at] <= r[end]) | (r[end] >= r["_vintage"]))
    return left.join(r, inside).drop("_k", "_vintage")


def asof_backward(
    left: DataFrame, right: DataFrame, on: str, left_at: str, right_at: str, take: list[str], tie: list[str], bucket_seconds: int = 86400, tolerance_seconds: int | None = None
) -> DataFrame:
    """Each left row with the latest right row at or before it, per key; ``take`` columns are null where there is none.

    Right rows at one instant are decided by ``tie`` (highest wins).  With a
    tolerance, older matches count as none.  Null keys or times match nothing.

    Both sides are stacked and read in time order, as a merge of sorted streams,
    but no key is sorted in one task: time is cut into buckets, and the last right
    row before a bucket is carried into it over one row per key and bucket.
    """
    payload = F.struct(F.col(right_at).alias("_t"), *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(take)])
    r = right.where(F.col(on).isNotNull() & F.col(right_at).isNotNull()).select(F.col(on).alias("_k"), F.col(right_at).alias("_at"), payload.alias("_r"))
    r = r.groupBy("_k", "_at").agg(F.max("_r").alias("_r"))
    lrow = F.struct(*[F.col(c) for c in left.columns])
    lrows = left.select(F.col(on).alias("_k"), F.col(left_at).alias("_at"), lrow.alias("_l"))
    both = r.select("_k", "_at", F.lit(0).alias("_side"), "_r", F.lit(None).cast(lrows.schema["_l"].dataType).alias("_l")).unionByName(
        lrows.select("_k", "_at", F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), "_l")
    )
    both = both.withColumn("_b", F.floor(F.unix_micros(F.col("_at").cast("timestamp")) / (bucket_seconds * 1_000_000)))
    ends = both.groupBy("_k", "_b").agg(F.max("_r").alias("_last"))
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(F.col("_k").alias("_ck"), F.col("_b").alias("_cb"), F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    same = F.col("_k").eqNullSafe(F.col("_ck")) & F.col("_b").eqNullSafe(F.col("_cb"))
    w = Window.partitionBy("_k", "_b").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.coalesce(F.last("_r", ignorenulls=True).over(w), F.col("_carry"))
    out = both.join(carry, same).withColumn("_hit", F.when(F.col("_k").isNotNull() & F.col("_at").isNotNull(), hit)).where("_side = 1")
    if tolerance_seconds is not None:
        age = F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col("_hit._t").cast("timestamp"))
        out = out.withColumn("_hit", F.when(age <= tolerance_seconds * 1_000_000, F.col("_hit")))
    return out.select("_l.*", *[F.col(f"_hit._v{i}").alias(c) for i, c in enumerate(take)])


def fallback(left: DataFrame, right: DataFrame, key: str, steps: list[tuple[str, Column, Column]], take: list[str]) -> DataFrame:
    """Tries each (path, left key, right key) in turn on the rows not yet matched; ``path`` tells which matched.

    ``key`` identifies a left row.  Right keys must be unique within a step.
    """
    out, rest = None, left
    for path, lk, rk in steps:
        r = right.where(rk.isNotNull()).select(rk.alias("_rk"), *take)
        hit = rest.withColumn("_lk", lk).join(r, F.col("_lk") == F.col("_rk")).drop("_lk", "_rk").withColumn("path", F.lit(path))
        out = hit if out is None else out.unionByName(hit)
        rest = rest.join(hit.select(key), key, "left_anti")
    return out


def audit(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """One row: rows and matches of a join before it is made, its fan-out, and a verdict."""
    n_right = right.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n"))
    joined = left.join(n_right, on, "left")
    out = joined.agg(
        F.count("*").alias("left_rows"), F.count("_n").alias("matched"), F.coalesce(F.sum(F.coalesce("_n", F.lit(1))), F.lit(0)).alias("rows_after"),
        F.count(F.when(F.col("_n") > 1, 1)).alias("fanned_out"),
    )
    rate = F.try_divide("matched", "left_rows")
    verdict = F.when(F.col("matched") == 0, "bug").when(rate < 0.9, "warn").otherwise("ok")
    return out.withColumn("match_rate", F.round(rate, 6)).withColumn("verdict", verdict)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on more than one row, with their counts: empty where ``keys`` are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
