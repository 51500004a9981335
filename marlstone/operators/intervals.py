"""Continuous periods and gaps of overlapping date intervals (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Day number of 9999-12-31, the end of an open interval.
OPEN_END = 2932896


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str, bucket_days: int = 366) -> DataFrame:
    """``(key, kind, start_date, end_date)`` with kind ``period`` or ``gap``, both ends included.

    Intervals are sorted by start per key; a start more than one day beyond the
    running maximum of the previous ends opens a new island.  No key is ever
    sorted in one task: equal starts are pre-aggregated, a key's rows are cut into
    buckets of ``bucket_days`` start days (at most that many rows each), and the
    running maximum is carried from bucket to bucket over one row per bucket.

    A null ``end`` is open (9999-12-31).  Rows with null key or start, or with
    end before start, do not count.  Repeated rows change nothing, an empty
    input gives an empty result, other columns are ignored.
    """
    s, e = F.unix_date(F.col(start).cast("date")), F.unix_date(F.coalesce(F.col(end).cast("date"), F.lit("9999-12-31").cast("date")))
    spans = df.select(F.col(key).alias("k"), s.alias("s"), e.alias("e")).where("k is not null and s is not null and e >= s")
    starts = spans.groupBy("k", "s").agg(F.max("e").alias("e")).withColumn("b", F.floor(F.col("s") / bucket_days).cast("int"))

    by_key = Window.partitionBy("k").orderBy("b")
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.groupBy("k", F.floor(F.col("s") / bucket_days).cast("int").alias("b")).agg(F.max("e").alias("top"))
    carried = carried.select(
        "k", "b", F.max("top").over(earlier).alias("carry"), F.max("top").over(Window.partitionBy("k")).alias("last")
    )

    in_bucket = Window.partitionBy("k", "b").orderBy("s")
    before = F.max("e").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1))
    heads = (
        starts.join(carried, ["k", "b"])
        .withColumn("prev", F.greatest("carry", before))
        .where("prev is null or s > prev + 1")
        .withColumn("next_prev", F.lead("prev").over(in_bucket))
    )
    # The last head of a bucket ends where the next bucket that has a head says the running maximum stood.
    following = by_key.rowsBetween(1, Window.unboundedFollowing)
    bridge = (
        heads.groupBy("k", "b").agg(F.min_by("prev", "s").alias("first_prev"))
        .select("k", "b", F.first("first_prev", ignorenulls=True).over(following).alias("bridge"))
    )
    ended = heads.join(bridge, ["k", "b"])
    period = ended.select("k", F.lit("period").alias("kind"), "s", F.coalesce("next_prev", "bridge", "last").alias("e"))
    gap = heads.where("prev is not null").select("k", F.lit("gap").alias("kind"), (F.col("prev") + 1).alias("s"), (F.col("s") - 1).alias("e"))
    both = period.unionByName(gap)
    return both.select(F.col("k").alias(key), "kind", _date("s").alias("start_date"), _date("e").alias("end_date"))


def _date(days: str) -> Column:
    return F.date_from_unix_date(F.col(days))


def ymd(date: str | Column) -> Column:
    """A date as an int such as 20240331."""
    d = F.col(date) if isinstance(date, str) else date
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")
