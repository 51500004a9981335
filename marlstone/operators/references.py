"""References to records that do not exist, from signed change deltas (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_id(text: str | Column) -> Column:
    """An exported number as plain digits: outer blanks, leading zeros and a ``.0`` tail gone.

    Null, blank and zero are no id and give null; other text is kept trimmed.
    """
    c = F.col(text) if isinstance(text, str) else text
    t = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    t = F.when(t.rlike(r"^[0-9]+(\.0*)?$"), F.regexp_replace(F.regexp_replace(t, r"\.0*$", ""), r"^0+", "")).otherwise(t)
    return F.when(t != "", t)


def orphan_references(references: DataFrame, versions: DataFrame, bucket_seconds: int = 7 * 86400) -> DataFrame:
    """Reference rows whose key has no existing record at the row's time, with the reason.

    ``references``: ``key string, ts timestamp, payload struct``; ``versions``:
    ``key string, ts timestamp, gone timestamp`` (a record is there from ``ts``,
    included, to ``gone``, excluded; null: for ever).

    Both sides become change deltas: +1/-1 existence when a version arrives or is
    removed, +1 reference when a row is loaded.  Signed sums per key up to a row's
    time give its state; positive references with zero existence are orphans.
    Running sums are cut into time buckets per key whose opening balance comes
    from one pre-aggregated row per bucket, so a hot key never meets in one task.

    Returns ``key, ts, payload, n_refs, reason``: ``missing`` (the key has no
    version at all), ``deleted`` (one had arrived by then), ``late`` (otherwise).
    References with null key are dropped.  A null reference time sees nothing yet;
    a version with null ``ts`` never arrives; one removed at or before its arrival
    arrives without ever being there.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    none = F.lit(None).cast(references.schema["payload"].dataType)
    there = F.when(F.col("ts").isNotNull() & (F.col("gone").isNull() | (F.col("gone") > F.col("ts"))), one).otherwise(zero)
    known = versions.where("key is not null")
    came = known.select(
        "key", "ts", F.lit(0).alias("kind"), there.alias("exist"), F.when(F.col("ts").isNotNull(), one).otherwise(zero).alias("arrived"),
        one.alias("ever"), zero.alias("refs"), none.alias("payload"),
    )
    left = known.where("ts is not null and gone > ts").select(
        "key", F.col("gone").alias("ts"), F.lit(0).alias("kind"), (-one).alias("exist"), zero.alias("arrived"),
        zero.alias("ever"), zero.alias("refs"), none.alias("payload"),
    )
    refs = references.where("key is not null").select(
        "key", "ts", F.lit(1).alias("kind"), zero.alias("exist"), zero.alias("arrived"), zero.alias("ever"), one.alias("refs"), "payload"
    )
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    deltas = came.unionByName(left).unionByName(refs).withColumn("b", F.floor(seconds / bucket_seconds))
    # Null times belong to no bucket: a separate lowest one, before anything has arrived.
    deltas = deltas.withColumn("b", F.coalesce("b", F.lit(-(1 << 60)).cast("long")))

    sums = ["exist", "arrived", "refs"]
    per_bucket = deltas.groupBy("key", "b").agg(*[F.sum(c).alias(c) for c in [*sums, "ever"]])
    earlier = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    opening = per_bucket.select(
        "key", "b", *[F.coalesce(F.sum(c).over(earlier), zero).alias(f"open_{c}") for c in sums],
        F.sum("ever").over(Window.partitionBy("key")).alias("n_ever"),
    )
    running = Window.partitionBy("key", "b").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    state = deltas.join(opening, ["key", "b"]).select(
        "key", "ts", "kind", "payload", "n_ever", *[(F.col(f"open_{c}") + F.sum(c).over(running)).alias(f"n_{c}") for c in sums]
    )
    reason = F.when(F.col("n_ever") == 0, "missing").when(F.col("n_arrived") > 0, "deleted").otherwise("late")
    return state.where("kind = 1 and n_refs > 0 and n_exist = 0").select("key", "ts", "payload", "n_refs", reason.alias("reason"))


def orphan_keys(references: DataFrame, versions: DataFrame) -> DataFrame:
    """The current report: ``key, n_refs, n_exist`` of keys with positive references and zero existence.

    Counts are signed sums of all deltas, so a removed record takes its existence back.
    """
    refs = references.where("key is not null").select("key", F.lit(1).alias("r"), F.lit(0).alias("x"))
    known = versions.where("key is not null and ts is not null and (gone is null or gone > ts)")
    came = known.select("key", F.lit(0).alias("r"), F.lit(1).alias("x"))
    left = known.where("gone is not null").select("key", F.lit(0).alias("r"), F.lit(-1).alias("x"))
    total = refs.unionByName(came).unionByName(left).groupBy("key").agg(F.sum("r").alias("n_refs"), F.sum("x").alias("n_exist"))
    return total.where("n_refs > 0 and n_exist = 0")


def quarter_label(date: str) -> Column:
    """``2024Q1``, or ``unknown`` for null."""
    return F.coalesce(F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string")), F.lit("unknown"))
