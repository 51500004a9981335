"""Time series and ticks: chained returns over a seam, bins, latency, books and imbalance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.joins import small
from marlstone.operators.windows import cumulative_product


def participant_time(participant: Column, tape: Column) -> Column:
    """A report's time set back by the delay between participant and tape once more: ``2 * participant - tape``."""
    return participant * 2 - tape


def bin_end(ts: Column, minutes: int) -> Column:
    """The end of the bin a time falls in; a time on a border opens the next bin."""
    us = minutes * 60_000_000
    t = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros((F.floor(t / us) + 1).cast("long") * us).cast("timestamp_ntz")


def vwap(trades: DataFrame, key: str, at: str, price: str, size: str, minutes: int = 15) -> DataFrame:
    """Size-weighted mean price per key and bin, from the definition: every trade of the bin counts."""
    good = trades.where(F.col(price).isNotNull() & (F.col(size) > 0))
    b = good.groupBy(key, bin_end(F.col(at), minutes).alias("bin_end"))
    return b.agg(F.try_divide(F.sum(F.col(price) * F.col(size)), F.sum(size)).alias("vwap"), F.sum(size).alias("volume"))


def last_in_bin(quotes: DataFrame, key: str, at: str, tie: str, value: str, minutes: int = 15) -> DataFrame:
    """The last value per key and bin: one partial maximum per task, no sort."""
    return quotes.groupBy(key, bin_end(F.col(at), minutes).alias("bin_end")).agg(F.max_by(value, F.struct(at, tie)).alias(value))


def order_imbalance(trades: DataFrame, keys: list[str], is_buy: Column, size: str) -> DataFrame:
    """(buys - sells) / (buys + sells); null where nothing traded."""
    buy, sell = F.sum(F.when(is_buy, F.col(size)).otherwise(0.0)), F.sum(F.when(~is_buy, F.col(size)).otherwise(0.0))
    return trades.groupBy(*keys).agg(F.try_divide(buy - sell, buy + sell).alias("imbalance"))


def anchors(panel: DataFrame, key: str, at: str, price: str, cutoff: str) -> DataFrame:
    """Each key's price on the cutoff day."""
    return panel.where(F.col(at) == F.lit(cutoff).cast("date")).groupBy(key).agg(F.max(price).alias("anchor"))


def ieee_ratio(a: Column, b: Column) -> Column:
    """``a / b`` of doubles as IEEE has it: over zero it is infinite, or NaN where ``a`` is zero too; null if either is null."""
    at_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, at_zero).otherwise(a / F.when(b != 0, b))


def splice(panel: DataFrame, vendor: DataFrame, links: DataFrame, cutoff: str) -> DataFrame:
    """The base panel to the cutoff, continued by a vendor's chained returns.

    ``panel``: ``key, date, price, ret, cap``; ``vendor``: ``code, date, price,
    ret``; ``links``: ``key, code, usable``.  Vendor rows count only after the
    cutoff, with both a price and a return, and for keys with a price on the cutoff
    day.  Their price is the anchor times the chained returns; the cap moves with
    the vendor's price relative, not the return, since dividends leave it.  A vendor price
    of zero on the cutoff day makes the cap and the ratio infinite or NaN.
    """
    cut = F.lit(cutoff).cast("date")
    base = panel.where(F.col("date") <= cut).select("key", "date", "price", "ret", "cap", F.lit(None).cast("double").alias("adj_ratio"), F.lit("base").alias("source"))
    on_day = panel.where(F.col("date") == cut).groupBy("key").agg(F.max("price").alias("p0"), F.max("cap").alias("c0"))
    linked = vendor.join(links.where("usable").select("key", "code"), "code")
    seam = linked.where((F.col("date") == cut) & F.col("price").isNotNull()).groupBy("key").agg(F.max("price").alias("v0"))
    new = linked.where((F.col("date") > cut) & F.col("price").isNotNull() & F.col("ret").isNotNull()).join(on_day, "key").join(seam, "key")
    new = cumulative_product(new.withColumnRenamed("price", "v"), ["key"], "date", "ret", F.col("p0"), "price")
    tail = new.select(
        "key", "date", "price", "ret", ieee_ratio(F.col("c0") * F.col("v"), F.col("v0")).alias("cap"), ieee_ratio(F.col("p0"), F.col("v0")).alias("adj_ratio"), F.lit("vendor").alias("source")
    )
    return base.unionByName(tail)


def splice_coverage(spliced: DataFrame, links: DataFrame, cutoff: str, jump: float = 0.25, basis: float = 0.02) -> DataFrame:
    """One row: of all linked keys, how many are usable, continued, have a seam return over ``jump``, or a basis off 1 by more than ``basis``."""
    first = spliced.where("source = 'vendor'").groupBy("key").agg(F.min_by("ret", "date").alias("seam_ret"), F.max("adj_ratio").alias("ratio"))
    n = lambda c: F.count(F.when(c, 1))
    return links.join(first, "key", "left").agg(
        F.count("*").alias("n_links"), n(F.col("usable")).alias("n_usable"), F.count("seam_ret").alias("n_continued"),
        n(F.abs("seam_ret") > jump).alias("n_seam_outliers"), n(F.abs(F.col("ratio") - 1) > basis).alias("n_off_basis"),
    )


def adaptive_slices(df: DataFrame, day: Column, cap: int) -> list[tuple[str, str, int]]:
    """Date ranges of at most ``cap`` rows each where days allow it, by halving; daily counts (one row a day) come to the driver."""
    counts = {str(r["d"]): r["n"] for r in df.groupBy(day.alias("d")).agg(F.count("*").alias("n")).where("d is not null").collect()}
    days = sorted(counts)

    def cut(lo: int, hi: int) -> list[tuple[str, str, int]]:
        n = sum(counts[d] for d in days[lo:hi])
        if n <= cap or hi - lo <= 1:
            return [(days[lo], days[hi - 1], n)] if lo < hi else []
        mid = (lo + hi) // 2
        return cut(lo, mid) + cut(mid, hi)

    return cut(0, len(days))


def best_quotes(quotes: DataFrame, delays: DataFrame, key: str, at: str, venue: str, bid: str, ask: str, bucket_minutes: int = 60) -> DataFrame:
    """Best bid and ask over venues as an observer sees them: each venue's last quote by its delayed time.

    ``delays``: ``venue, delay_us`` (a handful of venues).  One row per observed
    quote; venues without a quote yet are left out of the best.  Each venue's last
    quote is carried over time buckets, so no key is sorted in one task.
    """
    seen = quotes.join(small(delays), venue).withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")) + F.col("delay_us"))
    names = [r[0] for r in delays.select(venue).orderBy(venue).collect()]
    for i, v in enumerate(names):
        seen = seen.withColumn(f"_q{i}", F.when(F.col(venue) == v, F.struct(F.col("_t"), F.col(bid).alias("b"), F.col(ask).alias("a"))))
    seen = seen.withColumn("_b", F.floor(F.col("_t") / (bucket_minutes * 60_000_000)))
    ends = seen.groupBy(key, "_b").agg(*[F.max(f"_q{i}").alias(f"_e{i}") for i in range(len(names))])
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(key, "_b", *[F.last(f"_e{i}", ignorenulls=True).over(earlier).alias(f"_c{i}") for i in range(len(names))])
    w = Window.partitionBy(key, "_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    now = seen.join(carry, [key, "_b"])
    for i in range(len(names)):
        now = now.withColumn(f"_n{i}", F.coalesce(F.max(f"_q{i}").over(w), F.col(f"_c{i}")))
    many = len(names) > 1
    pick = lambda f, c: f(*[F.col(f"_n{i}.{c}") for i in range(len(names))]) if many else F.col(f"_n0.{c}")
    return now.select(*quotes.columns, F.col("_t").alias("observed_us"), pick(F.greatest, "b").alias("best_bid"), pick(F.least, "a").alias("best_ask"))
