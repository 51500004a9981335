"""Window operators of panels: entry and exit markers, breadth, chained returns, repairs and tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_markers(df: DataFrame, keys: list[str], period: str, step: int = 1) -> DataFrame:
    """``is_first``/``is_last``: no report one ``step`` before/after.  ``df`` is unique in keys and period."""
    w = Window.partitionBy(*keys).orderBy(period)
    first = F.coalesce(F.col(period) - F.lag(period).over(w) > step, F.lit(True))
    last = F.coalesce(F.lead(period).over(w) - F.col(period) > step, F.lit(True))
    return df.select(*keys, period, first.alias("is_first"), last.alias("is_last"))


def report_markers(held: DataFrame, holder: str, period: str) -> DataFrame:
    """``holder, period, is_first, is_last, n_holders``: a holder's entry and exit over all it reports, and how many report in the period.

    One row per holder and period, whatever the number of entities held.
    """
    m = gap_markers(held.select(holder, period).distinct(), [holder], period)
    n = m.groupBy(period).agg(F.count("*").alias("n_holders"))
    return m.join(n, period)


def breadth_change(held: DataFrame, entity: str, holder: str, period: str) -> DataFrame:
    """``dbreadth`` per entity and period: owners that are no new reporters, less the owners one row before that were to report on, over all reporters then.

    ``held`` is unique in entity, holder and period; null in an entity's first period.
    """
    m = held.select(entity, holder, period).join(report_markers(held, holder, period), [holder, period])
    p = m.groupBy(entity, period).agg(
        F.count("*").alias("own"), F.count_if("is_first").alias("new"), F.count_if("is_last").alias("old"), F.max("n_holders").alias("n")
    )
    w = Window.partitionBy(entity).orderBy(period)
    stay = (F.col("own") - F.col("new")) - F.lag(F.col("own") - F.col("old")).over(w)
    return p.select(entity, period, F.try_divide(stay, F.lag("n").over(w)).alias("dbreadth"))


def change_flag(df: DataFrame, keys: list[str], period: str, value: str, name: str) -> DataFrame:
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy(period))
    return df.withColumn(name, F.coalesce(F.col(value) != prev, F.lit(False)))


def neighbourhood(df: DataFrame, keys: list[str], period: str, flag: str, name: str) -> DataFrame:
    """True where the flag is up one row before, here or one row after."""
    w = Window.partitionBy(*keys).orderBy(period)
    no = F.lit(False)
    return df.withColumn(name, F.coalesce(F.lag(flag).over(w), no) | F.coalesce(F.col(flag), no) | F.coalesce(F.lead(flag).over(w), no))


def cumulative_product(df: DataFrame, keys: list[str], at: str, rate: str, start: float | Column, name: str) -> DataFrame:
    """``start`` times the running product of ``1 + rate``.

    Magnitudes add up as logs, signs as the parity of negative factors, and a
    factor of zero holds the product at zero from there on; so rates of -100 % and
    below need no other path.  A null rate leaves the product as it was.
    """
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    f = 1 + F.coalesce(F.col(rate), F.lit(0.0))
    size = F.exp(F.sum(F.when(f != 0, F.ln(F.abs(f))).otherwise(0.0)).over(w))
    sign = F.when(F.sum(F.when(f < 0, 1).otherwise(0)).over(w) % 2 == 1, -1.0).otherwise(1.0)
    dead = F.max(F.when(f == 0, 1).otherwise(0)).over(w) == 1
    first = F.lit(start) if isinstance(start, float) else start
    return df.withColumn(name, F.when(dead, 0.0).otherwise(first * sign * size))


def smooth_flips(df: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """Repairs A-B-A to A-A-A, then A-B-B-A to A-A-A-A, each pass from left to right, each repair seen by the next.

    Groups are one entity's yearly states: short by nature.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {at} {df.schema[at].dataType.simpleString()}, {state} string"

    def fix(pdf):
        pdf = pdf.sort_values(at)
        s = list(pdf[state])
        for width in (1, 2):
            for i in range(len(s) - width - 1):
                inner = set(s[i + 1 : i + 1 + width])
                if s[i] == s[i + width + 1] and len(inner) == 1 and s[i] not in inner:
                    s[i + 1 : i + 1 + width] = [s[i]] * width
        pdf[state] = s
        return pdf[[key, at, state]]

    return df.select(key, at, state).groupBy(key).applyInPandas(fix, schema)


def best_with_margin(df: DataFrame, key: str, unit: str, score: str) -> DataFrame:
    """The best unit per key and its margin over the best of any other unit (over 0 where there is none)."""
    best = df.groupBy(key, unit).agg(F.max(score).alias(score))
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(unit))
    two = best.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    top = F.max(F.when(F.col("_rn") == 1, F.struct(F.col(score).alias("s"), F.col(unit).alias("u")))).alias("t")
    out = two.groupBy(key).agg(top, F.max(F.when(F.col("_rn") == 2, F.col(score))).alias("second"))
    return out.select(key, F.col("t.u").alias(unit), F.col("t.s").alias(score), (F.col("t.s") - F.coalesce("second", F.lit(0.0))).alias("margin"))


def tail_run(df: DataFrame, key: str, period: str, healthy: Column, name: str) -> DataFrame:
    """How many of a key's periods lie after its last healthy one (all of them, if none is)."""
    last = df.groupBy(key).agg(F.max(F.when(healthy, F.col(period))).alias("_last"))
    out = df.join(last, key).groupBy(key).agg(F.count(F.when(F.col("_last").isNull() | (F.col(period) > F.col("_last")), 1)).alias(name))
    return out


def winsorize(df: DataFrame, key: str, value: str, q: float, least: int, name: str) -> DataFrame:
    """Values capped at their group's ``q`` quantile; groups with under ``least`` non-zero values stay as they are."""
    cap = df.groupBy(key).agg(F.when(F.count(F.when(F.col(value) != 0, 1)) >= least, F.percentile(value, F.lit(q))).alias("_cap"))
    return df.join(cap, key).withColumn(name, F.when(F.col("_cap").isNull(), F.col(value)).otherwise(F.least(value, "_cap"))).drop("_cap")
