"""Detectors of panel defects.

Each takes a panel and gives findings ``kind, entity, period, detail`` (text) and
``metric`` (double).  Panels hold one row per entity and period; of repeated rows
the last in order is kept by :func:`one_per_period`.  Unknown values never make a
finding: a missing period is not a period of zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.dedup import first_of


def one_per_period(df: DataFrame, entity: str, period: str, order: str) -> DataFrame:
    return first_of(df, [entity, period], [F.desc(order)])


def finding(df: DataFrame, kind: str | Column, entity: str | Column, period: str | Column, detail: Column, metric: Column) -> DataFrame:
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    k = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(k.alias("kind"), text(entity).alias("entity"), text(period).alias("period"), detail.cast("string").alias("detail"), F.round(metric.cast("double"), 6).alias("metric"))


def _steps(df: DataFrame, entity: str, period: str, *cols: str) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(period)
    return df.select("*", *[F.lag(c).over(w).alias("prev_" + c) for c in cols])


def _change(now: str, prev: str) -> Column:
    return F.when(F.col(prev) > 0, F.col(now) / F.col(prev) - 1)


def flat_owner_swing(df: DataFrame, entity: str, period: str, shares: str, owners: str, swing: float = 0.2, flat: float = 0.05) -> DataFrame:
    """Shares move by ``swing`` or more while owners move by ``flat`` at most."""
    s = _steps(df, entity, period, shares, owners)
    ds, do = _change(shares, "prev_" + shares), _change(owners, "prev_" + owners)
    fold = F.greatest(F.col(shares) / F.col("prev_" + shares), F.try_divide("prev_" + shares, shares))
    hit = s.where((F.abs(ds) >= swing) & (F.abs(do) <= flat))
    return finding(hit, "flat_owner_share_swing", entity, period, F.when(ds > 0, F.lit("up")).otherwise("down"), fold)


def seasonal(df: DataFrame, entity: str, period: str, value: str, ratio: float = 1.5, least: int = 8) -> DataFrame:
    """Means by month of the year alternate: the highest is ``ratio`` times the lowest, over ``least`` observations."""
    m = df.where(F.col(value).isNotNull()).groupBy(entity, F.month(period).alias("_m")).agg(F.avg(value).alias("_a"), F.count("*").alias("_c"))
    g = m.groupBy(entity).agg(
        F.sum("_c").alias("n"), F.count("*").alias("months"), F.max(F.struct(F.col("_a"), -F.col("_m"))).alias("hi"), F.min(F.struct("_a", "_m")).alias("lo")
    )
    fold = F.col("hi._a") / F.col("lo._a")
    hit = g.where((F.col("n") >= least) & (F.col("months") >= 2) & (F.col("lo._a") > 0)).where(fold >= ratio)
    return finding(hit, "seasonal_alternation", entity, F.lit(None), F.concat(F.lit("high "), -F.col("hi.col2"), F.lit(" low "), F.col("lo._m")), fold)


# Split factors tried, each and then its square.
SPLITS = [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 10.0, 20.0, 28.0]


def split_ratio(df: DataFrame, entity: str, period: str, shares: str, owners: str, near: float = 0.03, least: float = 1.5, flat: float = 0.1) -> DataFrame:
    """Shares rise by about a split factor (``split``) or its square (``double-adjusted``), with owners about the same."""
    s = _steps(df, entity, period, shares, owners).withColumn("_fold", F.try_divide(shares, F.when(F.col("prev_" + shares) > 0, F.col("prev_" + shares))))
    targets = F.array(*[F.struct(F.lit(f ** n).alias("f"), F.lit(label).alias("label")) for n, label in ((1, "split"), (2, "double-adjusted")) for f in SPLITS])
    first = F.try_element_at(F.filter(targets, lambda x: F.abs(F.col("_fold") - x["f"]) / x["f"] <= near), F.lit(1))
    hit = s.withColumn("_t", first).where((F.col("_fold") >= least) & F.col("_t").isNotNull() & (F.abs(_change(owners, "prev_" + owners)) <= flat))
    return finding(hit, "split_factor_ratio", entity, period, F.concat(F.col("_t.label"), F.lit(" "), F.col("_t.f").cast("string")), F.col("_fold"))


def unit_break(df: DataFrame, period: str, value: str, ratio: float = 10.0, least: int = 20, even: float = 3.0) -> DataFrame:
    """Whole-panel medians a factor of ``ratio`` apart between neighbouring periods; ``clean`` if all quantiles moved alike."""
    q = df.where(F.col(value) > 0).groupBy(period).agg(F.count("*").alias("n"), F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q")).where(F.col("n") >= least)
    w = Window.partitionBy(F.lit(1)).orderBy(period)  # one row per period
    s = q.withColumn("p", F.lag("q").over(w)).where("p is not null")
    r = F.zip_with("q", "p", lambda a, b: F.greatest(a / b, b / a))
    s = s.withColumn("r", r).withColumn("m", F.element_at("r", 2)).where(F.col("m") >= ratio)
    clean = F.array_max("r") / F.array_min("r") <= even
    return finding(s, "unit_break", F.lit(None), period, F.when(clean, F.lit("clean")).otherwise("uneven"), F.col("m"))


def coverage_end(df: DataFrame, entity: str, period: str, expected: str, days: int = 100) -> DataFrame:
    """The panel (entity null), and each entity, whose last period lies more than ``days`` before the expected end."""
    last = df.groupBy(entity).agg(F.max(period).alias("last"))
    both = last.unionByName(last.agg(F.max("last").alias("last")).select(F.lit(None).cast(df.schema[entity].dataType).alias(entity), "last"))
    gap = F.datediff(F.lit(expected).cast("date"), "last")
    return finding(both.where(gap > days), "coverage_end", entity, "last", F.concat(gap, F.lit(" days short")), gap)


def owner_dropout(df: DataFrame, entity: str, period: str, owners: str, drop: float = 0.5) -> DataFrame:
    s = _steps(df, entity, period, owners)
    c = _change(owners, "prev_" + owners)
    return finding(s.where(c <= -drop), "owner_dropout", entity, period, F.lit("owners fell"), c)


def zero_row_cohort(docs: DataFrame, cohort: str, period: Column, rows: str, least: int = 10, share: float = 0.9) -> DataFrame:
    """Cohorts of at least ``least`` documents of which ``share`` gave no rows."""
    g = docs.groupBy(cohort, period.alias("_p")).agg(F.count("*").alias("n"), F.count(F.when(F.col(rows) == 0, 1)).alias("z"))
    rate = F.col("z") / F.col("n")
    return finding(g.where((F.col("n") >= least) & (rate >= share)), "zero_row_cohort", cohort, "_p", F.concat(F.col("z"), F.lit(" of "), F.col("n")), rate)


def coverage_step(df: DataFrame, period: str, counts: list[str], step: float = 0.5) -> DataFrame:
    """Counts per period that jump by ``step`` or more; ``df`` has one row per period."""
    long = df.unpivot([period], counts, "name", "n")
    s = _steps(long, "name", period, "n")
    c = _change("n", "prev_n")
    return finding(s.where(F.abs(c) >= step), "coverage_step", "name", period, F.lit("count jumped"), c)


def bridge_rate(df: DataFrame, entity: str, period: str, linked: str, total: str, low: float = 0.7, drop: float = 0.1) -> DataFrame:
    """Link rates under ``low``, and falls of more than ``drop`` against the period before that has a rate."""
    r = df.where(F.col(total) > 0).withColumn("_r", F.col(linked) / F.col(total)).where("_r is not null")
    s = _steps(r, entity, period, "_r")
    a = finding(s.where(F.col("_r") < low), "bridge_rate_low", entity, period, F.lit("few are linked"), F.col("_r"))
    fall = F.col("prev__r") - F.col("_r")
    return a.unionByName(finding(s.where(fall > drop), "bridge_rate_regression", entity, period, F.lit("fewer are linked than before"), fall))


def duplicate_grain(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """One finding: the share of keys with more rows than one, excess rows, and how much the repeats inflate the sum of ``value``."""
    first = F.min_by(value, F.struct(*order))
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("all"), first.alias("one"))
    s = g.agg(F.count("*").alias("k"), F.count(F.when(F.col("n") > 1, 1)).alias("d"), F.sum(F.col("n") - 1).alias("excess"), F.try_divide(F.sum("all"), F.sum("one")).alias("inflation"))
    detail = F.concat(F.lit("excess rows "), F.col("excess"), F.lit(", inflation "), F.round("inflation", 4))
    return finding(s.where("d > 0"), "duplicate_grain", F.lit(None), F.lit(None), detail, F.col("d") / F.col("k"))


def unresolved_overlap(df: DataFrame, period: Column, secondary: Column, resolved: Column, share: float = 0.05) -> DataFrame:
    """Unresolved secondary rows as a share of all rows of a period."""
    g = df.groupBy(period.alias("_p")).agg(F.count("*").alias("n"), F.count(F.when(secondary & ~resolved, 1)).alias("u"))
    return finding(g.where(F.col("u") > share * F.col("n")), "unresolved_overlap", F.lit(None), "_p", F.concat(F.col("u"), F.lit(" rows")), F.col("u") / F.col("n"))


def calendar_gap(df: DataFrame, month: Column, expected: list[int], thin: float = 0.5) -> DataFrame:
    """Expected months of the year without rows, with under ``thin`` of the mean of those present, and unexpected months."""
    have = df.groupBy(month.alias("m")).agg(F.count("*").alias("n")).where("m is not null")
    want = df.sparkSession.createDataFrame([(m,) for m in expected], "m int").withColumn("want", F.lit(True))
    mean = have.join(want, "m", "left_semi").agg(F.avg("n").alias("mean"))
    j = want.join(have, "m", "full").crossJoin(F.broadcast(mean))  # twelve months by one row
    kind = F.when(F.col("n").isNull(), "calendar_gap").when(F.col("want").isNull(), "calendar_unexpected").when(F.col("n") < thin * F.col("mean"), "calendar_thin")
    return finding(j.withColumn("k", kind).where("k is not null"), F.col("k"), F.lit(None), "m", F.concat(F.coalesce("n", F.lit(0)), F.lit(" rows")), F.coalesce(F.col("n") / F.col("mean"), F.lit(0.0)))


def join_gap_cluster(df: DataFrame, month: Column, joined: str, spread: float = 0.25) -> DataFrame:
    """Null rates of a joined column that differ by ``spread`` between months: one finding, at the worst month."""
    g = df.groupBy(month.alias("m")).agg(F.avg(F.col(joined).isNull().cast("double")).alias("r")).where("m is not null")
    s = g.agg(F.count("*").alias("k"), F.max(F.struct(F.col("r"), -F.col("m"))).alias("hi"), F.min("r").alias("lo"))
    gap = F.col("hi.r") - F.col("lo")
    return finding(s.where((F.col("k") >= 2) & (gap >= spread)), "join_gap_cluster", F.lit(None), -F.col("hi.col2"), F.lit("nulls cluster by month"), gap)


def join_tail(df: DataFrame, period: Column, joined: str, rate: float = 0.99, least: int = 2) -> DataFrame:
    """A joined column all but null over the last ``least`` or more periods, after at least one healthy one (of three or more)."""
    g = df.groupBy(period.alias("p")).agg(F.avg(F.col(joined).isNull().cast("double")).alias("r")).where("p is not null")
    s = g.agg(F.max(F.when(F.col("r") < rate, F.col("p"))).alias("last_ok"), F.count("*").alias("k"))
    t = g.join(F.broadcast(s)).where("last_ok is not null and k >= 3 and p > last_ok").groupBy("last_ok").agg(F.count("*").alias("n"), F.min("p").alias("first"))
    return finding(t.where(F.col("n") >= least), "join_tail", F.lit(None), "first", F.concat(F.col("n"), F.lit(" periods")), F.col("n"))


def impossible_ratio(df: DataFrame, entity: str, period: str, num: str, den: str, cap: float = 1.0, slack: float = 0.02) -> DataFrame:
    r = F.col(num) / F.col(den)
    return finding(df.where(F.col(den) > 0).where(r > cap * (1 + slack)), "impossible_ratio", entity, period, F.lit("over its cap"), r)


def implied_price(df: DataFrame, entity: str, period: str, value: str, shares: str, scale: float = 1.0, low: float = 0.01, high: float = 1e4, least: float = 1e5) -> DataFrame:
    p = F.col(value) * scale / F.col(shares)
    return finding(df.where(F.col(shares) >= least).where((p < low) | (p > high)), "implied_price", entity, period, F.lit("implausible price"), p)


def fallback_contamination(df: DataFrame, entity: str, period: str, fallback: str, total: str, share: float = 0.05) -> DataFrame:
    """Entity-periods in which values from a fallback make up more than ``share`` of the total; a null fallback is none."""
    r = F.coalesce(F.col(fallback), F.lit(0.0)) / F.col(total)
    return finding(df.where(F.col(total) > 0).where(r > share), "fallback_contamination", entity, period, F.lit("fallback share"), r)


def sweep(findings: dict[str, DataFrame | None]) -> tuple[DataFrame, dict[str, str]]:
    """All findings as one frame, and for each detector whether it ran or was not applicable."""
    ran = {k: "ran" if v is not None else "not applicable" for k, v in findings.items()}
    return reduce(DataFrame.unionByName, [v for v in findings.values() if v is not None]), ran
