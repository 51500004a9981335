"""Best representative of each duplicate group, built field by field (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def golden_records(df: DataFrame, keys: list[str], fields: dict[str, Column], order: list[Column], least: int = 2) -> DataFrame:
    """``keys`` and one value per field for each group of at least ``least`` rows.

    ``fields``: name -> usable value of a row (null where the row has none);
    ``order``: total order of the rows of a group, best first.  Each usable value is
    ranked by ``row_number`` over (group, field) and the top one kept; Spark's
    window group limit keeps one row per group and task before the shuffle, so a
    group that holds a third of all rows costs no more than any other.

    A field without usable value in the group is null.  Rows with a null key
    column form groups of their own null key; drop them before if they are none.
    Repeated rows count as rows; other columns are ignored, whatever their names.
    """
    ks = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    os = [f"o{i}" for i in range(len(order))]
    rows = df.select(*ks, *[o.alias(n) for o, n in zip(order, os, strict=True)], *[v.alias(f"v{i}") for i, v in enumerate(fields.values())])
    kn = [f"k{i}" for i in range(len(keys))]
    out = rows.groupBy(*kn).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    best = Window.partitionBy(*kn).orderBy(*[F.col(o).asc_nulls_last() for o in os])
    for i in range(len(fields)):
        top = rows.where(F.col(f"v{i}").isNotNull()).withColumn("rn", F.row_number().over(best)).where("rn = 1")
        top = top.select(*[F.col(k).alias(f"{k}_{i}") for k in kn], f"v{i}")
        same = [F.col(k).eqNullSafe(F.col(f"{k}_{i}")) for k in kn]
        out = out.join(top, same, "left").drop(*[f"{k}_{i}" for k in kn])
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"v{i}").alias(f) for i, f in enumerate(fields)])


def best_records(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The whole top row of each group by ``order``: the plain form of the above, all columns kept."""
    w = Window.partitionBy(*keys).orderBy(*[o.asc_nulls_last() for o in order])
    return df.withColumn("_marlstone_rn", F.row_number().over(w)).where("_marlstone_rn = 1").drop("_marlstone_rn")


def quarter_end(date: str) -> Column:
    return F.last_day(F.add_months(F.trunc(date, "quarter"), 2))


def positions(holdings: DataFrame, feeds: DataFrame) -> DataFrame:
    """One record per reported position ``(wficn, rq, cusip8)`` with two or more rows: ``shares``, ``ticker``.

    Recency: filed soonest on or after its own rdate; null or earlier fdate comes
    last and is equal in this.  Trust: lower ``trust_rank``, unknown feed last.
    Tie-break: lower hold_id.  Rows with null rdate, wficn or cusip8 belong to no
    position.  ``feeds`` is a five-row table; it is left to the planner's size check.
    """
    rank = feeds.groupBy("feed").agg(F.min("trust_rank").alias("_rank"))
    h = holdings.select("hold_id", "wficn", "rdate", "fdate", "cusip8", "shares", "ticker", "feed")
    h = h.where("rdate is not null and wficn is not null and cusip8 is not null").join(rank, "feed", "left")
    h = h.withColumn("rq", quarter_end("rdate")).withColumn("cusip8", F.upper(F.substring(F.regexp_replace("cusip8", r"\s+", ""), 1, 8)))
    delay = F.when(F.col("fdate") >= F.col("rdate"), F.datediff("fdate", "rdate"))
    ticker = F.when(~F.trim(F.regexp_replace("ticker", r"\s+", " ")).isin("", "N/A", "-"), F.col("ticker"))
    return golden_records(
        h, ["wficn", "rq", "cusip8"], {"shares": F.when(F.col("shares") > 0, F.col("shares")), "ticker": ticker},
        [delay, F.col("_rank"), F.col("hold_id")],
    )
