"""Panels composed of the other operators, on generic roles: entity, holder, period, measure, denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators.aggregates import hhi
from marlstone.operators.joins import small
from marlstone.operators.windows import change_flag, neighbourhood, report_markers


def ownership(holdings: DataFrame, denominators: DataFrame) -> DataFrame:
    """Institutional ownership per entity and quarter.

    ``holdings``: ``holder, entity, date, measure``; ``denominators``: ``entity,
    total``.  Holdings are reduced to (holder, entity, quarter) once; owners, sum,
    concentration, entrants, leavers, change of breadth and the ratio follow from
    that, the ratio null where the total is not positive, never 0 for unknown.
    """
    known = holdings.where("measure > 0 and holder is not null and entity is not null and date is not null").withColumn("q", S.quarter_index("date"))
    h = known.groupBy("holder", "entity", "q").agg(F.sum("measure").alias("measure"))
    # Entry and exit over all a holder reports: one row per holder and quarter, whatever the number of entities.
    marks = report_markers(h, "holder", "q")
    p = h.join(marks, ["holder", "q"]).groupBy("entity", "q").agg(
        F.count("*").alias("numowners"), F.sum("measure").alias("io_total"), hhi("measure").alias("ioc_hhi"), F.count_if("is_first").alias("newinst"),
        F.count_if("is_last").alias("oldinst"), F.max("n_holders").alias("_n"),
    )
    e = Window.partitionBy("entity").orderBy("q")
    stay = (F.col("numowners") - F.col("newinst")) - F.lag(F.col("numowners") - F.col("oldinst")).over(e)
    out = p.withColumn("dbreadth", F.try_divide(stay, F.lag("_n").over(e))).drop("_n").join(denominators, "entity", "left")
    period = F.last_day(F.make_date(F.expr("(q - 1) div 4").cast("int"), F.expr("((q - 1) % 4) * 3 + 3").cast("int"), F.lit(1)))
    return out.withColumn("period", period).withColumn("ior", S.ratio("io_total", "total"))


def ownership_flags(panel: DataFrame) -> DataFrame:
    """Marks quarters at, before and after a change of the owners' count by half or more."""
    w = Window.partitionBy("entity").orderBy("q")
    p = panel.withColumn("_jump", F.abs(F.try_divide("numowners", F.lag("numowners").over(w)) - 1) >= 0.5)
    return neighbourhood(change_flag(p, ["entity"], "q", "numowners", "owners_changed"), ["entity"], "q", "_jump", "near_jump").drop("_jump")


def vote_cells(cells: DataFrame, universe: DataFrame, lookup: DataFrame) -> DataFrame:
    """Votes per item and block: ``cells`` of items in the universe, blocks renamed by a small lookup, unknown ones ``__unlinked__``."""
    c = cells.join(universe, "item", "left_semi").join(small(lookup), "block", "left").withColumn("group", F.coalesce("group", F.lit("__unlinked__")))
    known = F.count("weight")
    return c.groupBy("item", "group").agg(
        F.sum("n_for").alias("n_for"), F.sum("n_against").alias("n_against"), F.sum("n_abstain").alias("n_abstain"), F.when(known > 0, F.sum("weight")).alias("weight"),
        F.count_if(F.col("weight").isNull()).alias("n_no_weight"),
    )


def meetings(items: DataFrame, low: float = 0.0, high: float = 120.0) -> DataFrame:
    """Voted items with turnout clipped to 0..100 (rows beyond ``high`` dropped), the issuer's mean, and a tri-state contested flag."""
    m = items.where(F.col("turnout").isNull() | (F.col("turnout") <= high)).withColumn("turnout", S.clip("turnout", low, 100.0))
    mean = F.avg("forpct").over(Window.partitionBy("permno"))
    return m.withColumn("mean_for", mean).withColumn("close", F.when(F.col("forpct").isNotNull(), F.abs(F.col("forpct") - 50) <= 10))


def pivotal(panel: DataFrame, pct: float) -> Column:
    """True, false or unknown: whether the vote was within ``pct`` of one half."""
    return F.when(F.col("forpct").isNotNull(), F.abs(F.col("forpct") - 50) <= pct)


def merged(panel: DataFrame, cells: DataFrame) -> DataFrame:
    """The panel with its cells; items without votes get measured zeros and the label ``no_votes``, shares stay null on empty sums."""
    j = panel.join(cells, "item", "left").withColumn("votes", F.when(F.col("group").isNull(), "no_votes").otherwise("votes")).fillna(0, ["n_for", "n_against", "n_abstain"])
    total = F.col("n_for") + F.col("n_against") + F.col("n_abstain")
    return j.withColumn("for_frac", S.ratio("n_for", total)).withColumn("against_frac", S.ratio("n_against", total))


def short_interest(reports: DataFrame, links: DataFrame) -> DataFrame:
    """The latest report in each quarter of linked codes: ``reports``: ``code, date, shares``; ``links``: ``code, entity, start, end``."""
    r = reports.join(links, "code").where(F.col("date").between(F.col("start"), F.coalesce("end", F.lit("2099-12-31").cast("date"))))
    return r.groupBy("entity", S.quarter_end("date").alias("period")).agg(F.max_by("shares", F.struct("date", "shares")).alias("shares"), F.max("date").alias("as_of"))


def extend_links(links: DataFrame, id_: str, last: str, until: Column) -> DataFrame:
    """Each id's last link repeated for every quarter up to ``until``: ``quarter`` is its end."""
    top = links.where(F.col(last).isNotNull()).groupBy(id_).agg(F.max_by(F.struct(*links.columns), F.struct(last, *[c for c in links.columns if c not in (id_, last)])).alias("r")).select("r.*")
    first = F.add_months(F.trunc(F.col(last), "quarter"), 3)
    qs = F.when(first <= until, F.sequence(first, until, F.expr("interval 3 months")))
    return top.withColumn("_q", F.explode(qs)).withColumn("quarter", S.quarter_end("_q")).drop("_q")


def cohort(events: DataFrame, user: str, at: str, starts: Column) -> DataFrame:
    """Users by month of their first start and months since: how many were active."""
    month = F.trunc(F.col(at).cast("date"), "month")
    first = events.where(starts).groupBy(user).agg(F.min(month).alias("cohort"))
    active = events.select(user, month.alias("m")).distinct().join(first, user).where("m >= cohort")
    return active.groupBy("cohort", F.months_between("m", "cohort").cast("int").alias("months")).agg(F.count("*").alias("users"))


def funnel(events: DataFrame, user: str, at: str, kind: str, steps: list[str]) -> DataFrame:
    """Users that took each step after the one before, and the conversion from it."""
    # A user's step counts from the first time it comes at or after the step before: one ordered pass with a running state, no self-join.
    only = events.where(F.col(kind).isin(steps) & F.col(user).isNotNull() & F.col(at).isNotNull()).select(F.col(user).alias("u"), F.col(at).alias("t"), F.col(kind).alias("k"))
    reached = only
    w = Window.partitionBy("u")
    for i, s in enumerate(steps):
        after = F.lit(True) if i == 0 else F.col("t") >= F.col(f"t{i - 1}")
        reached = reached.withColumn(f"t{i}", F.min(F.when((F.col("k") == s) & after, F.col("t"))).over(w))
    users = reached.groupBy("u").agg(*[F.first(f"t{i}").alias(f"t{i}") for i in range(len(steps))])
    firsts = [users.where(f"t{i} is not null") for i in range(len(steps))]
    out = None
    for i, (s, f) in enumerate(zip(steps, firsts, strict=True)):
        n = f.agg(F.count("*").alias("users")).select(F.lit(i + 1).alias("step"), F.lit(s).alias("event"), "users")
        out = n if out is None else out.unionByName(n)
    prev = F.lag("users").over(Window.partitionBy(F.lit(1)).orderBy("step"))  # one row a step
    return out.withColumn("conversion", F.round(F.try_divide("users", prev), 6))
