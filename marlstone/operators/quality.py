"""Data-quality matrix, declarations, gates, content hash and frame comparison."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Declaration:
    """What a table's author says of it: its keys, and columns excused from single rules."""

    pk: list[str] = field(default_factory=list)
    event: list[str] = field(default_factory=list)
    sparse: list[str] = field(default_factory=list)
    freetext: list[str] = field(default_factory=list)
    constant: list[str] = field(default_factory=list)


def declaration(text: str) -> Declaration:
    """Reads ``pk: a, b; event: c; sparse: x; freetext: y; constant: z``; an unknown word or a repeated one is an error."""
    out, seen = Declaration(), set()
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, colon, rest = part.partition(":")
        name = name.strip().lower()
        if not colon or name not in Declaration.__dataclass_fields__ or name in seen:
            raise ValueError(f"not a declaration: {part!r}")
        seen.add(name)
        setattr(out, name, [c.strip() for c in rest.split(",") if c.strip()])
    return out


@dataclass
class Coverage:
    column: str | None
    first: str
    last: str


def coverage_window(text: str) -> Coverage:
    """Reads ``[column:]2020-01-01..2024-12-31``."""
    m = re.fullmatch(r"\s*(?:([A-Za-z_]\w*)\s*:)?\s*(\d{4}-\d{2}-\d{2})\s*\.\.\s*(\d{4}-\d{2}-\d{2})\s*", text)
    if not m or m.group(2) > m.group(3):
        raise ValueError(f"not a window: {text!r}")
    return Coverage(m.group(1), m.group(2), m.group(3))


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: ``column, n, nulls, n_unique`` (a null counts as one value).

    Counting distinct values of every column at once shuffles each row once a
    column.  Where only one value or more matters, not ``exact`` tells 0, 1 and 2
    (two or more) by the least and greatest value, in one partial aggregation.
    """
    plain = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct")]
    aggs = [F.count("*").alias("_n")]
    for i, c in enumerate(plain):
        aggs += [F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"_z{i}"), (F.countDistinct(F.col(f"`{c}`")) if exact else _few(F.col(f"`{c}`"))).alias(f"_u{i}")]
    one = df.agg(*aggs)
    rows = [
        F.struct(F.lit(c).alias("column"), F.col("_n").alias("n"), F.coalesce(f"_z{i}", F.lit(0)).alias("nulls"), (F.col(f"_u{i}") + (F.coalesce(f"_z{i}", F.lit(0)) > 0).cast("long")).alias("n_unique"))
        for i, c in enumerate(plain)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _few(c: Column) -> Column:
    return F.when(F.min(c).isNull(), 0).when(F.min(c) == F.max(c), 1).otherwise(2).cast("long")


def constant_columns(df: DataFrame, d: Declaration) -> DataFrame:
    """DQ1: columns of at most one value, unless declared constant and never null."""
    p = column_profile(df, exact=False).where("n_unique <= 1")
    return p.where(~(F.col("column").isin(d.constant or [""]) & (F.col("nulls") == 0))).select("column", "n_unique")


def null_columns(df: DataFrame, d: Declaration, share: float = 0.5) -> DataFrame:
    """DQ2: columns null in more than ``share`` of the rows, unless declared sparse."""
    p = column_profile(df, exact=False).where(F.col("nulls") > share * F.col("n"))
    return p.where(~F.col("column").isin(d.sparse or [""])).select("column", F.round(F.col("nulls") / F.col("n"), 6).alias("null_share"))


def grain(df: DataFrame, d: Declaration) -> DataFrame:
    """DQ3: rows in repeated primary keys (all copies), rows that repeat exactly, event keys seen more than once."""
    rows = []
    if d.pk:
        g = df.groupBy(*d.pk).agg(F.count("*").alias("n")).where("n > 1")
        rows.append(g.agg(F.lit("DQ3a").alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("bad")))
    whole = df.groupBy(F.xxhash64(*df.columns).alias("h"), F.sha2(F.to_json(F.struct(*df.columns)), 256).alias("s")).agg(F.count("*").alias("n")).where("n > 1")
    rows.append(whole.agg(F.lit("DQ3b").alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("bad")))
    if d.event:
        g = df.groupBy(*d.event).agg(F.count("*").alias("n")).where("n > 1")
        rows.append(g.agg(F.lit("DQ3c").alias("rule"), F.count("*").alias("bad")))
    return reduce(DataFrame.unionByName, rows)


def wordy_columns(df: DataFrame, d: Declaration, share: float = 0.9) -> DataFrame:
    """DQ5: string columns outside the keys, with values almost as many as rows, unless declared free text."""
    strings = [f.name for f in df.schema if f.dataType.typeName() == "string" and f.name not in {*d.pk, *d.event, *d.freetext}]
    p = column_profile(df.select(*strings)) if strings else column_profile(df).where("false")
    return p.where(F.col("n_unique") > share * F.col("n")).select("column", "n_unique")


def covers(df: DataFrame, w: Coverage) -> DataFrame:
    """COV: one row with ``status`` and ``reason``; without a named column the only date-like one is taken, several are a failure."""
    dates = [f.name for f in df.schema if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz")]
    c = w.column or (dates[0] if len(dates) == 1 else None)
    if c is None or c not in df.columns:
        why = "ambiguous" if len(dates) > 1 and w.column is None else "absent"
        return df.sparkSession.range(1).select(F.lit("FAIL").alias("status"), F.lit(why).alias("reason"))
    d = F.col(c).cast("string").try_cast("date") if c not in dates else F.col(c).cast("date")
    lo, hi = F.lit(w.first).cast("date"), F.lit(w.last).cast("date")
    m = df.agg(F.min(d).alias("a"), F.max(d).alias("b"))
    bad = F.when(F.col("a").isNull(), "all_null").when(F.col("a") > lo, "starts_late").when(F.col("b") < hi, "ends_early")
    return m.select(F.when(bad.isNull(), "PASS").otherwise("FAIL").alias("status"), bad.alias("reason"))


#: Rules a program cannot decide: listed as such, never as passed.
JUDGED = ["DQ4", "DQ6", "SEM1", "SEM2", "SEM3"]


def matrix(df: DataFrame, d: Declaration, window: Coverage | None = None) -> DataFrame:
    """``rule, status, detail`` with a line for every rule, also for those that need a judgement or do not apply."""

    def verdict(rule: str, bad: DataFrame, col: str) -> DataFrame:
        got = bad.agg(F.array_join(F.array_sort(F.collect_set(F.col(col).cast("string"))), ",").alias("detail"))
        return got.select(F.lit(rule).alias("rule"), F.when(F.col("detail") == "", "PASS").otherwise("FAIL").alias("status"), "detail")

    lines = [verdict("DQ1", constant_columns(df, d), "column"), verdict("DQ2", null_columns(df, d), "column"), verdict("DQ5", wordy_columns(df, d), "column")]
    g = grain(df, d)
    lines.append(g.select("rule", F.when(F.col("bad") == 0, "PASS").otherwise("FAIL").alias("status"), F.col("bad").cast("string").alias("detail")))
    if window:
        lines.append(covers(df, window).select(F.lit("COV").alias("rule"), "status", F.coalesce("reason", F.lit("")).alias("detail")))
    spark = df.sparkSession
    missing = [r for r, on in (("DQ3a", d.pk), ("DQ3c", d.event), ("COV", window)) if not on]
    fixed = [(r, "MODEL-EVALUATED", "needs a judgement") for r in JUDGED] + [(r, "N/A", "not declared") for r in missing]
    empty = df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("ROWS").alias("rule"), F.lit("FAIL").alias("status"), F.lit("no rows").alias("detail"))
    return reduce(DataFrame.unionByName, [*lines, spark.createDataFrame(fixed, "rule string, status string, detail string"), empty])


def declaration_gaps(report: DataFrame) -> DataFrame:
    """Which declaration would cure each failure of a :func:`matrix` report."""
    word = F.when(F.col("rule") == "DQ1", "constant").when(F.col("rule") == "DQ2", "sparse").when(F.col("rule") == "DQ5", "freetext")
    return report.where("status = 'FAIL'").select("rule", F.coalesce(word, F.lit("none: the data must change")).alias("cure"), "detail")


# --- gates -------------------------------------------------------------------------------------------------------


def prerequisites(frames: dict[str, DataFrame], parts: dict[str, tuple[Column, list]] | None = None) -> DataFrame:
    """``table, problem``: empty inputs, and declared partitions without rows; empty where all is well."""
    out = []
    for name, df in frames.items():
        out.append(df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(name).alias("table"), F.lit("empty").alias("problem")))
        if parts and name in parts:
            c, wanted = parts[name]
            have = df.select(c.alias("part")).distinct()
            want = df.sparkSession.createDataFrame([(w,) for w in wanted], have.schema)
            out.append(want.join(have, "part", "left_anti").select(F.lit(name).alias("table"), F.concat(F.lit("missing part "), F.col("part").cast("string")).alias("problem")))
    return reduce(DataFrame.unionByName, out)


def orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Universe gate: child keys without a parent, with their rows; must be empty."""
    return child.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("n_rows")).join(parent.select(on), on, "left_anti")


def denominators(df: DataFrame, a: str, b: str) -> DataFrame:
    """How far two denominators part, counted in both directions."""
    n = lambda c: F.count(F.when(c, 1))
    x, y = F.col(a), F.col(b)
    return df.where((x > 0) & (y > 0)).agg(
        F.count("*").alias("n"), n(x > y * 1.1).alias("a_over_10pct"), n(y > x * 1.1).alias("b_over_10pct"), n(x > y * 3).alias("a_over_3x"), n(y > x * 3).alias("b_over_3x")
    )


def closed_vocabulary(df: DataFrame, column: str, declared: list[str]) -> DataFrame:
    """Labels seen but not declared, with counts."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(declared)).groupBy(column).agg(F.count("*").alias("n"))


# --- content hash and comparison -----------------------------------------------------------------------------------


def rendered(df: DataFrame, c: str) -> Column:
    """A cell as text: doubles at 12 significant digits, null and NaN alike empty, booleans 1 and 0."""
    kind = df.schema[c].dataType.typeName()
    x = F.col(f"`{c}`")
    if kind in ("double", "float"):
        d = x.cast("double")
        # Digits of the mantissa, then the exponent: equal for values that differ beyond the 12th digit only.
        e = F.floor(F.log10(F.abs(d))).cast("int")
        m = F.round(d / F.pow(F.lit(10.0), e.cast("double")), 11)
        e, m = F.when(F.abs(m) >= 10, e + 1).otherwise(e), F.when(F.abs(m) >= 10, m / 10).otherwise(m)
        return F.when(x.isNull() | F.isnan(x), "").when(d == 0, "0").otherwise(F.concat(m.cast("decimal(14,11)").cast("string"), F.lit("e"), e.cast("string")))
    if kind == "boolean":
        return F.coalesce(x.cast("int").cast("string"), F.lit(""))
    return F.coalesce(x.cast("string"), F.lit(""))


def content_hash(df: DataFrame) -> DataFrame:
    """``rows, digest``: the same under any order of rows and columns.

    Each row's cells, in the order of their names, give one SHA-256; its four 64-bit
    parts are summed over all rows, and the sums and the count hashed.  A sum takes
    no order and combines before the shuffle, so no task holds more than one row.
    """
    names = sorted(df.columns)
    row = F.sha2(F.concat_ws("\x1f", *[F.concat(F.lit(n + "="), rendered(df, n)) for n in names]), 256)
    part = lambda i: F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = df.select(row.alias("h")).agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(part(i)), F.lit(0)).alias(f"s{i}") for i in range(4)])
    return sums.select("rows", F.sha2(F.concat_ws(",", "rows", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("digest"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: ``column, nulls, total, low, high, n_unique`` as text, to localise a mismatch."""
    aggs, rows = [], []
    for i, f in enumerate(df.schema):
        x = F.col(f"`{f.name}`")
        number = f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")
        x = F.when(F.isnan(x), None).otherwise(x) if f.dataType.typeName() in ("double", "float") else x
        if f.dataType.typeName() in ("array", "map", "struct"):
            continue
        aggs += [F.count(F.when(x.isNull(), 1)).alias(f"_z{i}"), F.countDistinct(x).alias(f"_u{i}"), F.min(x).alias(f"_a{i}"), F.max(x).alias(f"_b{i}")]
        total = F.lit(None).cast("double")
        if number:
            aggs.append(F.sum(x.cast("double")).alias(f"_s{i}"))
            total = F.round(f"_s{i}", 6)
        rows.append(
            F.struct(F.lit(f.name).alias("column"), F.col(f"_z{i}").alias("nulls"), total.alias("total"), F.col(f"_a{i}").cast("string").alias("low"), F.col(f"_b{i}").cast("string").alias("high"), F.col(f"_u{i}").alias("n_unique"))
        )
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def profile_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns whose profiles differ, and in what."""
    x, y = (p.select("column", *[F.col(c).alias(c + s) for c in ("nulls", "total", "low", "high", "n_unique")], F.lit(True).alias("in" + s)) for p, s in ((profile(a), "_a"), (profile(b), "_b")))
    j = x.join(y, "column", "full")
    what = [F.when(~F.col(c + "_a").eqNullSafe(F.col(c + "_b")), c) for c in ("nulls", "total", "low", "high", "n_unique")]
    parts = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").otherwise(F.concat_ws(",", *what))
    return j.select("column", parts.alias("differs")).where("differs != ''")


def compare_on(a: DataFrame, b: DataFrame, key: list[str], rtol: float = 1e-9) -> DataFrame:
    """Per column: rows of either side alone, and cells of common keys that differ (doubles beyond ``rtol``)."""
    cols = [c for c in a.columns if c in b.columns and c not in key]
    j = a.select(*key, *[F.col(c).alias("a_" + c) for c in cols], F.lit(1).alias("_a")).join(
        b.select(*key, *[F.col(c).alias("b_" + c) for c in cols], F.lit(1).alias("_b")), key, "full"
    )
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def differs(c: str) -> Column:
        x, y = F.col("a_" + c), F.col("b_" + c)
        if a.schema[c].dataType.typeName() in ("double", "float"):
            near = F.abs(x - y) <= rtol * F.greatest(F.abs(x), F.abs(y))
            return both & ~F.coalesce(near, x.isNull() & y.isNull())
        return both & ~x.eqNullSafe(y)

    out = j.agg(
        F.count(F.when(F.col("_b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("_a").isNull(), 1)).alias("only_b"), *[F.count(F.when(differs(c), 1)).alias("d_" + c) for c in cols]
    )
    lines = [F.struct(F.lit(c).alias("column"), F.col("only_a"), F.col("only_b"), F.col("d_" + c).alias("differing")) for c in cols]
    return out.select(F.explode(F.array(*lines)).alias("r")).select("r.*")
