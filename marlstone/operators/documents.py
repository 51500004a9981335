"""Document extraction: bytes to typed rows, a manifest with zero-row documents, and declarative field profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import filings as K
from marlstone.operators.text import per_text

SCHEMAS = {
    "holdings_13f": "issuer string, title string, cusip string, value double, shares double, kind string, discretion string, sole double, mode string",
    "votes_npx": "issuer string, cusip string, meeting_date string, proposal string, how_voted string, shares_voted double, management string",
    "ownership": "table_index int, row_index int, holder string, shares double, percent double, parser string",
    "people": "seq int, name string, age int, position string, is_ceo boolean",
    "submission_documents": "doc_type string, sequence int, filename string, body string",
    "header_roles": "accession string, form_type string, filed_date string, role string, cik string",
    "series_classes": "series_id string, series_name string, class_id string, class_name string, ticker string",
    "form4": "issuer_cik string, ticker string, owner_cik string, owner string, is_director boolean",
}


def extract(df: DataFrame, keep: list[str], text: str, kind: str) -> DataFrame:
    """Rows of one kernel of :mod:`marlstone.functions.filings` for every document, with its ``keep`` columns."""
    return per_text(df, keep, [text], SCHEMAS[kind], getattr(K, kind))


def manifest(documents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """One line per document, also of those that gave no row."""
    n = rows.groupBy(key).agg(F.count("*").alias("n_rows"))
    out = documents.select(key).join(n, key, "left").fillna(0, ["n_rows"])
    return out.withColumn("parse_status", F.when(F.col("n_rows") > 0, "ok").otherwise("zero_rows"))


@dataclass
class Field:
    """A field of a profile: a pattern with one group, a transform of the match and how several matches become one."""

    name: str
    pattern: str
    reduce: str = "first"  # first, last or max
    cast: str = "string"


def scan_profile(df: DataFrame, keep: list[str], text: str, fields: list[Field], head_chars: int | None = None, only: Column | None = None) -> DataFrame:
    """Declared fields of each document, inside the JVM; ``only`` prefilters cheaply, ``head_chars`` limits where a header field can stand."""
    d = df.where(only) if only is not None else df
    t = F.substring(F.col(text), 1, head_chars) if head_chars else F.col(text)
    d = d.select(*keep, t.alias("_t"))

    def value(f: Field) -> Column:
        hits = F.transform(F.regexp_extract_all("_t", F.lit(f.pattern), F.lit(1)), lambda h: F.replace(h, F.lit(","), F.lit("")).try_cast(f.cast) if f.cast != "string" else h)
        return {"first": F.try_element_at(hits, F.lit(1)), "last": F.try_element_at(hits, F.lit(-1)), "max": F.array_max(hits)}[f.reduce].alias(f.name)

    return d.select(*keep, *[value(f) for f in fields])


def block_type(item12: str, form: str, files_13f: str) -> Column:
    """individual, active (13D) or passive (13G) institution, or other: by the filer's kind, the form kept, and whether the filer reports holdings on 13F."""
    reports = F.coalesce(F.col(files_13f).cast("boolean"), F.lit(False))
    kind = F.when(reports & F.contains(F.col(form), F.lit("13D")), "active").when(reports & F.contains(F.col(form), F.lit("13G")), "passive")
    return F.when(F.col(item12) == "in", "individual").otherwise(F.coalesce(kind, F.lit("other")))


def gap_fill(df: DataFrame, keys: list[str], year: str, steps: tuple[int, ...] = (4, 3, 2)) -> DataFrame:
    """Missing interior years between two of a holder's years at most ``max(steps)`` apart, with the earlier row's values."""
    w = Window.partitionBy(*keys).orderBy(year)
    nxt = F.lead(year).over(w)
    gap = nxt - F.col(year)
    d = df.withColumn("_gap", F.when(gap.isin(list(steps)), gap).otherwise(F.lit(1)))
    filled = d.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_gap").cast("int") - 1)))
    return filled.withColumn(year, (F.col(year) + F.col("_i")).cast(df.schema[year].dataType)).withColumn("filled", F.col("_i") > 0).drop("_gap", "_i")


def insider_maximum(df: DataFrame, keys: list[str], shares: str, outstanding_thousands: str, least: float = 5.0) -> DataFrame:
    """Per company and person the largest percentage held, over ``least``."""
    pct = F.try_divide(100 * F.col(shares), 1000 * F.col(outstanding_thousands))
    return df.groupBy(*keys).agg(F.max(pct).alias("percent")).where(F.col("percent") > least)
