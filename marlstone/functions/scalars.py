"""Scalar column functions: dates, guards, identifiers, names, arrays and vectors, all inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = str | Column


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- dates -------------------------------------------------------------------------------------------------------


def quarter_end(d: ColumnLike) -> Column:
    """The last day of the quarter, as a date."""
    return F.last_day(F.add_months(F.trunc(col(d).cast("date"), "quarter"), 2))


def quarter_index(d: ColumnLike) -> Column:
    """Quarters counted through: ``year * 4 + quarter``; neighbours differ by one."""
    return (F.year(d) * 4 + F.quarter(d)).cast("int")


def date_int(d: ColumnLike) -> Column:
    """YYYYMMDD as an int, wide enough not to overflow."""
    c = col(d)
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def filed_within_a_year(filed: ColumnLike, reported: ColumnLike) -> Column:
    """Exact calendar arithmetic on YYYYMMDD ints: a filing of 29 February is in time to 28 February only by its number."""
    return date_int(filed) - date_int(reported) <= 10000


def valid_year(text: ColumnLike, low: int = 1990, high: int = 2035) -> Column:
    """The year of a YYYYMMDD text, null unless it is a real date with a plausible year."""
    d = F.try_to_date(col(text), "yyyyMMdd")
    return F.when(col(text).rlike(r"^\d{8}$") & F.year(d).between(low, high), F.year(d))


def fiscal_year(filed: ColumnLike, form: ColumnLike, percent: ColumnLike) -> Column:
    """The year a block filing stands for: the year before, if filed up to 14 days after New Year, or - passive forms (13G) under 10 % - up to 10 days after 14 February."""
    d = col(filed)
    passive = F.coalesce(col(form).contains("SC 13G") & (col(percent) < 10), F.lit(False))
    limit = F.when(passive, F.date_add(F.make_date(F.year(d), F.lit(2), F.lit(14)), 10)).otherwise(F.date_add(F.make_date(F.year(d), F.lit(1), F.lit(1)), 14))
    return F.when(d <= limit, F.year(d) - 1).otherwise(F.year(d)).cast("int")


def two_digit_year_date(text: ColumnLike, pivot: int = 68) -> Column:
    """``05-Mar-97`` as a date: two-digit years over ``pivot`` are of the last century."""
    d = F.split(F.initcap(col(text)), "-")
    yy = F.try_element_at(d, F.lit(3)).try_cast("int")
    full = F.concat_ws("-", F.try_element_at(d, F.lit(1)), F.try_element_at(d, F.lit(2)), F.when(yy > pivot, 1900 + yy).otherwise(2000 + yy).cast("string"))
    return F.try_to_date(full, "dd-MMM-yyyy")


# --- null rules --------------------------------------------------------------------------------------------------


def sum_known(*cs: ColumnLike) -> Column:
    """Sum of the known terms; null only if none is known."""
    known = F.coalesce(*[col(c).isNotNull().cast("int") * 0 + col(c) for c in cs])
    total = F.lit(0.0)
    for c in cs:
        total = total + F.coalesce(col(c), F.lit(0.0))
    return F.when(known.isNotNull(), total)


def below_or_missing(c: ColumnLike, limit: float) -> Column:
    """Missing sorts below every number."""
    return F.coalesce(col(c) <= limit, F.lit(True))


def ratio(n: ColumnLike, d: ColumnLike) -> Column:
    """Null where the denominator is unknown or not positive; 0 only when measured."""
    return F.when(col(d) > 0, col(n) / col(d))


def clip(c: ColumnLike, low: float, high: float) -> Column:
    """Clipped to [low, high]; null stays null (``greatest`` alone would swallow it)."""
    return F.when(col(c).isNotNull(), F.greatest(F.least(col(c), F.lit(high)), F.lit(low)))


# --- identifiers and names ---------------------------------------------------------------------------------------


def cusip(c: ColumnLike) -> Column:
    """``struct<cusip9, cusip8, cusip6, valid>`` of a raw security number."""
    t = F.upper(F.regexp_replace(col(c), r"\s+", ""))
    ok = t.rlike("^[0-9A-Z*@#]{8,9}$")
    return F.struct(
        F.when(ok & (F.length(t) == 9), t).alias("cusip9"), F.when(ok, F.substring(t, 1, 8)).alias("cusip8"),
        F.when(ok, F.substring(t, 1, 6)).alias("cusip6"), F.coalesce(ok, F.lit(False)).alias("valid"),
    )


LEGAL_FORMS = ["INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LLC", "LTD", "LIMITED", "LP", "LLP", "PLC", "TRUST", "NA"]


def squeeze(c: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


# Patterns of the three ways to bring fund names into one form.
LEGAL_SUFFIX = r"\b(INC|INCORPORATED|LLC|L L C|LP|L P|PLC|CORP|CORPORATION|LTD|LIMITED|N V|NV|S A|CO|COMPANY|THE)\b"
FORMERLY = r"\((FORMERLY|FORMALLY|F/K/A|FKA|PREVIOUSLY|NEE)[^)]*\)"
PARENTHESES = r"\(([^)]*)\)"
ACRONYM_DOT = r"\b([A-Z])\."
AMPERSAND_FOLD = [(r"\bSANDP\b", "S P"), (r"\bS AND P\b", "S P")]
CODE_PREFIX = r"^\s*(?:[0-9]{4,6}|[0-9]{1,4}[A-Za-z]{1,4}[0-9A-Za-z]{0,3}|[A-Za-z]{1,4}[0-9]{1,4}[0-9A-Za-z]{0,3})\s+"
DESIGNATOR = r"\b(?:SERIES|PORTFOLIO|FUND)\s+([A-Z0-9]{1,2})\b\s*$"


def normalize_name(c: ColumnLike, variant: str = "l3b", drop_former: bool = True, drop_code: bool = False) -> Column:
    """A fund's name as upper-case words.

    All variants drop parentheses (former names too; ``l2`` may keep those apart),
    punctuation, legal forms wherever they stand and doubled blanks, and write S&P
    as ``S P``.  ``l2`` folds the ampersand after the legal forms, ``l3`` before,
    ``l3b`` also joins dotted letters (U.S. as US) first.  ``drop_code`` takes a
    leading series code.
    """
    if variant not in ("l2", "l3", "l3b"):
        raise ValueError(f"unknown variant {variant}")
    steps: list[tuple[str, str]] = [(CODE_PREFIX, "")] if drop_code else []
    if drop_former or variant != "l2":
        steps.append((FORMERLY, " "))
    if variant == "l3b":
        steps.append((ACRONYM_DOT, "$1"))
    steps.append((PARENTHESES, " "))
    plain, blanks = (r"[^A-Z0-9]+", " "), (r"\s+", " ")
    if variant == "l2":
        steps += [plain, (LEGAL_SUFFIX, " "), blanks, *AMPERSAND_FOLD]
    else:
        steps += [(r"[^A-Z0-9&]+", " "), *AMPERSAND_FOLD, plain, (LEGAL_SUFFIX, " ")]
    t = F.upper(col(c))
    for pattern, by in steps:
        t = F.regexp_replace(t, pattern, by)
    return squeeze(t)


def simple_name(c: ColumnLike) -> Column:
    """Upper case, letters, digits and single blanks only; a ``&`` is AND; legal forms at the end are dropped."""
    t = F.regexp_replace(F.upper(col(c)), r"\([^)]*\)", " ")
    t = F.regexp_replace(t, r"\s*&\s*", " AND ")
    t = squeeze(F.regexp_replace(F.regexp_replace(t, r"[.']", ""), r"[^A-Z0-9 ]", " "))
    return squeeze(F.regexp_replace(t, r"(?:\s+(?:" + "|".join(LEGAL_FORMS) + r"))+$", ""))


ABBREVIATIONS = {"INTL": "INTERNATIONAL", "FD": "FUND", "FND": "FUND", "GRTH": "GROWTH", "EQTY": "EQUITY", "MGMT": "MANAGEMENT", "MGT": "MANAGEMENT", "BD": "BOND", "CAP": "CAPITAL", "INVT": "INVESTMENT"}


def expand_abbreviations(c: ColumnLike, table: dict[str, str] | None = None) -> Column:
    """Each word that is an abbreviation, spelled out."""
    pairs = F.create_map(*[F.lit(x) for kv in (table or ABBREVIATIONS).items() for x in kv])
    return F.array_join(F.transform(F.split(squeeze(c), " "), lambda w: F.coalesce(F.try_element_at(pairs, w), w)), " ")


def tokens(c: ColumnLike) -> Column:
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")


def digit_tokens(c: ColumnLike) -> Column:
    """Sorted words that hold a digit."""
    return F.array_sort(F.filter(tokens(c), lambda w: w.rlike("[0-9]")))


def designator(c: ColumnLike) -> Column:
    """The one or two characters of a trailing SERIES, PORTFOLIO or FUND designation, else null."""
    d = F.regexp_extract(col(c), DESIGNATOR, 1)
    return F.when(d != "", d)


def family_tokens(c: ColumnLike, stop: Iterable[str], least: int = 4) -> Column:
    """Distinct words of at least ``least`` letters outside the stop set."""
    return F.array_except(F.filter(tokens(c), lambda w: F.length(w) >= least), F.array(*[F.lit(s) for s in stop]))


def split_digits(c: ColumnLike) -> Column:
    """A blank at each boundary of letters and digits."""
    return F.regexp_replace(F.regexp_replace(col(c), r"([A-Za-z])([0-9])", "$1 $2"), r"([0-9])([A-Za-z])", "$1 $2")


def strip_leading(c: ColumnLike, stop: Iterable[str], keep: int = 2) -> Column:
    """Drops leading words of the stop set while at least ``keep`` words remain."""
    ws, stops = tokens(c), F.array(*[F.lit(s) for s in stop])
    first = F.coalesce(F.array_position(F.transform(ws, lambda w: F.array_contains(stops, w)), False), F.lit(0))
    cut = F.when(first == 0, F.size(ws)).otherwise(first.cast("int") - 1)
    cut = F.greatest(F.least(cut, F.size(ws) - keep), F.lit(0))
    return F.array_join(F.slice(ws, cut + 1, F.greatest(F.size(ws) - cut, F.lit(1))), " ")


def char_wb_ngrams(c: ColumnLike, low: int = 2, high: int = 4) -> Column:
    """Character n-grams of each word padded by one blank a side; a word shorter than n gives itself once and no longer n."""

    def of(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        size = F.length(p)
        lengths = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: (n <= size) | (n == F.lit(low)))
        return F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(p, i, n))))

    return F.flatten(F.transform(tokens(F.lower(col(c))), of))


# --- text --------------------------------------------------------------------------------------------------------


def sanitize(c: ColumnLike) -> Column:
    """Tabs and line ends as blanks, so that a field stays one field."""
    return F.translate(col(c), "\t\n\r", "   ")


def html_plain(c: ColumnLike) -> Column:
    """Text without scripts, styles and markup, common entities decoded, blanks squeezed."""
    t = F.regexp_replace(col(c), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^<>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return squeeze(t)


def alnum_probe(c: ColumnLike, width: int = 40) -> Column:
    """The middle ``width`` letters and digits, to look a text up by."""
    t = F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]", "")
    start = F.greatest(F.floor((F.length(t) - width) / 2).cast("int"), F.lit(0)) + 1
    return t.substr(start, F.lit(width))


def phrase_regex(phrase: str) -> str:
    """A pattern that finds a phrase across line ends and hyphens."""
    import re

    return r"(?i)\b" + r"[\s-]+".join(re.escape(w) for w in phrase.split()) + r"\b"


# --- vectors -----------------------------------------------------------------------------------------------------


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: ColumnLike, b: ColumnLike) -> Column:
    """Null where either vector is all zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
