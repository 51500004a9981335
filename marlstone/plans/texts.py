"""Document-extraction and text-analytics queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import filings as FK
from marlstone.functions import style as K
from marlstone.operators import documents as D
from marlstone.operators import text as X
from marlstone.plans.panels import block_form, block_item12
from marlstone.plans.registry import Registry

R = Registry()


def _docs(t):
    return t("documents").select("doc_id", "text", "source", "cik", "accession", "filed_date")


# --- documents ---------------------------------------------------------------------------------------------------

_HOLD = r"(?m)^\s*(\S.*?)\s{2,}(COM|CL A|CL B|ORD|SPONSORED ADR)\s{2,}([0-9A-Z]{8,9})\s+"


@R.on("doc_13f")
def _(t):
    return D.extract(_docs(t), ["doc_id"], "text", "holdings_13f")


@R.on("doc_npx")
def _(t):
    """Votes of XML proxy tables; the test texts hold none, fixtures cover it."""
    return D.extract(_docs(t), ["doc_id"], "text", "votes_npx")


@R.on("doc_def14a_own")
def _(t):
    return D.extract(_docs(t), ["doc_id"], "text", "ownership")


@R.on("doc_s1_mgmt")
def _(t):
    return D.extract(_docs(t), ["doc_id"], "text", "people")


@R.on(
    "doc_scan_profile",
    """SELECT doc_id, nullif(regexp_extract(text, 'record date there were ([0-9,]+) shares', 1), '') AS record_shares,
       list_max(list_transform(regexp_extract_all(text, '\\$([0-9,]+)', 1), lambda x: TRY_CAST(replace(x, ',', '') AS BIGINT))) AS largest_amount,
       regexp_extract_all(text, '\\b(20[0-9]{2})\\b', 1)[-1] AS last_year FROM documents WHERE contains(text, 'shares')""",
)
def _(t):
    fields = [D.Field("record_shares", r"record date there were ([0-9,]+) shares"), D.Field("largest_amount", r"\$([0-9,]+)", "max", "bigint"), D.Field("last_year", r"\b(20[0-9]{2})\b", "last")]
    return D.scan_profile(_docs(t), ["doc_id"], "text", fields, only=F.contains("text", F.lit("shares")))


@R.on("doc_scan_headers", "SELECT doc_id, upper(regexp_extract(text, 'Series (S[0-9]{9})', 1)) AS series_id, regexp_extract(text, 'class (S[0-9]{9})', 1) AS class_id FROM documents WHERE regexp_matches(text, 'Series S[0-9]{9}; class S[0-9]{9}')")
def _(t):
    d = _docs(t).where(F.col("text").rlike(r"Series S[0-9]{9}; class S[0-9]{9}"))
    return d.select("doc_id", F.upper(F.regexp_extract("text", r"Series (S[0-9]{9})", 1)).alias("series_id"), F.regexp_extract("text", r"class (S[0-9]{9})", 1).alias("class_id"))


@R.on("doc_sec_index")
def _(t):
    """Role rows of submission headers built from the table's own columns."""
    head = F.concat(F.lit("ACCESSION NUMBER:\t"), "accession", F.lit("\nCONFORMED SUBMISSION TYPE:\tDEF14A\nFILED AS OF DATE:\t"), F.date_format("filed_date", "yyyyMMdd"), F.lit("\nFILER:\n\tCENTRAL INDEX KEY:\t"), "cik", F.lit("\n</SEC-HEADER>\n"), F.coalesce("text", F.lit("")))
    return D.extract(_docs(t).withColumn("text", head), ["doc_id"], "text", "header_roles")


@R.on("doc_13dg_percent")
def _(t):
    return X.per_text(_docs(t), ["doc_id"], ["text"], "percent double", lambda s: [{"percent": FK.percent_of_class(s)}])


@R.on(
    "doc_block_type",
    r"""WITH o AS (SELECT own_row, CASE WHEN is_group_row OR regexp_matches(upper(holder_name), '\b(?:INC|LLC|LP|L\.P|LTD|MANAGEMENT|MGMT|MGT|ADVISORS|ADVS?|PARTNERS|FUNDS?)\b') THEN 'ia' ELSE 'in' END AS item12,
        CASE WHEN percent < 10 THEN 'SC 13G' ELSE 'SC 13D' END AS form, table_index % 3 <> 0 AS files FROM own_rows)
        SELECT own_row, CASE WHEN item12 = 'in' THEN 'individual' WHEN coalesce(files, false) AND form LIKE '%13D%' THEN 'active' WHEN coalesce(files, false) AND form LIKE '%13G%' THEN 'passive' ELSE 'other' END AS kind FROM o""",
)
def _(t):
    o = t("own_rows").select("own_row", block_item12().alias("item12"), block_form().alias("form"), (F.col("table_index") % 3 != 0).alias("files"))
    return o.select("own_row", D.block_type("item12", "form", "files").alias("kind"))


@R.on(
    "doc_gap_fill",
    """WITH y AS (SELECT DISTINCT cik, CAST(year(filing_date) AS INTEGER) AS y FROM own_rows WHERE filing_date IS NOT NULL), g AS (SELECT *, lead(y) OVER (PARTITION BY cik ORDER BY y) - y AS gap FROM y)
       SELECT cik, CAST(y + i AS INTEGER) AS y, i > 0 AS filled FROM (SELECT *, unnest(range(0, CASE WHEN gap IN (2, 3, 4) THEN gap ELSE 1 END)) AS i FROM g)""",
)
def _(t):
    y = t("own_rows").where("filing_date is not null").select("cik", F.year("filing_date").alias("y")).distinct()
    return D.gap_fill(y, ["cik"], "y")


@R.on(
    "doc_rule_classify",
    r"""WITH k AS (SELECT doc_id, text, (SELECT count(*) FROM (SELECT unnest(['class\s+a\s+common', 'class\s+b\s+common', 'ten\s+votes\s+per\s+share', 'one\s+vote\s+per\s+share', 'super-?voting', 'dual[- ]class']) AS p)
            WHERE regexp_matches(text, '(?i)' || p)) AS n FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, n >= 2 OR (n = 1 AND regexp_matches(text, '(?i)(\b(ten|10|twenty|20|multiple)\s+votes\b)|votes?\s+per\s+share')) AS dual FROM k""",
)
def _(t):
    return X.per_text(_docs(t), ["doc_id"], ["text"], "dual boolean", lambda s: [{"dual": FK.dual_class(s)}])


@R.on("doc_form4")
def _(t):
    """Ownership forms written from the persons table and read back."""
    xml = F.concat(
        F.lit("<?xml version='1.0'?><ownershipDocument><issuer><issuerCik>"), "cik", F.lit("</issuerCik></issuer><reportingOwner><rptOwnerCik>"), F.col("person_row").cast("string"),
        F.lit("</rptOwnerCik><isDirector>"), F.when(F.contains("position", F.lit("Director")), "1").otherwise("0"), F.lit("</isDirector></reportingOwner></ownershipDocument>"),
    )
    return D.extract(t("s1_persons").select("person_row", xml.alias("text")), ["person_row"], "text", "form4")


@R.on("doc_insider_max", "SELECT company, holder_name, round(max(100 * shares / (1000 * 2000.0)), 6) AS percent FROM own_rows WHERE holder_name IS NOT NULL GROUP BY 1, 2 HAVING max(100 * shares / (1000 * 2000.0)) > 5")
def _(t):
    o = t("own_rows").where("holder_name is not null").withColumn("out", F.lit(2000.0))
    return D.insider_maximum(o, ["company", "holder_name"], "shares", "out").withColumn("percent", F.round("percent", 6))


@R.on("doc_fulltext", "SELECT doc_id, substr(text, CAST(greatest(strpos(lower(text), 'burn rate') - 40, 1) AS BIGINT), 89) AS snippet FROM documents WHERE contains(lower(text), 'burn rate')")
def _(t):
    return X.full_text(_docs(t), "text", "burn rate").select("doc_id", "snippet")


@R.on("snk_manifest")
def _(t):
    return D.manifest(t("documents"), D.extract(_docs(t), ["doc_id"], "text", "ownership"), "doc_id")


# --- text --------------------------------------------------------------------------------------------------------


@R.on("txt_normalize")
def _(t):
    return X.per_text(_docs(t), ["doc_id"], ["text"], "plain string", lambda s: [{"plain": K.normalize(s)}])


@R.on("txt_sentences")
def _(t):
    return X.per_text(_docs(t), ["doc_id"], ["text"], "seq int, sentence string", lambda s: [{"seq": i, "sentence": x} for i, x in enumerate(K.sentences(K.normalize(s)))])


@R.on("txt_features")
def _(t):
    return X.features(_docs(t), ["doc_id"], "text")


@R.on("txt_windows")
def _(t):
    return X.window_features(_docs(t), ["doc_id"], "text").select("doc_id", "unit", "n_words", "n_sents", F.round("sent_len_cv", 6).alias("sent_len_cv"))


@R.on("txt_score")
def _(t):
    """Against the statistics of proxy statements."""
    stats = X.reference_stats(_docs(t).where("source = 'def14a'"), "text")
    return X.scores(_docs(t), ["doc_id"], "text", stats).withColumn("score", F.round("score", 4))


@R.on("txt_lint")
def _(t):
    return X.per_text(_docs(t), ["doc_id"], ["text"], "line int, kind string, excerpt string", lambda s: [{"line": a, "kind": b, "excerpt": c} for a, b, c in K.lint(s)])


@R.on("txt_false_precision")
def _(t):
    return X.per_text(_docs(t), ["doc_id"], ["text"], "pos int, figure string", lambda s: [{"pos": a, "figure": b} for a, b in K.false_precision(s)])


_PATTERNS = {"committee": r"\w+ committee", "record": r"record date", "comp": r"compensation committee", "board": r"the board"}


@R.on("txt_pattern_audit")
def _(t):
    return X.pattern_hits(_docs(t), ["doc_id"], "text", _PATTERNS)


@R.on("txt_span_collapse")
def _(t):
    return X.collapse(X.pattern_hits(_docs(t), ["doc_id"], "text", _PATTERNS), ["doc_id"])


def _quotes(t):
    """Of every text that is not empty a quote from its middle, of a sixth of it and at most 80 characters a part: as it stands, with an elision, or with the parts turned round."""
    d = _docs(t).where("length(text) > 0").withColumn("n", F.length("text")).withColumn("k", F.expr("least(greatest(n div 6, 1), 80)").cast("int"))
    a, b = F.expr("substring(text, cast(n div 3 as int) + 1, k)"), F.expr("substring(text, cast(n div 2 as int) + k + 1, k)")
    q = F.when(F.col("doc_id") % 3 == 0, a).when(F.col("doc_id") % 3 == 1, F.concat(a, F.lit(" ... "), b)).otherwise(F.concat(b, F.lit(" ... "), a))
    return d.select("doc_id", "text", q.alias("quote"))


@R.on("txt_quote_match")
def _(t):
    return X.per_text(_quotes(t), ["doc_id"], ["quote", "text"], "verdict string", lambda q, s: [{"verdict": K.quote_match(q, s)}])


@R.on("txt_quote_order")
def _(t):
    return X.per_text(_quotes(t), ["doc_id"], ["quote", "text"], "verdict string", lambda q, s: [{"verdict": K.quote_order(q, s)}])


@R.on("txt_lcs_ground")
def _(t):
    def one(q, s):
        ok, cov, den = K.grounded(q, s)
        return [{"grounded": ok, "coverage": cov, "density": den}]

    return X.per_text(_quotes(t), ["doc_id"], ["quote", "text"], "grounded boolean, coverage double, density double", one)


@R.on("txt_coverage_ratio")
def _(t):
    return X.per_text(_quotes(t), ["doc_id"], ["quote", "text"], "share double", lambda q, s: [{"share": K.matched_share(q, s)}]).withColumn("covered", F.col("share") >= 0.9)


@R.on("txt_bow", "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2")
def _(t):
    return X.bag_of_words(_docs(t), ["doc_id"], "text")


@R.on(
    "txt_quote_fragments",
    r"""WITH d AS (SELECT doc_id, text, length(text) AS n, least(greatest(length(text) // 6, 1), 80) AS k FROM documents WHERE length(text) > 0),
        p AS (SELECT doc_id, text, substr(text, n // 3 + 1, k) AS a, substr(text, n // 2 + k + 1, k) AS b FROM d),
        q AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN a WHEN 1 THEN a || ' ... ' || b ELSE b || ' ... ' || a END AS quote FROM p),
        f AS (SELECT doc_id, lower(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS flat,
            list_filter(list_transform(string_split_regex(quote, '\.{3}|…'), lambda x: trim(lower(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g')))), lambda x: length(x) >= 15) AS fs FROM q)
        SELECT doc_id, len(list_filter(fs, lambda x: NOT contains(flat, x))) = 0 AS present FROM f""",
)
def _(t):
    return _quotes(t).select("doc_id", X.fragments_present(F.col("quote"), F.col("text")).alias("present"))
