"""Scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import ticks as T
from marlstone.plans.registry import Registry

R = Registry()


@R.on("fn_quarter_end", "SELECT o_orderkey, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS qe, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS INTEGER) AS qi FROM orders")
def _(t):
    return t("orders").select("o_orderkey", S.quarter_end("o_orderdate").alias("qe"), S.quarter_index("o_orderdate").alias("qi"))


@R.on(
    "fn_date_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
       CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS later FROM orders""",
)
def _(t):
    d = F.col("o_orderdate").cast("date")
    return t("orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.trunc(d, "month").alias("month_start"), F.datediff(d, F.lit("1995-01-01")).alias("days"), F.date_add(d, 10).alias("later"))


@R.on("fn_date_series", "SELECT CAST(s AS DATE) AS day, (SELECT count(*) FROM events e WHERE CAST(e.ts AS DATE) = CAST(s AS DATE)) AS n FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY) g(s)")
def _(t):
    days = t.spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-05").cast("date"))).alias("day"))
    n = t("events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").fillna(0, ["n"])


@R.on("fn_date_validate", "SELECT own_row, CASE WHEN regexp_full_match(x, '[0-9]{8}') AND year(TRY_CAST(strptime_d AS DATE)) BETWEEN 1990 AND 2035 THEN CAST(year(strptime_d) AS INTEGER) END AS y FROM (SELECT own_row, x, CAST(try_strptime(x, '%Y%m%d') AS DATE) AS strptime_d FROM (SELECT own_row, CASE WHEN own_row % 7 = 0 THEN '20261399' ELSE strftime(filing_date, '%Y%m%d') END AS x FROM own_rows))")
def _(t):
    x = F.when(F.col("own_row") % 7 == 0, "20261399").otherwise(F.date_format("filing_date", "yyyyMMdd"))
    return t("own_rows").select("own_row", S.valid_year(x).alias("y"))


@R.on("fn_filed_within_year", "SELECT hold_id, CAST(strftime(fdate, '%Y%m%d') AS INTEGER) - CAST(strftime(rdate, '%Y%m%d') AS INTEGER) <= 10000 AS in_time FROM tfn_holdings")
def _(t):
    return t("tfn_holdings").select("hold_id", S.filed_within_a_year("fdate", "rdate").alias("in_time"))


@R.on(
    "fn_fiscal_assign",
    """SELECT own_row, CAST(year(filing_date) - CASE WHEN date_diff('day', make_date(year(filing_date), 1, 1), filing_date) <= 14
       OR (form LIKE '%SC 13G%' AND percent < 10 AND date_diff('day', make_date(year(filing_date), 2, 14), filing_date) <= 10) THEN 1 ELSE 0 END AS INTEGER) AS fy
       FROM (SELECT *, CASE WHEN table_index % 2 = 0 THEN 'SC 13G/A' ELSE 'SC 13D' END AS form FROM own_rows)""",
)
def _(t):
    o = t("own_rows").withColumn("form", F.when(F.col("table_index") % 2 == 0, "SC 13G/A").otherwise("SC 13D"))
    return o.select("own_row", S.fiscal_year("filing_date", "form", "percent").alias("fy"))


@R.on("fn_two_digit_year", "SELECT meet_row, meetingdate AS d FROM meetings")
def _(t):
    return t("meetings").select("meet_row", S.two_digit_year_date(F.date_format("meetingdate", "dd-MMM-yy")).alias("d"))


_FORMER, _LEGAL = r"'\((FORMERLY|FORMALLY|F/K/A|FKA|PREVIOUSLY|NEE)[^)]*\)', ' ', 'g'", r"'\b(INC|INCORPORATED|LLC|L L C|LP|L P|PLC|CORP|CORPORATION|LTD|LIMITED|N V|NV|S A|CO|COMPANY|THE)\b', ' ', 'g'"


def _replaced(x: str, *steps: str) -> str:
    for step in steps:
        x = f"regexp_replace({x}, {step})"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_SP = [r"'\bSANDP\b', 'S P', 'g'", r"'\bS AND P\b', 'S P', 'g'"]
_L2 = _replaced("upper(fund_name)", _FORMER, r"'\(([^)]*)\)', ' ', 'g'", "'[^A-Z0-9]+', ' ', 'g'", _LEGAL, r"'\s+', ' ', 'g'", *_SP)
_L3 = [r"'\(([^)]*)\)', ' ', 'g'", "'[^A-Z0-9&]+', ' ', 'g'", *_SP, "'[^A-Z0-9]+', ' ', 'g'", _LEGAL]


@R.on(
    "fn_name_normalize",
    f"""SELECT map_id, {_L2} AS l2, {_replaced("upper(fund_name)", _FORMER, *_L3)} AS l3, {_replaced("upper(fund_name)", _FORMER, "'" + chr(92) + "b([A-Z])" + chr(92) + ".', '" + chr(92) + "1', 'g'", *_L3)} AS l3b FROM portnomap""",
)
def _(t):
    return t("portnomap").select("map_id", *[S.normalize_name("fund_name", v).alias(v) for v in ("l2", "l3", "l3b")])


@R.on(
    "fn_name_norm_simple",
    r"""SELECT DISTINCT company, trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(company), '\([^)]*\)', ' ', 'g'), '\s*&\s*', ' AND ', 'g'), '[.'']', '', 'g'),
        '[^A-Z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')), '(\s+("""
    + "|".join(S.LEGAL_FORMS)
    + """))+$', '')) AS name FROM own_rows""",
)
def _(t):
    return t("own_rows").select("company", S.simple_name("company").alias("name")).distinct()


@R.on(
    "fn_abbrev_expand",
    f"""SELECT DISTINCT fundname, array_to_string(list_transform(string_split(trim(regexp_replace(upper(fundname), '\\s+', ' ', 'g')), ' '),
        lambda w: CASE w {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.ABBREVIATIONS.items())} ELSE w END), ' ') AS full_name FROM split_s12 WHERE fundname IS NOT NULL""",
)
def _(t):
    return t("split_s12").where("fundname is not null").select("fundname").distinct().select("fundname", S.expand_abbreviations(F.upper("fundname")).alias("full_name"))


@R.on("fn_digit_tokens", "SELECT fundname, array_to_string(list_sort(list_filter(string_split_regex(fundname, '\\s+'), lambda w: regexp_matches(w, '[0-9]'))), '|') AS digits FROM (SELECT DISTINCT fundname FROM split_s12 WHERE fundname IS NOT NULL)")
def _(t):
    return t("split_s12").where("fundname is not null").select("fundname").distinct().select("fundname", F.array_join(S.digit_tokens("fundname"), "|").alias("digits"))


@R.on("fn_designator", "SELECT DISTINCT fundname, nullif(regexp_extract(upper(fundname), '\\b(?:SERIES|PORTFOLIO|FUND)\\s+([A-Z0-9]{1,2})\\b\\s*$', 1), '') AS d FROM split_s12 WHERE fundname IS NOT NULL")
def _(t):
    return t("split_s12").where("fundname is not null").select("fundname").distinct().select("fundname", S.designator(F.upper("fundname")).alias("d"))


@R.on(
    "fn_family_tokens",
    """WITH w AS (SELECT DISTINCT fundname, list_filter(string_split_regex(upper(fundname), '\\s+'), lambda x: length(x) >= 4 AND x NOT IN ('FUND', 'GROWTH', 'EQUITY', 'INDEX', 'BOND', 'INCOME')) AS ws
       FROM split_s12 WHERE fundname IS NOT NULL)
       SELECT fundname, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), '|') AS family FROM w""",
)
def _(t):
    stop = ["FUND", "GROWTH", "EQUITY", "INDEX", "BOND", "INCOME"]
    return t("split_s12").where("fundname is not null").select("fundname").distinct().select("fundname", F.array_join(S.family_tokens(F.upper("fundname"), stop), "|").alias("family"))


@R.on("fn_digit_split", "SELECT DISTINCT cusip, regexp_replace(regexp_replace(cusip, '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g') AS parts FROM split_s12 WHERE cusip IS NOT NULL")
def _(t):
    return t("split_s12").where("cusip is not null").select("cusip").distinct().select("cusip", S.split_digits("cusip").alias("parts"))


@R.on(
    "fn_strip_leading",
    """WITH w AS (SELECT DISTINCT holder_name, list_filter(string_split_regex(upper(holder_name), '\\s+'), lambda x: x <> '') AS ws FROM own_rows),
       f AS (SELECT *, len(ws) AS n, list_position(list_transform(ws, lambda x: x IN ('THE', 'MR.', 'DR.', 'HON.', 'MS.')), false) AS first FROM w)
       SELECT holder_name, array_to_string(ws[greatest(least(CASE WHEN coalesce(first, 0) = 0 THEN n ELSE first - 1 END, n - 2), 0) + 1 :], ' ') AS name FROM f""",
)
def _(t):
    return t("own_rows").select("holder_name").distinct().select("holder_name", S.strip_leading(F.upper("holder_name"), ["THE", "MR.", "DR.", "HON.", "MS."]).alias("name"))


_C = r"upper(regexp_replace(cusip8, '\s+', '', 'g'))"


@R.on("fn_cusip", f"SELECT hold_id, substr({_C}, 1, 8) AS c8, substr({_C}, 1, 6) AS c6, CASE WHEN length({_C}) = 9 THEN {_C} END AS c9, regexp_full_match({_C}, '[0-9A-Z*@#]{{8,9}}') AS valid FROM tfn_holdings")
def _(t):
    c = t("tfn_holdings").select("hold_id", S.cusip("cusip8").alias("c"))
    return c.select("hold_id", F.col("c.cusip8").alias("c8"), F.col("c.cusip6").alias("c6"), F.col("c.cusip9").alias("c9"), F.col("c.valid").alias("valid"))


@R.on(
    "fn_regex_family",
    """SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS num, len(regexp_extract_all(p_name, '[aeiou]')) AS vowels, regexp_replace(p_name, '\\s+', '_', 'g') AS snake,
       split_part(p_name, ' ', 2) AS second FROM part""",
)
def _(t):
    return t("part").select(
        "p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).alias("num"), F.regexp_count("p_name", F.lit("[aeiou]")).alias("vowels"),
        F.regexp_replace("p_name", r"\s+", "_").alias("snake"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("second"),
    )


@R.on("fn_suffix_split", "SELECT s_suppkey, split_part(s_name, '#', 2) AS code, contains(s_name, '#00000000') AS low FROM supplier")
def _(t):
    return t("supplier").select("s_suppkey", F.split_part("s_name", F.lit("#"), F.lit(2)).alias("code"), F.contains("s_name", F.lit("#00000000")).alias("low"))


@R.on("fn_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@R.on("fn_array", "SELECT word, count(*) AS n FROM (SELECT trim(unnest(string_split(p_name, ' '))) AS word FROM part) WHERE word <> '' GROUP BY 1")
def _(t):
    words = t("part").select(F.explode(F.split("p_name", " ")).alias("w")).select(F.trim("w").alias("word"))
    return words.where("word != ''").groupBy("word").agg(F.count("*").alias("n"))


@R.on("fn_math", "SELECT p_partkey, round(ln(p_retailprice), 6) AS log_price, round(exp(p_size / 50.0), 6) AS e, abs(p_size - 25) AS a, round(greatest(p_size, 25) / least(p_size, 25), 6) AS fold FROM part WHERE p_size > 0")
def _(t):
    fold = F.greatest("p_size", F.lit(25)) / F.least("p_size", F.lit(25))
    return t("part").where("p_size > 0").select(
        "p_partkey", F.round(F.ln("p_retailprice"), 6).alias("log_price"), F.round(F.exp(F.col("p_size") / 50.0), 6).alias("e"), F.abs(F.col("p_size") - 25).alias("a"), F.round(fold, 6).alias("fold")
    )


@R.on("fn_coalesce", "SELECT own_row, coalesce(percent, shares, -1) AS x, coalesce(share_class, 'none') AS c FROM own_rows")
def _(t):
    return t("own_rows").select("own_row", F.coalesce("percent", "shares", F.lit(-1.0)).alias("x"), F.coalesce("share_class", F.lit("none")).alias("c"))


@R.on("fn_sum_known", "SELECT cell_row, CASE WHEN sv_for IS NOT NULL OR sv_against IS NOT NULL OR tna_for IS NOT NULL THEN round(coalesce(sv_for, 0) + coalesce(sv_against, 0) + coalesce(tna_for, 0), 2) END AS total FROM npx_cells")
def _(t):
    return t("npx_cells").select("cell_row", F.round(S.sum_known("sv_for", "sv_against", "tna_for"), 2).alias("total"))


@R.on("fn_hash", "SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS h FROM customer")
def _(t):
    return t("customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("h"))


@R.on("fn_sanitize", "SELECT doc_id, md5(translate(text, chr(9) || chr(10) || chr(13), '   ')) AS h FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(S.sanitize("text")).alias("h"))


@R.on(
    "fn_html_plain",
    r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS t FROM documents),
        b AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^<>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM a)
        SELECT doc_id, trim(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS plain FROM b""",
)
def _(t):
    return t("documents").select("doc_id", S.html_plain("text").alias("plain"))


_AN = "regexp_replace(lower(text), '[^a-z0-9]', '', 'g')"


@R.on("fn_alnum_probe", f"SELECT doc_id, substr({_AN}, CAST(greatest(floor((length({_AN}) - 40) / 2.0), 0) AS BIGINT) + 1, 40) AS probe FROM documents WHERE text IS NOT NULL")
def _(t):
    return t("documents").where("text is not null").select("doc_id", S.alnum_probe("text").alias("probe"))


@R.on("fn_phrase_regex", "SELECT doc_id, coalesce(regexp_matches(text, '(?i)\\brecord[\\s-]+date\\b'), false) AS has FROM documents")
def _(t):
    return t("documents").select("doc_id", F.coalesce(F.col("text").rlike(S.phrase_regex("record date")), F.lit(False)).alias("has"))


@R.on("fn_title_similarity")
def _(t):
    """Ratio of matching blocks of each title and the next of its company in order; at 0.75 they count as one."""
    from marlstone.functions.texts import title_ratio

    titles = t("documents").where("title is not null and cik is not null").select("cik", "title").distinct()
    after = F.lead("title").over(Window.partitionBy("cik", F.substring("title", 1, 2)).orderBy("title"))
    pairs = titles.select("title", after.alias("other")).where("other is not null").distinct()
    return pairs.withColumn("ratio", title_ratio("title", "other")).where("ratio >= 0.75")


@R.on("fn_ngram_charwb")
def _(t):
    words = t("part").select("p_name").distinct()
    return words.select("p_name", F.explode(S.char_wb_ngrams("p_name")).alias("gram")).groupBy("p_name", "gram").agg(F.count("*").alias("tf"))


@R.on(
    "fn_cosine_vec",
    """SELECT a.vec_id AS query_id, b.vec_id AS hit_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS sim FROM embeddings a JOIN embeddings b
       ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3""",
)
def _(t):
    """Every twentieth row is a query, compared with all other rows whatever their label."""
    a = t("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("x"))
    b = t("embeddings").select(F.col("vec_id").alias("hit_id"), F.col("embedding").alias("y"))
    # Every query meets every row: without a key Spark compares block by block.
    sim = a.crossJoin(b).where("query_id != hit_id").select("query_id", "hit_id", S.cosine("x", "y").alias("sim"))
    return sim.where("sim >= 0.3").withColumn("sim", F.round("sim", 5))


@R.on("fn_latency_adjust", "SELECT event_id, 2 * epoch_us(ts) - (epoch_us(ts) + CAST(round(value * 1000) AS BIGINT)) AS t_us FROM events")
def _(t):
    part = F.unix_micros(F.col("ts").cast("timestamp"))
    return t("events").select("event_id", T.participant_time(part, part + F.round(F.col("value") * 1000).cast("long")).alias("t_us"))
