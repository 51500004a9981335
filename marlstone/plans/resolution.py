"""Entity-resolution queries: S12 fund names against share-class titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import documents as D
from marlstone.operators import ladder as L
from marlstone.operators import resolution as E
from marlstone.plans.registry import Registry
from marlstone.session import written

R = Registry()


_CLASS = r"(?: - Class .*|; .*|/[^/]*)$"


def _title():
    return F.regexp_replace(F.regexp_replace("fund_name", r"^[^:]*: ", ""), _CLASS, "")


def _names(t):
    """Distinct normalised names of both sides, as (id, name, scope); the scope is the first letter."""
    # Spellings are written first: else Spark tests for empty names below `distinct` and normalises every row of the tables.
    spelled = lambda table, c: written(t(table).where(f"{c} is not null").select(c).distinct(), "spellings")
    left = spelled("split_s12", "fundname").select(S.normalize_name("fundname").alias("name")).where("name != ''").distinct()
    right = spelled("portnomap", "fund_name").select(S.normalize_name(_title()).alias("name")).where("name != ''").distinct()
    side = lambda d: d.select(F.col("name").alias("id"), "name", F.substring("name", 1, 1).alias("scope"))
    return written(side(left), "names"), written(side(right), "names")


_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper({0}),
    '\((FORMERLY|FORMALLY|F/K/A|FKA|PREVIOUSLY|NEE)[^)]*\)', ' ', 'g'), '\b([A-Z])\.', '\1', 'g'), '\(([^)]*)\)', ' ', 'g'), '[^A-Z0-9&]+', ' ', 'g'), '\bSANDP\b', 'S P', 'g'),
    '\bS AND P\b', 'S P', 'g'), '[^A-Z0-9]+', ' ', 'g'), '\b(INC|INCORPORATED|LLC|L L C|LP|L P|PLC|CORP|CORPORATION|LTD|LIMITED|N V|NV|S A|CO|COMPANY|THE)\b', ' ', 'g'), '\s+', ' ', 'g'))"""
_TITLE = r"regexp_replace(regexp_replace(fund_name, '^[^:]*: ', ''), '(?: - Class .*|; .*|/[^/]*)$', '')"
_TFIDF = f"""
    WITH l AS (SELECT DISTINCT {_NORM.format('fundname')} AS id FROM split_s12 WHERE fundname IS NOT NULL), r AS (SELECT DISTINCT {_NORM.format(_TITLE)} AS id FROM portnomap WHERE fund_name IS NOT NULL),
    u AS (SELECT 0 AS side, id FROM l WHERE id <> '' UNION ALL SELECT 1, id FROM r WHERE id <> ''),
    w AS (SELECT side, id, ' ' || unnest(string_split(lower(id), ' ')) || ' ' AS w FROM u),
    n AS (SELECT side, id, w, unnest([2, 3, 4]) AS n FROM w), g AS (SELECT side, id, substr(w, i, n) AS g FROM (SELECT *, unnest(range(1, CAST(length(w) - n + 2 AS BIGINT))) AS i FROM n WHERE n <= length(w))),
    tf AS (SELECT side, id, g, count(*) AS tf FROM g GROUP BY 1, 2, 3), df AS (SELECT g, count(*) AS df FROM tf GROUP BY 1), total AS (SELECT count(*) AS n FROM u),
    v AS (SELECT side, id, g, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (g), total), u2 AS (SELECT side, id, sqrt(sum(x * x)) AS len FROM v GROUP BY 1, 2),
    v2 AS (SELECT side, id, g, x / len AS x FROM v JOIN u2 USING (side, id)),
    s AS (SELECT a.id AS left_id, b.id AS right_id, sum(a.x * b.x) AS score FROM v2 a JOIN v2 b ON a.g = b.g AND a.side = 0 AND b.side = 1 GROUP BY 1, 2)
"""


@R.on("er_tfidf_topk", _TFIDF + "SELECT left_id, right_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(score, 9) DESC, right_id) AS rn FROM s WHERE score >= 0.3) WHERE rn <= 100")
def _(t):
    left, right = _names(t)
    # Ties are told apart by rounded scores: the best 100 by plain scores may be others.
    return E.similar(left, right, 0.3, 100, digits=9).select("left_id", "right_id", F.round("score", 5).alias("score"))


@R.on("er_global", _TFIDF + "SELECT left_id, max(round(score, 5)) AS score FROM s WHERE score >= 0.85 GROUP BY 1")
def _(t):
    left, right = _names(t)
    return E.similar(left, right, 0.85, 1).select("left_id", F.round("score", 5).alias("score"))


@R.on("er_scoped", _TFIDF + "SELECT left_id, max(round(score, 5)) AS score FROM s WHERE score >= 0.8 AND substr(left_id, 1, 1) = substr(right_id, 1, 1) GROUP BY 1")
def _(t):
    left, right = _names(t)
    return E.similar(left, right, 0.8, 1, "scope").select("left_id", F.round("score", 5).alias("score"))


@R.on(
    "er_two_pass",
    _TFIDF
    + """, a AS (SELECT left_id, max(score) AS score FROM s WHERE score >= 0.8 AND substr(left_id, 1, 1) = substr(right_id, 1, 1) GROUP BY 1)
    SELECT left_id, round(score, 5) AS score, 'scoped' AS tier FROM a UNION ALL SELECT left_id, round(max(score), 5), 'global' FROM s WHERE score >= 0.85 AND left_id NOT IN (SELECT left_id FROM a) GROUP BY 1""",
)
def _(t):
    left, right = _names(t)
    return E.two_pass(left, right, "scope").select("left_id", F.round("score", 5).alias("score"), "tier")


@R.on("er_digit_guard")
def _(t):
    left, right = _names(t)
    got = E.similar(left, right, 0.8, 3)
    return got.select("left_id", "right_id", E.digit_guard("left_id", "right_id").alias("passes"))


def _candidates(t):
    """Scored pairs with what the passes need; a name is unique if one portfolio (else fund) bears it on the right side."""
    left, right = _names(t)
    got = E.similar(left, right, 0.7, 5).withColumnRenamed("right_id", "unit")
    stop = ["FUND", "FUNDS", "GROWTH", "EQUITY", "INDEX", "BOND", "INCOME", "SERIES", "TARGET", "CAPITAL", "VALUE", "MARKET", "MARKETS", "INTERNATIONAL", "RETIREMENT"]
    bearer = F.coalesce(F.col("crsp_portno"), -F.col("crsp_fundno"), F.lit(0))
    same = t("portnomap").where("fund_name is not null").groupBy(S.normalize_name(_title()).alias("unit")).agg(F.countDistinct(bearer).alias("n_same_name"))
    head = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    return written(got.join(same, "unit").select("*", head("left_id").alias("scope_l"), head("unit").alias("scope_r"), S.family_tokens("left_id", stop).alias("families")), "candidates")


def _verdicts(t):
    cand = _candidates(t)
    _, support = E.scope_bootstrap(cand)
    return E.judged(cand, support)


@R.on("er_family_verdict")
def _(t):
    return _verdicts(t).select("left_id", F.col("unit").alias("right_id"), "verdict")


@R.on(
    "er_best_margin",
    _TFIDF
    + """, m AS (SELECT left_id, split_part(right_id, ' ', 1) AS unit, max(score) AS score FROM s WHERE score >= 0.5 GROUP BY 1, 2),
    q AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM m WINDOW w AS (PARTITION BY left_id ORDER BY score DESC, unit))
    SELECT left_id, unit, round(score, 5) AS score, round(score - coalesce(nxt, 0), 4) AS margin FROM q WHERE rn = 1""",
)
def _(t):
    left, right = _names(t)
    right = right.withColumn("unit", F.split_part("name", F.lit(" "), F.lit(1)))
    # The best two units of a name are all that its margin needs.
    return E.best_margin(E.similar(left, right, 0.5, 2, group="unit"), right.select(F.col("id").alias("right_id"), "unit")).select("left_id", "unit", F.round("score", 5).alias("score"), F.round("margin", 4).alias("margin"))


@R.on("er_accept_global")
def _(t):
    return E.accept_global(_verdicts(t), 0.0).select("left_id", "unit", F.round("score", 5).alias("score"))


@R.on("er_scope_bootstrap")
def _(t):
    """Links of both passes: accepted ones tell which scopes belong together; a second pass looks there.  Numbers and designators must agree."""
    links, _ = E.scope_bootstrap(_candidates(t).where(E.digit_guard("left_id", "unit")))
    return links.withColumn("score", F.round("score", 5))


@R.on("er_tier_ladder")
def _(t):
    """Left: the spellings of the S12 funds' names; right: portfolio titles.  The series of submission headers are sought in all documents."""
    firms = t("split_s12").where("fundname is not null").groupBy("fundname").agg(F.collect_set("fundno").alias("members"), F.collect_set("mgrcoab").alias("firms"), F.year(F.min("rdate")).alias("first"))
    left = written(firms, "spellings").select(S.normalize_name("fundname").alias("id"), F.col("fundname").alias("raw"), "members", "firms", "first")
    classes = t("portnomap").where("fund_name is not null").select("fund_name", "ticker", "mgmt_name", F.coalesce(F.year("enddt"), F.lit(9999)).alias("last"))
    heading = F.when(F.col("fund_name").rlike("^[^:]*: "), F.regexp_replace("fund_name", _CLASS, ""))
    right = classes.select(S.normalize_name(_title()).alias("unit"), _title().alias("title"), heading.alias("heading"), "ticker", F.col("mgmt_name").alias("firm"), "last")
    headers = t("documents").where(F.contains("text", F.lit("<SERIES>"))).select("doc_id", "text")
    series = D.extract(headers, ["doc_id"], "text", "series_classes").select(F.col("series_name").alias("name"), "ticker").distinct()
    return L.tier_ladder(left.where("id != ''"), right.where("unit != ''"), series).select("left_id", "unit", "tier")


@R.on(
    "er_class_collapse",
    """WITH n AS (SELECT crsp_portno, index_fund_flag AS f, count(*) AS n FROM portnomap WHERE index_fund_flag IS NOT NULL GROUP BY 1, 2), m AS (SELECT crsp_portno, f, row_number() OVER (PARTITION BY crsp_portno ORDER BY n DESC, f) AS rn FROM n)
       SELECT p.crsp_portno, round(sum(tna_latest), 3) AS tna_latest, arg_max(map_id, (coalesce(tna_latest, -1.0), -map_id)) AS representative, count(*) AS n_classes, max(m.f) AS index_fund_flag
       FROM portnomap p LEFT JOIN m ON m.crsp_portno = p.crsp_portno AND m.rn = 1 GROUP BY 1""",
)
def _(t):
    return E.collapse_classes(t("portnomap"), "crsp_portno", "tna_latest", "index_fund_flag", "map_id").withColumn("tna_latest", F.round("tna_latest", 3))


@R.on(
    "er_vocab_variants",
    f"""SELECT DISTINCT * FROM (SELECT {_NORM.format('fundname')} AS name, 's12' AS source, CAST(year(rdate) AS INTEGER) AS year FROM split_s12 UNION ALL SELECT {_NORM.format('fund_name')}, 'crsp', CAST(year(begdt) AS INTEGER) FROM portnomap) WHERE name <> ''""",
)
def _(t):
    return E.vocabulary([("s12", t("split_s12"), "fundname", F.year("rdate")), ("crsp", t("portnomap"), "fund_name", F.year("begdt"))])


@R.on("er_variants_query")
def _(t):
    left, right = _names(t)
    q = left.select("id", F.array_distinct(F.array("name", S.expand_abbreviations("name"))).alias("variants"))
    return E.best_of_variants(q, right, 0.8).select("left_id", "right_id", F.round("score", 5).alias("score"))


@R.on(
    "er_threshold_sweep",
    _TFIDF
    + """, k AS (SELECT split_part(left_id, ' ', 1) = split_part(right_id, ' ', 1) AS t, score FROM s WHERE score >= 0.7), x AS (SELECT t, score, unnest([0.85, 0.9, 0.95])::DOUBLE AS threshold FROM k)
    SELECT threshold, round(count(*) FILTER (NOT t AND score >= threshold) / nullif(count(*) FILTER (NOT t), 0), 6) AS fpr, round(count(*) FILTER (t AND score >= threshold) / nullif(count(*) FILTER (t), 0), 6) AS accuracy,
    round(count(*) FILTER (t AND score >= threshold) / nullif(count(*) FILTER (score >= threshold), 0), 6) AS "precision" FROM x GROUP BY 1""",
)
def _(t):
    left, right = _names(t)
    head = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    return E.threshold_sweep(E.similar(left, right, 0.7, None), head("left_id") == head("right_id"))


@R.on(
    "er_coverage_rollup",
    """WITH k AS (SELECT DISTINCT crsp_fundno FROM mflink_portno), y AS (SELECT CAST(year(rdate) AS INTEGER) AS year, CASE WHEN k.crsp_fundno IS NOT NULL THEN coalesce(feed, 'none') ELSE 'unlinked' END AS tier, shares AS w
       FROM tfn_holdings h LEFT JOIN k ON k.crsp_fundno = h.crsp_fundno WHERE shares > 0), g AS (SELECT year, tier, count(*) AS n, sum(w) AS w FROM y GROUP BY 1, 2)
       SELECT year, tier, n, round(n / sum(n) OVER (PARTITION BY year), 6) AS row_share, round(w / sum(w) OVER (PARTITION BY year), 6) AS weight_share FROM g""",
)
def _(t):
    k = t("mflink_portno").select("crsp_fundno").distinct().withColumn("ok", F.lit(True))
    h = t("tfn_holdings").where("shares > 0").join(k, "crsp_fundno", "left")
    return E.coverage_rollup(h, F.year("rdate"), F.coalesce("feed", F.lit("none")), F.col("ok").isNotNull(), F.col("shares"))


@R.on(
    "er_narrow",
    """WITH j AS (SELECT h.hold_id, p.map_id, coalesce(h.rdate BETWEEN p.begdt AND coalesce(p.enddt, DATE '9999-12-31'), false) AS a, coalesce(p.loaddt <= h.rdate, false) AS b, p.enddt IS NULL AS c
           FROM tfn_holdings h JOIN portnomap p USING (crsp_fundno)),
       x AS (SELECT *, CASE WHEN count(*) FILTER (a) OVER (PARTITION BY hold_id) > 0 THEN a ELSE true END AS i1 FROM j),
       y AS (SELECT *, CASE WHEN count(*) FILTER (i1 AND b) OVER (PARTITION BY hold_id) > 0 THEN i1 AND b ELSE i1 END AS i2 FROM x),
       z AS (SELECT *, CASE WHEN count(*) FILTER (i2 AND c) OVER (PARTITION BY hold_id) > 0 THEN i2 AND c ELSE i2 END AS i3 FROM y)
       SELECT hold_id, CASE WHEN count(*) = 1 THEN min(map_id) END AS map_id, count(*) AS n_left FROM z WHERE i3 GROUP BY 1""",
)
def _(t):
    """The span of a holding's fund: by date, then by known time, then open ended."""
    h = t("tfn_holdings").select("hold_id", "crsp_fundno", "rdate")
    j = h.join(t("portnomap").select("crsp_fundno", "map_id", "begdt", "enddt", "loaddt"), "crsp_fundno")
    tests = [F.col("rdate").between(F.col("begdt"), F.coalesce("enddt", F.lit("9999-12-31").cast("date"))), F.col("loaddt") <= F.col("rdate"), F.col("enddt").isNull()]
    return E.narrow(j, "hold_id", "map_id", tests)


@R.on(
    "er_candidate_keys",
    """WITH r AS (SELECT cik, filed_date, count(*) AS n, min(person_row) AS p FROM s1_persons GROUP BY 1, 2)
       SELECT d.doc_id, CASE WHEN r.n IS NULL THEN 'none' WHEN r.n = 1 THEN 'one' ELSE 'many' END AS status, CASE WHEN r.n = 1 THEN r.p END AS person_row
       FROM documents d LEFT JOIN r ON r.cik = d.cik AND r.filed_date = d.filed_date""",
)
def _(t):
    return E.candidate_status(t("documents").select("doc_id", "cik", "filed_date"), t("s1_persons").select("cik", "filed_date", "person_row"), ["cik", "filed_date"], "person_row").select("doc_id", "status", "person_row")


@R.on("join_topk_similarity", _TFIDF + "SELECT left_id, right_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(score, 9) DESC, right_id) AS rn FROM s WHERE score >= 0.75) WHERE rn <= 1")
def _(t):
    left, right = _names(t)
    return E.similar(left, right, 0.75, 1, digits=9).select("left_id", "right_id", F.round("score", 5).alias("score"))
