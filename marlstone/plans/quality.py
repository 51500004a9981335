"""Data-quality queries: the rule matrix, detectors on a holdings panel, gates, hashes and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import detectors as X
from marlstone.operators import quality as Q
from marlstone.plans.registry import Registry

R = Registry()
_D = Q.declaration("pk: l_orderkey, l_linenumber; event: l_partkey, l_suppkey, l_shipdate")

# --- matrix ------------------------------------------------------------------------------------------------------


def _mixed(t):
    """Own rows with a constant and a sparse column."""
    return t("own_rows").select("own_row", "cik", "parser", "percent_marker", "holder_name", F.lit("us").alias("region"), "filing_date")


@R.on(
    "dq_constant",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) + CAST(coalesce(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_unique FROM (SELECT *, 'us' AS region FROM own_rows)"""
        for c in ("own_row", "cik", "parser", "percent_marker", "holder_name", "region", "filing_date")
    )
    + ") WHERE n_unique <= 1",
)
def _(t):
    return Q.constant_columns(_mixed(t), Q.Declaration())


@R.on(
    "dq_high_null",
    """SELECT "column", round(s, 6) AS null_share FROM (SELECT 'percent_marker' AS "column", avg(CASE WHEN percent_marker IS NULL THEN 1.0 ELSE 0 END) AS s FROM own_rows UNION ALL
       SELECT 'holder_name', avg(CASE WHEN holder_name IS NULL THEN 1.0 ELSE 0 END) FROM own_rows UNION ALL SELECT 'parser', avg(CASE WHEN parser IS NULL THEN 1.0 ELSE 0 END) FROM own_rows) WHERE s > 0.5""",
)
def _(t):
    return Q.null_columns(_mixed(t), Q.Declaration())


@R.on(
    "dq_grain",
    """SELECT 'DQ3a' AS rule, coalesce(sum(n), 0)::BIGINT AS bad FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL
       SELECT 'DQ3b', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL
       SELECT 'DQ3c', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_partkey, l_suppkey, l_shipdate HAVING count(*) > 1)""".replace(
        "SELECT count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
        "SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate HAVING count(*) > 1",
    ),
)
def _(t):
    return Q.grain(t("lineitem"), _D)


@R.on("dq_cardinality", "SELECT 'c_name' AS \"column\", count(DISTINCT c_name) AS n_unique FROM customer HAVING count(DISTINCT c_name) > 0.9 * count(*)")
def _(t):
    return Q.wordy_columns(t("customer"), Q.declaration("pk: c_custkey"))


@R.on(
    "dq_coverage",
    """SELECT CASE WHEN min(o_orderdate) > TIMESTAMP '1995-01-10' OR max(o_orderdate) < TIMESTAMP '2001-12-31' THEN 'FAIL' ELSE 'PASS' END AS status,
       CASE WHEN min(o_orderdate) > TIMESTAMP '1995-01-10' THEN 'starts_late' WHEN max(o_orderdate) < TIMESTAMP '2001-12-31' THEN 'ends_early' END AS reason FROM orders""",
)
def _(t):
    return Q.covers(t("orders"), Q.coverage_window("1995-01-10..2001-12-31"))


@R.on("dq_enum")
def _(t):
    """A line for every rule; rules that need a judgement never pass."""
    return Q.matrix(_mixed(t), Q.declaration("pk: own_row; freetext: holder_name"), Q.coverage_window("filing_date: 2012-01-01..2020-12-31"))


@R.on("dq_trace", "SELECT * FROM (VALUES ('DQ4', 'MODEL-EVALUATED', 'needs a judgement'), ('DQ6', 'MODEL-EVALUATED', 'needs a judgement')) v(rule, status, detail)")
def _(t):
    """Tracing to sources and before-and-after comparisons need a judgement: always listed, never passed."""
    return Q.matrix(t("region"), Q.Declaration()).where("rule in ('DQ4', 'DQ6')")


@R.on("dq_keys_grammar", "SELECT * FROM (VALUES ('pk', 'a,b'), ('event', 'c'), ('sparse', 'x'), ('freetext', ''), ('constant', 'z'), ('window', 'd 2020-01-01 2020-12-31')) v(part, columns)")
def _(t):
    """What the two small grammars read."""
    d, w = Q.declaration("pk: a, b; event: c; sparse: x; constant: z"), Q.coverage_window("d: 2020-01-01..2020-12-31")
    rows = [(k, ",".join(getattr(d, k))) for k in ("pk", "event", "sparse", "freetext", "constant")] + [("window", f"{w.column} {w.first} {w.last}")]
    return t.spark.createDataFrame(rows, "part string, columns string")


@R.on("dq_declaration_gaps")
def _(t):
    return Q.declaration_gaps(Q.matrix(_mixed(t), Q.declaration("pk: own_row; freetext: holder_name")))


# --- detectors on a holdings panel --------------------------------------------------------------------------------

_PANEL = """panel AS (SELECT l_partkey AS e, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS p, sum(l_quantity) AS io, count(DISTINCT l_suppkey) AS own,
    round(sum(l_extendedprice), 2) AS val FROM lineitem GROUP BY 1, 2)"""
_LAG = "SELECT *, lag(io) OVER (PARTITION BY e ORDER BY p) AS pio, lag(own) OVER (PARTITION BY e ORDER BY p) AS pown FROM panel"


def _panel(t):
    return t("lineitem").groupBy(F.col("l_partkey").alias("e"), S.quarter_end("l_shipdate").alias("p")).agg(
        F.sum("l_quantity").alias("io"), F.countDistinct("l_suppkey").alias("own"), F.round(F.sum("l_extendedprice"), 2).alias("val")
    )


def _select(kind, entity, period, detail, metric, rest):
    return f"SELECT '{kind}' AS kind, CAST({entity} AS VARCHAR) AS entity, CAST({period} AS VARCHAR) AS period, CAST({detail} AS VARCHAR) AS detail, round(CAST({metric} AS DOUBLE), 6) AS metric {rest}"


@R.on(
    "det_flat_owner_swing",
    f"WITH {_PANEL}, s AS ({_LAG}) "
    + _select("flat_owner_share_swing", "e", "p", "CASE WHEN io > pio THEN 'up' ELSE 'down' END", "greatest(io / pio, pio / io)", "FROM s WHERE pio > 0 AND pown > 0 AND abs(io / pio - 1) >= 0.2 AND abs(own / pown - 1) <= 0.05"),
)
def _(t):
    return X.flat_owner_swing(_panel(t), "e", "p", "io", "own")


@R.on(
    "det_seasonal",
    f"""WITH {_PANEL}, m AS (SELECT e, month(p) AS m, avg(io) AS a, count(*) AS c FROM panel GROUP BY 1, 2), g AS (SELECT e, sum(c) AS n, count(*) AS k, max(a) AS hi, min(a) AS lo,
        arg_max(m, (a, -m)) AS hm, arg_min(m, (a, m)) AS lm FROM m GROUP BY 1) """
    + _select("seasonal_alternation", "e", "NULL", "'high ' || hm || ' low ' || lm", "hi / lo", "FROM g WHERE n >= 8 AND k >= 2 AND lo > 0 AND hi / lo >= 1.5"),
)
def _(t):
    return X.seasonal(_panel(t), "e", "p", "io")


@R.on(
    "det_split_ratio",
    f"""WITH {_PANEL}, s AS ({_LAG}), f AS (SELECT *, io / pio AS fold FROM s WHERE pio > 0 AND pown > 0 AND abs(own / pown - 1) <= 0.1),
        t AS (SELECT unnest([2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 10.0, 20.0, 28.0]::DOUBLE[]) AS k, unnest(range(9)) AS i),
        u AS (SELECT k, i, 'split' AS label FROM t UNION ALL SELECT k * k, i + 9, 'double-adjusted' FROM t),
        h AS (SELECT f.*, arg_min(label, i) AS label, arg_min(k, i) AS k FROM f JOIN u ON abs(fold - k) / k <= 0.03 WHERE fold >= 1.5 GROUP BY ALL) """
    + _select("split_factor_ratio", "e", "p", "label || ' ' || k", "fold", "FROM h"),
)
def _(t):
    return X.split_ratio(_panel(t), "e", "p", "io", "own")


@R.on(
    "det_unit_break",
    """WITH x AS (SELECT CAST(year(rdate) AS INTEGER) AS y, CASE WHEN year(rdate) >= 2019 THEN assets * 1000 ELSE assets END AS v FROM split_s12 WHERE rdate IS NOT NULL),
       q AS (SELECT y, quantile_cont(v, 0.1) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.9) AS c FROM x WHERE v > 0 GROUP BY 1 HAVING count(*) >= 20),
       r AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb, lag(c) OVER w AS pc FROM q WINDOW w AS (ORDER BY y)),
       s AS (SELECT y, greatest(a / pa, pa / a) AS ra, greatest(b / pb, pb / b) AS rb, greatest(c / pc, pc / c) AS rc FROM r WHERE pb IS NOT NULL) """
    + _select("unit_break", "NULL", "y", "CASE WHEN greatest(ra, rb, rc) / least(ra, rb, rc) <= 3 THEN 'clean' ELSE 'uneven' END", "rb", "FROM s WHERE rb >= 10"),
)
def _(t):
    x = t("split_s12").where("rdate is not null").select(F.year("rdate").alias("y"), F.when(F.year("rdate") >= 2019, F.col("assets") * 1000).otherwise(F.col("assets")).alias("v"))
    return X.unit_break(x, "y", "v")


@R.on(
    "det_coverage_end",
    """WITH l AS (SELECT fundno AS e, max(rdate) AS last FROM split_s12 GROUP BY 1 UNION ALL SELECT NULL, max(rdate) FROM split_s12), g AS (SELECT *, date_diff('day', last, DATE '2025-12-31') AS gap FROM l) """
    + _select("coverage_end", "e", "last", "gap || ' days short'", "gap", "FROM g WHERE gap > 100"),
)
def _(t):
    return X.coverage_end(t("split_s12"), "fundno", "rdate", "2025-12-31")


@R.on("det_owner_dropout", f"WITH {_PANEL}, s AS ({_LAG}) " + _select("owner_dropout", "e", "p", "'owners fell'", "own / pown - 1", "FROM s WHERE pown > 0 AND own / pown - 1 <= -0.5"))
def _(t):
    return X.owner_dropout(_panel(t), "e", "p", "own")


@R.on(
    "det_zero_row_cohort",
    """WITH g AS (SELECT source, CAST(year(filed_date) AS INTEGER) AS y, count(*) AS n, count(*) FILTER (coalesce(n_chars, 0) > 3000) AS big, count(*) FILTER (NOT coalesce(n_chars > 3000, false)) AS z FROM documents GROUP BY 1, 2) """
    + _select("zero_row_cohort", "source", "y", "z || ' of ' || n", "z / n", "FROM g WHERE n >= 10 AND z / n >= 0.9"),
)
def _(t):
    docs = t("documents").withColumn("rows", F.when(F.coalesce("n_chars", F.lit(0)) > 3000, 1).otherwise(0))
    return X.zero_row_cohort(docs, "source", F.year("filed_date"), "rows")


@R.on(
    "det_coverage_step",
    """WITH y AS (SELECT CAST(year(filing_date) AS INTEGER) AS y, count(*) AS n_rows, count(DISTINCT cik) AS n_ciks FROM own_rows WHERE filing_date IS NOT NULL GROUP BY 1),
       l AS (SELECT y, 'n_rows' AS name, n_rows AS n FROM y UNION ALL SELECT y, 'n_ciks', n_ciks FROM y), s AS (SELECT *, lag(n) OVER (PARTITION BY name ORDER BY y) AS pn FROM l) """
    + _select("coverage_step", "name", "y", "'count jumped'", "n / pn - 1", "FROM s WHERE pn > 0 AND abs(n / pn - 1) >= 0.5"),
)
def _(t):
    y = t("own_rows").where("filing_date is not null").groupBy(F.year("filing_date").alias("y")).agg(F.count("*").alias("n_rows"), F.countDistinct("cik").alias("n_ciks"))
    return X.coverage_step(y, "y", ["n_rows", "n_ciks"])


@R.on(
    "det_bridge_rate",
    """WITH g AS (SELECT block AS e, CAST(year(meetingdate) AS INTEGER) AS p, count(sv_for) / count(*) AS r FROM npx_cells WHERE meetingdate IS NOT NULL GROUP BY 1, 2),
       s AS (SELECT *, lag(r) OVER (PARTITION BY e ORDER BY p) AS pr FROM g) """
    + _select("bridge_rate_low", "e", "p", "'few are linked'", "r", "FROM s WHERE r < 0.7 UNION ALL ")
    + _select("bridge_rate_regression", "e", "p", "'fewer are linked than before'", "pr - r", "FROM s WHERE pr - r > 0.1"),
)
def _(t):
    g = t("npx_cells").where("meetingdate is not null").groupBy(F.col("block").alias("e"), F.year("meetingdate").alias("p")).agg(F.count("sv_for").alias("linked"), F.count("*").alias("total"))
    return X.bridge_rate(g, "e", "p", "linked", "total")


@R.on(
    "det_duplicate_grain",
    """WITH g AS (SELECT wficn, rdate, cusip8, count(*) AS n, sum(shares) AS a, arg_min(shares, hold_id) AS one FROM (SELECT * FROM tfn_holdings WHERE shares > 0) GROUP BY 1, 2, 3) """
    + _select("duplicate_grain", "NULL", "NULL", "'excess rows ' || CAST(sum(n - 1) AS BIGINT) || ', inflation ' || round(sum(a) / sum(one), 4)", "count(*) FILTER (n > 1) / count(*)", "FROM g HAVING count(*) FILTER (n > 1) > 0"),
)
def _(t):
    return X.duplicate_grain(t("tfn_holdings").where("shares > 0"), ["wficn", "rdate", "cusip8"], "shares", ["hold_id"])


@R.on(
    "det_unresolved_overlap",
    """WITH k AS (SELECT DISTINCT crsp_fundno FROM mflink_portno), g AS (SELECT CAST(year(rdate) AS INTEGER) AS p, count(*) AS n, count(*) FILTER (coalesce(feed <> 'main_tape', false) AND k.crsp_fundno IS NULL) AS u
       FROM tfn_holdings h LEFT JOIN k ON k.crsp_fundno = h.crsp_fundno GROUP BY 1) """
    + _select("unresolved_overlap", "NULL", "p", "u || ' rows'", "u / n", "FROM g WHERE u > 0.05 * n"),
)
def _(t):
    k = t("mflink_portno").select("crsp_fundno").distinct().withColumn("ok", F.lit(True))
    h = t("tfn_holdings").join(k, "crsp_fundno", "left")
    return X.unresolved_overlap(h, F.year("rdate"), F.coalesce(F.col("feed") != "main_tape", F.lit(False)), F.col("ok").isNotNull())


@R.on(
    "det_calendar_gap",
    """WITH h AS (SELECT CAST(month(rdate) AS INTEGER) AS m, count(*) AS n FROM split_s12 WHERE rdate IS NOT NULL GROUP BY 1), w AS (SELECT unnest([3, 6, 9, 12]) AS m), a AS (SELECT avg(n) AS a FROM h WHERE m IN (3, 6, 9, 12)),
       j AS (SELECT coalesce(h.m, w.m) AS m, n, w.m IS NOT NULL AS want, a FROM h FULL JOIN w ON h.m = w.m CROSS JOIN a),
       k AS (SELECT *, CASE WHEN n IS NULL THEN 'calendar_gap' WHEN NOT want THEN 'calendar_unexpected' WHEN n < 0.5 * a THEN 'calendar_thin' END AS k FROM j)
       SELECT k AS kind, NULL AS entity, CAST(m AS VARCHAR) AS period, coalesce(n, 0) || ' rows' AS detail, round(coalesce(n / a, 0), 6) AS metric FROM k WHERE k IS NOT NULL""",
)
def _(t):
    return X.calendar_gap(t("split_s12"), F.month("rdate"), [3, 6, 9, 12])


@R.on(
    "det_join_gap_cluster",
    """WITH g AS (SELECT CAST(month(meetingdate) AS INTEGER) AS m, avg(CASE WHEN sv_for IS NULL THEN 1.0 ELSE 0 END) AS r FROM npx_cells WHERE meetingdate IS NOT NULL AND year(meetingdate) = 2022 OR month(meetingdate) > 6 AND meetingdate IS NOT NULL GROUP BY 1) """
    + _select("join_gap_cluster", "NULL", "arg_max(m, (r, -m))", "'nulls cluster by month'", "max(r) - min(r)", "FROM g HAVING count(*) >= 2 AND max(r) - min(r) >= 0.05"),
)
def _(t):
    c = t("npx_cells").where("meetingdate is not null and (year(meetingdate) = 2022 or month(meetingdate) > 6)")
    return X.join_gap_cluster(c, F.month("meetingdate"), "sv_for", 0.05)


@R.on(
    "det_join_tail",
    """WITH g AS (SELECT CAST(year(rdate) AS INTEGER) AS p, avg(CASE WHEN year(rdate) < 2021 THEN 0.0 ELSE 1.0 END) AS r FROM tfn_holdings WHERE rdate IS NOT NULL GROUP BY 1), s AS (SELECT max(p) FILTER (r < 0.99) AS ok, count(*) AS k FROM g) """
    + _select("join_tail", "NULL", "min(p)", "count(*) || ' periods'", "count(*)", "FROM g, s WHERE ok IS NOT NULL AND k >= 3 AND p > ok HAVING count(*) >= 2"),
)
def _(t):
    h = t("tfn_holdings").withColumn("joined", F.when(F.year("rdate") < 2021, F.lit(1)))
    return X.join_tail(h, F.year("rdate"), "joined")


@R.on("det_impossible_ratio", _select("impossible_ratio", "permno", "meetingdate", "'over its cap'", "turnout / 100", "FROM meetings WHERE turnout / 100 > 1.0 * (1 + 0.02)"))
def _(t):
    return X.impossible_ratio(t("meetings").withColumn("cap", F.lit(100.0)), "permno", "meetingdate", "turnout", "cap")


@R.on("det_implied_price", f"WITH {_PANEL} " + _select("implied_price", "e", "p", "'implausible price'", "val * 1.0 / io", "FROM panel WHERE io >= 100 AND (val / io < 1000 OR val / io > 3000)"))
def _(t):
    return X.implied_price(_panel(t), "e", "p", "val", "io", low=1000, high=3000, least=100)


@R.on(
    "det_fallback_contam",
    """WITH g AS (SELECT wficn AS e, CAST(year(rdate) AS INTEGER) AS p, sum(CASE WHEN feed = 'hand_keyed' THEN shares END) AS f, sum(shares) AS s FROM tfn_holdings WHERE shares > 0 AND rdate IS NOT NULL GROUP BY 1, 2) """
    + _select("fallback_contamination", "e", "p", "'fallback share'", "coalesce(f, 0) / s", "FROM g WHERE s > 0 AND coalesce(f, 0) / s > 0.05"),
)
def _(t):
    h = t("tfn_holdings").where("shares > 0 and rdate is not null")
    g = h.groupBy(F.col("wficn").alias("e"), F.year("rdate").alias("p")).agg(F.sum(F.when(F.col("feed") == "hand_keyed", F.col("shares"))).cast("double").alias("f"), F.sum("shares").alias("s"))
    return X.fallback_contamination(g, "e", "p", "f", "s")


@R.on("dq_sweep")
def _(t):
    p = _panel(t)
    found, ran = X.sweep(
        {
            "flat_owner_swing": X.flat_owner_swing(p, "e", "p", "io", "own"), "seasonal": X.seasonal(p, "e", "p", "io"), "split_ratio": X.split_ratio(p, "e", "p", "io", "own"),
            "owner_dropout": X.owner_dropout(p, "e", "p", "own"), "bridge_rate": None, "implied_price": X.implied_price(p, "e", "p", "val", "io", least=100),
        }
    )
    counts = found.groupBy("kind").agg(F.count("*").alias("n_findings"), F.count_distinct("entity").alias("n_entities"))
    state = t.spark.createDataFrame(list(ran.items()), "detector string, state string")
    return state.where("state != 'ran'").select(F.col("detector").alias("kind"), F.lit(None).cast("long").alias("n_findings"), F.lit(None).cast("long").alias("n_entities"), "state").unionByName(
        counts.withColumn("state", F.lit("ran"))
    )


# --- gates, hashes, comparisons -----------------------------------------------------------------------------------


@R.on(
    "dq_prereq_gate",
    """SELECT 'orders' AS "table", 'missing part ' || y AS problem FROM (SELECT unnest(range(1994, 2004)) AS y) WHERE y NOT IN (SELECT year(o_orderdate) FROM orders)""",
)
def _(t):
    return Q.prerequisites({"orders": t("orders"), "part": t("part")}, {"orders": (F.year("o_orderdate").cast("long"), list(range(1994, 2004)))})


@R.on("dq_universe_gate", "SELECT crsp_fundno, count(*) AS n_rows FROM tfn_holdings WHERE crsp_fundno IS NOT NULL AND crsp_fundno NOT IN (SELECT crsp_fundno FROM portnomap WHERE crsp_fundno IS NOT NULL AND begdt < DATE '2016-01-01') GROUP BY 1")
def _(t):
    return Q.orphans(t("tfn_holdings"), t("portnomap").where("begdt < date '2016-01-01'"), "crsp_fundno")


@R.on(
    "dq_denominator_diag",
    """SELECT count(*) AS n, count(*) FILTER (sv_for > sv_against * 1.1) AS a_over_10pct, count(*) FILTER (sv_against > sv_for * 1.1) AS b_over_10pct, count(*) FILTER (sv_for > sv_against * 3) AS a_over_3x,
       count(*) FILTER (sv_against > sv_for * 3) AS b_over_3x FROM npx_cells WHERE sv_for > 0 AND sv_against > 0""",
)
def _(t):
    return Q.denominators(t("npx_cells"), "sv_for", "sv_against")


@R.on("dq_canonical_hash")
def _(t):
    return Q.content_hash(t("npx_cells").drop("loadts"))


@R.on("dq_fingerprint")
def _(t):
    return Q.content_hash(t("orders").select("o_orderkey"))


@R.on("dq_profile", "SELECT 'p_size' AS \"column\", 0 AS nulls, round(CAST(sum(p_size) AS DOUBLE), 6) AS total, CAST(min(p_size) AS VARCHAR) AS low, CAST(max(p_size) AS VARCHAR) AS high, count(DISTINCT p_size) AS n_unique FROM part UNION ALL SELECT 'p_type', 0, NULL, min(p_type), max(p_type), count(DISTINCT p_type) FROM part")
def _(t):
    return Q.profile(t("part").select("p_size", "p_type"))


@R.on("dq_report_diff", "SELECT 'c_acctbal' AS \"column\", 'total,high' AS differs")
def _(t):
    a = t("customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    top = a.agg(F.max("c_acctbal")).first()[0]
    return Q.profile_diff(a, a.withColumn("c_acctbal", F.when(F.col("c_acctbal") == top, top + 1).otherwise(F.col("c_acctbal"))))


@R.on("dq_compare_frames", "SELECT 'c_acctbal' AS \"column\", 0 AS only_a, count(*) FILTER (c_custkey = 1) AS only_b, count(*) FILTER (c_custkey % 10 = 0) AS differing FROM customer")
def _(t):
    b = t("customer").select("c_custkey", "c_acctbal")
    a = b.where("c_custkey != 1").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return Q.compare_on(a, b, ["c_custkey"])


@R.on(
    "dq_reconcile",
    """SELECT CAST(year(rdate) AS INTEGER) AS y, count(*) AS total, count(crsp_fundno) + count(*) FILTER (crsp_fundno IS NULL) AS parts FROM tfn_holdings GROUP BY 1""",
)
def _(t):
    tier = F.when(F.col("crsp_fundno").isNull(), "unlinked").otherwise("linked")
    parts = t("tfn_holdings").groupBy(F.year("rdate").alias("y"), tier.alias("tier")).agg(F.count("*").alias("n"))
    total = t("tfn_holdings").groupBy(F.year("rdate").alias("y")).agg(F.count("*").alias("total"))
    summed = parts.groupBy(F.col("y").alias("_y")).agg(F.sum("n").alias("parts"))
    return total.join(summed, F.col("y").eqNullSafe(F.col("_y"))).drop("_y")


@R.on("dq_closed_vocab", "SELECT feed, count(*) AS n FROM tfn_holdings WHERE feed NOT IN ('main_tape', 'vendor_mirror') GROUP BY 1")
def _(t):
    return Q.closed_vocabulary(t("tfn_holdings"), "feed", ["main_tape", "vendor_mirror"])
