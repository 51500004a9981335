"""Aggregations and window functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import aggregates as A
from marlstone.operators import windows as W
from marlstone.plans.registry import Registry

R = Registry()

_Q = "last_day(CAST(date_trunc('quarter', {0}) AS DATE) + INTERVAL 2 MONTH)"
_SHIPQ = _Q.format("l_shipdate")

# --- aggregation -------------------------------------------------------------------------------------------------


@R.on("agg_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_discount), 6) AS disc, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1, 2")
def _(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi")
    )


@R.on("agg_count_distinct", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_owners FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n_owners"))


@R.on("agg_approx_distinct")
def _(t):
    return t("events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("n_users"))


@R.on("agg_conditional", "SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 0) AS n_negative, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END), 2) AS credit FROM customer GROUP BY 1")
def _(t):
    return t("customer").groupBy("c_mktsegment").agg(
        F.count_if(F.col("c_acctbal") < 0).alias("n_negative"), F.round(F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(0.0)), 2).alias("credit")
    )


@R.on("agg_partial_final", "SELECT l_partkey, sum(l_quantity) AS total, sum(l_quantity * l_quantity) AS squares, max(l_quantity) AS top FROM lineitem GROUP BY 1")
def _(t):
    by_year = t("lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("y")).agg(
        F.sum("l_quantity").alias("s"), F.sum(F.col("l_quantity") * F.col("l_quantity")).alias("q"), F.max("l_quantity").alias("m")
    )
    return by_year.groupBy("l_partkey").agg(F.sum("s").alias("total"), F.sum("q").alias("squares"), F.max("m").alias("top"))


@R.on("agg_hhi", "SELECT l_partkey, round(sum(l_quantity * l_quantity) / (sum(l_quantity) * sum(l_quantity)), 9) AS hhi FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_partkey").agg(F.round(A.hhi("l_quantity"), 9).alias("hhi"))


@R.on(
    "agg_hash_accumulator",
    """SELECT itemonagendaid, block, sum(n_rows)::BIGINT AS n_rows, sum(n_for)::BIGINT AS n_for, sum(n_against)::BIGINT AS n_against, sum(n_abstain + n_other)::BIGINT AS n_rest,
       round(sum(coalesce(tna_for, 0)), 2) AS tna_for, count(*) FILTER (WHERE sv_for IS NULL) AS n_no_sv FROM npx_cells GROUP BY 1, 2""",
)
def _(t):
    s = lambda c: F.sum(c)
    return t("npx_cells").groupBy("itemonagendaid", "block").agg(
        s("n_rows").alias("n_rows"), s("n_for").alias("n_for"), s("n_against").alias("n_against"), s(F.col("n_abstain") + F.col("n_other")).alias("n_rest"),
        F.round(F.sum(F.coalesce("tna_for", F.lit(0.0))), 2).alias("tna_for"), F.count_if(F.col("sv_for").isNull()).alias("n_no_sv"),
    )


@R.on("agg_recombine", "SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1")
def _(t):
    split = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return split.groupBy("l_orderkey").agg(F.sum("q").alias("qty"))


@R.on("agg_modal", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1")
def _(t):
    return A.modal(t("events"), ["user_id"], "event_type")


@R.on("agg_arg_max", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS largest FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("largest"))


@R.on("agg_first_last", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY 1")
def _(t):
    at = F.struct("ts", "event_id")
    return t("events").groupBy("user_id").agg(F.min_by("event_id", at).alias("first_id"), F.max_by("event_id", at).alias("last_id"))


@R.on(
    "agg_last_non_null",
    """SELECT cik, arg_max(shares, (filing_date, own_row)) FILTER (WHERE shares IS NOT NULL AND filing_date IS NOT NULL) AS shares,
       arg_max(share_class, (filing_date, own_row)) FILTER (WHERE share_class IS NOT NULL AND filing_date IS NOT NULL) AS share_class FROM own_rows GROUP BY cik""",
)
def _(t):
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & F.col("filing_date").isNotNull(), F.struct("filing_date", "own_row"))).alias(c)
    return t("own_rows").groupBy("cik").agg(last("shares"), last("share_class"))


@R.on("agg_span", "SELECT crsp_fundno, min(begdt) AS first_day, max(enddt) AS last_day, count(DISTINCT begdt) AS n_spans FROM portnomap GROUP BY 1")
def _(t):
    return t("portnomap").groupBy("crsp_fundno").agg(F.min("begdt").alias("first_day"), F.max("enddt").alias("last_day"), F.countDistinct("begdt").alias("n_spans"))


@R.on("agg_max_flag", "SELECT cik, max(f) AS any_ceo, CAST(sum(f) AS BIGINT) AS n_years FROM (SELECT cik, year(filed_date) AS y, max(CASE WHEN is_ceo THEN 1 ELSE 0 END) AS f FROM s1_persons GROUP BY 1, 2) GROUP BY cik")
def _(t):
    year = t("s1_persons").groupBy("cik", F.year("filed_date").alias("y")).agg(F.max(F.when(F.col("is_ceo"), 1).otherwise(0)).alias("f"))
    return year.groupBy("cik").agg(F.max("f").alias("any_ceo"), F.sum("f").alias("n_years"))


@R.on(
    "agg_collect_set",
    """WITH a AS (SELECT crsp_fundno, list(DISTINCT crsp_portno) AS x FROM portnomap GROUP BY 1), b AS (SELECT crsp_fundno, list(DISTINCT crsp_portno) AS y FROM mflink_portno GROUP BY 1)
       SELECT crsp_fundno, list_has_any(x, y) AS agrees, len(x) AS n FROM a JOIN b USING (crsp_fundno)""",
)
def _(t):
    s = lambda n, c: t(n).groupBy("crsp_fundno").agg(F.collect_set("crsp_portno").alias(c))
    both = s("portnomap", "x").join(s("mflink_portno", "y"), "crsp_fundno")
    return both.select("crsp_fundno", F.arrays_overlap("x", "y").alias("agrees"), F.size("x").alias("n"))


@R.on("agg_string", "SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part GROUP BY 1")
def _(t):
    return t("part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"))


@R.on("agg_percentile", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def _(t):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return t("events").groupBy("event_type").agg(p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.99).alias("p99"))


@R.on(
    "agg_weighted_mean",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS v, count(*) AS w FROM events GROUP BY 1, 2),
       l AS (SELECT *, lag(w) OVER (PARTITION BY user_id ORDER BY day) AS lw FROM d)
       SELECT day, round(sum(v * lw) / sum(lw), 9) AS weighted FROM l WHERE lw IS NOT NULL GROUP BY day""",
)
def _(t):
    d = t("events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("v"), F.count("*").alias("w"))
    d = d.withColumn("lw", F.lag("w").over(Window.partitionBy("user_id").orderBy("day"))).where("lw is not null")
    return d.groupBy("day").agg(F.round(A.weighted_mean("v", "lw"), 9).alias("weighted"))


@R.on("agg_having_extreme", "SELECT wficn, hold_id FROM tfn_holdings t WHERE fdate = (SELECT max(fdate) FROM tfn_holdings u WHERE u.wficn = t.wficn)")
def _(t):
    h = t("tfn_holdings").select("wficn", "hold_id", "fdate")
    last = h.groupBy("wficn").agg(F.max("fdate").alias("fdate"))
    return h.join(last, ["wficn", "fdate"]).select("wficn", "hold_id")


@R.on("agg_distinct", "SELECT DISTINCT agendageneraldesc, voteresult FROM npx_items")
def _(t):
    return t("npx_items").select("agendageneraldesc", "voteresult").distinct()


@R.on("agg_value_counts", "SELECT p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1")
def _(t):
    return A.value_counts(t("part"), "p_type")


@R.on("agg_describe", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("event_type").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"),
        F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"),
    )


@R.on("agg_cut_bins", "SELECT CASE WHEN l_quantity <= 10 THEN '1-10' WHEN l_quantity <= 25 THEN '11-25' ELSE '26+' END AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    b = F.when(F.col("l_quantity") <= 10, "1-10").when(F.col("l_quantity") <= 25, "11-25").otherwise("26+")
    return t("lineitem").groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


_PAIR = "SELECT a.label <> 'clean' AS t, b.label <> 'clean' AS g FROM doc_labels a JOIN doc_labels b ON a.doc_id = b.doc_id AND a.reviewer < b.reviewer"
_CONF = f"SELECT count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn, count(*) FILTER (NOT t AND NOT g) AS tn FROM ({_PAIR})"


def _reviewers(t):
    a = t("doc_labels").select("doc_id", F.col("reviewer").alias("ra"), (F.col("label") != "clean").alias("t"))
    b = t("doc_labels").select("doc_id", F.col("reviewer").alias("rb"), (F.col("label") != "clean").alias("g"))
    return a.join(b, "doc_id").where("ra < rb")


@R.on(
    "agg_confusion",
    f"""SELECT *, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy FROM ({_CONF})""",
)
def _(t):
    return A.confusion(_reviewers(t), F.col("t"), F.col("g"))


@R.on(
    "agg_kappa_wilson",
    f"""WITH c AS ({_CONF}), n AS (SELECT *, CAST(tp + fp + fn + tn AS DOUBLE) AS n FROM c), p AS (SELECT n, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM n)
       SELECT round((po - pe) / (1 - pe), 6) AS kappa,
       round((po + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(po * (1 - po) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 6) AS wilson_low,
       round((po + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(po * (1 - po) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 6) AS wilson_high FROM p""",
)
def _(t):
    return A.kappa_wilson(A.confusion(_reviewers(t), F.col("t"), F.col("g")))


@R.on("agg_bootstrap_ci")
def _(t):
    return A.bootstrap_kappa(_reviewers(t), F.col("t"), F.col("g"))


@R.on("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def _(t):
    """Extension: not in the reference."""
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    return t("lineitem").groupingSets([[f], [s], []], f, s).agg(F.count("*").alias("n"))


@R.on("agg_cube", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    """Extension: not in the reference."""
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))


@R.on("agg_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def _(t):
    """Extension: not in the reference."""
    return t("customer").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@R.on("agg_pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS \"view\", count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.count("event_id")).fillna(0)


@R.on("agg_unpivot", "SELECT cell_row, 'n_for' AS vote, n_for AS n FROM npx_cells UNION ALL SELECT cell_row, 'n_against', n_against FROM npx_cells UNION ALL SELECT cell_row, 'n_abstain', n_abstain FROM npx_cells")
def _(t):
    return t("npx_cells").unpivot(["cell_row"], ["n_for", "n_against", "n_abstain"], "vote", "n")


@R.on(
    "agg_day_key_ledger",
    """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS calls, count(*) FILTER (value >= 10) AS billed, count(*) FILTER (value < 10) AS hits,
       round(sum(CASE WHEN value >= 10 THEN value ELSE 0 END), 4) AS cost, round(sum(CASE WHEN value < 10 THEN value ELSE 0 END), 4) AS saved FROM events GROUP BY 1, 2""",
)
def _(t):
    return A.ledger(t("events"), F.col("ts").cast("date"), "event_type", F.col("value") < 10, F.col("value"), F.col("value"))


@R.on(
    "agg_outcomes",
    """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY reviewer DESC) AS rn FROM doc_labels) WHERE rn = 1),
       s AS (SELECT l.*, coalesce(d.source, 'none') AS source FROM l JOIN documents d USING (doc_id)),
       n AS (SELECT source, label, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, label) AS rn FROM s WHERE label <> 'clean' GROUP BY 1, 2)
       SELECT source, count(*) AS n, round(avg(CASE WHEN label <> 'clean' THEN 1.0 ELSE 0.0 END), 6) AS rate,
       (SELECT string_agg(label, '|' ORDER BY n.rn) FROM n WHERE n.source = s.source AND n.rn <= 3) AS top FROM s GROUP BY source""",
)
def _(t):
    from marlstone.operators.dedup import first_of, top

    latest = first_of(t("doc_labels"), ["doc_id"], [F.desc("reviewer")]).select("doc_id", "label")
    s = latest.join(t("documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source")), "doc_id")
    n = s.where("label <> 'clean'").groupBy("source", "label").agg(F.count("*").alias("n"))
    best = top(n, ["source"], [F.desc("n"), F.asc("label")], 3).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rn", "label"))).alias("x"))
    best = best.select("source", F.array_join(F.transform("x", lambda r: r["label"]), "|").alias("top"))
    rate = F.round(F.avg(F.when(F.col("label") != "clean", 1.0).otherwise(0.0)), 6)
    return s.groupBy("source").agg(F.count("*").alias("n"), rate.alias("rate")).join(best, "source", "left")


# --- windows -----------------------------------------------------------------------------------------------------


@R.on("win_row_number", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events")
def _(t):
    return t("events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rn"))


@R.on("win_rank_in_group", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS pos FROM part")
def _(t):
    return t("part").select("p_partkey", (F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")) - 1).alias("pos"))


@R.on("win_lag_lead", "SELECT event_id, lag(event_id) OVER w AS prev_id, lead(event_id) OVER w AS next_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.lag("event_id").over(w).alias("prev_id"), F.lead("event_id").over(w).alias("next_id"))


_HOLD = "SELECT DISTINCT l_suppkey, l_partkey, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS INTEGER) AS q FROM lineitem"


@R.on(
    "win_gap_markers",
    f"""SELECT l_suppkey, l_partkey, q, coalesce(q - lag(q) OVER w > 1, true) AS is_first, coalesce(lead(q) OVER w - q > 1, true) AS is_last FROM ({_HOLD})
        WINDOW w AS (PARTITION BY l_suppkey, l_partkey ORDER BY q)""",
)
def _(t):
    held = t("lineitem").select("l_suppkey", "l_partkey", S.quarter_index("l_shipdate").alias("q")).distinct()
    return W.gap_markers(held, ["l_suppkey", "l_partkey"], "q")


@R.on(
    "win_dbreadth",
    f"""WITH h AS ({_HOLD}), k AS (SELECT DISTINCT l_suppkey, q FROM h),
        m AS (SELECT *, coalesce(q - lag(q) OVER w > 1, true) AS f, coalesce(lead(q) OVER w - q > 1, true) AS l FROM k WINDOW w AS (PARTITION BY l_suppkey ORDER BY q)),
        p AS (SELECT l_partkey, q, count(*) AS own, count(*) FILTER (f) AS new, count(*) FILTER (l) AS old FROM h JOIN m USING (l_suppkey, q) GROUP BY 1, 2),
        n AS (SELECT q, count(DISTINCT l_suppkey) AS n FROM h GROUP BY 1),
        j AS (SELECT p.*, n.n FROM p JOIN n USING (q))
        SELECT l_partkey, q, round(((own - new) - lag(own - old) OVER w) / lag(n) OVER w, 6) AS dbreadth FROM j WINDOW w AS (PARTITION BY l_partkey ORDER BY q)""",
)
def _(t):
    held = t("lineitem").select("l_suppkey", "l_partkey", S.quarter_index("l_shipdate").alias("q")).distinct()
    return W.breadth_change(held, "l_partkey", "l_suppkey", "q").withColumn("dbreadth", F.round("dbreadth", 6))


_DAY = "SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS v, count(*) AS n FROM events GROUP BY 1, 2"


def _days(t):
    return t("events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"), F.count("*").alias("n"))


@R.on("win_change_flag", f"SELECT user_id, day, coalesce(n <> lag(n) OVER (PARTITION BY user_id ORDER BY day), false) AS changed FROM ({_DAY})")
def _(t):
    return W.change_flag(_days(t), ["user_id"], "day", "n", "changed").select("user_id", "day", "changed")


@R.on(
    "win_neighbourhood",
    f"""SELECT user_id, day, coalesce(lag(f) OVER w, false) OR f OR coalesce(lead(f) OVER w, false) AS near FROM (SELECT *, n >= 6 AS f FROM ({_DAY})) WINDOW w AS (PARTITION BY user_id ORDER BY day)""",
)
def _(t):
    return W.neighbourhood(_days(t).withColumn("f", F.col("n") >= 6), ["user_id"], "day", "f", "near").select("user_id", "day", "near")


@R.on("win_running_total", f"SELECT user_id, day, round(sum(v) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS total FROM ({_DAY})")
def _(t):
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return _days(t).select("user_id", "day", F.round(F.sum("v").over(w), 4).alias("total"))


@R.on("win_moving_avg", f"SELECT user_id, day, round(avg(v) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS avg7 FROM ({_DAY})")
def _(t):
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(-6, 0)
    return _days(t).select("user_id", "day", F.round(F.avg("v").over(w), 4).alias("avg7"))


@R.on(
    "win_rolling_std",
    """SELECT event_id, CASE WHEN count(value) OVER w >= 24 THEN round(stddev_samp(value) OVER w, 5) END AS std60 FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
)
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-59, 0)
    return t("events").select("event_id", F.when(F.count("value").over(w) >= 24, F.round(F.stddev_samp("value").over(w), 5)).alias("std60"))


@R.on("win_last_value", "SELECT event_id, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM events")
def _(t):
    last = t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("final"))
    return t("events").select("event_id", "user_id").join(last, "user_id").select("event_id", "final")


@R.on("win_partition_agg", "SELECT l_orderkey, l_linenumber, l_quantity, n FROM lineitem JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) USING (l_orderkey)")
def _(t):
    n = t("lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("n"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(n, "l_orderkey")


@R.on(
    "win_cumprod",
    f"""SELECT user_id, day, round(100 * exp(sum(ln(1 + r)) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING)), 5) AS price FROM (SELECT user_id, day, (n - 3) / 100.0 AS r FROM ({_DAY}))""",
)
def _(t):
    d = _days(t).withColumn("r", (F.col("n") - 3) / 100.0)
    return W.cumulative_product(d, ["user_id"], "day", "r", 100.0, "price").select("user_id", "day", F.round("price", 5).alias("price"))


@R.on("win_smooth_flips")
def _(t):
    yearly = t("own_rows").where("filing_date is not null").groupBy("cik", F.year("filing_date").alias("y")).agg(F.max_by("parser", "own_row").alias("state"))
    return W.smooth_flips(yearly, "cik", "y", "state")


@R.on("win_percent_within", "SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS share FROM supplier")
def _(t):
    return t("supplier").select("s_suppkey", F.round(F.col("s_acctbal") / F.sum("s_acctbal").over(Window.partitionBy("s_nationkey")), 6).alias("share"))


@R.on(
    "win_top_margin",
    """WITH m AS (SELECT o_custkey, o_orderpriority AS unit, max(o_totalprice) AS score FROM orders GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, unit) AS rn, lead(score) OVER (PARTITION BY o_custkey ORDER BY score DESC, unit) AS nxt FROM m)
       SELECT o_custkey, unit, round(score - coalesce(nxt, 0), 2) AS margin FROM r WHERE rn = 1""",
)
def _(t):
    s = t("orders").select("o_custkey", F.col("o_orderpriority").alias("unit"), F.col("o_totalprice").alias("score"))
    return W.best_with_margin(s, "o_custkey", "unit", "score").select("o_custkey", "unit", F.round("margin", 2).alias("margin"))


@R.on(
    "win_tail_run",
    """WITH q AS (SELECT block, CAST(date_trunc('quarter', meetingdate) AS DATE) AS q, count(sv_for) AS n FROM npx_cells WHERE meetingdate IS NOT NULL GROUP BY 1, 2),
       l AS (SELECT block, max(q) FILTER (n > 0) AS last_seen FROM q GROUP BY 1)
       SELECT block, count(*) FILTER (q.q > coalesce(l.last_seen, DATE '1900-01-01')) AS tail FROM q JOIN l USING (block) GROUP BY block""",
)
def _(t):
    q = t("npx_cells").where("meetingdate is not null").groupBy("block", F.trunc("meetingdate", "quarter").alias("q")).agg(F.count("sv_for").alias("n"))
    return W.tail_run(q, "block", "q", F.col("n") > 0, "tail")


@R.on(
    "win_winsorize",
    """WITH c AS (SELECT event_type, CASE WHEN count(*) FILTER (value <> 0) >= 10 THEN quantile_cont(value, 0.99) END AS cap FROM events GROUP BY 1)
       SELECT event_id, round(CASE WHEN cap IS NULL THEN value ELSE least(value, cap) END, 6) AS capped FROM events JOIN c USING (event_type)""",
)
def _(t):
    return W.winsorize(t("events"), "event_type", "value", 0.99, 10, "capped").select("event_id", F.round("capped", 6).alias("capped"))


@R.on("win_rank", "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS q, round(cume_dist() OVER w, 6) AS c FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)")
def _(t):
    """Extension: rank, dense_rank, ntile and cume_dist are in no program of the reference."""
    w = Window.partitionBy("c_mktsegment").orderBy("c_nationkey")
    q = F.ntile(4).over(Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey"))
    return t("customer").select("c_custkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), q.alias("q"), F.round(F.cume_dist().over(w), 6).alias("c"))
