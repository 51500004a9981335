"""Time-series and tick queries over ``events`` (purchases as trades, views as quotes)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marlstone.operators import joins as J
from marlstone.operators import ticks as T
from marlstone.plans.registry import Registry

R = Registry()
_BIN = "to_timestamp((floor(epoch_us(ts) / 900000000) + 1) * 900)::TIMESTAMP"


def _trades(t):
    return t("events").where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.col("value").alias("px"), F.get_json_object("props", "$.k").cast("double").alias("sz"))


_TRADES = "(SELECT *, value AS px, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS sz FROM events WHERE event_type = 'purchase')"


@R.on(
    "ts_vwap",
    f"SELECT user_id, timezone('UTC', to_timestamp((floor(epoch_us(ts) / 900000000) + 1) * 900)) AS bin_end, round(sum(px * sz) / sum(sz), 6) AS vwap, sum(sz) AS volume FROM {_TRADES} WHERE sz > 0 GROUP BY 1, 2",
)
def _(t):
    return T.vwap(_trades(t), "user_id", "ts", "px", "sz").withColumn("vwap", F.round("vwap", 6))


@R.on("ts_last_in_bin", "SELECT user_id, timezone('UTC', to_timestamp((floor(epoch_us(ts) / 900000000) + 1) * 900)) AS bin_end, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2")
def _(t):
    return T.last_in_bin(t("events").where("event_type = 'view'"), "user_id", "ts", "event_id", "value")


@R.on(
    "ts_transpose",
    """SELECT user_id, arg_max(value, (ts, event_id)) FILTER (hour(ts) < 8) AS night, arg_max(value, (ts, event_id)) FILTER (hour(ts) >= 8 AND hour(ts) < 16) AS day,
       arg_max(value, (ts, event_id)) FILTER (hour(ts) >= 16) AS evening FROM events GROUP BY 1""",
)
def _(t):
    part = F.when(F.hour("ts") < 8, "night").when(F.hour("ts") < 16, "day").otherwise("evening")
    e = t("events").withColumn("part", part)
    return e.groupBy("user_id").pivot("part", ["night", "day", "evening"]).agg(F.max_by("value", F.struct("ts", "event_id")))


@R.on(
    "ts_latency_match",
    """SELECT p.event_id AS trade_id, v.event_id AS quote_id FROM (SELECT *, ts - INTERVAL 30 SECOND AS at FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.at >= v.ts""",
)
def _(t):
    p = _trades(t).select(F.col("event_id").alias("trade_id"), "user_id", (F.col("ts") - F.expr("interval 30 seconds")).alias("at"))
    v = t("events").where("event_type = 'view'").select(F.col("event_id").alias("quote_id"), "user_id", F.col("ts").alias("qts"))
    return J.asof_backward(p, v, "user_id", "at", "qts", ["quote_id"], ["quote_id"]).select("trade_id", "quote_id")


@R.on(
    "ts_multi_observer_book",
    """WITH q AS (SELECT *, event_type AS venue, epoch_us(ts) + CASE event_type WHEN 'click' THEN 1500 ELSE 800 END AS t FROM events WHERE event_type IN ('click', 'view')),
       s AS (SELECT a.event_id, a.t, a.user_id, b.venue, max((b.t, b.value, b.value + 1)) AS x FROM q a JOIN q b ON a.user_id = b.user_id AND b.t <= a.t GROUP BY 1, 2, 3, 4)
       SELECT event_id, t AS observed_us, max(x[2]) AS best_bid, min(x[3]) AS best_ask FROM s GROUP BY 1, 2""",
)
def _(t):
    q = t("events").where("event_type in ('click', 'view')").select("event_id", "user_id", "ts", F.col("event_type").alias("venue"), F.col("value").alias("bid"), (F.col("value") + 1).alias("ask"))
    delays = t.spark.createDataFrame([("click", 1500), ("view", 800)], "venue string, delay_us long")
    return T.best_quotes(q, delays, "user_id", "ts", "venue", "bid", "ask").select("event_id", "observed_us", "best_bid", "best_ask")


@R.on("ts_closing_trade", "SELECT a.event_id, b.value AS next_value FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_type = 'purchase'")
def _(t):
    a = t("events").where("event_type = 'purchase'").select("event_id", (F.col("event_id") + 1).alias("seq"))
    return a.join(t("events").select(F.col("event_id").alias("seq"), F.col("value").alias("next_value")), "seq").select("event_id", "next_value")


@R.on("ts_auction_trades", "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INTEGER) IN (6, 9, 16) AND hour(ts) >= 16")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t("events").where((F.col("event_type") == "purchase") & k.isin(6, 9, 16) & (F.hour("ts") >= 16)).select("event_id", "value")


@R.on("ts_order_imbalance", f"SELECT user_id, CAST(ts AS DATE) AS day, round((sum(CASE WHEN px > 10 THEN sz ELSE 0 END) - sum(CASE WHEN px <= 10 THEN sz ELSE 0 END)) / nullif(sum(sz), 0), 6) AS imbalance FROM {_TRADES} GROUP BY 1, 2")
def _(t):
    trades = _trades(t).withColumn("day", F.col("ts").cast("date"))
    return T.order_imbalance(trades, ["user_id", "day"], F.col("px") > 10, "sz").withColumn("imbalance", F.round("imbalance", 6))


@R.on("ts_anchor", "SELECT user_id AS key, max(value) AS anchor FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1")
def _(t):
    e = t("events").select(F.col("user_id").alias("key"), F.col("ts").cast("date").alias("date"), "value")
    return T.anchors(e, "key", "date", "value", "2024-01-15")


def _spliced(t):
    daily = t("events").groupBy(F.col("user_id").alias("key"), F.col("ts").cast("date").alias("date")).agg(
        F.round(F.sum("value"), 2).alias("price"), ((F.count("*") - 3) / 97.0).alias("ret"), F.max("value").alias("cap")
    )
    vendor = daily.select(F.concat(F.lit("c"), "key").alias("code"), "date", F.round(F.col("price") * 2, 4).alias("price"), "ret")
    links = daily.select("key").distinct().select("key", F.concat(F.lit("c"), "key").alias("code"), (F.col("key") % 5 != 0).alias("usable"))
    return T.splice(daily, vendor, links, "2024-01-15"), links


_SPLICE = """WITH d AS (SELECT user_id AS k, CAST(ts AS DATE) AS d, round(sum(value), 2) AS p, (count(*) - 3) / 97.0 AS r, max(value) AS c FROM events GROUP BY 1, 2),
    a AS (SELECT k, p AS p0, c AS c0, round(p * 2, 4) AS v0 FROM d WHERE d = DATE '2024-01-15' AND k % 5 <> 0),
    n AS (SELECT d.k, d.d, a.p0 * exp(sum(ln(1 + r)) OVER (PARTITION BY d.k ORDER BY d.d)) AS p, r, c0 * round(d.p * 2, 4) / v0 AS c, p0 / v0 AS ratio FROM d JOIN a USING (k) WHERE d.d > DATE '2024-01-15'),
    s AS (SELECT k, d, p, r, c, NULL AS ratio, 'base' AS source FROM d WHERE d <= DATE '2024-01-15' UNION ALL SELECT k, d, p, r, c, ratio, 'vendor' FROM n)"""


@R.on("ts_splice", _SPLICE + " SELECT k AS \"key\", d AS \"date\", round(p, 6) AS price, round(r, 6) AS ret, round(c, 6) AS cap, round(ratio, 6) AS adj_ratio, source FROM s")
def _(t):
    s, _ = _spliced(t)
    return s.select("key", "date", *[F.round(c, 6).alias(c) for c in ("price", "ret", "cap", "adj_ratio")], "source")


@R.on(
    "ts_coverage",
    _SPLICE
    + """, l AS (SELECT DISTINCT k, k % 5 <> 0 AS usable FROM d), f AS (SELECT k, arg_min(r, d) AS sr, max(ratio) AS ratio FROM s WHERE source = 'vendor' GROUP BY 1)
    SELECT count(*) AS n_links, count(*) FILTER (usable) AS n_usable, count(sr) AS n_continued, count(*) FILTER (abs(sr) > 0.25) AS n_seam_outliers,
    count(*) FILTER (abs(ratio - 1) > 0.02) AS n_off_basis FROM l LEFT JOIN f USING (k)""",
)
def _(t):
    s, links = _spliced(t)
    return T.splice_coverage(s, links, "2024-01-15")


@R.on("ts_pit_membership", "SELECT p.map_id, p.crsp_fundno FROM portnomap p WHERE p.begdt <= DATE '2018-06-30' AND coalesce(p.enddt, DATE '9999-12-31') >= DATE '2018-06-30' AND p.loaddt <= DATE '2018-06-30'")
def _(t):
    day = F.lit(dt.date(2018, 6, 30))
    return t("portnomap").where((F.col("begdt") <= day) & (F.coalesce("enddt", F.lit(dt.date(9999, 12, 31))) >= day) & (F.col("loaddt") <= day)).select("map_id", "crsp_fundno")


@R.on(
    "ts_event_preagg",
    """WITH m AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1, 2)
       SELECT c_custkey, m AS month, total, n FROM customer JOIN m ON o_custkey = c_custkey WHERE c_acctbal > 0""",
)
def _(t):
    m = t("orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.trunc("o_orderdate", "month").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))
    return t("customer").where("c_acctbal > 0").select("c_custkey").join(m, "c_custkey")


@R.on(
    "ts_crsp_taq_merge",
    """SELECT h.hold_id, m.link_id, p.map_id, s.n_s12 FROM tfn_holdings h LEFT JOIN mflink_portno m ON m.wficn = h.wficn AND m.crsp_fundno = h.crsp_fundno AND h.rdate BETWEEN m.linkb AND m.linke
       LEFT JOIN portnomap p ON p.crsp_fundno = h.crsp_fundno AND h.rdate BETWEEN p.begdt AND p.enddt
       LEFT JOIN (SELECT cusip, min(rdate) AS lo, max(rdate) AS hi, count(*) AS n_s12 FROM split_s12 GROUP BY 1) s ON s.cusip = h.cusip8 AND h.rdate BETWEEN s.lo AND s.hi""",
)
def _(t):
    h = t("tfn_holdings").select("hold_id", "wficn", "crsp_fundno", "rdate", "cusip8")
    m = t("mflink_portno").select("link_id", F.col("wficn").alias("w"), F.col("crsp_fundno").alias("f"), "linkb", "linke")
    p = t("portnomap").select("map_id", F.col("crsp_fundno").alias("g"), "begdt", "enddt")
    s = t("split_s12").groupBy("cusip").agg(F.min("rdate").alias("lo"), F.max("rdate").alias("hi"), F.count("*").alias("n_s12"))
    r = F.col("rdate")
    out = h.join(m, (F.col("w") == F.col("wficn")) & (F.col("f") == F.col("crsp_fundno")) & r.between(F.col("linkb"), F.col("linke")), "left")
    out = out.join(p, (F.col("g") == F.col("crsp_fundno")) & r.between(F.col("begdt"), F.col("enddt")), "left")
    out = out.join(s, (F.col("cusip") == F.col("cusip8")) & r.between(F.col("lo"), F.col("hi")), "left")
    return out.select("hold_id", "link_id", "map_id", "n_s12")


@R.on("ts_adaptive_slices")
def _(t):
    slices = T.adaptive_slices(t("events"), F.col("ts").cast("date"), 1500)
    return t.spark.createDataFrame(slices, "first string, last string, n long")
