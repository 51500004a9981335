"""Projections, filters, joins, set operations, ordering and deduplication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import dedup as D
from marlstone.operators import joins as J
from marlstone.plans.registry import Registry

R = Registry()

# --- projection and filters --------------------------------------------------------------------------------------


@R.on("prj_select", "SELECT l_orderkey AS order_id, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def _(t):
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return t("lineitem").select(F.col("l_orderkey").alias("order_id"), "l_partkey", net.alias("net"))


@R.on("flt_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'")
def _(t):
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("1997-01-01", "1997-12-31"))
    return t("orders").where(F.col("o_orderdate").between(lo, hi)).select("o_orderkey", "o_totalprice")


@R.on("flt_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t):
    return t("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


def _universe():
    """The one predicate both legs of a panel must share."""
    return (F.col("o_totalprice") > 1000) & (F.col("o_orderstatus") != "P")


@R.on(
    "flt_universe",
    """SELECT l.l_orderkey, count(*) AS n_lines FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
       WHERE o.o_totalprice > 1000 AND o.o_orderstatus <> 'P' GROUP BY l.l_orderkey""",
)
def _(t):
    keys = t("orders").where(_universe()).select(F.col("o_orderkey").alias("l_orderkey"))
    return t("lineitem").join(keys, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))


@R.on("flt_exists", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def _(t):
    big = t("orders").where("o_totalprice > 400000")
    return t("customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@R.on("flt_not_in", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_quantity > 49)")
def _(t):
    used = t("lineitem").where("l_quantity > 49 and l_partkey is not null")
    return t("part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


@R.on("flt_regex", "SELECT p_partkey, regexp_matches(p_name, '(red|blue)\\s+\\w+t') AS flagged FROM part")
def _(t):
    return t("part").select("p_partkey", F.col("p_name").rlike(r"(red|blue)\s+\w+t").alias("flagged"))


@R.on(
    "prj_case",
    """SELECT cell_row, round(CASE WHEN n_for + n_against > 0 AND n_abstain = 0 THEN n_for / (n_for + n_against)
       WHEN n_for + n_against + n_abstain > 0 THEN n_for / (n_for + n_against + n_abstain) END, 6) AS for_share FROM npx_cells""",
)
def _(t):
    two, three = F.col("n_for") + F.col("n_against"), F.col("n_for") + F.col("n_against") + F.col("n_abstain")
    share = F.when((two > 0) & (F.col("n_abstain") == 0), F.col("n_for") / two).when(three > 0, F.col("n_for") / three)
    return t("npx_cells").select("cell_row", F.round(share, 6).alias("for_share"))


@R.on("prj_clip", "SELECT meet_row, CASE WHEN turnout IS NOT NULL THEN greatest(least(turnout, 100.0), 0.0) END AS turnout FROM meetings WHERE turnout IS NULL OR turnout <= 150")
def _(t):
    m = t("meetings").where("turnout is null or turnout <= 150")
    return m.select("meet_row", S.clip("turnout", 0.0, 100.0).alias("turnout"))


@R.on("prj_const_ratio_guard", "SELECT p_partkey, round(CASE WHEN p_size > 25 THEN p_retailprice / (p_size - 25) END, 6) AS price_per_unit FROM part")
def _(t):
    return t("part").select("p_partkey", F.round(S.ratio("p_retailprice", F.col("p_size") - 25), 6).alias("price_per_unit"))


@R.on("prj_label_priority", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 50 THEN 'large' WHEN value > 10 THEN 'medium' ELSE 'small' END AS status FROM events")
def _(t):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 50, "large").when(F.col("value") > 10, "medium").otherwise("small")
    return t("events").select("event_id", status.alias("status"))


@R.on("flt_implausible", "SELECT hold_id, shares FROM tfn_holdings WHERE NOT (coalesce(shares, 0) <= 0 OR shares > 50000000)")
def _(t):
    return t("tfn_holdings").where(~((F.coalesce("shares", F.lit(0)) <= 0) | (F.col("shares") > 50_000_000))).select("hold_id", "shares")


_SCREEN = """CASE WHEN holder_name IS NULL OR trim(holder_name) = '' THEN 'no_name' WHEN is_group_row THEN 'group'
    WHEN percent > 100 THEN 'percent_over_100' WHEN shares IS NULL AND percent IS NULL THEN 'no_measure' END"""


@R.on("flt_screen_rows", f"SELECT own_row, coalesce({_SCREEN}, 'kept') AS reason FROM own_rows")
def _(t):
    reason = (
        F.when(F.col("holder_name").isNull() | (F.trim("holder_name") == ""), "no_name").when(F.col("is_group_row"), "group")
        .when(F.col("percent") > 100, "percent_over_100").when(F.col("shares").isNull() & F.col("percent").isNull(), "no_measure")
    )
    return t("own_rows").select("own_row", F.coalesce(reason, F.lit("kept")).alias("reason"))


# --- joins -------------------------------------------------------------------------------------------------------


@R.on("join_inner", "SELECT o.o_orderkey, c.c_mktsegment, o.o_totalprice FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey")
def _(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "o_totalprice")


@R.on("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def _(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return t("customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["n_orders"])


@R.on(
    "join_outer_indicator",
    """SELECT coalesce(a.k, b.k) AS id, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side
       FROM (SELECT DISTINCT crsp_fundno AS k FROM portnomap WHERE crsp_fundno IS NOT NULL) a
       FULL JOIN (SELECT DISTINCT crsp_fundno AS k FROM mflink_portno WHERE crsp_fundno IS NOT NULL) b ON a.k = b.k""",
)
def _(t):
    ids = lambda n: t(n).where("crsp_fundno is not null").select(F.col("crsp_fundno").alias("id")).distinct()
    return J.with_indicator(ids("portnomap"), ids("mflink_portno"), ["id"])


@R.on("join_semi", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')")
def _(t):
    p = t("part").where("p_type = 'ECONOMY'")
    return t("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@R.on("join_anti", "SELECT s_suppkey, s_name FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity >= 50 AND l.l_tax > 0.07)")
def _(t):
    full = t("lineitem").where("l_quantity >= 50 and l_tax > 0.07")
    return t("supplier").join(full, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("s_suppkey", "s_name")


@R.on("join_broadcast_lookup", "SELECT t.hold_id, coalesce(CAST(f.trust_rank AS VARCHAR), '__unlinked__') AS trust_rank FROM tfn_holdings t LEFT JOIN feeds f ON f.feed = t.feed")
def _(t):
    ranks = t("feeds").select("feed", F.col("trust_rank").cast("string").alias("trust_rank"))
    return J.lookup(t("tfn_holdings").select("hold_id", "feed"), ranks, "feed", "trust_rank").drop("feed")


@R.on("join_sort_merge", "SELECT o.o_orderkey, sum(l.l_quantity) AS qty FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey")
def _(t):
    o = t("orders").select("o_orderkey").hint("merge")
    return o.join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.sum("l_quantity").alias("qty"))


@R.on(
    "join_multikey",
    """SELECT a.wficn, a.crsp_fundno, count(*) AS n FROM tfn_holdings a JOIN (SELECT DISTINCT wficn, crsp_fundno FROM mflink_portno) b
       ON a.wficn = b.wficn AND a.crsp_fundno = b.crsp_fundno GROUP BY a.wficn, a.crsp_fundno""",
)
def _(t):
    links = t("mflink_portno").select("wficn", "crsp_fundno").distinct()
    return t("tfn_holdings").join(links, ["wficn", "crsp_fundno"]).groupBy("wficn", "crsp_fundno").agg(F.count("*").alias("n"))


@R.on(
    "join_valid_time",
    """SELECT h.hold_id, p.map_id FROM tfn_holdings h JOIN portnomap p ON p.crsp_fundno = h.crsp_fundno AND h.rdate >= p.begdt AND h.rdate <= p.enddt""",
)
def _(t):
    h = t("tfn_holdings").select("hold_id", "crsp_fundno", "rdate")
    p = t("portnomap").where("enddt is not null").select("map_id", "crsp_fundno", "begdt", "enddt")
    return J.valid_time(h, p, "crsp_fundno", "rdate", "begdt", "enddt").select("hold_id", "map_id")


@R.on(
    "join_open_interval",
    """WITH v AS (SELECT max(enddt) AS m FROM portnomap WHERE enddt < DATE '2025-01-01'), p AS (SELECT * FROM portnomap WHERE enddt < DATE '2025-01-01')
       SELECT h.hold_id, p.map_id FROM tfn_holdings h JOIN p ON p.crsp_fundno = h.crsp_fundno CROSS JOIN v
       WHERE h.rdate >= p.begdt AND (h.rdate <= p.enddt OR p.enddt >= v.m)""",
)
def _(t):
    h = t("tfn_holdings").select("hold_id", "crsp_fundno", "rdate")
    p = t("portnomap").where("enddt < date '2025-01-01'").select("map_id", "crsp_fundno", "begdt", "enddt")
    return J.still_current(h, p, "crsp_fundno", "rdate", "begdt", "enddt").select("hold_id", "map_id")


@R.on(
    "join_null_open_end",
    """SELECT h.hold_id, m.link_id FROM tfn_holdings h JOIN mflink_portno m ON m.wficn = h.wficn AND h.rdate >= m.linkb
       AND h.rdate <= coalesce(m.linke, DATE '9999-12-31')""",
)
def _(t):
    h = t("tfn_holdings").select("hold_id", "wficn", "rdate")
    return J.valid_time(h, t("mflink_portno").select("link_id", "wficn", "linkb", "linke"), "wficn", "rdate", "linkb", "linke").select("hold_id", "link_id")


@R.on(
    "join_range_window",
    """SELECT a.event_id AS signup_id, count(*) AS n_purchases FROM events a JOIN events b ON b.user_id = a.user_id AND b.event_type = 'purchase'
       AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 DAY WHERE a.event_type = 'signup' GROUP BY a.event_id""",
)
def _(t):
    a = t("events").where("event_type = 'signup'").select(F.col("event_id").alias("signup_id"), "user_id", "ts")
    b = t("events").where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("ts").alias("t"))
    near = (a["user_id"] == b["u"]) & (b["t"] >= a["ts"]) & (b["t"] <= a["ts"] + F.expr("interval 1 day"))
    return a.join(b, near).groupBy("signup_id").agg(F.count("*").alias("n_purchases"))


def _sides(t):
    p = t("events").where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "ts")
    v = t("events").where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("user_id"), F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    return p, v


_ASOF = """FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
    ON p.user_id = v.user_id AND p.ts >= v.ts"""


@R.on("join_asof_backward", f"SELECT p.event_id AS purchase_id, v.event_id AS view_id, v.value AS view_value {_ASOF}")
def _(t):
    p, v = _sides(t)
    return J.asof_backward(p, v, "user_id", "ts", "view_ts", ["view_id", "view_value"], ["view_id"]).select("purchase_id", "view_id", "view_value")


@R.on("join_asof_tolerance", f"SELECT p.event_id AS purchase_id, CASE WHEN p.ts - v.ts <= INTERVAL 6 HOUR THEN v.event_id END AS view_id {_ASOF}")
def _(t):
    p, v = _sides(t)
    return J.asof_backward(p, v, "user_id", "ts", "view_ts", ["view_id"], ["view_id"], tolerance_seconds=6 * 3600).select("purchase_id", "view_id")


@R.on(
    "join_fallback_keys",
    """WITH a AS (SELECT c_custkey, s_suppkey AS hit, 'id' AS path FROM customer JOIN supplier ON s_suppkey = c_custkey),
       b AS (SELECT c_custkey, n_nationkey AS hit, 'nation' AS path FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey NOT IN (SELECT c_custkey FROM a))
       SELECT * FROM a UNION ALL SELECT * FROM b""",
)
def _(t):
    ids = t("supplier").select(F.col("s_suppkey").alias("hit"), F.concat(F.lit("s"), "s_suppkey").alias("tag"))
    nations = t("nation").select(F.col("n_nationkey").cast("long").alias("hit"), F.concat(F.lit("n"), "n_nationkey").alias("tag"))
    steps = [("id", F.concat(F.lit("s"), "c_custkey"), F.col("tag")), ("nation", F.concat(F.lit("n"), "c_nationkey"), F.col("tag"))]
    got = J.fallback(t("customer").select("c_custkey", "c_nationkey"), ids.unionByName(nations), "c_custkey", steps, ["hit"])
    return got.select("c_custkey", "hit", "path")


@R.on("join_prefix_key", "SELECT s.cusip, count(*) AS n FROM (SELECT DISTINCT cusip FROM split_s12) s JOIN tfn_holdings t ON substr(upper(trim(t.cusip8)), 1, 6) = substr(s.cusip, 1, 6) GROUP BY s.cusip")
def _(t):
    s = t("split_s12").select("cusip").distinct().withColumn("k", F.substring("cusip", 1, 6))
    n = t("tfn_holdings").groupBy(F.substring(F.upper(F.trim("cusip8")), 1, 6).alias("k")).agg(F.count("*").alias("n"))
    return s.join(n, "k").groupBy("cusip").agg(F.sum("n").alias("n"))


@R.on("join_like_prefix", "SELECT p.p_partkey, r.r_name FROM part p JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS r_name FROM part) r ON p.p_name LIKE r.r_name || '%'")
def _(t):
    # Each name meets patterns by its own beginnings, of the lengths that patterns have: an equality, whatever the patterns' length.
    words = t("part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("r_name")).distinct()
    lengths = words.agg(F.collect_set(F.length("r_name")).alias("ns"))  # one row, no longer than the longest pattern
    p = t("part").select("p_partkey", "p_name").crossJoin(F.broadcast(lengths))
    p = p.select("p_partkey", F.explode(F.transform(F.filter("ns", lambda n: n <= F.length("p_name")), lambda n: F.substring(F.col("p_name"), F.lit(1), n))).alias("r_name"))
    return p.join(words, "r_name").select("p_partkey", "r_name")


@R.on(
    "join_theta_nested",
    """SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type
       AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) < 1 AND contains(a.p_name, split_part(b.p_name, ' ', 2))""",
)
def _(t):
    a = t("part").select(F.col("p_partkey").alias("a_key"), "p_brand", "p_type", F.col("p_name").alias("a_name"), F.col("p_retailprice").alias("a_price"))
    b = t("part").select(F.col("p_partkey").alias("b_key"), "p_brand", "p_type", F.col("p_name").alias("b_name"), F.col("p_retailprice").alias("b_price"))
    near = (F.col("a_key") < F.col("b_key")) & (F.abs(F.col("a_price") - F.col("b_price")) < 1)
    # Prices less than 1 apart have the same or neighbouring whole parts; as doubles, which far prices cannot overflow.
    whole = lambda c: F.floor(c).cast("double")
    a = a.withColumn("whole", F.explode(F.array_distinct(F.array(*[whole("a_price") + i for i in (-1, 0, 1)]))))
    # Few bytes are much work: a fixed number of partitions, which adaptive execution does not merge by size.
    on, n = ["p_brand", "p_type", "whole"], int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = a.repartition(n, *on).join(b.withColumn("whole", whole("b_price")).repartition(n, *on), on).where(near)
    return pairs.where(F.contains("a_name", F.split_part("b_name", F.lit(" "), F.lit(2)))).select("a_key", "b_key")


@R.on("join_cross_expand", "SELECT n_name, alias FROM nation, (VALUES (' (fund)'), (' trust')) v(suffix), LATERAL (SELECT n_name || suffix AS alias)")
def _(t):
    aliases = F.array(F.concat("n_name", F.lit(" (fund)")), F.concat("n_name", F.lit(" trust")))
    return t("nation").select("n_name", F.explode(aliases).alias("alias"))


@R.on(
    "join_self_next",
    """WITH q AS (SELECT l_suppkey, year(l_shipdate) * 4 + quarter(l_shipdate) AS q, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)
       SELECT a.l_suppkey, CAST(a.q AS INTEGER) AS q, a.qty - b.qty AS change FROM q a JOIN q b ON a.l_suppkey = b.l_suppkey AND b.q = a.q - 1""",
)
def _(t):
    q = t("lineitem").groupBy("l_suppkey", S.quarter_index("l_shipdate").alias("q")).agg(F.sum("l_quantity").alias("qty"))
    w = Window.partitionBy("l_suppkey").orderBy("q")
    prev = q.withColumn("pq", F.lag("q").over(w)).withColumn("pqty", F.lag("qty").over(w)).where("pq = q - 1")
    return prev.select("l_suppkey", "q", (F.col("qty") - F.col("pqty")).alias("change"))


@R.on(
    "join_audit",
    """WITH r AS (SELECT crsp_fundno, count(*) AS n FROM portnomap WHERE crsp_fundno IS NOT NULL GROUP BY 1),
       j AS (SELECT r.n FROM tfn_holdings h LEFT JOIN r ON r.crsp_fundno = h.crsp_fundno)
       SELECT count(*) AS left_rows, count(n) AS matched, CAST(sum(coalesce(n, 1)) AS BIGINT) AS rows_after, count(CASE WHEN n > 1 THEN 1 END) AS fanned_out,
       round(count(n) / count(*), 6) AS match_rate, CASE WHEN count(n) = 0 THEN 'bug' WHEN count(n) / count(*) < 0.9 THEN 'warn' ELSE 'ok' END AS verdict FROM j""",
)
def _(t):
    return J.audit(t("tfn_holdings"), t("portnomap").select("crsp_fundno"), "crsp_fundno")


@R.on("join_one_to_one_assert", "SELECT crsp_fundno, begdt, count(*) AS n FROM portnomap GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return J.repeated_keys(t("portnomap"), ["crsp_fundno", "begdt"])


# --- sets --------------------------------------------------------------------------------------------------------


@R.on("set_union_all", "SELECT itemonagendaid AS id FROM meetings UNION ALL SELECT itemonagendaid FROM npx_items")
def _(t):
    return t("meetings").select(F.col("itemonagendaid").alias("id")).unionByName(t("npx_items").select(F.col("itemonagendaid").alias("id")))


@R.on("set_union_diagonal", "SELECT s_suppkey AS id, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    s = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@R.on("set_union_named_parts", "SELECT event_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id FROM events WHERE event_type = 'view'")
def _(t):
    declared = ["click", "view"]  # only named partitions are stacked, never what happens to be there
    parts = [t("events").where(F.col("event_type") == p).select("event_id") for p in declared]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@R.on(
    "set_symmetric_check",
    """SELECT id, 'left_only' AS side FROM (SELECT crsp_fundno AS id FROM mflink_portno EXCEPT SELECT crsp_fundno FROM portnomap) UNION ALL
       SELECT id, 'right_only' FROM (SELECT crsp_fundno AS id FROM portnomap EXCEPT SELECT crsp_fundno FROM mflink_portno)""",
)
def _(t):
    a, b = (t(n).select(F.col("crsp_fundno").alias("id")) for n in ("mflink_portno", "portnomap"))
    return a.subtract(b).withColumn("side", F.lit("left_only")).unionByName(b.subtract(a).withColumn("side", F.lit("right_only")))


@R.on("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@R.on("set_except", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def _(t):
    return t("orders").select(F.col("o_custkey").alias("k")).subtract(t("customer").where("c_acctbal < 0").select("c_custkey"))


@R.on(
    "set_overlap_unresolved",
    """WITH k AS (SELECT crsp_fundno, count(DISTINCT wficn) AS n FROM mflink_portno WHERE wficn IS NOT NULL GROUP BY 1)
       SELECT year(h.rdate) AS yr, CASE WHEN k.n IS NULL THEN 'absent' WHEN k.n > 1 THEN 'ambiguous' ELSE 'bridged' END AS status, count(*) AS n
       FROM tfn_holdings h LEFT JOIN k ON k.crsp_fundno = h.crsp_fundno GROUP BY 1, 2""",
)
def _(t):
    k = t("mflink_portno").where("wficn is not null").groupBy("crsp_fundno").agg(F.countDistinct("wficn").alias("k"))
    status = F.when(F.col("k").isNull(), "absent").when(F.col("k") > 1, "ambiguous").otherwise("bridged")
    h = t("tfn_holdings").select("crsp_fundno", F.year("rdate").cast("long").alias("yr")).join(k, "crsp_fundno", "left")
    return h.groupBy("yr", status.alias("status")).agg(F.count("*").alias("n"))


# --- order, top-k, dedup ----------------------------------------------------------------------------------------------


@R.on(
    "srt_multi",
    """SELECT hold_id, row_number() OVER (ORDER BY shares DESC NULLS LAST, hold_id) AS pos FROM tfn_holdings
       ORDER BY shares DESC NULLS LAST, hold_id""",
)
def _(t):
    return D.positions(t("tfn_holdings").select("hold_id", "shares"), [F.col("shares").desc_nulls_last(), F.col("hold_id").asc()], "pos").drop("shares")


@R.on("srt_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def _(t):
    return t("orders").orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@R.on("topk_global", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def _(t):
    return t("part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_retailprice")


@R.on("topk_per_group", "SELECT c_mktsegment, c_custkey, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")
def _(t):
    return D.top(t("customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey").asc()], 3).select("c_mktsegment", "c_custkey", "rn")


@R.on(
    "dedup_latest",
    """SELECT accession, cik, holder_name, own_row FROM (SELECT *, row_number() OVER (PARTITION BY cik, holder_name ORDER BY filing_date DESC NULLS LAST,
       CASE parser WHEN 'grid' THEN 0 ELSE 1 END, own_row) AS rn FROM own_rows WHERE holder_name IS NOT NULL) WHERE rn = 1""",
)
def _(t):
    order = [F.desc_nulls_last("filing_date"), F.when(F.col("parser") == "grid", 0).otherwise(1).asc(), F.col("own_row").asc()]
    return D.first_of(t("own_rows").where("holder_name is not null"), ["cik", "holder_name"], order).select("accession", "cik", "holder_name", "own_row")


@R.on(
    "dedup_least_stale",
    """SELECT wficn, rdate, cusip8, hold_id FROM (SELECT *, row_number() OVER (PARTITION BY wficn, rdate, cusip8 ORDER BY date_diff('day', rdate, fdate) NULLS LAST, hold_id) AS rn
       FROM tfn_holdings) WHERE rn = 1""",
)
def _(t):
    order = [F.datediff("fdate", "rdate").asc_nulls_last(), F.col("hold_id").asc()]
    return D.first_of(t("tfn_holdings"), ["wficn", "rdate", "cusip8"], order).select("wficn", "rdate", "cusip8", "hold_id")


@R.on("dedup_supersede", "SELECT o_custkey, y, o_orderkey FROM (SELECT o_custkey, year(o_orderdate) AS y, o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def _(t):
    o = t("orders").withColumn("y", F.year("o_orderdate").cast("long"))
    return D.first_of(o, ["o_custkey", "y"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "y", "o_orderkey")


@R.on(
    "dedup_conf_rank",
    """SELECT wficn, hold_id FROM (SELECT t.wficn, t.hold_id, row_number() OVER (PARTITION BY t.wficn ORDER BY f.trust_rank NULLS LAST, t.hold_id) AS rn
       FROM tfn_holdings t LEFT JOIN feeds f ON f.feed = t.feed) WHERE rn = 1""",
)
def _(t):
    h = t("tfn_holdings").select("wficn", "hold_id", "feed").join(J.small(t("feeds")), "feed", "left")
    return D.first_of(h, ["wficn"], [F.col("trust_rank").asc_nulls_last(), F.col("hold_id").asc()]).select("wficn", "hold_id")


@R.on("dedup_distinct_on", "SELECT DISTINCT ON (user_id) user_id, event_id FROM events ORDER BY user_id, ts DESC, event_id DESC")
def _(t):
    return D.first_of(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@R.on("dedup_nodupkey", "SELECT l_orderkey, l_linenumber, count(*) - 1 AS n_dropped FROM lineitem GROUP BY 1, 2")
def _(t):
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.count("*") - 1).alias("n_dropped"))


@R.on("dedup_assert_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return J.repeated_keys(t("lineitem"), ["l_orderkey", "l_linenumber"])


@R.on("smp_seeded")
def _(t):
    """A seeded stratified sample: per segment the 5 customers of least hash, the same on every run and cluster."""
    return D.seeded_sample(t("customer"), ["c_custkey"], 5, 13, ["c_mktsegment"]).select("c_mktsegment", "c_custkey")
