"""Composed panels, sources and sinks, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import dedup as D
from marlstone.operators import documents as DOC
from marlstone.operators import joins as J
from marlstone.operators import panels as P
from marlstone.operators.references import canonical_id
from marlstone.plans.registry import Registry
from marlstone.session import shared_dir
from marlstone.sources import readers as RD
from marlstone.sources import writers as WR
from marlstone.streaming import events as ST

R = Registry()


def block_form():
    """The form of a block filing, which own_rows lacks: passive holders under 10 % file 13G."""
    return F.when(F.col("percent") < 10, "SC 13G").otherwise("SC 13D")


def block_item12():
    """The filer's kind, which own_rows lacks: an institution by the words of its name, else an individual."""
    firm = F.upper("holder_name").rlike(r"\b(?:INC|LLC|LP|L\.P|LTD|MANAGEMENT|MGMT|MGT|ADVISORS|ADVS?|PARTNERS|FUNDS?)\b")
    return F.when(F.col("is_group_row") | firm, "ia").otherwise("in")


def _place(t, name):
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


# --- panels ------------------------------------------------------------------------------------------------------

_OWN = """
    WITH h AS (SELECT l_suppkey AS holder, l_partkey AS entity, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS INTEGER) AS q, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS period, sum(l_quantity) AS m
               FROM lineitem WHERE l_quantity > 0 GROUP BY ALL),
    p AS (SELECT entity, q, period, count(*) AS numowners, sum(m) AS io_total, sum(m * m) / (sum(m) * sum(m)) AS hhi FROM h GROUP BY 1, 2, 3),
    k AS (SELECT *, coalesce(q - lag(q) OVER w > 1, true) AS f, coalesce(lead(q) OVER w - q > 1, true) AS l FROM (SELECT DISTINCT holder, q FROM h) WINDOW w AS (PARTITION BY holder ORDER BY q)),
    g AS (SELECT entity, q, count(*) FILTER (f) AS newinst, count(*) FILTER (l) AS oldinst, count(*) AS own FROM h JOIN k USING (holder, q) GROUP BY 1, 2),
    n AS (SELECT q, count(DISTINCT holder) AS n FROM h GROUP BY 1),
    b AS (SELECT entity, q, ((own - newinst) - lag(own - oldinst) OVER w) / lag(n) OVER w AS db FROM g JOIN n USING (q) WINDOW w AS (PARTITION BY entity ORDER BY q))
"""


def _ownership(t):
    h = t("lineitem").select(F.col("l_suppkey").alias("holder"), F.col("l_partkey").alias("entity"), F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("measure"))
    d = t("part").select(F.col("p_partkey").alias("entity"), ((F.col("p_size") - 10) * 100.0).alias("total"))
    return P.ownership(h, d)


@R.on(
    "panel_inst_own",
    _OWN
    + """SELECT p.entity, p.period, p.numowners, p.io_total, round(p.hhi, 9) AS ioc_hhi, g.newinst, g.oldinst, round(b.db, 6) AS dbreadth, round(CASE WHEN (p_size - 10) * 100.0 > 0 THEN p.io_total / ((p_size - 10) * 100.0) END, 6) AS ior
    FROM p JOIN g USING (entity, q) JOIN b USING (entity, q) LEFT JOIN part ON p_partkey = p.entity""",
)
def panel_inst_own(t):
    o = _ownership(t)
    return o.select("entity", "period", "numowners", "io_total", F.round("ioc_hhi", 9).alias("ioc_hhi"), "newinst", "oldinst", F.round("dbreadth", 6).alias("dbreadth"), F.round("ior", 6).alias("ior"))


@R.on(
    "panel_inst_own_flags",
    _OWN
    + """, j AS (SELECT entity, q, period, numowners, coalesce(numowners <> lag(numowners) OVER w, false) AS owners_changed, coalesce(abs(numowners / lag(numowners) OVER w - 1) >= 0.5, false) AS jump
         FROM p WINDOW w AS (PARTITION BY entity ORDER BY q))
       SELECT entity, period, numowners, owners_changed, coalesce(lag(jump) OVER w, false) OR jump OR coalesce(lead(jump) OVER w, false) AS near_jump FROM j WINDOW w AS (PARTITION BY entity ORDER BY q)""",
)
def _(t):
    return P.ownership_flags(_ownership(t)).select("entity", "period", "numowners", "owners_changed", "near_jump")


@R.on(
    "panel_meetings",
    """SELECT meet_row, CASE WHEN turnout IS NOT NULL THEN greatest(least(turnout, 100.0), 0.0) END AS turnout, round(avg(forpct) OVER (PARTITION BY permno), 7) AS mean_for, abs(forpct - 50) <= 10 AS close
       FROM meetings WHERE turnout IS NULL OR turnout <= 120""",
)
def _(t):
    return P.meetings(t("meetings")).select("meet_row", "turnout", F.round("mean_for", 7).alias("mean_for"), "close")


@R.on(
    "panel_fund_own",
    """WITH h AS (SELECT t.*, row_number() OVER (PARTITION BY t.wficn, t.rdate, t.cusip8 ORDER BY date_diff('day', t.rdate, t.fdate) NULLS LAST, t.hold_id) AS rn FROM tfn_holdings t WHERE shares > 0 AND rdate IS NOT NULL AND coalesce(fdate >= rdate, true)),
       l AS (SELECT h.*, EXISTS (SELECT 1 FROM portnomap p WHERE p.crsp_fundno = h.crsp_fundno AND p.index_fund_flag IN ('B', 'D', 'E')) AS passive FROM h WHERE rn = 1)
       SELECT upper(substr(trim(cusip8), 1, 8)) AS entity, last_day(CAST(date_trunc('quarter', rdate) AS DATE) + INTERVAL 2 MONTH) AS period, CAST(sum(shares) AS BIGINT) AS held, CAST(sum(CASE WHEN passive THEN shares ELSE 0 END) AS BIGINT) AS held_passive,
       count(DISTINCT wficn) AS n_funds FROM l GROUP BY 1, 2""",
)
def _(t):
    h = t("tfn_holdings").where("shares > 0 and rdate is not null and coalesce(fdate >= rdate, true)")
    h = D.first_of(h, ["wficn", "rdate", "cusip8"], [F.datediff("fdate", "rdate").asc_nulls_last(), F.asc("hold_id")])
    flags = t("portnomap").where("index_fund_flag in ('B', 'D', 'E')").select("crsp_fundno").distinct().withColumn("passive", F.lit(True))
    h = h.join(flags, "crsp_fundno", "left")
    return h.groupBy(F.upper(F.substring(F.trim("cusip8"), 1, 8)).alias("entity"), S.quarter_end("rdate").alias("period")).agg(
        F.sum("shares").alias("held"), F.sum(F.when(F.col("passive"), F.col("shares")).otherwise(0)).alias("held_passive"), F.countDistinct("wficn").alias("n_funds")
    )


def _cells(t):
    c = t("npx_cells").select(canonical_id("itemonagendaid").try_cast("long").alias("item"), "block", "n_for", "n_against", "n_abstain", F.col("tna_for").alias("weight"))
    universe = t("meetings").where("itemonagendaid > 0").select(F.col("itemonagendaid").alias("item"))
    lookup = t.spark.createDataFrame([("index", "passive"), ("quant", "passive"), ("active", "active"), ("hedge", "active")], "block string, group string")
    return P.vote_cells(c, universe, lookup)


_CELLS = """c AS (SELECT TRY_CAST(regexp_replace(trim(itemonagendaid), '\\.0*$', '') AS BIGINT) AS item, CASE block WHEN 'index' THEN 'passive' WHEN 'quant' THEN 'passive' WHEN 'active' THEN 'active' WHEN 'hedge' THEN 'active' ELSE '__unlinked__' END AS g, n_for, n_against, n_abstain, tna_for FROM npx_cells),
    v AS (SELECT item, g, CAST(sum(n_for) AS BIGINT) AS n_for, CAST(sum(n_against) AS BIGINT) AS n_against, CAST(sum(n_abstain) AS BIGINT) AS n_abstain, round(sum(tna_for), 2) AS weight, count(*) FILTER (tna_for IS NULL) AS n_no_weight
      FROM c WHERE item IN (SELECT itemonagendaid FROM meetings WHERE itemonagendaid > 0) GROUP BY 1, 2)"""


@R.on("panel_vote_cells", f"WITH {_CELLS} SELECT item, g AS \"group\", n_for, n_against, n_abstain, weight, n_no_weight FROM v")
def _(t):
    return _cells(t).withColumn("weight", F.round("weight", 2))


@R.on(
    "panel_merge",
    f"""WITH {_CELLS}, m AS (SELECT DISTINCT ON (itemonagendaid) itemonagendaid AS item, forpct FROM meetings WHERE itemonagendaid > 0 ORDER BY itemonagendaid, meet_row)
        SELECT m.item, v.g AS "group", abs(forpct - 50) <= 5 AS pivotal, CASE WHEN v.g IS NULL THEN 'no_votes' ELSE 'votes' END AS votes, coalesce(n_for, 0) AS n_for,
        round(CASE WHEN n_for + n_against + n_abstain > 0 THEN n_for / (n_for + n_against + n_abstain) END, 6) AS for_frac FROM m LEFT JOIN v ON v.item = m.item""",
)
def _(t):
    m = D.first_of(t("meetings").where("itemonagendaid > 0"), ["itemonagendaid"], [F.asc("meet_row")]).select(F.col("itemonagendaid").alias("item"), "forpct")
    return P.merged(m, _cells(t)).select("item", "group", P.pivotal(m, 5).alias("pivotal"), "votes", "n_for", F.round("for_frac", 6).alias("for_frac"))


@R.on(
    "panel_short_interest",
    """SELECT m.wficn AS entity, last_day(CAST(date_trunc('quarter', h.rdate) AS DATE) + INTERVAL 2 MONTH) AS period, arg_max(h.shares, (h.rdate, h.shares)) AS shares, max(h.rdate) AS as_of
       FROM tfn_holdings h JOIN mflink_portno m ON m.crsp_fundno = h.crsp_fundno AND h.rdate BETWEEN m.linkb AND coalesce(m.linke, DATE '2099-12-31') WHERE h.shares IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    r = t("tfn_holdings").where("shares is not null").select(F.col("crsp_fundno").alias("code"), F.col("rdate").alias("date"), "shares")
    links = t("mflink_portno").select(F.col("crsp_fundno").alias("code"), F.col("wficn").alias("entity"), F.col("linkb").alias("start"), F.col("linke").alias("end"))
    return P.short_interest(r, links)


@R.on(
    "panel_blockholders",
    r"""WITH o AS (SELECT *, CASE WHEN percent < 10 THEN 'SC 13G' ELSE 'SC 13D' END AS form,
            CASE WHEN is_group_row OR regexp_matches(upper(holder_name), '\b(?:INC|LLC|LP|L\.P|LTD|MANAGEMENT|MGMT|MGT|ADVISORS|ADVS?|PARTNERS|FUNDS?)\b') THEN 'ia' ELSE 'in' END AS item12
            FROM own_rows WHERE holder_name IS NOT NULL AND filing_date IS NOT NULL AND NOT is_group_row AND percent > 4.5),
        y AS (SELECT *, CAST(year(filing_date) - CASE WHEN date_diff('day', make_date(year(filing_date), 1, 1), filing_date) <= 14
            OR (form = 'SC 13G' AND date_diff('day', make_date(year(filing_date), 2, 14), filing_date) <= 10) THEN 1 ELSE 0 END AS INTEGER) AS y FROM o),
        d AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY cik, holder_name, y ORDER BY filing_date DESC, own_row) = 1),
        g AS (SELECT *, lead(y) OVER (PARTITION BY cik, holder_name ORDER BY y) - y AS gap FROM d),
        e AS (SELECT cik, holder_name, percent, form, item12, CAST(y + i AS INTEGER) AS y, i > 0 AS filled FROM (SELECT *, unnest(range(0, CASE WHEN gap IN (2, 3, 4) THEN gap ELSE 1 END)) AS i FROM g)),
        f AS (SELECT DISTINCT year(rdate) AS y FROM tfn_holdings WHERE rdate IS NOT NULL)
        SELECT e.cik, e.holder_name, e.y, e.percent, e.filled, CASE WHEN item12 = 'in' THEN 'individual' WHEN f.y IS NULL THEN 'other' WHEN form LIKE '%13D%' THEN 'active' ELSE 'passive' END AS kind
        FROM e LEFT JOIN f ON f.y = e.y""",
)
def _(t):
    o = t("own_rows").where("holder_name is not null and filing_date is not null and not is_group_row").withColumn("form", block_form())
    o = o.withColumn("y", S.fiscal_year("filing_date", "form", "percent")).where("percent > 4.5")
    o = D.first_of(o, ["cik", "holder_name", "y"], [F.desc("filing_date"), F.asc("own_row")]).select("cik", "holder_name", "y", "percent", "form", block_item12().alias("item12"))
    filers = t("tfn_holdings").where("rdate is not null").select(F.year("rdate").alias("y")).distinct().withColumn("files_13f", F.lit(True))
    o = DOC.gap_fill(o, ["cik", "holder_name"], "y").join(filers, "y", "left")
    return o.withColumn("kind", DOC.block_type("item12", "form", "files_13f")).select("cik", "holder_name", "y", "percent", "filled", "kind")


@R.on(
    "panel_mflinks_extend",
    """WITH l AS (SELECT wficn, max(linke) AS linke FROM mflink_portno WHERE linke IS NOT NULL AND wficn IS NOT NULL GROUP BY 1)
       SELECT wficn, linke, last_day(CAST(q AS DATE) + INTERVAL 2 MONTH) AS quarter FROM (SELECT wficn, linke, unnest(generate_series(CAST(date_trunc('quarter', linke) AS TIMESTAMP) + INTERVAL 3 MONTH, TIMESTAMP '2025-03-31', INTERVAL 3 MONTH)) AS q FROM l)""",
)
def _(t):
    links = t("mflink_portno").where("wficn is not null").select("wficn", "linke")
    return P.extend_links(links, "wficn", "linke", F.lit("2025-03-31").cast("date"))


@R.on(
    "panel_cohort",
    """WITH f AS (SELECT o_custkey, min(CAST(date_trunc('month', o_orderdate) AS DATE)) AS cohort FROM orders WHERE o_totalprice > 50000 GROUP BY 1),
       a AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders)
       SELECT cohort, CAST(date_diff('month', cohort, m) AS INTEGER) AS months, count(*) AS users FROM a JOIN f USING (o_custkey) WHERE m >= cohort GROUP BY 1, 2""",
)
def _(t):
    return P.cohort(t("orders"), "o_custkey", "o_orderdate", F.col("o_totalprice") > 50000)


@R.on(
    "panel_funnel",
    """WITH a AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'signup' GROUP BY 1), b AS (SELECT a.user_id, min(e.ts) AS t FROM a JOIN events e ON e.user_id = a.user_id AND e.event_type = 'view' AND e.ts >= a.t GROUP BY 1),
       c AS (SELECT b.user_id, min(e.ts) AS t FROM b JOIN events e ON e.user_id = b.user_id AND e.event_type = 'purchase' AND e.ts >= b.t GROUP BY 1),
       u AS (SELECT 1 AS step, 'signup' AS event, count(*) AS users FROM a UNION ALL SELECT 2, 'view', count(*) FROM b UNION ALL SELECT 3, 'purchase', count(*) FROM c)
       SELECT step, event, users, round(users / lag(users) OVER (ORDER BY step), 6) AS conversion FROM u""",
)
def _(t):
    return P.funnel(t("events"), "user_id", "ts", "event_type", ["signup", "view", "purchase"])


# --- sources and sinks --------------------------------------------------------------------------------------------


@R.on("src_parquet", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    return RD.check_schema(RD.parquet(t.spark, f"{t.sf_dir}/nation.parquet"), ["n_nationkey", "n_name", "n_regionkey"], "nation", exact=True)


@R.on("src_parquet_glob", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders WHERE year(o_orderdate) = 1998")
def _(t):
    """Written by year and read back with the filter as partition pruning."""
    path = _place(t, "orders-by-year")
    WR.hive_parquet(t("orders").withColumn("y", F.year("o_orderdate")), path, ["y"])
    return RD.parquet(t.spark, path, columns=["o_orderkey", "y"], where=F.col("y") == 1998)


@R.on("src_csv_tsv", "SELECT p_partkey, p_name, p_size FROM part")
def _(t):
    path = _place(t, "part") + ".csv"
    WR.csv(t("part").select("p_partkey", "p_name", "p_size"), path)
    return RD.delimited(t.spark, path, "p_partkey long, p_name string, p_size int")


@R.on("src_tsv_strict", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def _(t):
    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    path = _place(t, "customer-tsv")
    t("customer").select(F.concat_ws("\t", "c_custkey", "c_mktsegment", "c_acctbal")).write.option("compression", "gzip").text(path)
    return RD.strict_tsv(t.spark, path, StructType().add("c_custkey", LongType()).add("c_mktsegment", StringType()).add("c_acctbal", DoubleType()))


@R.on("src_quarantine", "SELECT hold_id, CASE WHEN rdate IS NULL THEN 'no partition key' END AS quarantine_reason FROM tfn_holdings")
def _(t):
    good, bad = RD.quarantine(t("tfn_holdings").select("hold_id", "rdate"), F.col("rdate").isNotNull(), "no partition key")
    return good.unionByName(bad, allowMissingColumns=True).drop("rdate")


@R.on("src_csv_vintage", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS id, s_name AS name FROM supplier UNION ALL SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0'), c_name FROM customer")
def _(t):
    a = t("supplier").select(F.col("s_suppkey").alias("CIK Number"), F.col("s_name").alias(" Name"))
    b = t("customer").select(F.col("c_custkey").alias("cik"), F.col("c_name").alias("Entity"))
    return RD.vintages([a, b], {"id": ["cik", "cik number"], "name": ["entity"]}, {"id": 10})


@R.on("src_preamble_csv", "SELECT r_regionkey, r_name FROM region")
def _(t):
    path = _place(t, "preamble")
    lines = [(0, "Report of regions"), (1, "as of today"), (2, "r_regionkey,r_name")]
    head = t.spark.createDataFrame(lines, "n int, value string")
    body = t("region").select((F.col("r_regionkey") + 10).cast("int").alias("n"), F.concat_ws(",", "r_regionkey", "r_name").alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    return RD.after_preamble(t.spark, path, 2, "r_regionkey int, r_name string")


@R.on("src_ndjson", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 100 <> 7")
def _(t):
    """Written as JSON lines, some of them torn, and read back without those."""
    path = _place(t, "ndjson")
    line = F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
    t("events").select(F.when(F.col("event_id") % 100 == 7, F.substring(line, 1, 9)).otherwise(line)).write.text(path)
    return RD.ndjson(t.spark, path, "event_id long, k long")


@R.on("src_remote_parquet", "SELECT 'supplier' AS src, s_suppkey AS id FROM supplier UNION ALL SELECT 'nation', n_nationkey FROM nation")
def _(t):
    """Several paths in one plan, filtered and projected at the scan."""
    a = RD.parquet(t.spark, f"{t.sf_dir}/supplier.parquet", columns=["s_suppkey"]).select(F.lit("supplier").alias("src"), F.col("s_suppkey").alias("id"))
    b = RD.parquet(t.spark, f"{t.sf_dir}/nation.parquet", columns=["n_nationkey"]).select(F.lit("nation").alias("src"), F.col("n_nationkey").cast("long").alias("id"))
    return a.unionByName(b)


@R.on("src_sas", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-06-30'")
def _(t):
    """An indexed range read: the bounds reach the scan as pushed filters."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("1998-01-01", "1998-06-30"))
    return RD.parquet(t.spark, f"{t.sf_dir}/lineitem.parquet", columns=["l_orderkey", "l_partkey"], where=F.col("l_shipdate").between(lo, hi))


@R.on("src_jdbc", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _(t):
    """Through the embedded database that Spark ships: written by the driver, then read by a bound query in key ranges.

    A database in memory, or one that a process has opened for writing, is closed to other executors: it is packed into an
    archive in the shared folder, which any number of processes may read.
    """
    url = WR.derby(t("nation"), _place(t, "derby"), "NATION")
    q = 'SELECT "n_nationkey", "n_name" FROM NATION WHERE "n_regionkey" = 2'
    return RD.jdbc(t.spark, url, q, ("n_nationkey", 0, 25, 3), driver="org.apache.derby.jdbc.EmbeddedDriver")


@R.on("src_text_header", "SELECT feed AS accession, CAST(trust_rank AS VARCHAR) AS form_type FROM feeds")
def _(t):
    """One file per feed with a header, of which the first bytes are read back."""
    path = _place(t, "headers")
    head = F.concat(F.lit("ACCESSION NUMBER: "), "feed", F.lit("\nCONFORMED SUBMISSION TYPE: "), "trust_rank", F.lit("\n</SEC-HEADER>\n"), F.repeat(F.lit("body "), 3000))
    t("feeds").select(head.alias("value"), F.col("feed").alias("part")).write.partitionBy("part").text(path)
    got = RD.header_bytes(t.spark, path + "/*/*.txt")
    return got.select(F.regexp_extract("head", r"ACCESSION NUMBER: (\S+)", 1).alias("accession"), F.regexp_extract("head", r"SUBMISSION TYPE: (\S+)", 1).alias("form_type"))


@R.on("src_xlsx", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def _(t):
    """A workbook made of the table's rows under a title line, read by its header."""

    @F.udf("binary")
    def workbook(rows):
        import io
        import zipfile

        cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
        lines = [["A report of regions"], ["r_regionkey", "", "r_name"], *[[k, "", n] for k, n in rows]]
        body = "".join("<row>" + "".join(cell("ABC"[j] + str(i + 1), v) for j, v in enumerate(line) if v) + "</row>" for i, line in enumerate(lines))
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
        return buf.getvalue()

    rows = t("region").agg(F.collect_list(F.struct(F.col("r_regionkey").cast("string"), "r_name")).alias("rows"))
    return RD.workbooks(rows.select(F.lit("regions.xlsx").alias("path"), workbook("rows").alias("content")), 1, ["r_regionkey", "r_name"]).drop("path")


@R.on("src_sgml_docs", "SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN 'DEF14A' ELSE 'EX-99' END AS type FROM documents, (VALUES (0), (1)) v(pos)")
def _(t):
    block = lambda kind, seq: F.concat(F.lit(f"<DOCUMENT>\n<TYPE>{kind}\n<SEQUENCE>{seq}\n<FILENAME>f{seq}.htm\n<TEXT>"), F.coalesce("title", F.lit("")), F.lit("</TEXT>\n</DOCUMENT>\n"))
    d = t("documents").select("doc_id", F.concat(block("DEF14A", 1), block("EX-99", 2)).alias("text"))
    return RD.submission(d, "text").select("doc_id", "pos", "type")


@R.on("snk_parquet_hive", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    path = _place(t, "customers")
    WR.hive_parquet(t("customer"), path, ["c_mktsegment"], 500)
    return t.spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@R.on("snk_csv", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
def _(t):
    path = _place(t, "nations") + ".csv"
    WR.csv(t("supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")), path)
    return RD.delimited(t.spark, path, "s_nationkey int, n long")


# --- streams (extension) -------------------------------------------------------------------------------------------


def _stream(t):
    return ST.read(t.spark, f"{t.sf_dir}/events.parquet", t("events").schema)


@R.on("str_tumbling", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(t):
    """Hourly windows of a stream, summed up again."""
    w = ST.windowed(_stream(t), "ts", ["event_type"], "value", late="60 days")
    got = ST.run_once(w, "s" + uuid.uuid4().hex, "complete", _place(t, "stream"))
    return got.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@R.on(
    "str_sessions",
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, CAST(sum(new) AS BIGINT) AS n_sessions, count(*) AS n_events FROM s GROUP BY 1""",
)
def _(t):
    w = ST.sessions(_stream(t), "ts", "user_id", "3 hours", "60 days")
    got = ST.run_once(w, "s" + uuid.uuid4().hex, "complete", _place(t, "stream"))
    return got.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


@R.on("str_upsert", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def _(t):
    got = ST.run_once(ST.latest(_stream(t), "user_id", "ts", "event_id", "value"), "s" + uuid.uuid4().hex, "update", _place(t, "stream"))
    return got.groupBy("user_id").agg(F.max_by("event_id", F.struct("us", "event_id")).alias("event_id"))
