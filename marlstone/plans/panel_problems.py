"""Queries of the general data problems: intervals, orphan references, attributes at event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators.intervals import periods_and_gaps, ymd
from marlstone.operators.known_time import as_known_at
from marlstone.operators.references import canonical_id, orphan_keys, orphan_references, quarter_label
from marlstone.plans.registry import Registry
from marlstone.session import table

R = Registry()


@R.add(
    "p2_found",
    """
    WITH s AS (SELECT wficn, linkb AS s, coalesce(linke, DATE '9999-12-31') AS e FROM mflink_portno
               WHERE wficn IS NOT NULL AND linkb IS NOT NULL AND (linke IS NULL OR linke >= linkb)),
    p AS (SELECT *, max(e) OVER (PARTITION BY wficn ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s),
    i AS (SELECT *, sum(CASE WHEN prev IS NULL OR date_diff('day', prev, s) > 1 THEN 1 ELSE 0 END)
                 OVER (PARTITION BY wficn ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM p),
    c AS (SELECT wficn, n, min(s) AS s, max(e) AS e FROM i GROUP BY wficn, n),
    g AS (SELECT wficn, s, e, lead(s) OVER (PARTITION BY wficn ORDER BY s) AS nxt FROM c),
    u AS (SELECT wficn, 'period' AS kind, s, e FROM g UNION ALL
          SELECT wficn, 'gap', CAST(e + INTERVAL 1 DAY AS DATE), CAST(nxt - INTERVAL 1 DAY AS DATE) FROM g WHERE nxt IS NOT NULL)
    SELECT wficn, kind, CAST(strftime(s, '%Y%m%d') AS INTEGER) AS start_ymd, CAST(strftime(e, '%Y%m%d') AS INTEGER) AS end_ymd FROM u
    """,
)
def p2_found(spark, sf_dir):
    spans = periods_and_gaps(table(spark, sf_dir, "mflink_portno"), "wficn", "linkb", "linke")
    return spans.select("wficn", "kind", ymd("start_date").alias("start_ymd"), ymd("end_date").alias("end_ymd"))


def _references(spark, sf_dir):
    def of(name, row, key):
        t = table(spark, sf_dir, name)
        payload = F.struct(F.lit(name).alias("tbl"), F.col(row).alias("row_id"), quarter_label("meetingdate").alias("period"))
        return t.select(canonical_id(key).alias("key"), F.col("loadts").alias("ts"), payload.alias("payload"))

    refs = of("meetings", "meet_row", "itemonagendaid").unionByName(of("npx_cells", "cell_row", "itemonagendaid"))
    items = table(spark, sf_dir, "npx_items")
    return refs, items.select(canonical_id("itemonagendaid").alias("key"), F.col("loadts").alias("ts"), F.col("delts").alias("gone"))


_REFS_SQL = """
    WITH refs AS (
      SELECT 'meetings' AS tbl, meet_row AS row_id, meetingdate, loadts, CAST(itemonagendaid AS VARCHAR) AS raw FROM meetings UNION ALL
      SELECT 'npx_cells', cell_row, meetingdate, loadts, itemonagendaid FROM npx_cells),
    k AS (SELECT tbl, row_id, loadts, TRY_CAST(TRY_CAST(trim(raw) AS DECIMAL(18,2)) AS BIGINT) AS id,
          coalesce(CAST(year(meetingdate) AS VARCHAR) || 'Q' || CAST(quarter(meetingdate) AS VARCHAR), 'unknown') AS period
          FROM refs WHERE raw IS NOT NULL),
    o AS (SELECT tbl, row_id, period,
          CASE WHEN NOT EXISTS (SELECT 1 FROM npx_items i WHERE i.itemonagendaid = k.id) THEN 'missing'
               WHEN EXISTS (SELECT 1 FROM npx_items i WHERE i.itemonagendaid = k.id AND i.loadts <= k.loadts) THEN 'deleted'
               ELSE 'late' END AS reason
          FROM k WHERE id IS NOT NULL AND id <> 0 AND NOT EXISTS (
            SELECT 1 FROM npx_items i WHERE i.itemonagendaid = k.id AND i.loadts <= k.loadts AND (i.delts IS NULL OR i.delts > k.loadts)))
"""


@R.add("p4_found", _REFS_SQL + "SELECT tbl, row_id, period, reason FROM o")
def p4_found(spark, sf_dir):
    return orphan_references(*_references(spark, sf_dir)).select("payload.*", "reason")


@R.add("p4_report", _REFS_SQL + "SELECT tbl, period, reason, count(*) AS n_rows FROM o GROUP BY tbl, period, reason")
def p4_report(spark, sf_dir):
    """Orphans per table and period."""
    found = orphan_references(*_references(spark, sf_dir)).select("payload.tbl", "payload.period", "reason")
    return found.groupBy("tbl", "period", "reason").agg(F.count("*").alias("n_rows"))


@R.add(
    "p4_keys",
    _REFS_SQL
    + """SELECT CAST(id AS VARCHAR) AS "key", count(*) AS n_refs, CAST(0 AS BIGINT) AS n_exist FROM k WHERE id IS NOT NULL AND id <> 0
    AND id NOT IN (SELECT itemonagendaid FROM npx_items WHERE loadts IS NOT NULL AND delts IS NULL) GROUP BY id""",
)
def p4_keys(spark, sf_dir):
    """Keys that are referred to and do not exist now."""
    return orphan_keys(*_references(spark, sf_dir))


_KNOWN_SQL = """
    WITH c AS (SELECT h.hold_id, p.map_id, p.crsp_portno, p.index_fund_flag, p.et_flag,
      row_number() OVER (PARTITION BY h.hold_id ORDER BY p.loaddt DESC, p.begdt DESC, p.map_id DESC) AS rn
      FROM tfn_holdings h JOIN portnomap p ON p.crsp_fundno = h.crsp_fundno AND p.begdt <= h.rdate
        AND h.rdate <= coalesce(p.enddt, DATE '9999-12-31') AND p.loaddt <= h.rdate)
"""


def _known(spark, sf_dir):
    holds, spans = table(spark, sf_dir, "tfn_holdings"), table(spark, sf_dir, "portnomap")
    return as_known_at(holds.select("hold_id", "crsp_fundno", "rdate"), "crsp_fundno", "rdate", spans, "map_id", "begdt", "enddt", "loaddt")


@R.add("p6_found", _KNOWN_SQL + "SELECT hold_id, map_id FROM c WHERE rn = 1")
def p6_found(spark, sf_dir):
    return _known(spark, sf_dir).select("hold_id", "map_id").distinct()


@R.add("p6_attributes", _KNOWN_SQL + "SELECT hold_id, crsp_portno, index_fund_flag, et_flag FROM c WHERE rn = 1")
def p6_attributes(spark, sf_dir):
    """Each holding with the portfolio and flags as known on its report date."""
    spans = table(spark, sf_dir, "portnomap").select("map_id", "crsp_portno", "index_fund_flag", "et_flag")
    return _known(spark, sf_dir).join(spans, "map_id").select("hold_id", "crsp_portno", "index_fund_flag", "et_flag")
