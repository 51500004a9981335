"""What larger or odder tables showed."""

import datetime as dt
import math
import subprocess
import sys
from pathlib import Path


import __spark_entry__ as entry
from marlstone.operators import ticks as TK
from tests import oracle

REPO = Path(__file__).resolve().parent.parent


def test_jdbc_on_a_cluster():
    """Executors of their own: the database must be there for each of them."""
    code = """
import __spark_entry__ as e, os, sys, tempfile
from pyspark.sql import SparkSession
b = SparkSession.builder.master("local-cluster[2,1,600]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false")
s = b.config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp()).getOrCreate()
print("rows", e.queries()["src_jdbc"](s, "/root/testdata/sf0.001").count())
"""
    got = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert "rows 5" in got.stdout, got.stderr[-2000:]


def test_splice_over_a_price_of_zero(spark):
    """A vendor's price of zero on the cutoff day: infinite or NaN, as in SQL, and no error."""
    d = lambda x: dt.date(2026, 1, 1) + dt.timedelta(x)
    base = spark.createDataFrame([(1, d(0), 5.0, 0.0, 10.0), (2, d(0), 0.0, 0.0, 0.0)], "key long, date date, price double, ret double, cap double")
    vendor = spark.createDataFrame([(c, d(i), p, 0.0) for c in "ab" for i, p in ((0, 0.0), (1, 3.0))], "code string, date date, price double, ret double")
    links = spark.createDataFrame([(1, "a", True), (2, "b", True)], "key long, code string, usable boolean")
    got = {r["key"]: r for r in TK.splice(base, vendor, links, str(d(0))).where("source = 'vendor'").collect()}
    assert got[1]["cap"] == got[1]["adj_ratio"] == math.inf and math.isnan(got[2]["cap"]) and math.isnan(got[2]["adj_ratio"]) and got[2]["price"] == 0.0


def test_theta_join_meets_near_prices_only(spark, tmp_path):
    """Parts of one brand and type: as SQL says, and prices far apart are no longer paired."""
    prices = [1.0, 1.9, 1.9999999, 2.0, 2.9, 3.0, -0.5, 0.4, 1e300, 1e300, None]
    rows = [(i, "red ring", "b", "t", p) for i, p in enumerate(prices)] + [(100 + i, "red ring", "b", "t", 10.0 + 2 * i) for i in range(300)]
    df = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double")
    df.coalesce(1).write.parquet(str(tmp_path / "files"))
    next((tmp_path / "files").glob("*.parquet")).rename(tmp_path / "part.parquet")
    oracle.compare(spark, "join_theta_nested", entry.queries()["join_theta_nested"], entry.oracle_sql()["join_theta_nested"], str(tmp_path))
    plan = entry.queries()["join_theta_nested"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "whole" in plan
