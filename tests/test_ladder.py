"""The ladder of seven tiers: a small table on which each of them links a name, and what none may link."""

import pytest

from marlstone.operators import ladder as L

TITLES = [
    "Acmefield Growth Income Fund", "Acmefield Core Bond Fund", "Acmefield Large Value Fund", "Bexhill Core Equity Fund", "Bexhill Small Company Fund", "Bexhill Small Company Growth Fund",
    "Delmont Capital Appreciation Fund", "Delmont Ultra Russell2000 Growth", "Delmont Ultra Russell1000 Growth", "Everholt Intermediate Municipal Bond Fund", "Forwick Strategic Income Fund", "Forwick Target 2040 Fund",
]
#: Spelling, number of the fund, manager.
SPELLED = [
    ("Acmefield Core Bond Fund", 1, "ACMEFIELD ADVISORS"),
    ("ACMEFLD CR BND", 1, "ACMEFIELD ADVISORS"),
    ("Bexhill Small Company Fund", 2, "BEXHILL CAPITAL"),
    ("Bexhill Small Company Growth Fund", 2, "BEXHILL CAPITAL"),
    ("BXH SML CMPNY", 2, "BEXHILL CAPITAL"),
    ("DELMONT CAPITAL APPRECIATN FUND", 3, "DELMONT MGMT"),
    ("STRATEGIC INCOME FUND FORWICK", 4, None),
    ("9431 CAPITAL APPRECIATION MASTER PORTFOLIO", 5, "DELMONT MGMT"),
    ("DELMONT ULTRA RUSSELL 2000 GROWTH", 6, "DELMONT MGMT"),
    ("INTERM MUNI BD FUND EVERHOLT", 7, "EVERHOLT PARTNERS"),
    ("PROXIMA HARBOUR SERIES", 8, "GALTWOOD ADVISERS"),
    ("FORWICK TARGET 2050 FUND", 9, "FORWICK INVT"),
]
#: Equal numbers of classes bear the tickers; the second fund's are on one unit once more.
TICKERS = {"Bexhill Small Company Fund": ["BSCAX", "BSCBX"], "Bexhill Small Company Growth Fund": ["BSCBX"]}


@pytest.fixture(scope="module")
def links(spark):
    from pyspark.sql import functions as F

    from marlstone.functions import scalars as S

    left = spark.createDataFrame([(r, [m], [f] if f else [], 2015) for r, m, f in SPELLED], "raw string, members array<long>, firms array<string>, first int")
    rows = [(t, t.split()[0] + " Advisors", k, None) for t in TITLES for k in TICKERS.get(t, [t[:4].upper() + "X" if t.startswith("Acmefield Growth") else None])]
    right = spark.createDataFrame(rows, "title string, firm string, ticker string, heading string").withColumn("last", F.lit(9999))
    series = spark.createDataFrame([("Proxima Harbour Series", "ACMEX")], "name string, ticker string")
    got = L.tier_ladder(left.withColumn("id", S.normalize_name("raw")), right.withColumn("unit", S.normalize_name("title")), series)
    rows = got.collect()
    assert len({r.left_id for r in rows}) == len(rows)
    return {r.left_id: (r.unit, r.tier) for r in rows}


@pytest.mark.parametrize(
    "name, unit, tier",
    [
        ("ACMEFIELD CORE BOND FUND", "ACMEFIELD CORE BOND FUND", "exact"),
        ("ACMEFLD CR BND", "ACMEFIELD CORE BOND FUND", "exact"),
        ("BXH SML CMPNY", "BEXHILL SMALL FUND", "ticker"),
        ("DELMONT CAPITAL APPRECIATN FUND", "DELMONT CAPITAL APPRECIATION FUND", "scoped"),
        ("STRATEGIC INCOME FUND FORWICK", "FORWICK STRATEGIC INCOME FUND", "global"),
        ("9431 CAPITAL APPRECIATION MASTER PORTFOLIO", "DELMONT CAPITAL APPRECIATION FUND", "feeder_master"),
        ("DELMONT ULTRA RUSSELL 2000 GROWTH", "DELMONT ULTRA RUSSELL2000 GROWTH", "digit_split"),
        ("PROXIMA HARBOUR SERIES", "ACMEFIELD GROWTH INCOME FUND", "header"),
    ],
)
def test_each_tier_links(links, name, unit, tier):
    assert links.get(name) == (unit, tier)


def test_numbers_keep_names_apart(links):
    """No tier takes 2050 for 2040."""
    assert "FORWICK TARGET 2050 FUND" not in links
