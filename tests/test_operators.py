"""Operators on small golden frames: fire on the defect, stay silent on the clean frame."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import filings as FK
from marlstone.functions import scalars as S
from marlstone.functions import style as K
from marlstone.operators import dedup as DD
from marlstone.operators import detectors as X
from marlstone.operators import documents as DOC
from marlstone.operators import joins as J
from marlstone.operators import quality as Q
from marlstone.operators import resolution as E
from marlstone.operators import text as TX
from marlstone.operators import ticks as TK
from marlstone.operators import windows as W
from marlstone.sources import readers as RD


def one(spark, expr_col, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr_col).first()[0]


# --- data quality ------------------------------------------------------------------------------------------------


def frame(spark, dirty):
    keys = ["001", "001", "002", "003", "004"] if dirty else ["001", "002", "003", "004", "005"]
    region = ["US"] * 5 if dirty else ["US", "CA", "US", "CA", "US"]
    seg = [None, None, None, "a", "b"] if dirty else ["a", "b", "a", "b", "a"]
    rows = [(keys[i], 2020 if dirty else 2016 + i, region[i], seg[i], float(i + 1)) for i in range(5)]
    return spark.createDataFrame(rows, "gvkey string, fyear int, region string, segment string, revenue double")


def test_matrix_dirty_and_clean(spark):
    d = Q.declaration("pk: gvkey, fyear")
    bad = {r["rule"]: r for r in Q.matrix(frame(spark, True), d).collect()}
    assert bad["DQ1"]["status"] == "FAIL" and bad["DQ1"]["detail"] == "fyear,region"
    assert bad["DQ2"]["status"] == "FAIL" and bad["DQ3a"]["status"] == "FAIL"
    good = {r["rule"]: r["status"] for r in Q.matrix(frame(spark, False), d).collect()}
    assert good["DQ1"] == good["DQ2"] == good["DQ3a"] == good["DQ3b"] == "PASS"
    assert all(good[r] == "MODEL-EVALUATED" for r in Q.JUDGED) and "ROWS" not in good
    empty = {r["rule"]: r["status"] for r in Q.matrix(frame(spark, False).limit(0), d).collect()}
    assert empty["ROWS"] == "FAIL"


def test_declarations():
    d = Q.declaration("pk: a, b; event: c; sparse: x; freetext: y; constant: z")
    assert (d.pk, d.event, d.sparse, d.freetext, d.constant) == (["a", "b"], ["c"], ["x"], ["y"], ["z"])
    for bad in ("pk a", "key: a", "pk: a; pk: b"):
        with pytest.raises(ValueError):
            Q.declaration(bad)
    w = Q.coverage_window("d: 2020-01-01..2020-12-31")
    assert (w.column, w.first, w.last) == ("d", "2020-01-01", "2020-12-31")
    with pytest.raises(ValueError):
        Q.coverage_window("2021-01-01..2020-01-01")


def quarters(n, first=2015):
    return [dt.date(first + i // 4, (3, 6, 9, 12)[i % 4], (31, 30, 30, 31)[i % 4]) for i in range(n)]


def panel(spark, io, owners, first=2015):
    return spark.createDataFrame([(1, d, float(a), int(b)) for d, a, b in zip(quarters(len(io), first), io, owners, strict=True)], "permno long, rdate date, io_total double, numowners int")


def test_swings_and_seasons(spark):
    swing = panel(spark, [1.41e10 if d.month in (3, 12) else 3.11e9 for d in quarters(24)], [2195 + (i % 5) * 8 for i in range(24)])
    found = X.flat_owner_swing(swing, "permno", "rdate", "io_total", "numowners").collect()
    assert len(found) == 12
    assert all(4.0 < r["metric"] < 5.0 for r in found)
    s = X.seasonal(swing, "permno", "rdate", "io_total").collect()
    assert len(s) == 1 and s[0]["detail"] == "high 3 low 6"
    growth = panel(spark, [1e9 * 1.3**i for i in range(12)], [int(500 * 1.28**i) for i in range(12)])
    assert X.flat_owner_swing(growth, "permno", "rdate", "io_total", "numowners").count() == 0


def test_dropout_and_split(spark):
    lost = panel(spark, [1e10, 1e10, 2e9, 2e9], [1500, 1500, 400, 400])
    assert X.owner_dropout(lost, "permno", "rdate", "numowners").count() == 1
    assert X.flat_owner_swing(lost, "permno", "rdate", "io_total", "numowners").count() == 0
    split = panel(spark, [1e9] * 8 + [4e9] * 8, [2000 + 12 * i for i in range(16)], 2018)
    r = X.split_ratio(split, "permno", "rdate", "io_total", "numowners").collect()
    assert len(r) == 1 and r[0]["detail"] == "split 4.0" and r[0]["kind"] == "split_factor_ratio"
    twice = panel(spark, [1e9] * 8 + [49e9] * 8, [2000] * 16, 2018)
    assert [x["detail"] for x in X.split_ratio(twice, "permno", "rdate", "io_total", "numowners").collect()] == ["double-adjusted 49.0"]
    back = panel(spark, [4e9] * 8 + [1e9] * 8, [2000] * 16, 2018)
    assert X.split_ratio(back, "permno", "rdate", "io_total", "numowners").count() == 0  # a fall is no split
    assert X.split_ratio(panel(spark, [1e9] * 8, [100] * 8), "permno", "rdate", "io_total", "numowners").count() == 0


def test_ratio_and_tail(spark):
    df = spark.createDataFrame([("a", 1, 103.0, 100.0), ("b", 1, 101.0, 100.0), ("c", 1, 5.0, 0.0), ("d", 1, None, 3.0)], "e string, p int, n double, d double")
    assert [r["entity"] for r in X.impossible_ratio(df, "e", "p", "n", "d").collect()] == ["a"]
    rows = [(y, 1 if y < 2018 else None) for y in range(2015, 2021) for _ in range(5)]
    t = spark.createDataFrame(rows, "y int, j int")
    assert [r["period"] for r in X.join_tail(t, F.col("y"), "j").collect()] == ["2018"]
    assert X.join_tail(t.where("y < 2018"), F.col("y"), "j").count() == 0
    assert X.join_tail(t.where("y >= 2018"), F.col("y"), "j").count() == 0  # never healthy


def test_canonical_hash(spark):
    rows = [(1, 0.1 + 0.2), (2, float("nan")), (3, None), (4, 0.0)]
    a = spark.createDataFrame(rows, "k long, v double")
    b = spark.createDataFrame([(v, k) for k, v in reversed([(1, 0.3), (2, None), (3, float("nan")), (4, 0.0)])], "v double, k long")
    c = spark.createDataFrame([(1, 0.3001), *rows[1:]], "k long, v double")
    h = lambda d: Q.content_hash(d).first()["digest"]
    assert h(a) == h(b) != h(c)


def test_compare(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, 3.0, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, "x"), (2, 2.5, None), (4, 4.0, "w")], "k int, v double, s string")
    got = {r["column"]: r for r in Q.compare_on(a, b, ["k"]).collect()}
    assert got["v"]["differing"] == 1 and got["s"]["differing"] == 0 and got["v"]["only_a"] == got["v"]["only_b"] == 1


# --- joins, windows, time series ---------------------------------------------------------------------------------------


def test_asof_ties_nulls_and_buckets(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m) if m is not None else None
    left = spark.createDataFrame([(i, k, t(m)) for i, k, m in [(1, "a", 5), (2, "a", 10), (3, "a", 3000), (4, "b", 1), (5, None, 5), (6, "a", None), (7, "a", 4)]], "id int, k string, at timestamp_ntz")
    right = spark.createDataFrame([("a", t(5), 1), ("a", t(5), 2), ("a", t(9), 3), ("a", None, 9), (None, t(1), 8), ("b", t(2), 4)], "k string, rt timestamp_ntz, v int")
    got = {r["id"]: r["v"] for r in J.asof_backward(left, right, "k", "at", "rt", ["v"], ["v"], bucket_seconds=60).collect()}
    assert got == {1: 2, 2: 3, 3: 3, 4: None, 5: None, 6: None, 7: None}
    near = {r["id"]: r["v"] for r in J.asof_backward(left, right, "k", "at", "rt", ["v"], ["v"], tolerance_seconds=60).collect()}
    assert near[1] == 2 and near[2] == 3 and near[3] is None
    assert J.asof_backward(left, right.limit(0), "k", "at", "rt", ["v"], ["v"]).count() == 7


def test_cumulative_product(spark):
    rows = [(1, i, r) for i, r in enumerate([0.10, -0.50, 0.0])] + [(2, 0, -2.0), (2, 1, 0.5), (3, 0, -1.0), (3, 1, 9.0)]
    df = W.cumulative_product(spark.createDataFrame(rows, "k int, t int, r double"), ["k"], "t", "r", 100.0, "p")
    got = {(r["k"], r["t"]): round(r["p"], 6) for r in df.collect()}
    assert got == {(1, 0): 110.0, (1, 1): 55.0, (1, 2): 55.0, (2, 0): -100.0, (2, 1): -150.0, (3, 0): 0.0, (3, 1): 0.0}


def test_splice(spark):
    d = lambda x: dt.date(2026, 1, 1) + dt.timedelta(x)
    base = spark.createDataFrame([(1, d(-1), 10.1, 0.0, 1000.0), (2, d(-1), 101.0, 0.0, 5000.0), (2, d(-2), 100.0, 0.0, 5000.0)], "key long, date date, price double, ret double, cap double")
    vendor = spark.createDataFrame([("a", d(-1), 10.1, 0.0), ("a", d(1), 10.3, 0.02), ("b", d(-1), 50.5, 0.0), ("b", d(1), 51.0, 0.01), ("b", d(2), None, 0.05)], "code string, date date, price double, ret double")
    links = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "c", False)], "key long, code string, usable boolean")
    out = TK.splice(base, vendor, links, str(d(-1)))
    got = {(r["key"], r["date"]): r for r in out.where("source = 'vendor'").collect()}
    assert set(got) == {(1, d(1)), (2, d(1))} and out.count() == 5
    assert abs(got[1, d(1)]["price"] - 10.1 * 1.02) < 1e-9 and got[2, d(1)]["adj_ratio"] == 2.0
    assert abs(got[2, d(1)]["cap"] - 5000 * 51.0 / 50.5) < 1e-9
    assert TK.splice_coverage(out, links, str(d(-1))).first()["n_off_basis"] == 1


def test_smooth_flips(spark):
    rows = [("x", y, s) for y, s in enumerate("ABACCA")]
    got = "".join(r["s"] for r in W.smooth_flips(spark.createDataFrame(rows, "k string, y int, s string"), "k", "y", "s").orderBy("y").collect())
    assert got == "AAAAAA"
    for text, want in (("ABBABB", "ABBBBB"), ("ABBAB", "ABBBB"), ("ABBA", "AAAA"), ("AB", "AB")):
        rows = [("x", y, s) for y, s in enumerate(text)]
        assert "".join(r["s"] for r in W.smooth_flips(spark.createDataFrame(rows, "k string, y int, s string"), "k", "y", "s").orderBy("y").collect()) == want


def test_breadth_change(spark):
    """By hand: of 10 holders, all there before; then 12 owners, 4 of them new reporters and 2 their last quarter: ((12 - 4) - (10 - 0)) / 10."""
    old = [(h, "e", 1) for h in range(10)] + [(h, "other", 3) for h in range(10)]
    second = [(h, "e", 2) for h in range(8)] + [(h, "e", 2) for h in range(100, 104)] + [(h, "other", 2) for h in range(8, 10)] + [(h, "other", 3) for h in range(100, 102)]
    df = spark.createDataFrame(old + second, "h int, e string, q int")
    got = {(r["e"], r["q"]): r["dbreadth"] for r in W.breadth_change(df, "e", "h", "q").collect()}
    assert got["e", 1] is None and abs(got["e", 2] + 0.2) < 1e-12


def test_breadth_is_not_constant(spark):
    from marlstone.plans import aggregation, panels

    sf = "/root/testdata/sf0.01"
    for q in (aggregation.R.queries["win_dbreadth"], panels.R.queries["panel_inst_own"]):
        assert q(spark, sf).where("dbreadth is not null and dbreadth != 0").count() > 1000


def test_fiscal_year_and_block_type(spark):
    y = lambda d, form, pct: one(spark, S.fiscal_year(F.lit(d).cast("date"), F.lit(form), F.lit(pct)))
    assert y("2020-01-15", "SC 13D", 50.0) == 2019 and y("2020-01-16", "SC 13D", 50.0) == 2020
    assert y("2020-02-24", "SC 13G/A", 9.9) == 2019 and y("2020-02-25", "SC 13G", 9.9) == 2020
    assert y("2020-02-20", "SC 13G", 10.0) == 2020 and y("2020-02-20", None, None) == 2020
    rows = [(1, "in", "SC 13D", True), (2, "ia", "SC 13D", True), (3, "ia", "SC 13G/A", True), (4, "ia", "SC 13G", False), (5, None, None, None)]
    df = spark.createDataFrame(rows, "i int, item12 string, form string, files boolean")
    got = {r["i"]: r["kind"] for r in df.withColumn("kind", DOC.block_type("item12", "form", "files")).collect()}
    assert got == {1: "individual", 2: "active", 3: "passive", 4: "other", 5: "other"}


def test_coverage_end(spark):
    rows = [(1, dt.date(2024, 12, 31)), (2, dt.date(2025, 12, 1))]
    df = spark.createDataFrame(rows, "e int, p date")
    got = {(r["kind"], r["entity"], r["metric"]) for r in X.coverage_end(df, "e", "p", "2025-12-31").collect()}
    assert got == {("coverage_end", "1", 365.0)}
    assert {r["entity"] for r in X.coverage_end(df.where("e = 1"), "e", "p", "2025-12-31").collect()} == {"1", None}


def test_positions(spark):
    df = spark.range(500).select((F.col("id") * 37 % 501).alias("v"), "id")
    got = [(r["v"], r["pos"]) for r in DD.positions(df, [F.col("v").asc(), F.col("id").asc()], "pos").orderBy("pos").collect()]
    assert [p for _, p in got] == list(range(1, 501)) and [v for v, _ in got] == sorted(v for v, _ in got)


# --- names and matching ------------------------------------------------------------------------------------------------


def test_normalize_name(spark):
    n = lambda s, v="l3b", **k: one(spark, S.normalize_name("x", v, **k), x=s)
    assert n("PF Small-Cap Fund (formerly named PF Growth Fund), Inc.") == "PF SMALL CAP FUND" and n("The U.S. Growth Co Fund") == "US GROWTH FUND"
    assert n("The U.S. Growth Fund", "l3") == n("The U.S. Growth Fund", "l2") == "U S GROWTH FUND"
    assert n("S&P 500") == n("SandP 500") == n("S and P 500") == n("S&P 500", "l2") == "S P 500" and n("A & B") == "A B"
    assert n("6721 500 Index B") == "6721 500 INDEX B" and n("6721 500 Index B", drop_code=True) == "500 INDEX B"
    assert n("500 Index Fund", drop_code=True) == "500 INDEX FUND" and n("Trust Na Formerly Held") == "TRUST NA FORMERLY HELD"
    assert one(spark, S.simple_name("x"), x="ORBIMED ADVISORS, L.L.C.") == "ORBIMED ADVISORS" and one(spark, S.simple_name("x"), x="Smith & Co. (Europe), Inc.") == "SMITH AND"
    assert one(spark, S.designator("x"), x="SBL FUND SERIES N") == "N" and one(spark, S.designator("x"), x="PORTFOLIO BOND") is None


def test_similar_is_exact(spark):
    """Against a plain dictionary version: every pair at or over the floor."""
    import math
    from collections import Counter

    left = ["gabelli mario", "katz avishay", "orbimed advisors", "baker bros advisors", "a b"]
    right = ["mario gabelli", "avishay katz", "orbimed advisers", "baker brothers advisors", "gabelli funds", "unrelated"]

    def grams(s):
        out = Counter()
        for w in s.split():
            p = f" {w} "
            for n in (2, 3, 4):
                if n <= len(p) or n == 2:
                    out.update(p[i : i + n] for i in range(max(len(p) - n + 1, 1)))
        return out

    df, n = Counter(g for s in left + right for g in grams(s)), len(left) + len(right)
    unit = lambda v: {g: x / math.sqrt(sum(y * y for y in v.values())) for g, x in v.items()}
    vec = lambda s: unit({g: c * (math.log((1 + n) / (1 + df[g])) + 1) for g, c in grams(s).items()})
    cos = {(a, b): sum(x * vec(b).get(g, 0) for g, x in vec(a).items()) for a in left for b in right}
    frame = lambda xs: spark.createDataFrame([(x, x) for x in xs], "id string, name string")
    for floor in (0.1, 0.3, 0.6):
        got = {(r[0], r[1]): r[2] for r in E.similar(frame(left), frame(right), floor, 99).collect()}
        want = {p: s for p, s in cos.items() if s >= floor}
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_narrow(spark):
    df = spark.createDataFrame([(1, "a", True, True), (1, "b", True, False), (1, "c", False, True), (2, "a", False, False), (2, "b", False, False)], "k int, c string, t bool, u bool".replace("bool", "boolean"))
    got = {r["k"]: (r["c"], r["n_left"]) for r in E.narrow(df, "k", "c", [F.col("t"), F.col("u")]).collect()}
    assert got == {1: ("a", 1), 2: (None, 2)}


def test_cusip_and_dates(spark):
    c = one(spark, S.cusip("x"), x=" 19157p309 ")
    assert (c["cusip9"], c["cusip8"], c["cusip6"], c["valid"]) == ("19157P309", "19157P30", "19157P", True)
    assert one(spark, S.cusip("x"), x="12")["valid"] is False
    leap = dict(f=dt.date(2024, 2, 29), r=dt.date(2023, 2, 28))
    assert one(spark, S.filed_within_a_year("f", "r"), **leap) is False
    assert str(one(spark, S.two_digit_year_date("x"), x="05-MAR-97")) == "1997-03-05"
    assert one(spark, S.html_plain("x"), x="<p>A&nbsp;&amp; <b>B</b><script>x<y</script></p>") == "A & B"
    assert one(spark, S.clip("x", 0.0, 1.0), x=3.0) == 1.0


# --- text and filings ---------------------------------------------------------------------------------------------------


def test_sentences_and_features():
    text = K.normalize("The court in Smith v. Jones held for Mr. Doe. It was re-\nversed.\n12\n\nA new para-\ngraph follows. Yes!")
    assert "reversed" in text and "paragraph" in text and "12" not in text
    assert len(K.sentences(text)) == 4
    f = K.features("Moreover, the rule was made. It is, however, used — often.")
    assert f["n_sents"] == 2 and f["transition_types"] == 2 and f["emdash_per_1000"] > 0 and f["sent_init_trans_frac"] == 0.5
    assert K.features("")["n_words"] == 0 and K.score("", {"sent_len_cv": (0, 1)}) is None


def test_limits_are_gone(spark):
    """Long cells, wide spans and one-letter patterns are whole."""
    long = "H" + "o" * 200
    assert FK.ownership(f"{long} | {'t' * 90} | 12 | 34 | 5.6%")[0]["holder"] == long
    assert FK.people(f"{long} | 44 | {'chief ' * 20}executive officer")[0] == {"seq": 0, "name": long, "age": 44, "position": ("chief " * 20) + "executive officer", "is_ceo": True}
    row = FK.html_tables("<table><tr><td colspan=70>a</td><td>b</td></tr></table>")[0][0]
    assert len(row) == 71 and row[70] == "b"


def test_pattern_places(spark):
    df = spark.createDataFrame([(1, "the board met; the boardroom was cold\nTHE BOARD"), (2, None), (3, "")], "i int, t string")
    got = sorted((r["line"], r["col"], r["end"]) for r in TX.pattern_hits(df, ["i"], "t", {"b": r"\bthe board\b"}).collect())
    assert got == [(1, 1, 10), (2, 1, 10)]


def test_false_precision_masks():
    text = "See Pub. L. 111.2034 and DGCL 2.1234 for the rule in this case.\nThe long run mean was^[a note of 1.2345 here] near 0.5678 in all of them.\n#table(\n 1.2345 one two three four\n)"
    assert [x for _, x in K.false_precision(text)] == ["0.5678"]
    assert K.normalize("a\npage 3\n12345\nb") == "a page 3 b"


def test_false_precision():
    text = "The mean effect was 0.3952 in our sample of firms.\n| 0.3952 | a table row of many words here |\nRule 14.1234 applies to the firms we study.\nIt rose 12.34 percent over all the years.\nCosts were $1,234.567 for each of the firms."
    assert [x for _, x in K.false_precision(text)] == ["0.3952", "12.34 percent"]


def test_metronome():
    s = "The committee of the board has met with the managers of the fund in each of these years. "
    assert "metronomic_run" in [k for _, k, _ in K.lint(s * 5)]
    assert "metronomic_run" not in [k for _, k, _ in K.lint(s * 3 + "It was not so. " + s * 2)]


def test_quotes():
    src = "The court held that the statute, as amended, applies to all funds that vote. " + "filler words go here " * 20 + "It remanded the case for further review of the facts."
    assert K.quote_match("the statute, as amended, applies", src) == "exact"
    assert K.quote_match("[T]he court held [, we note,] that the statute", src) == "bracketed"
    assert K.quote_match("applies to all funds that vote. It remanded the case for further", src) == "gapped"
    assert K.quote_match("the moon is made of green cheese today", src) == "none"
    assert K.quote_order("The court held that the statute ... remanded the case for further review", src) == "ok"
    assert K.quote_order("remanded the case for further review ... The court held that the statute", src) == "disorder"
    assert K.quote_order("nothing like this is in the text ... The court held that the statute", src) == "absent"


def test_grounding():
    src = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    assert K.tightest_span(src, "beta gamma epsilon".split()) == (3, 1, 4)
    assert K.tightest_span(src, "omega psi chi".split()) is None and K.tightest_span([], ["a"]) is None
    ok, cov, den = K.grounded("beta gamma epsilon", " ".join(src))
    assert ok and cov == 1.0 and den == 0.75
    assert K.grounded("", "x")[0] is False


def test_filings():
    xml = "<a:informationTable xmlns:a='u'><a:infoTable><a:nameOfIssuer>ACME</a:nameOfIssuer><a:cusip>037833100</a:cusip><a:value>1,200</a:value><a:shrsOrPrnAmt><a:sshPrnamt>50</a:sshPrnamt></a:shrsOrPrnAmt></a:infoTable></a:informationTable>"
    assert FK.holdings_13f(xml)[0] | {} == {"issuer": "ACME", "title": None, "cusip": "037833100", "value": 1200.0, "shares": 50.0, "kind": None, "discretion": None, "sole": None, "mode": "xml"}
    line = "Kolulund Holdings      COM      901125G10      2,830      865  SH      SOLE      3,142"
    assert FK.holdings_13f(line)[0]["shares"] == 865.0 and FK.holdings_13f("no table") == [] and FK.holdings_13f("<infoTable><broken") == []
    html = "<table><tr><th>Name</th><th>Shares</th><th>Percent</th></tr><tr><td>Ann&nbsp;Lee</td><td>1,000</td><td>5.2%</td></tr></table>"
    assert FK.ownership(html) == [{"table_index": 0, "row_index": 0, "holder": "Ann Lee", "shares": 1000.0, "percent": 5.2, "parser": "grid"}]
    assert FK.people("Name | Age | Position: Samuel B. Shibozzi | 38 | treasurer")[0]["age"] == 38
    assert FK.votes_npx("<x><proxyTable><issuerName>A</issuerName><howVoted>FOR</howVoted><sharesVoted>1,5</sharesVoted></proxyTable></x>")[0]["how_voted"] == "FOR"
    form = "<?xml version='1.0'?><ownershipDocument><issuer><issuerCik>1</issuerCik></issuer><reportingOwner><rptOwnerCik>9</rptOwnerCik><isDirector>1</isDirector></reportingOwner></ownershipDocument>"
    assert FK.form4(form) == [{"issuer_cik": "1", "ticker": None, "owner_cik": "9", "owner": None, "is_director": True}]
    head = "ACCESSION NUMBER:\t0001-24-1\nFILED AS OF DATE:\t20240105\nCONFORMED SUBMISSION TYPE:\tSC 13G\nSUBJECT COMPANY:\n\tCENTRAL INDEX KEY:\t12\nFILED BY:\n\tCENTRAL INDEX KEY:\t34\n</SEC-HEADER>\nCENTRAL INDEX KEY:\t56"
    assert [(r["role"], r["cik"]) for r in FK.header_roles(head)] == [("subject", "0000000012"), ("filed_by", "0000000034")]
    assert FK.percent_of_class("11) Percent of class represented\n\n(11.) 7.5%\n300%") == 7.5 and FK.percent_of_class("none") == 0.0
    assert FK.percent_of_class("Percent of class: -0-") == 0.0 and FK.percent_of_class("PERCENT\n\n\n\nrow\n12,5 %") == 12.5 and abs(FK.percent_of_class("percent\n905.2%") - 5.2) < 1e-9
    assert FK.percent_of_class("percent of the class\n6.25") == 6.25 and FK.percent_of_class("") == 0.0
    assert FK.dual_class("Class A common stock and Class B common stock") and not FK.dual_class("Class A common stock only")


# --- sources ---------------------------------------------------------------------------------------------------------


def test_strict_tsv(spark, tmp_path):
    (tmp_path / "ok.tsv").write_text("1\ta\n2\tb\n")
    (tmp_path / "bad.tsv").write_text("1\ta\n2\n")
    schema = T.StructType().add("n", T.LongType()).add("s", T.StringType())
    assert [tuple(r) for r in RD.strict_tsv(spark, str(tmp_path / "ok.tsv"), schema).collect()] == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="expected 2 fields, found 1"):
        RD.strict_tsv(spark, str(tmp_path / "bad.tsv"), schema).collect()
    with pytest.raises(RD.SchemaError):
        RD.check_schema(spark.range(1), ["x"], "t")


def test_headers_and_submissions(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ACCESSION NUMBER: 1\n</SEC-HEADER>\n" + "x" * 9000)
    assert RD.header_bytes(spark, str(tmp_path / "a.txt")).first()["head"] == "ACCESSION NUMBER: 1\n"
    sub = "<DOCUMENT>\n<TYPE>10-K\n<SEQUENCE>1\n<FILENAME>a.htm\n<TEXT>hello</TEXT>\n</DOCUMENT>"
    df = spark.createDataFrame([(1, sub), (2, None)], "id int, text string")
    assert [tuple(r) for r in RD.submission(df, "text").collect()] == [(1, 0, "10-K", "1", "a.htm", "hello")]


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = [[("A1", "a title")], [("A3", "id"), ("C3", "name")], [("A4", "7"), ("C4", "x")], [("C5", "y")]]
    sheet = f"<worksheet {ns}><sheetData>" + "".join("<row>" + "".join(cell(*c) for c in r) + "</row>" for r in rows) + "</sheetData></worksheet>"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "b.xlsx").write_bytes(buf.getvalue())
    got = RD.xlsx(spark, str(tmp_path / "b.xlsx"), 1, ["name", "id"]).select("name", "id").collect()
    assert [tuple(r) for r in got] == [("x", "7"), ("y", None)]


def test_vote_cells_ids(spark):
    """Every way an id is written counts: blanks, leading zeros and a ``.0`` tail too."""
    from marlstone.plans import panels

    class Given:
        def __init__(self):
            self.spark = spark

        def __call__(self, name):
            if name == "meetings":
                return spark.createDataFrame([(1234567890,), (7,), (0,)], "itemonagendaid long")
            rows = [("1234567890", 1), (" 1234567890 ", 10), ("1234567890.0", 100), ("001234567890", 1000), ("7.0", 5), ("0.0", 9), ("", 9), (None, 9), ("x.0", 9)]
            return spark.createDataFrame([(i, "index", n, 0, 0, float(n)) for i, n in rows], "itemonagendaid string, block string, n_for long, n_against long, n_abstain long, tna_for double")

    got = {r["item"]: (r["n_for"], r["weight"]) for r in panels._cells(Given()).collect()}
    assert got == {1234567890: (1111, 1111.0), 7: (5, 5.0)}


def test_scope_bootstrap(spark):
    """The second pass links within grown scopes, support backs exact names, and shared names are not unique."""
    rows = [
        ("acme growth", "ACME GROWTH", 0.9, "acme", "ACME", ["ACME"], 1),
        ("acme income", "ACME INC", 0.81, "acme", "ACME", ["OTHER"], 1),  # only within the grown scope
        ("beta income", "BETA INC", 0.81, "beta", "BETA", ["OTHER"], 1),  # no scope known
        ("rare name", "RARE NAME", 0.98, "rare", "RARE", ["OTHER"], 1),
        ("shared name", "SHARED NAME", 0.98, "shared", "SHARED", ["OTHER"], 2),  # not unique
    ]
    cand = spark.createDataFrame(rows, "left_id string, unit string, score double, scope_l string, scope_r string, families array<string>, n_same_name long")
    links, support = E.scope_bootstrap(cand)
    got = {r["left_id"]: (r["unit"], r["tier"], r["pass"]) for r in links.collect()}
    assert got == {"acme growth": ("ACME GROWTH", "global", 1), "rare name": ("RARE NAME", "global", 1), "acme income": ("ACME INC", "scoped", 2)}
    assert {(r["scope_l"], r["scope_r"]): r["support"] for r in support.collect()} == {("acme", "ACME"): 1.0, ("rare", "RARE"): 1.0}
    exact = spark.createDataFrame([("x", "X FUND", 1.0, "acme", "ACME", ["OTHER"], 2), ("y", "Y FUND", 1.0, "beta", "BETA", ["OTHER"], 2)], cand.schema)
    verdicts = E.judged(exact, support)
    assert {r["left_id"]: r["verdict"] for r in verdicts.collect()} == {"x": "backed", "y": "veto"}
    assert [r["left_id"] for r in E.accept_global(verdicts).collect()] == ["x"]


def test_cosine_all_labels(spark, tmp_path):
    """A near row counts whatever its label."""
    from marlstone.plans import functions

    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 2), (2, [1.0, 0.2], 1), (3, [-1.0, 0.0], 1), (20, [0.0, 1.0], 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["query_id"], r["hit_id"]) for r in functions.R.queries["fn_cosine_vec"](spark, str(tmp_path)).collect()}
    assert got == {(0, 1), (0, 2)}


def test_tfidf_topk_constants(spark, tmp_path):
    """Every pair from 0.30 on, by brute force, and ranks beyond the third."""
    import math
    from collections import Counter

    from marlstone.plans import resolution

    left = ["ACME GROWTH", "BETA INCOME"]
    right = ["ACME GROWTH", "ACME GROWTHS", "ACME GROW", "ACME GREEN", "ACME GROUP", "BETA INCOMES", "BETA OTHER", "ZZZ QQQ"]
    spark.createDataFrame([(x,) for x in left], "fundname string").write.parquet(str(tmp_path / "split_s12.parquet"))
    spark.createDataFrame([(x,) for x in right], "fund_name string").write.parquet(str(tmp_path / "portnomap.parquet"))

    def grams(s):
        return Counter(p[i : i + n] for w in s.lower().split() for p in [f" {w} "] for n in (2, 3, 4) for i in range(len(p) - n + 1))

    df, n = Counter(g for s in left + right for g in grams(s)), len(left) + len(right)
    vec = {s: {g: c * (math.log((1 + n) / (1 + df[g])) + 1) for g, c in grams(s).items()} for s in left + right}
    size = {s: math.sqrt(sum(x * x for x in v.values())) for s, v in vec.items()}
    cos = {(a, b): sum(x * vec[b].get(g, 0) for g, x in vec[a].items()) / size[a] / size[b] for a in left for b in right}
    want = {p: round(s, 5) for p, s in cos.items() if s >= 0.3}
    got = {(r["left_id"], r["right_id"]): r["score"] for r in resolution.R.queries["er_tfidf_topk"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 2e-5 for p in want)
    assert min(want.values()) < 0.6 and max(Counter(a for a, _ in want).values()) > 3
