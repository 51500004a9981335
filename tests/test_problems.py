"""The general data problems against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.operators.intervals import periods_and_gaps
from marlstone.operators.known_time import KnownTimeTree, as_known_at
from marlstone.operators.references import canonical_id, orphan_keys, orphan_references

D0 = dt.date(2020, 1, 1)
OPEN = dt.date(9999, 12, 31)


def day(n):
    return D0 + dt.timedelta(n)


def brute_periods(rows):
    by = {}
    for k, s, e in rows:
        e = e or OPEN
        if k is not None and s is not None and e >= s:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, v in by.items():
        cur = None
        for s, e in sorted(v):
            if cur and s <= cur[1] + dt.timedelta(1) if cur and cur[1] < OPEN else cur:
                cur[1] = max(cur[1], e)
            else:
                if cur:
                    out.add((k, "period", *cur))
                    out.add((k, "gap", cur[1] + dt.timedelta(1), s - dt.timedelta(1)))
                cur = [s, e]
        out.add((k, "period", *cur))
    return out


def got_periods(spark, rows, **kw):
    df = spark.createDataFrame(rows, "wficn long, linkb date, linke date")
    return {tuple(r) for r in periods_and_gaps(df, "wficn", "linkb", "linke", **kw).collect()}


@pytest.mark.parametrize("seed,bucket", [(1, 366), (2, 7), (3, 1), (4, 30)])
def test_periods_brute(spark, seed, bucket):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        s = rng.randint(0, 900)
        k = rng.choice([1, 1, 1, 2, 3, None])
        e = None if rng.random() < 0.01 else day(s + rng.choice([-3, 0, 0, 1, 2, 5, 20]))
        rows.append((k, None if rng.random() < 0.05 else day(s), e))
    rows += rows[:50]
    assert got_periods(spark, rows, bucket_days=bucket) == brute_periods(rows)


def test_periods_edges(spark):
    assert got_periods(spark, []) == set()
    rows = [(1, day(0), day(5)), (1, day(6), day(7)), (1, day(9), day(9)), (2, day(1), day(0)), (None, day(1), day(2)), (3, day(1), None), (3, day(50), day(60))]
    assert got_periods(spark, rows) == {(1, "period", day(0), day(7)), (1, "gap", day(8), day(8)), (1, "period", day(9), day(9)), (3, "period", day(1), OPEN)}


def test_periods_clashing_columns(spark):
    df = spark.createDataFrame([(1, day(0), day(1), "x", 5)], "k long, s date, e date, kind string, b int")
    assert periods_and_gaps(df, "k", "s", "e").count() == 1


# --- references --------------------------------------------------------------------------------------------------

T0 = dt.datetime(2024, 1, 1)


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def brute_orphans(refs, versions):
    out = []
    for k, t, i in refs:
        if k is None:
            continue
        vs = [(a, g) for kk, a, g in versions if kk == k]
        if any(a is not None and t is not None and a <= t and (g is None or g > t) for a, g in vs):
            continue
        reason = "missing" if not vs else "deleted" if any(a is not None and t is not None and a <= t for a, g in vs) else "late"
        out.append((i, reason))
    return sorted(out)


@pytest.mark.parametrize("seed,bucket", [(1, 3600), (2, 86400), (3, 7 * 86400)])
def test_orphans_brute(spark, seed, bucket):
    rng = random.Random(seed)
    refs = [(rng.choice(["a", "a", "a", "b", "c", "d", None]), at(rng.choice([None, *range(0, 300)])), i) for i in range(300)]
    versions = []
    for _ in range(60):
        a = rng.choice([None, *range(0, 300)])
        versions.append((rng.choice(["a", "b", "c", "e"]), at(a), at(rng.choice([None, a, (a or 0) + rng.randint(-5, 60)]))))
    r = spark.createDataFrame([(k, t, (i,)) for k, t, i in refs], "key string, ts timestamp_ntz, payload struct<i:int>")
    v = spark.createDataFrame(versions, "key string, ts timestamp_ntz, gone timestamp_ntz")
    got = sorted((x["payload"]["i"], x["reason"]) for x in orphan_references(r, v, bucket).collect())
    assert got == brute_orphans(refs, versions)


def test_orphans_borders_and_empty(spark):
    rs, vs = "key string, ts timestamp_ntz, payload struct<i:int>", "key string, ts timestamp_ntz, gone timestamp_ntz"
    r = spark.createDataFrame([("a", at(5), (1,)), ("a", at(9), (2,))], rs)
    v = spark.createDataFrame([("a", at(5), at(9))], vs)
    assert [(x["payload"]["i"], x["reason"]) for x in orphan_references(r, v).collect()] == [(2, "deleted")]
    assert orphan_references(r.limit(0), v).count() == 0
    assert {x["reason"] for x in orphan_references(r, v.limit(0)).collect()} == {"missing"}
    assert orphan_keys(r, v).collect()[0][:] == ("a", 2, 0)


def test_canonical_id(spark):
    rows = [("0012",), ("12.0",), (" 12 ",), ("0",), ("",), ("  ",), (None,), ("0.0",), ("x7",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(canonical_id("t")).collect()]
    assert got == ["12", "12", "12", None, None, None, None, None, "x7"]


# --- attributes at event time ----------------------------------------------------------------------------------------


def brute_known(events, spans):
    out = {}
    for i, k, a in events:
        fit = [(ld, b, m) for m, kk, b, e, ld in spans if k is not None and a is not None and kk == k and b is not None and ld is not None and b <= a and (e is None or a <= e) and ld <= a]
        if fit:
            out[i] = max(fit)[2]
    return out


@pytest.mark.parametrize("seed,shard", [(1, 1830), (2, 40), (3, 365)])
def test_known_brute(spark, seed, shard):
    rng = random.Random(seed)
    some = lambda n: None if rng.random() < 0.04 else day(n)
    spans = []
    for m in range(300):
        b = rng.randint(0, 800)
        e = None if rng.random() < 0.2 else day(b + rng.choice([-5, 0, 10, 100, 500]))
        spans.append((m, rng.choice([1, 1, 1, 2, 3, None]), some(b), e, some(b + rng.randint(-50, 200))))
    spans += [(1000 + m, *s[1:]) for m, *s in [(i, *x) for i, x in enumerate(spans[:40])]]
    events = [(i, rng.choice([1, 1, 1, 2, 3, 4, None]), some(rng.randint(-50, 1200))) for i in range(500)]
    ev = spark.createDataFrame([(*e, "x") for e in events], "hold_id long, f long, rdate date, map_id string")
    sp = spark.createDataFrame([(*s, 1) for s in spans], "map_id long, f long, begdt date, enddt date, loaddt date, hold_id int")
    for most in (50_000, 3):  # one piece a shard, and hot keys' spans in pieces
        got = {r["hold_id"]: r["map_id"] for r in as_known_at(ev, "f", "rdate", sp, "map_id", "begdt", "enddt", "loaddt", shard, most).collect()}
        assert got == brute_known(events, spans)


def test_known_empty(spark):
    ev = spark.createDataFrame([], "hold_id long, f long, rdate date")
    sp = spark.createDataFrame([(1, 1, day(0), None, day(0))], "map_id long, f long, begdt date, enddt date, loaddt date")
    args = ("f", "rdate", sp, "map_id", "begdt", "enddt", "loaddt")
    assert as_known_at(ev, *args).count() == 0
    one = spark.createDataFrame([(7, 1, day(3)), (7, 1, day(3))], ev.schema)
    assert as_known_at(one, *args).count() == 2  # repeated events keep their rows
    assert as_known_at(one, "f", "rdate", sp.limit(0), "map_id", "begdt", "enddt", "loaddt").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 30), st.integers(0, 12)), max_size=25), st.integers(-2, 35), st.integers(-2, 25))
def test_tree(spans, valid, known):
    rows = [(k, a, a + w, i) for i, (k, a, w) in enumerate(sorted(spans))]
    fit = [i for k, a, b, i in rows if k <= known and a <= valid <= b]
    assert (KnownTimeTree(rows).find(known, valid) if rows else None) == (max(fit) if fit else None)
