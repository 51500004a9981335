"""Golden records against brute force."""

import datetime as dt
import random

from marlstone.llm import survivor

D = dt.date(2024, 1, 1)
FEEDS = {"main": 1, "web": 2}


def brute(rows):
    groups = {}
    for h, w, r, f, c, s, t, feed in rows:
        if r is None or w is None or c is None:
            continue
        q = (r.month - 1) // 3
        end = dt.date(r.year + (q == 3), (q * 3 + 4) % 12 or 12, 1) - dt.timedelta(1) if q < 3 else dt.date(r.year, 12, 31)
        delay = (f - r).days if f is not None and f >= r else None
        key = (delay is None, delay or 0, feed not in FEEDS, FEEDS.get(feed, 0), h)
        groups.setdefault((w, end, "".join(c.split())[:8].upper()), []).append((key, s, t))
    out = set()
    for k, v in groups.items():
        if len(v) >= 2:
            v.sort(key=lambda x: x[0])
            s = next((s for _, s, _ in v if s is not None and s > 0), None)
            t = next((t for _, _, t in v if t is not None and t.strip() not in ("", "N/A", "-")), None)
            out.add((*k, s, t))
    return out


def test_positions_brute(spark):
    rng = random.Random(5)
    day = lambda a, b: None if rng.random() < 0.1 else D + dt.timedelta(rng.randint(a, b))
    rows = [
        (i, rng.choice([1, 1, 1, 2, None]), day(0, 200), day(-10, 260), rng.choice(["abc12345", "ABC12345", " ABC 12345 ", "abc123459", "zzz99999", None]), rng.choice([None, 0, -5, 10, 20]),
         rng.choice([None, "", " ", "N/A", "-", "AA", "BB"]), rng.choice(["main", "web", "odd", None]))
        for i in range(400)
    ]
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(rows[:60])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "hold_id long, wficn long, rdate date, fdate date, cusip8 string, shares long, ticker string, feed string, rq int")
    feeds = spark.createDataFrame(list(FEEDS.items()), "feed string, trust_rank int")
    assert {tuple(r) for r in survivor.positions(df, feeds).collect()} == brute(rows)
    assert survivor.positions(df.limit(0), feeds).count() == 0
    assert survivor.positions(df, feeds.limit(0)).count() == len(brute(rows))


def test_best_records(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None, "a"), (1, 5, "b"), (1, 5, "c"), (2, None, "d")], "k int, v int, _marlstone string")
    got = {r["k"]: r["_marlstone"] for r in survivor.best_records(df, ["k"], [-F.col("v"), F.col("_marlstone")]).collect()}
    assert got == {1: "b", 2: "d"}
