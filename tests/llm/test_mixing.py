"""Budgets and mixtures: shares reached, caps kept, shortages to siblings first."""

import pytest

from marlstone.llm import mixing


def leaf(d, g, s, w, tokens, rep):
    return {"domain": d, "lang": g, "source": s, "weight": w, "tokens": tokens, "max_repeats": rep}


def test_no_shortage_at_the_default_size():
    leaves = [leaf("x", "en", "a", 0.5, 100, 2), leaf("x", "en", "b", 0.25, 1000, 1), leaf("y", "en", "c", 0.25, 500, 1)]
    got, total = mixing.plan(leaves)
    assert total == 400 and got["x", "en", "a"] == pytest.approx(200) and got["y", "en", "c"] == pytest.approx(100)


def test_shortage_goes_to_siblings_before_ancestors():
    leaves = [leaf("x", "en", "a", 0.4, 10, 1), leaf("x", "en", "b", 0.3, 1000, 1), leaf("y", "en", "c", 0.3, 1000, 1)]
    got, _ = mixing.plan(leaves, 100)
    assert got["x", "en", "a"] == pytest.approx(10) and got["x", "en", "b"] == pytest.approx(60) and got["y", "en", "c"] == pytest.approx(30)
    leaves[1]["tokens"] = 40
    got, _ = mixing.plan(leaves, 100)
    assert got["x", "en", "b"] == pytest.approx(40) and got["y", "en", "c"] == pytest.approx(50)
    assert sum(mixing.plan(leaves, 10**9)[0].values()) == pytest.approx(1050)
    assert mixing.plan([]) == ({}, 0.0)


def test_mixture(spark):
    rows = [(i, "a", "en", 5) for i in range(60)] + [(100 + i, "b", ["en", "de"][i % 2], 7) for i in range(300)] + [(500, None, "en", 9), (501, "b", None, 7), (502, "a", "en", 0), (503, "z", "en", 4)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1), ("c", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(counts, targets)
    assert m.where("source = 'a' and repeats > 2 or source = 'b' and repeats > 1").count() == 0
    assert m.where("doc_id in (500, 502, 503)").count() == 0 and m.select("doc_id").distinct().count() == m.count()
    s = {r["source"]: r for r in mixing.shares(m, counts, targets).collect()}
    assert s["a"]["tokens"] == 600 and abs(s["b"]["tokens"] - 600) <= 3 * 7 and s["c"]["tokens"] == 0
    again = {tuple(r) for r in mixing.mix(counts.repartition(7), targets).collect()}
    assert again == {tuple(r) for r in m.collect()}
    other = {tuple(r) for r in mixing.mix(counts, targets, seed=8).collect()}
    assert other != again
    assert mixing.mix(counts.limit(0), targets).count() == 0


def test_plain_source(spark):
    rows = [("DEF14A",), (" forum-Posts ",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(mixing.plain_source("s")).collect()]
    assert got == ["def14a", "forum_posts", None]
