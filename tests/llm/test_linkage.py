"""The label model on votes of known truth, components, and linkage of a small fixture."""

import datetime as dt

import numpy as np

from marlstone.llm import linkage
from marlstone.llm.label_model import LabelModel
from marlstone.llm.names import fold, fund
from marlstone.llm.variants import _score
from marlstone.session import table


def test_label_model_learns_accuracies_and_correlation():
    rng = np.random.default_rng(4)
    n, truth = 20000, None
    truth = rng.random(n) < 0.4
    flip = lambda acc: np.where(rng.random(n) < acc, truth, ~truth)
    a, b, c = flip(0.9), flip(0.85), flip(0.8)
    weak = flip(0.6)
    copies = [weak, weak, weak]  # three functions that say the same must not outvote the rest
    v = np.stack([np.where(x, 1, -1) for x in (a, b, c, *copies)], axis=1)
    v[rng.random(v.shape) < 0.1] = 0
    patterns, inverse, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    post = LabelModel(6).fit(patterns, counts, np.array([[1.0, 1, 1, 0.3, 0.3, 0.3]] * 2))
    guess = post[inverse.ravel()] > 0.5
    majority = v.sum(axis=1) > 0
    assert (guess == truth).mean() > 0.9 > (majority == truth).mean()


def test_components(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "c"), (6, "d"), (None, "d"), (7, None), (1, "a")]
    chain = [(100 + i, f"h{i}") for i in range(12)] + [(101 + i, f"h{i}") for i in range(12)]
    got = {r["node"]: r["unit"] for r in linkage.components(spark.createDataFrame(rows + chain, "node long, hub string")).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert {v for k, v in got.items() if k >= 100} == {100}


def test_components_of_long_chains(spark):
    """400 classes in a chain, labelled in no order: rounds grow with the logarithm, nothing stays apart."""
    ids = [(i * 7919) % 4001 + 1 for i in range(400)]
    rows = [(ids[i], f"h{i}") for i in range(399)] + [(ids[i + 1], f"h{i}") for i in range(399)] + [(9000, "z")]
    got = {r["node"]: r["unit"] for r in linkage.components(spark.createDataFrame(rows, "node long, hub string")).collect()}
    assert {got[i] for i in ids} == {min(ids)} and got[9000] == 9000
    assert linkage.components(spark.createDataFrame([], "node long, hub string")).count() == 0


def test_candidates_against_all_pairs(spark):
    """Of all pairs of titles that verify, how many share a blocking key."""
    titles = {r[0] for r in table(spark, "/root/testdata/sf0.01", "split_s12").select("fundname").distinct().collect() if r[0]}
    titles |= {r[0] for r in table(spark, "/root/testdata/sf0.01", "portnomap").select("fund_name").distinct().collect() if r[0]}
    forms = sorted({fund(fold(t), repair=True)._replace(whole=0) for t in titles if t.strip()})
    keys = [set(linkage._keys(p)) for p in forms]
    met = like = 0
    for i, x in enumerate(forms):
        for j in range(i):
            y = forms[j]
            if x.s == y.s and x.l and y.l and _score(x, y) >= 0.8:
                like, met = like + 1, met + (not keys[i].isdisjoint(keys[j]))
    assert like > 20 and met / like >= 0.97


SIDE = "title string, manager string, objective string, n long, log_sum double, log_n long, first date, last date"


def d(y):
    return dt.date(y, 6, 30)


def test_linkage(spark):
    families = ["ALPHAREX", "BETOLAND", "CARDUMONT", "DELVIRA", "ESTORAK", "FULMINO", "GRADIVA", "HOLMERIT", "INVASTO", "JUNIPOR"]
    left, right = [], []
    for i, f in enumerate(families):
        for j, (short, full) in enumerate([("GRTH FD", "Growth Fund"), ("CORE BD FND", "Core Bond Fund"), ("EMERG MKTS DEBT FD", "Emerging Markets Debt Fund")]):
            k = 10 * i + j
            left.append((k, f"{f} {short}", f"{f} ADVS", str(j), 5, 5 * (3.0 + i), 5, d(2012), d(2020)))
            right.append((1000 + k, f"{f.title()} Funds Trust: {f.title()} {full}; Class A Shares", f"{f.title()} Advisors LLC", "GBE"[j], 2, 2 * (3.1 + i), 2, d(2011), d(2021)))
    right.append((5000, "Alpharex Growth Fund; Class A Shares", "Alpharex Advisors LLC", "G", 2, 2 * 12.0, 2, d(2021), d(2023)))  # a namesake of another size and time
    left.append((900, None, None, None, 1, None, 0, None, None))
    left.append((901, "NOWHERE VALUE FUND", None, None, 1, None, 0, None, None))
    lf, rf = spark.createDataFrame(left, "fund long, " + SIDE), spark.createDataFrame(right, "unit long, " + SIDE)
    got = {r["fund"]: (r["unit"], r["confidence"]) for r in linkage.link_funds(lf, rf).collect()}
    assert {k: u for k, (u, _) in got.items()} == {x[0]: 1000 + x[0] for x in left if x[0] < 900}
    assert all(0.5 < c <= 1 for _, c in got.values())
    assert linkage.link_funds(lf.limit(0), rf).count() == 0
