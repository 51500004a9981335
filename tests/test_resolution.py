"""Name matching by blocks: against brute force, and what its queries shuffle."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
INPUT = sum(os.path.getsize(f"{SF}/{t}.parquet") for t in ("split_s12", "portnomap"))

#: Queries that match names; no pair of names is shuffled.
MATCHING = ["er_tfidf_topk", "er_best_margin", "er_family_verdict", "er_scoped", "er_tier_ladder", "er_global", "er_two_pass", "join_topk_similarity", "er_accept_global", "er_digit_guard", "er_scope_bootstrap", "er_threshold_sweep", "er_variants_query"]


@pytest.mark.parametrize("name", MATCHING)
def test_no_pair_is_shuffled(spark, name):
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = written()
    entry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert written() - before < INPUT


@pytest.fixture
def names(monkeypatch, tmp_path):
    """Sparse vectors of both sides, with scopes and groups, the right ones on disk in two files; blocks of a few rows."""
    from marlstone.functions import cosine

    for k, v in {"DENSE": 5, "LEFT": 8, "RIGHT": 7, "STRIP": 3, "HELD": 20}.items():
        monkeypatch.setattr(cosine, k, v)
    rng = np.random.default_rng(1)

    def side(n, m):
        dense = rng.random((n, m)) * (rng.random((n, m)) < 0.4)
        dense[:, 0] += 0.01
        dense[1] = dense[0]
        dense /= np.sqrt((dense**2).sum(1))[:, None]
        pack = lambda f: pa.array([f(r).tobytes() for r in dense], pa.binary())
        return dense, pa.table({
            "id": [f"{i:03}" for i in range(n)], "scope": [None if i < 2 else "abc"[i * 3 // n] for i in range(n)], "unit": [i // 5 for i in range(n)],
            "g": pack(lambda r: np.nonzero(r)[0].astype(np.int32)), "w": pack(lambda r: r[r > 0]),
        })

    (a, left), (b, right) = side(21, 30), side(40, 20)
    pq.write_table(right.slice(0, 17), tmp_path / "part-0.parquet")
    pq.write_table(right.slice(17), tmp_path / "part-1.parquet")
    s = a[:, :20] @ b.T

    def found(**kw):
        given = {"floor": 0.3, "k": None, "scope": None, "group": None, "digits": None} | kw
        out = [r for x in cosine.search(str(tmp_path), **given)(iter(left.to_batches(max_chunksize=4))) for r in x.to_pylist()]
        return {(int(r["left_id"]), int(r["right_id"])): r["score"] for r in out}

    return s, left, right, found


def best(s, k, floor, digits=12):
    return {(i, int(j)) for i, r in enumerate(s) for j in np.lexsort((np.arange(len(r)), -np.round(r, digits)))[:k] if r[j] >= floor}


def test_blocks_give_every_pair(names):
    s, left, right, found = names
    got = found()
    assert set(got) == best(s, 99, 0.3) and all(abs(v - s[p]) < 1e-12 for p, v in got.items())
    same = np.array([[x is not None and x == y for y in right["scope"].to_pylist()] for x in left["scope"].to_pylist()])
    assert set(found(scope="scope")) == best(np.where(same, s, 0), 99, 0.3) and set(found(scope="scope", k=2)) == best(np.where(same, s, 0), 2, 0.3)


def test_blocks_keep_the_best(names):
    s, _, _, found = names
    for k in (1, 3, 10):
        assert set(found(k=k, digits=9)) == best(s, k, 0.3)
        assert set(found(k=k, digits=1)) == best(np.where(s >= 0.3, s, 0), k, 0.3, 1)
    units = s.reshape(len(s), -1, 5)
    top = best(units.max(2), 2, 0.3)
    assert set(found(k=2, group="unit", digits=12)) == {(i, u * 5 + int(units[i, u].argmax())) for i, u in top}


def test_blocks_spare_far_pairs(names, monkeypatch):
    """From a floor of 0.6 on: every pair as by brute force, and the dense columns are multiplied for few of the pairs only."""
    from marlstone.functions import cosine

    s, left, right, found = names
    rows = []
    einsum = np.einsum
    monkeypatch.setattr(cosine.np, "einsum", lambda how, a, b: rows.append(len(a)) or einsum(how, a, b))
    for f in (0.6, 0.7, 0.9):
        assert set(found(floor=f)) == best(s, 99, f) and set(found(floor=f, k=2, digits=9)) == best(s, 2, f)
    rows.clear()
    got = found(floor=0.7)
    assert all(abs(v - s[p]) < 1e-12 for p, v in got.items()) and 0 < len(got) <= sum(rows) < s.size // 2


#: Queries whose names are written before they are matched.
SPELLED = ["er_family_verdict", "er_accept_global", "er_scope_bootstrap", "er_threshold_sweep", "er_variants_query", "er_scoped", "er_tier_ladder", "er_global", "er_two_pass", "er_digit_guard"]


@pytest.mark.parametrize("name", SPELLED)
def test_spellings_are_normalised_not_rows(spark, name):
    """split_s12 is read once, for its distinct spellings; no name is normalised on the way."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    entry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList(int(before), 1000)
    plans = [ran.apply(i).physicalPlanDescription() for i in range(ran.size())]
    reading = [p for p in plans if "split_s12.parquet" in p]
    assert len(reading) == 1 and "regexp_replace" not in reading[0]
