"""The nearest-neighbour join against all pairs."""

import numpy as np
import pytest

from gradus.operators import nearest as N

ROW = "id long, vector array<double>"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], ROW)


def plain(targets, candidates, least):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cosine = unit(targets) @ unit(candidates).T
    return {i: (int(row.argmax()), float(row.max())) for i, row in enumerate(cosine) if row.max() >= least}


@pytest.mark.parametrize(("miss", "recall"), [(1e-9, 1.0), (0.05, 0.95)])
def test_best_matches(spark, miss, recall):
    rng = np.random.default_rng(5)
    candidates = rng.standard_normal((3000, 24))
    targets = candidates[rng.integers(0, 3000, 400)] + rng.uniform(0, 1.2, (400, 1)) * rng.standard_normal((400, 24))
    want = plain(targets, candidates, 0.75)
    got = {r["target"]: (r["candidate"] - 10_000, r["cosine"]) for r in N.best_matches(frame(spark, targets), frame(spark, candidates, 10_000), 0.75, miss).collect()}
    assert set(got) <= set(want) and 150 < len(want) < 400
    same = [t for t in got if got[t][0] == want[t][0]]
    assert len(same) >= recall * len(want)
    assert all(got[t][1] == pytest.approx(want[t][1], abs=1e-12) for t in same)


def test_buckets_where_they_cost_less(spark, monkeypatch):
    """Buckets and the grid of all pairs find the same; which one is taken follows from their costs, and the grid posts nothing."""
    rng = np.random.default_rng(9)
    candidates = rng.standard_normal((700, 12))
    targets = candidates[rng.integers(0, 700, 150)] + rng.uniform(0, 1.2, (150, 1)) * rng.standard_normal((150, 12))
    want = {i: (c, round(v, 9)) for i, (c, v) in plain(targets, candidates, 0.75).items()}
    posted, real = [], N.coded
    monkeypatch.setattr(N, "coded", lambda *a, **k: posted.append(1) or real(*a, **k))
    monkeypatch.setattr(N, "ROW_BYTES", 8 * 12 * 50, raising=False)
    got = lambda: {r["target"]: (r["candidate"], round(r["cosine"], 9)) for r in N.best_matches(frame(spark, targets), frame(spark, candidates), 0.75, 1e-9).collect()}
    assert got() == want and not posted
    monkeypatch.setattr(N, "POST", -(10**9), raising=False)
    assert got() == want and posted


def test_copies_ties_and_vectors_without_direction(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 8)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(8)
    near = [base + 0.05 * rng.standard_normal(8) for _ in range(100)]  # a bucket of many chunks
    candidates = [np.zeros(8), None, [float("nan")] * 8, [float("inf")] * 8, [1.0] * 7, *near, *[base] * 50]
    targets = [base, base, -base, None, np.zeros(8), base * 2, near[3]]
    got = {r["target"]: (r["candidate"], round(r["cosine"], 12)) for r in N.best_matches(frame(spark, targets), frame(spark, candidates), 0.75, 1e-9).collect()}
    assert got == {0: (105, 1.0), 1: (105, 1.0), 5: (105, 1.0), 6: (8, 1.0)}
    empty = frame(spark, [])
    assert N.best_matches(frame(spark, targets), empty).count() == 0 and N.best_matches(empty, frame(spark, candidates)).count() == 0
    sizes = {n: N.plan(n, 0.75, 0.01) for n in (0, 1, 10**4, 10**8)}
    assert sizes[0] == sizes[1] and sizes[10**8][0] > sizes[10**4][0]


def test_what_a_task_posts_at_a_time_does_not_grow_with_the_tables():
    for n in (10**3, 10**6, 10**8):
        bits, tables = N.plan(n, 0.75, 1e-9)
        times = tables * (bits + 1)
        assert N.at_once(times) >= 1 and N.at_once(times) * times <= max(N.POSTS, times)
