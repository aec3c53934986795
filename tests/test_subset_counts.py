"""Counting over subsets against enumeration."""

from itertools import combinations
from math import comb

import numpy as np
import pytest

from rollspark.operators.subset_counts import marginal_by_counting, scores


def score(kind, rows, drop):
    """(f, variance of a random pick among tied clusters) of one subset of (cluster, reward)."""
    if kind == "worst":
        return min(r for _, r in rows), 0
    if kind == "poly":
        return sum(r for _, r in rows) / len(rows) * len({c for c, _ in rows if c != -1 or not drop}) / len(rows), 0
    by = {}
    for c, r in rows:
        by.setdefault(c, []).append(r)
    low = min(map(len, by.values()))
    means = [sum(x) / len(x) for x in by.values() if len(x) == low]
    return float(np.mean(means)), float(np.var(means))


def brute(kind, cluster, reward, m, drop=True):
    n = len(cluster)
    if n < m:
        return [(0.0, 0.0, False)] * n
    found = {s: score(kind, [(cluster[i], reward[i]) for i in s], drop) for s in combinations(range(n), m)}
    fs = [f for f, _ in found.values()]
    keep = max(fs) - min(fs) > 1e-9
    out = []
    for i in range(n):
        own = np.mean([f for s, (f, _) in found.items() if i in s])
        var = sum(v * ((i in s) / comb(n - 1, m - 1) - 1 / comb(n, m)) ** 2 for s, (_, v) in found.items())
        out.append((own - np.mean(fs), var**0.5, True) if keep else (0.0, 0.0, False))
    return out


@pytest.mark.parametrize("kind", ["rarest", "poly", "worst"])
def test_counting_equals_enumeration(kind):
    rng = np.random.default_rng(5)
    for m in (1, 2, 3, 4, 5, 8):
        groups = []
        for n in [*range(1, 11), 10, 10, 9, 8]:
            cluster = rng.integers(-1, rng.integers(0, 5), n)
            reward = rng.choice([0.0, 1.0], n) if n % 2 else rng.normal(0, 1, n).round(2)
            groups.append((cluster, reward))
        groups += [(np.zeros(8, int), np.ones(8)), (np.arange(8), np.zeros(8)), (np.zeros(8, int), np.full(8, 0.1)), (np.full(8, -1), np.arange(8.0))]
        for drop in (True, False):
            got = scores(np.array([len(c) for c, _ in groups]), np.concatenate([c for c, _ in groups]), np.concatenate([r for _, r in groups]), kind, m, drop)
            want = [x for c, r in groups for x in brute(kind, c.tolist(), r.tolist(), m, drop)]
            assert np.allclose(got[0], [x[0] for x in want], atol=1e-9) and got[2].tolist() == [x[2] for x in want]
            assert kind != "rarest" or np.allclose(got[1], [x[1] for x in want], atol=1e-9)


@pytest.mark.parametrize("kind", ["rarest", "poly", "worst"])
def test_large_groups(spark, kind):
    rng = np.random.default_rng(6)
    rows = [(p, i, int(c), float(r)) for p in range(40) for i, (c, r) in enumerate(zip(rng.integers(-1, 20, 64), rng.integers(0, 2, 64)))]
    df = marginal_by_counting(spark.createDataFrame(rows, "problem_id long, rollout_idx int, cluster_id long, reward double"), kind, 8)
    got = df.collect()
    assert len(got) == len(rows)
    sums = {}
    for r in got:
        sums[r.problem_id] = sums.get(r.problem_id, 0) + r.advantage
    assert all(abs(x) < 1e-9 for x in sums.values())
    # Two rollouts of a cluster with one reward are alike.
    by = {(r[0], r[1]): r for r in rows}
    alike = {}
    for r in got:
        alike.setdefault((r.problem_id, *by[r.problem_id, r.rollout_idx][2:]), set()).add(round(r.advantage, 12))
    assert all(len(x) == 1 for x in alike.values())


def test_no_rows(spark):
    assert marginal_by_counting(spark.createDataFrame([], "problem_id long, rollout_idx int, cluster_id long, reward double"), "rarest", 4).count() == 0


def test_table_function(spark):
    """Problems of all sizes against enumeration, with many in a partition and one by one from SQL."""
    from rollspark.operators.subset_table import scored_subsets

    rng = np.random.default_rng(7)
    groups = [[(None if c > 3 else int(c), float(r)) for c, r in zip(rng.integers(-1, 5, n), rng.normal(0, 1, n).round(2))] for n in [*range(1, 11)] * 5]
    ids = [p * 7 - 40 for p in range(49)] + [None]
    rows = [(ids[p], i, c, r) for p, g in enumerate(groups) for i, (c, r) in enumerate(g)]
    R = spark.createDataFrame(rows, "problem_id long, rollout_idx int, cluster_id long, reward double").repartition(5)
    for kind in ("rarest", "poly", "worst"):
        want = {}
        for p, g in enumerate(groups):
            for s in combinations(range(len(g)), 4):
                part = [g[i] for i in s]
                sizes = {c: sum(x == c for x, _ in part) for c, _ in part}
                rare = [r for c, r in part if sizes[c] == min(sizes.values())]
                f = {"rarest": sum(rare) / len(rare), "poly": sum(r for _, r in part) / 4 * len(set(sizes) - {-1, None}) / 4, "worst": min(r for _, r in part)}[kind]
                want[ids[p], sum(1 << i for i in s)] = f
        found = scored_subsets(R, 4, kind, buckets=3)
        one = spark.sql("SELECT * FROM scored_subsets(TABLE({R}) PARTITION BY problem_id, m => 4, score => {kind})", R=R, kind=kind)
        for df in (found, one):
            got = df.collect()
            assert len(got) == len(want) and {(r.problem_id, r.subset): r.f for r in got} == pytest.approx(want)
    assert "ArrowEvalPythonUDTF" in found._jdf.queryExecution().executedPlan().toString() and "pmod" in found._jdf.queryExecution().executedPlan().toString()
