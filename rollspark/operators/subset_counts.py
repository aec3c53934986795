"""Scores over all subsets of a group by counting: generating functions over cluster sizes in place of the subsets themselves.

A group of n rollouts has C(n, m) subsets. A subset's score depends on how many rollouts it takes from each cluster, so sums
over subsets are coefficients of products with a factor per cluster. The work is polynomial in n and m and no row is made
for a subset.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that are counted together in arrays.
SLICE = 256
TINY = 1e-12


def marginal_by_counting(R: DataFrame, kind: str, m: int, by=(), drop_degenerate: bool = True) -> DataFrame:
    """by, problem_id, rollout_idx, advantage, spread, keep: as ``marginal_advantage(subset_score(...))``, for groups of any size.

    ``advantage`` is the mean score of the subsets of m rollouts that hold the rollout, less the mean over all. ``keep`` is false where
    all subsets score the same. ``spread`` is, for ``rarest``, the standard deviation of the advantage when one of the tied
    clusters is drawn at random in each subset (what ``marginal_over_seeds`` estimates; its mean is ``advantage``), else 0.
    A group with fewer than m rollouts has no subsets: advantage 0, keep false. Rewards must not be null.

    A group is one row of an Arrow batch, so its size is bounded by memory; groups are counted ``SLICE`` at a time.
    """
    if kind not in ("rarest", "poly", "worst"):
        raise ValueError(f"no subset score named {kind}")
    keys = [*by, "problem_id"]
    groups = R.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rollout_idx", F.col("cluster_id").cast("long").alias("c"), F.col("reward").cast("double").alias("r")))).alias("g"))
    groups = groups.select(*keys, *(F.col(f"g.{c}").alias(f"_{c}") for c in ("rollout_idx", "c", "r")))
    kinds = ", ".join(f"{k} {groups.schema[k].dataType.simpleString()}" for k in keys)
    index = R.schema["rollout_idx"].dataType.simpleString()

    def count(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                sizes = np.diff(columns["_r"].offsets.to_numpy())
                flat = {c: columns[f"_{c}"].flatten() for c in ("rollout_idx", "c", "r")}
                found = scores(sizes, flat["c"].to_numpy(zero_copy_only=False), flat["r"].to_numpy(zero_copy_only=False), kind, m, drop_degenerate)
                rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays([*(columns[k].take(rows) for k in keys), flat["rollout_idx"], *map(pa.array, found)], [*keys, "rollout_idx", "advantage", "spread", "keep"])

    return groups.mapInArrow(count, f"{kinds}, rollout_idx {index}, advantage double, spread double, keep boolean")


def scores(sizes, cluster, reward, kind: str, m: int, drop_degenerate: bool = True):
    """(advantage, spread, keep) per rollout, for groups given one after the other by their sizes."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    if kind == "worst":
        own, spread, lo, hi = _worst(sizes, group, reward, m)
    else:
        own, spread, lo, hi = Groups(sizes, group, cluster, reward, m).means(kind, drop_degenerate)
    full = sizes >= m
    mean = np.bincount(group, own, len(sizes)) / np.maximum(sizes, 1)
    with np.errstate(invalid="ignore"):
        keep = full & (hi - lo > TINY * np.maximum(1, np.maximum(np.abs(lo), np.abs(hi))))
    return np.where(keep[group], own - mean[group], 0.0), np.where(keep[group], spread, 0.0), keep[group]


def _worst(sizes, group, reward, m):
    """By ranks: the least of a subset with rollout i is i itself, or a lower one beside it."""
    own, lo, hi = np.zeros(len(reward)), np.zeros(len(sizes)), np.zeros(len(sizes))
    starts = np.cumsum(sizes) - sizes
    for g, (at, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        if n < m:
            continue
        order = np.argsort(reward[at : at + n], kind="stable")
        r = reward[at : at + n][order]
        below, itself = _rank_shares(n, m)
        sums = np.cumsum(r * below) - r * below + r * itself
        own[at + order] = sums
        lo[g], hi[g] = r[0], r[n - m]
    return own, np.zeros(len(reward)), lo, hi


@lru_cache(1024)
def _rank_shares(n: int, m: int):
    """Of the subsets with a given rollout: the share whose least is the j-th lowest below it, and whose least is itself, the i-th."""
    total = comb(n - 1, m - 1)
    below = np.array([comb(n - j - 2, m - 2) / total if m > 1 and j < n - 1 else 0.0 for j in range(n)])
    itself = np.array([comb(n - i - 1, m - 1) / total for i in range(n)])
    return below, itself


class Groups:
    """Some groups' clusters side by side: n, R, Q (size, sum and sum of squares of rewards) by group and cluster; sizes 0 fill up."""

    def __init__(self, sizes, group, cluster, reward, m):
        self.m, self.sizes, self.group, self.reward = m, sizes, group, reward
        order = np.lexsort((reward, cluster, group))
        g, c, r = group[order], cluster[order], reward[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        of_group = g[first]
        place = np.arange(len(first)) - np.searchsorted(of_group, of_group)
        self.column = np.empty(len(g), np.int64)
        self.column[order] = place[number]
        shape = (len(sizes), int(place.max()) + 1 if len(place) else 1)
        self.n, self.R, self.Q = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape)
        np.add.at(self.n, (g, place[number]), 1)
        np.add.at(self.R, (g, place[number]), r)
        np.add.at(self.Q, (g, place[number]), r * r)
        self.degenerate = np.zeros(shape, bool)
        self.degenerate[of_group, place] = c[first] == -1
        # Sums of a cluster's j lowest and highest rewards, j to m.
        self.low, self.high = np.full((*shape, m + 1), np.inf), np.full((*shape, m + 1), -np.inf)
        self.low[..., 0] = self.high[..., 0] = 0
        inside = np.arange(len(g)) - first[number] if len(g) else g
        back = self.n[g, place[number]] - 1 - inside
        run = np.cumsum(r)
        upto = run - (run[first] - r[first])[number]
        total = self.R[g, place[number]]
        some = inside < m
        self.low[g[some], place[number][some], inside[some] + 1] = upto[some]
        some = back < m
        self.high[g[some], place[number][some], back[some] + 1] = (total - upto + r)[some]
        most = int(sizes.max()) if len(sizes) else 0
        self.binomial = np.array([[comb(a, b) for b in range(m + 1)] for a in range(most + 1)], float)

    def means(self, kind, drop_degenerate):
        if kind == "poly":
            own, (lo, hi) = self._poly(drop_degenerate), self._poly_range(drop_degenerate)
            return own, np.zeros(len(own)), lo, hi
        return *self._rarest(), *self._rarest_range()

    def _c(self, a, b):
        """Binomials, 0 outside."""
        return np.where((a >= b) & (b >= 0), self.binomial[np.maximum(a, 0), np.clip(b, 0, self.m)], 0.0)

    # --- mean reward times distinct clusters over m ---

    def _poly(self, drop_degenerate):
        m, N = self.m, self.sizes
        counted = (self.n > 0) & ~(self.degenerate & drop_degenerate)
        total = np.maximum(self._c(N - 1, m - 1), 1)[:, None]
        # Of the subsets with i: those without cluster c; those without c but with another given rollout.
        none = self._c(N[:, None] - 1 - self.n, m - 1) / total * counted
        pair = self._c(N[:, None] - 2 - self.n, m - 2) / total * counted
        R = self.R.sum(1)
        g, c, r = self.group, self.column, self.reward
        with np.errstate(divide="ignore", invalid="ignore"):
            both = np.where(N > 1, (m - 1) / np.maximum(N - 1, 1), 0.0)
        expected = r + (R[g] - r) * both[g]  # sum of a subset's rewards, given i

        def others(x):
            return x.sum(1)[g] - x[g, c]

        gone = r * others(none) + (R[g] - r) * others(pair) - others(self.R * pair)
        return (expected * counted.sum(1)[g] - gone) / m**2

    def _poly_range(self, drop_degenerate):
        m, (G, C) = self.m, self.n.shape
        out = []
        for sums, worst, better in ((self.low, np.inf, np.minimum), (self.high, -np.inf, np.maximum)):
            best = np.full((G, m + 1, m + 1), worst)
            best[:, 0, 0] = 0
            for c in range(C):
                step = best.copy()
                free = self.degenerate[:, c] & drop_degenerate
                for j in range(1, m + 1):
                    moved = best[:, : m + 1 - j] + sums[:, c, j][:, None, None]
                    step[:, j:] = better(step[:, j:], np.where(free[:, None, None], moved, worst))
                    step[:, j:, 1:] = better(step[:, j:, 1:], np.where(free[:, None, None], worst, moved)[:, :, :-1])
                best = step
            sums_m = best[:, m]
            scored = np.where(np.isfinite(sums_m), np.where(np.isfinite(sums_m), sums_m, 0) * np.arange(m + 1) / m**2, worst)
            out.append((scored.min if worst > 0 else scored.max)(1))
        return out

    # --- mean reward of the rarest cluster, tied ones averaged ---

    def _rarest(self):
        m, N = self.m, self.sizes
        G, C = self.n.shape
        g, c, r = self.group, self.column, self.reward
        own, var = np.zeros(len(r)), np.zeros(len(r))
        n, R, Q = self.n[g, c], self.R[g, c], self.Q[g, c]
        nn = np.maximum(self.n, 1)
        for s in range(1, m + 1):
            T = m // s
            mean = self.R / nn
            pairs = np.where(self.n > 1, (self.R**2 - self.Q) / np.maximum(self.n * (self.n - 1), 1), 0)
            square = (s * self.Q / nn + s * (s - 1) * pairs) / s**2
            tied = self._c(self.n, np.full_like(self.n, s))
            larger = [(j, self._c(self.n, np.full_like(self.n, j))) for j in range(s + 1, m + 1)]

            def times(p, k):
                """The product p with the factor of cluster k: absent, tied (s rollouts) or with more than s."""
                out = p.copy()
                w = tied[:, k][:, None, None]
                a, b = mean[:, k][:, None, None], square[:, k][:, None, None]
                p0, p1, p2, q = (x[:, : m + 1 - s, :T] * w for x in p)
                out[0][:, s:, 1:] += p0
                out[1][:, s:, 1:] += p1 + a * p0
                out[2][:, s:, 1:] += p2 + a * p1
                out[3][:, s:, 1:] += q + b * p0
                for j, w in larger:
                    out[:, :, j:] += p[:, :, : m + 1 - j] * w[:, k][None, :, None, None]
                return out

            one = np.zeros((4, G, m + 1, T + 1))
            one[0, :, 0, 0] = 1
            after = [one]
            for k in reversed(range(1, C)):
                after.append(times(after[-1], k))
            after.reverse()
            before = one
            for k in range(C):
                # The product over the other clusters; rows: how many, sum of means, of products of means, of squares.
                rest = _product(before, after[k], m, T)
                mine = c == k
                if mine.any():
                    own_k, var_k = self._with(rest, s, T, g[mine], n[mine], R[mine], Q[mine], r[mine])
                    own[mine] += own_k
                    var[mine] += var_k
                before = times(before, k)
        a, b = np.maximum(self._c(N - 1, m - 1), 1), np.maximum(self._c(N, m), 1)
        total = np.bincount(g, var, G) / m
        spread = var * (1 / a - 1 / b)[g] ** 2 + (total[g] - var) / b[g] ** 2
        return own / a[g], np.sqrt(np.maximum(spread, 0))

    def _with(self, rest, s, T, g, n, R, Q, r):
        """Sums over the subsets with a rollout, whose cluster is tied or has more than s in the subset."""
        m, k = self.m, n - 1
        left, squares = R - r, Q - r * r
        first = (s - 1) * left / np.maximum(k, 1)
        second = (s - 1) * squares / np.maximum(k, 1) + (s - 1) * (s - 2) * (left**2 - squares) / np.maximum(k * (k - 1), 1)
        mean = (r + first) / s
        square = (r * r + 2 * r * first + second) / s**2
        t = np.arange(1, T + 1)
        w = self._c(k, np.full_like(k, s - 1))[:, None]
        p0, p1, p2, q = (x[g, m - s, :T] * w for x in rest)
        own = ((mean[:, None] * p0 + p1) / t).sum(1)
        var = ((1 / t - 1 / t**2) * (square[:, None] * p0 + q) - 2 / t**2 * (mean[:, None] * p1 + p2)).sum(1)
        for j in range(s + 1, m + 1):
            w = self._c(k, np.full_like(k, j - 1))[:, None]
            _, p1, p2, q = (x[g, m - j, 1:] * w for x in rest)
            own += (p1 / t).sum(1)
            var += ((1 / t - 1 / t**2) * q - 2 / t**2 * p2).sum(1)
        return own, var

    def _rarest_range(self):
        m, (G, C) = self.m, self.n.shape
        lo, hi = np.full(G, np.inf), np.full(G, -np.inf)
        for s in range(1, m + 1):
            T = m // s
            share = s * np.maximum(np.arange(T + 1), 1)
            for sums, worst, better in ((self.low, np.inf, np.minimum), (self.high, -np.inf, np.maximum)):
                best = np.full((G, m + 1, T + 1), worst)
                best[:, 0, 0] = 0
                for c in range(C):
                    step = best.copy()
                    step[:, s:, 1:] = better(step[:, s:, 1:], best[:, : m + 1 - s, :T] + sums[:, c, s][:, None, None])
                    for j in range(s + 1, m + 1):
                        step[:, j:] = better(step[:, j:], np.where((self.n[:, c] >= j)[:, None, None], best[:, : m + 1 - j], worst))
                    best = step
                found = best[:, m, 1:] / share[1:]
                if worst > 0:
                    lo = np.minimum(lo, found.min(1))
                else:
                    hi = np.maximum(hi, found.max(1))
        return lo, hi


def _product(a, b, m, T):
    """The product of two truncated polynomials in rollouts and ties, with first- and second-order parts."""
    out = np.zeros_like(a)
    for x in range(m + 1):
        for t in range(T + 1):
            p0, p1, p2, q = (y[:, x, t][:, None, None] for y in a)
            if not p0.any():
                continue
            b0, b1, b2, bq = (y[:, : m + 1 - x, : T + 1 - t] for y in b)
            out[0][:, x:, t:] += p0 * b0
            out[1][:, x:, t:] += p0 * b1 + p1 * b0
            out[2][:, x:, t:] += p0 * b2 + p1 * b1 + p2 * b0
            out[3][:, x:, t:] += p0 * bq + q * b0
    return out
