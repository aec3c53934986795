"""A table function: problems' rollouts in, their scored subsets out."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs of members that are compared at once.
AT_ONCE = 1 << 20


class ScoredSubsets:
    """``scored_subsets(TABLE(SELECT problem_id, rollout_idx, cluster_id, reward FROM ..) PARTITION BY problem_id, m => 4, score => 'rarest')``.

    The table's columns are taken by name. Each subset of m rollouts of a problem gives a row: subset (the number with
    the bits of the members' indices) and f, by the scores of ``subset_score``. A problem with fewer rollouts than m has none.
    A partition may hold many problems if the table is ordered by problem_id, which is quicker: problems that a batch completes
    are scored together. Rows are yielded in parts, so only a problem's or a batch's rollouts are held.
    """

    def __init__(self):
        self.left, self.m, self.score = [], 4, "rarest"

    def eval(self, rows: pa.RecordBatch, m: pa.Array = None, score: pa.Array = None) -> Iterator[pa.Table]:
        self.m = self.m if m is None else m[0].as_py()
        self.score = self.score if score is None else score[0].as_py()
        self.left.append(pa.Table.from_batches([rows]))
        problem = rows.column("problem_id")
        if len(rows) and not problem[0].equals(problem[-1]):
            # The last problem may go on in the next batch.
            whole = pa.concat_tables(self.left)
            last = int(starts(whole["problem_id"])[-1])
            self.left = [whole.slice(last)]
            yield from scored(whole.slice(0, last), self.m, self.score)

    def terminate(self) -> Iterator[pa.Table]:
        if self.left:
            yield from scored(pa.concat_tables(self.left), self.m, self.score)


def starts(problem: pa.ChunkedArray) -> np.ndarray:
    """Where problems begin; null is one."""
    none, number = problem.is_null().to_numpy(), problem.fill_null(0).to_numpy()
    return np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (none[1:] != none[:-1])][: len(number)])


def scored(rows: pa.Table, m: int, score: str) -> Iterator[pa.Table]:
    """The scored subsets of problems whose rows stand together."""
    of = {"rarest": rarest, "poly": poly, "worst": worst}[score]
    problem, index = rows["problem_id"].combine_chunks(), rows["rollout_idx"].to_numpy().astype(np.int64)
    # Null is a cluster of its own.
    cluster = rows["cluster_id"].combine_chunks()
    absent = cluster.is_null().to_numpy(zero_copy_only=False)
    cluster, reward = cluster.fill_null(0).to_numpy(), rows["reward"].to_numpy()
    first = starts(rows["problem_id"])
    size = np.diff(np.r_[first, len(problem)])
    for n in np.unique(size[size >= m]).tolist():
        at = first[size == n][:, None] + np.arange(n)
        at = np.take_along_axis(at, np.argsort(index[at], axis=1, kind="stable"), 1)
        members, step = combinations(range(n), m), max(1, AT_ONCE // (m * m))
        while part := list(islice(members, step)):
            some = max(1, step // len(part))
            for lo in range(0, len(at), some):
                x = at[lo : lo + some][:, np.array(part).reshape(len(part), m)]
                f = of(cluster[x], absent[x], reward[x])
                bits = (np.int64(1) << index[x]).sum(2)
                yield pa.table({"problem_id": problem.take(pa.array(np.repeat(at[lo : lo + some, 0], len(part)))), "subset": bits.ravel(), "f": f.ravel()})


def rarest(cluster: np.ndarray, absent: np.ndarray, reward: np.ndarray) -> np.ndarray:
    """Mean reward of the smallest clusters' rollouts; the last axis is a subset's members."""
    same = (cluster[..., None] == cluster[..., None, :]) & (absent[..., None] == absent[..., None, :])
    sizes = same.sum(-1)
    low = sizes == sizes.min(-1, keepdims=True)
    return np.where(low, reward, 0).sum(-1) / low.sum(-1)


def poly(cluster: np.ndarray, absent: np.ndarray, reward: np.ndarray) -> np.ndarray:
    m = cluster.shape[-1]
    counted = (cluster != -1) & ~absent
    same = (cluster[..., None] == cluster[..., None, :]) & counted[..., None] & counted[..., None, :]
    # A member counts if no earlier one has its cluster.
    fresh = counted & ~np.tril(same, -1).any(-1)
    return reward.sum(-1) / m * fresh.sum(-1) / m


def worst(cluster: np.ndarray, absent: np.ndarray, reward: np.ndarray) -> np.ndarray:
    return reward.min(-1)


def register_table_functions(spark: SparkSession) -> None:
    """Make ``scored_subsets`` known to SQL; rows come and go in Arrow batches."""
    spark.udtf.register("scored_subsets", F.arrow_udtf(ScoredSubsets, returnType="problem_id long, subset long, f double"))


def scored_subsets(R: DataFrame, m: int = 4, score: str = "rarest", buckets: int = 1024) -> DataFrame:
    """The table function over all of a table, with many problems in a partition."""
    spark = R.sparkSession
    register_table_functions(spark)
    R = R.select(F.col("problem_id").cast("long").alias("problem_id"), F.col("rollout_idx").cast("int").alias("rollout_idx"), F.col("cluster_id").cast("long").alias("cluster_id"), F.col("reward").cast("double").alias("reward"))
    return spark.sql("SELECT * FROM scored_subsets(TABLE({R}) PARTITION BY pmod(xxhash64(problem_id), {buckets}) ORDER BY problem_id, m => {m}, score => {score})", R=R, m=m, score=score, buckets=buckets)
