"""Group-relative scores: advantages of rollouts within their problem, and scores over subsets of a group."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import comb
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollspark.operators.clusters import with_clusters
from rollspark.operators.order import exact_quantiles


def _group(by=()) -> Window:
    return Window.partitionBy(*by, "problem_id")


def grpo_advantage(R: DataFrame, by=()) -> DataFrame:
    """Reward less the group's mean; ``keep`` is false where all rewards of the group are equal."""
    w = _group(by)
    return R.withColumns({"advantage": F.col("reward") - F.avg("reward").over(w), "keep": F.min("reward").over(w) < F.max("reward").over(w)})


def filtered_share(A: DataFrame, by=()) -> DataFrame:
    pp = A.groupBy(*by, "problem_id").agg(F.max("keep").alias("keep"))
    return pp.groupBy(*by).agg(F.count("*").alias("n_prompts"), F.count_if("keep").alias("n_kept"), F.avg((~F.col("keep")).cast("double")).alias("filtered"))


def with_cluster_size(R: DataFrame, by=()) -> DataFrame:
    return R.withColumn("cluster_size", F.count("*").over(Window.partitionBy(*by, "problem_id", "cluster_id")))


def inverse_freq(A: DataFrame, gamma: float, cap: float, by=()) -> DataFrame:
    """Weights size^-gamma that sum to the group's size, capped; ``weighted`` is weight times advantage."""
    raw = F.pow(F.col("cluster_size"), F.lit(-gamma))
    w = _group(by)
    weight = F.least(raw * F.count("*").over(w) / F.sum(raw).over(w), F.lit(cap))
    return with_cluster_size(A, by).withColumn("weight", weight).withColumn("weighted", F.col("weight") * F.col("advantage"))


def size_divided(A: DataFrame, by=()) -> DataFrame:
    return with_cluster_size(A, by).withColumn("weighted", F.col("advantage") / F.col("cluster_size"))


def focal(A: DataFrame, gamma: float, by=()) -> DataFrame:
    """Advantages scaled by (1 - mean reward)^gamma of the group."""
    hard = 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("reward").over(_group(by))))
    return A.withColumn("weighted", F.pow(hard, F.lit(gamma)) * F.col("advantage"))


#: Subsets that may be made as rows; ``marginal_by_counting`` has no such bound.
MOST_SUBSETS = 1 << 24


def subsets(spark: SparkSession, n: int, m: int) -> DataFrame:
    """All subsets of m indices out of n (63 at most): subset (the number with the members' bits), members.

    Each of the C(n, m) numbers is turned into its subset by the combinatorial number system: from the highest index down,
    an index c is a member if as many subsets of the indices under it come before.
    """
    total = comb(n, m)
    if n > 63 or total > MOST_SUBSETS:
        raise ValueError(f"{total} subsets are too many for rows; see marginal_by_counting")
    table = "array(" + ",".join("array(" + ",".join(f"{comb(c, k)}L" for k in range(m + 1)) + ")" for c in range(max(n, 1))) + ")"
    step = "if(a.k > 0 and t[c][a.k] <= a.left, named_struct('left', a.left - t[c][a.k], 'k', a.k - 1, 'bits', a.bits | shiftleft(1L, c)), a)"
    walk = f"transform(array({table}), t -> aggregate(sequence({n - 1}, 0), named_struct('left', id, 'k', {m}, 'bits', 0L), (a, c) -> {step}).bits)[0]"
    members = F.expr(f"filter(sequence(0, {n - 1}), i -> shiftright(subset, i) % 2 = 1)")
    return spark.range(total).select(F.expr(walk).alias("subset")).withColumn("members", members)


def subset_rows(R: DataFrame, n: int, m: int, by=()) -> DataFrame:
    """Rollouts with index under n of full groups, once for each subset that holds them. The subsets are C(n, m) fixed rows."""
    spark = R.sparkSession
    full = R.where(F.col("rollout_idx") < n).withColumn("_n", F.count("*").over(_group(by))).where(F.col("_n") == n).drop("_n")
    member = subsets(spark, n, m).select("subset", F.explode("members").alias("rollout_idx"))
    return full.join(F.broadcast(member), "rollout_idx")


@dataclass(frozen=True)
class ScoreOfArrays:
    """A score of one's own over arrays: a column function (such as a pandas UDF from Series to Series) of ``columns``, each an
    array of the subset's m values in the order of ``rollout_idx``; a call scores a batch of subsets."""

    score: Callable[..., Column]
    columns: tuple[str, ...]


def scored_groups(R: DataFrame, columns, n: int, m: int, by=()) -> DataFrame:
    """A row per subset of each full group: by, problem_id, subset, and each of ``columns`` as an array of the members' values.

    A full group has the indices 0 to n - 1 once each. It is gathered into one row before its subsets are made, so only
    rollouts are shuffled, and a task holds no table of subsets.
    """
    group = F.array_sort(F.collect_list(F.struct("rollout_idx", *columns)))
    g = R.where(F.col("rollout_idx") < n).groupBy(*by, "problem_id").agg(group.alias("_g"))
    g = g.where(F.transform("_g", lambda x: x["rollout_idx"].cast("int")) == F.sequence(F.lit(0), F.lit(n - 1)))
    g = g.select(*by, "problem_id", *[F.col("_g")[c].alias(c) for c in columns])
    rows = g.crossJoin(F.broadcast(subsets(R.sparkSession, n, m)))
    mine = lambda c: F.transform("members", lambda i: F.get(F.col(c), i)).alias(c)
    return rows.select(*by, "problem_id", "subset", *map(mine, columns))


def _sizes() -> Column:
    """For each member, how many members share its cluster."""
    return F.transform("cluster_id", lambda x: F.size(F.filter("cluster_id", lambda y: y.eqNullSafe(x))))


def _picked(rows: DataFrame, keys, seed: Column) -> DataFrame:
    """Mean reward of the smallest cluster, or of one of the smallest ones by md5."""
    part = """transform(cluster_id, (c, i) -> struct(s[i] AS s, md5(concat_ws('|', _seed, problem_id, subset, c)) AS p,
        aggregate(sequence(0, size(s) - 1), cast(null AS double), (a, j) -> if(cluster_id[j] <=> c, coalesce(a + reward[j], a, reward[j]), a)) / s[i] AS f))"""
    return rows.withColumns({"s": _sizes(), "_seed": seed, "reward": F.col("reward").cast("array<double>")}).select(*keys, F.array_min(F.expr(part))["f"].alias("f"))


def subset_score(R: DataFrame, kind, n: int = 8, m: int = 4, by=(), drop_degenerate: bool = True, tie: str = "average", seed: str = "0") -> DataFrame:
    """A score f of each subset of each group: by, problem_id, subset, f.

    rarest: mean reward of the subset's rarest cluster; tied clusters are averaged (over rollouts), or one is picked by md5.
    poly: mean reward times distinct clusters (degenerate ones left out on demand) over m. worst: the least reward.
    A score of one's own as ``kind`` is a ``ScoreOfArrays``; an aggregate column over the subset's rollouts, such as a grouped pandas
    UDF (called once a subset, which costs some 2 ms); or a function that maps the rows (a rollout in a subset each) and the
    keys of a subset to a frame of the keys and f.
    """
    keys = [*by, "problem_id", "subset"]
    if isinstance(kind, ScoreOfArrays):
        return scored_groups(R, kind.columns, n, m, by).select(*keys, kind.score(*kind.columns).cast("double").alias("f"))
    if isinstance(kind, Column):
        return subset_rows(R, n, m, by).groupBy(*keys).agg(kind.cast("double").alias("f"))
    if callable(kind):
        return kind(subset_rows(R, n, m, by), keys).select(*keys, "f")
    if kind not in ("worst", "poly", "rarest"):
        raise ValueError(f"no subset score named {kind}")
    if kind == "worst":
        return scored_groups(R, ("reward",), n, m, by).select(*keys, F.array_min("reward").alias("f"))
    rows = scored_groups(R, ("reward", "cluster_id"), n, m, by).withColumn("reward", F.col("reward").cast("array<double>"))
    if kind == "poly":
        total = "aggregate(reward, struct(0D AS s, 0 AS n), (a, x) -> if(x is null, a, struct(a.s + x AS s, a.n + 1 AS n)), a -> if(a.n = 0, null, a.s / a.n))"
        kept = F.filter("cluster_id", lambda c: c.isNotNull() & (c != -1) if drop_degenerate else c.isNotNull())
        return rows.select(*keys, (F.expr(total) * F.size(F.array_distinct(kept)) / m).alias("f"))
    if tie != "average":
        return _picked(rows, keys, F.lit(seed))
    # Tied clusters have the same size, so their mean is the mean over their rollouts.
    mean = """aggregate(sequence(0, size(s) - 1), struct(cast(null AS double) AS r, 0 AS n), (a, i) -> if(s[i] = low, struct(coalesce(a.r + reward[i], a.r, reward[i]) AS r, a.n + 1 AS n), a), a -> a.r / a.n)"""
    return rows.withColumn("s", _sizes()).withColumn("low", F.array_min("s")).select(*keys, F.expr(mean).alias("f"))


def marginal_advantage(S: DataFrame, n: int = 8, m: int = 4, by=(), baseline: str = "group") -> DataFrame:
    """Mean of f over the subsets with rollout i, less the mean over all of the group (or of everything); groups whose f is
    all the same give 0 and keep = false. A group is one row of sums, whatever the number of its subsets."""
    if n > 63:
        raise ValueError("a subset's number has 63 bits; see marginal_by_counting")
    keys = [*by, "problem_id"]
    has = lambda i: F.shiftright("subset", i) % 2 == 1
    S = S.where(reduce(and_, [F.col(k).isNotNull() for k in keys])).where((F.bit_count("subset") == m) & (F.shiftright("subset", n) == 0))
    j = S.groupBy(*keys).agg(F.avg("f").alias("mean"), (F.min("f") < F.max("f")).alias("keep"), F.bit_or("subset").alias("subset"), *[F.avg(F.when(has(i), F.col("f"))).alias(f"_{i}") for i in range(n)])
    if baseline == "global":
        j = j.crossJoin(F.broadcast(S.agg(F.avg("f").alias("all")))).withColumn("mean", F.col("all"))
    own = F.array(*[F.when(has(i), F.struct(F.lit(i).alias("rollout_idx"), F.col(f"_{i}").alias("own"))) for i in range(n)])
    j = j.select(*keys, "mean", "keep", F.explode(F.filter(own, lambda x: x.isNotNull())).alias("_o"))
    return j.select(*keys, "_o.rollout_idx", F.when(F.col("keep"), F.col("_o.own") - F.col("mean")).otherwise(0.0).alias("advantage"), "keep")


def advantage_quantiles(A: DataFrame, by=()) -> DataFrame:
    return exact_quantiles(A, "advantage", {"p05": 0.05, "p50": 0.5, "p95": 0.95}, by)


def marginal_over_seeds(R: DataFrame, seeds, n: int = 8, m: int = 4) -> DataFrame:
    """Mean and spread of the marginal advantage over seeded picks among tied clusters."""
    rows = scored_groups(R, ("reward", "cluster_id"), n, m).withColumn("seed", F.explode(F.array(*[F.lit(str(x)) for x in seeds])))
    S = _picked(rows, ["seed", "problem_id", "subset"], F.col("seed"))
    A = marginal_advantage(S, n, m, ("seed",))
    return A.groupBy("problem_id", "rollout_idx").agg(F.avg("advantage").alias("mean"), F.stddev_pop("advantage").alias("std"))


def mechanism_signal(A: DataFrame, gamma: float, cap: float) -> DataFrame:
    """Correlation of recorded (``recorded``) and expected weighted advantages over problems with a correct minority; 1 when
    there are none or nothing varies."""
    x = inverse_freq(grpo_advantage(A), gamma, cap)
    k = A.groupBy("problem_id", "cluster_id").agg(F.count_if(F.col("reward") > 0.5).alias("r")).where("r > 0")
    low = k.groupBy("problem_id").agg((F.min("r") < F.max("r")).alias("m")).where("m").select("problem_id")
    x = x.join(low, "problem_id", "left_semi")
    found = x.agg(F.count("*").alias("n"), F.corr("recorded", "weighted").alias("r"), F.stddev_pop("recorded").alias("a"), F.stddev_pop("weighted").alias("b"))
    ok = (F.col("n") > 0) & (F.col("a") > 1e-12) & (F.col("b") > 1e-12)
    return found.select(F.col("n").alias("n_rollouts"), F.when(ok, F.col("r")).otherwise(1.0).alias("signal"))


def advantages(R: DataFrame, arm, cluster_source: str = "recorded", **options) -> DataFrame:
    """The advantages of an objective by its name, or by a subset score of one's own, over clusters from ``cluster_source``
    (see ``with_clusters``)."""
    R = with_clusters(R, cluster_source, **{k: options[k] for k in ("canonical", "valid", "text", "answer", "features") if k in options})
    if isinstance(arm, str) and arm == "grpo":
        return grpo_advantage(R)
    if isinstance(arm, str) and arm == "inverse_freq":
        return inverse_freq(grpo_advantage(R), options.get("gamma", 0.5), options.get("cap", 2.0)).withColumn("advantage", F.col("weighted"))
    if isinstance(arm, str) and arm == "focal":
        return focal(grpo_advantage(R), options.get("gamma", 2.0)).withColumn("advantage", F.col("weighted"))
    if isinstance(arm, Column | ScoreOfArrays) or callable(arm) or arm in ("rarest", "poly", "worst"):
        return marginal_advantage(subset_score(R, arm, options.get("n", 8), options.get("m", 4)), options.get("n", 8), options.get("m", 4))
    raise ValueError(f"no objective named {arm}")


def kept(R: DataFrame, A: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rollouts of problems with keep = true, and a row that tells how many stay and whether none do."""
    stay = A.where("keep").select("problem_id").distinct()
    rows = R.join(stay, "problem_id", "left_semi")
    return rows, rows.agg(F.count("*").alias("n_rows"), F.count_distinct("problem_id").alias("n_prompts"), (F.count("*") == 0).alias("empty"))

