"""The pass@k family and other metrics of groups of rollouts.

Nearly all are a two-level aggregation: rollouts to problems, problems to means. ``by`` names columns that both levels keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollspark.operators.order import with_quantiles, with_running

from rollspark.functions.math import miss_all

INVALID = ("", "[INVALID]")


def valid(pred: str = "pred") -> Column:
    return F.col(pred).isNotNull() & ~F.col(pred).isin(*INVALID)


def per_prompt(R: DataFrame, by=(), over: float = 0.5) -> DataFrame:
    """n rollouts and c correct ones of each problem."""
    return R.groupBy(*by, "problem_id").agg(F.count("*").alias("n"), F.count_if(F.col("reward") > over).alias("c"))


def long_ladder(df: DataFrame, by, ks, names: dict[str, str]) -> DataFrame:
    """Columns named ``prefix + k`` to rows (by, k, value columns)."""
    fields = lambda k: ", ".join(f"'{out}', {prefix}{k}" for prefix, out in names.items())
    rows = ", ".join(f"named_struct('k', {k}, {fields(k)})" for k in ks)
    return df.select(*by, F.expr(f"inline(array({rows}))"))


def pass_at_k(R: DataFrame, ks, by=(), over: float = 0.5) -> DataFrame:
    """Unbiased pass@k: mean over problems with at least k rollouts of 1 - C(n-c, k) / C(n, k)."""
    value = lambda k: F.when(F.col("n") >= k, 1 - miss_all(F.col("n"), F.col("c"), k))
    aggs = [x for k in ks for x in (F.avg(value(k)).alias(f"p{k}"), F.count_if(F.col("n") >= k).alias(f"m{k}"))]
    found = long_ladder(per_prompt(R, by, over).groupBy(*by).agg(*aggs), by, ks, {"m": "n_prompts", "p": "pass_at_k"})
    return found.where("n_prompts > 0")


def any_correct(R: DataFrame, by=(), over: float = 0.0) -> DataFrame:
    return per_prompt(R, by, over).groupBy(*by).agg(F.count("*").alias("n_prompts"), F.avg((F.col("c") > 0).cast("double")).alias("any_correct"))


def auc_at_k(R: DataFrame, ks, by=(), stored: DataFrame | None = None) -> DataFrame:
    """Trapezoid of pass@k over k; a value in ``stored`` (by, k, pass_at_k) goes before the computed one."""
    ladder = pass_at_k(R, ks, by)
    if stored is not None:
        kept = stored.select(*by, "k", F.col("pass_at_k").alias("stored"))
        ladder = ladder.join(kept, [*by, "k"], "left").withColumn("pass_at_k", F.coalesce("stored", "pass_at_k"))
    w = Window.partitionBy(*by).orderBy("k")
    area = (F.col("k") - F.lag("k").over(w)) * (F.col("pass_at_k") + F.lag("pass_at_k").over(w)) / 2
    return ladder.withColumn("area", F.coalesce(area, F.lit(0.0))).groupBy(*by).agg(F.sum("area").alias("auc"))


def potential_at_k(R: DataFrame, ks, by=(), over: float = 0.5) -> DataFrame:
    """Of problems with k rollouts or more that fail the first k, the share solved by all; 0 when none failed."""
    early = [F.count_if((F.col("rollout_idx") < k) & (F.col("reward") > over)).alias(f"e{k}") for k in ks]
    pp = R.groupBy(*by, "problem_id").agg(F.count("*").alias("n"), F.count_if(F.col("reward") > over).alias("c"), *early)
    failed = lambda k: (F.col("n") >= k) & (F.col(f"e{k}") == 0)
    aggs = [x for k in ks for x in (F.count_if(failed(k)).alias(f"f{k}"), F.count_if(failed(k) & (F.col("c") > 0)).alias(f"s{k}"))]
    found = long_ladder(pp.groupBy(*by).agg(*aggs), by, ks, {"f": "n_failed", "s": "n_later"})
    return found.withColumn("potential", F.when(F.col("n_failed") > 0, F.col("n_later") / F.col("n_failed")).otherwise(0.0))


def _first_k_distinct(R: DataFrame, ks, by, cond: Column, out: str) -> DataFrame:
    aggs = [F.count_distinct(F.when(cond & (F.col("rollout_idx") < k), F.col("pred"))).alias(f"d{k}") for k in ks]
    pp = R.groupBy(*by, "problem_id").agg(*aggs)
    return long_ladder(pp.groupBy(*by).agg(*[F.avg(f"d{k}").alias(f"d{k}") for k in ks]), by, ks, {"d": out})


def coverage_first_k(R: DataFrame, ks, by=(), over: float = 0.5) -> DataFrame:
    """Mean number of distinct correct answers among the first k."""
    return _first_k_distinct(R, ks, by, valid() & (F.col("reward") > over), "coverage")


def distinct_at_k(R: DataFrame, ks, by=()) -> DataFrame:
    return _first_k_distinct(R, ks, by, valid(), "distinct")


def expected_distinct(R: DataFrame, key: str, ks, by=(), keep: Column | None = None, zero_fill: bool = True) -> DataFrame:
    """Mean over problems of the expected number of different ``key`` values among k draws: sum of 1 - C(n-s, k) / C(n, k).

    Only rows under ``keep`` have a key; with ``zero_fill`` problems without such rows count 0. Problems with n < k are left out.
    """
    keep = keep if keep is not None else valid() & (F.col("reward") > 0.5)
    n = R.groupBy(*by, "problem_id").agg(F.count("*").alias("n"))
    s = R.where(keep).groupBy(*by, "problem_id", key).agg(F.count("*").alias("s"))
    joined = n.join(s, [*by, "problem_id"], "left" if zero_fill else "inner")
    miss = lambda k: F.when(F.col("s").isNull(), 0.0).otherwise(1 - miss_all(F.col("n"), F.col("s"), k))
    pp = joined.groupBy(*by, "problem_id", "n").agg(*[F.sum(F.when(F.col("n") >= k, miss(k))).alias(f"v{k}") for k in ks])
    return long_ladder(pp.groupBy(*by).agg(*[F.avg(f"v{k}").alias(f"v{k}") for k in ks]), by, ks, {"v": "expected"})


def cot_diversity(R: DataFrame, ks, by=()) -> DataFrame:
    """Expected number of reasoning clusters among k draws, over correct rollouts that are not degenerate; problems with
    fewer than two correct rollouts are not clustered and count what their single correct rollout gives."""
    c = F.count_if(F.col("reward") > 0.5).over(Window.partitionBy(*by, "problem_id"))
    label = F.when(c < 2, F.lit(0)).otherwise(F.col("cluster_id"))
    return expected_distinct(R.withColumn("label", label), "label", ks, by, (F.col("reward") > 0.5) & (F.col("label") >= 0))


def conditional_mean(df: DataFrame, value: str, n: str, n_with: str) -> DataFrame:
    """A mean over all problems as the mean over those with a correct rollout."""
    return df.withColumn("conditional", F.when(F.col(n_with) > 0, F.col(value) * F.col(n) / F.col(n_with)))


def entropy_at_k(R: DataFrame, ks, by=()) -> DataFrame:
    """Mean entropy in bits of valid answers among the first k, over problems that have one."""
    at = [F.count_if(F.col("rollout_idx") < k).alias(f"c{k}") for k in ks]
    counts = R.where(valid()).groupBy(*by, "problem_id", "pred").agg(*at)
    # -sum p log p = log t - (sum c log c) / t
    sums = [x for k in ks for x in (F.sum(f"c{k}").alias(f"t{k}"), F.sum(F.when(F.col(f"c{k}") > 0, F.col(f"c{k}") * F.log2(f"c{k}")).otherwise(0.0)).alias(f"l{k}"))]
    pp = counts.groupBy(*by, "problem_id").agg(*sums)
    means = [F.avg(F.when(F.col(f"t{k}") > 0, F.log2(f"t{k}") - F.col(f"l{k}") / F.col(f"t{k}"))).alias(f"h{k}") for k in ks]
    return long_ladder(pp.groupBy(*by).agg(*means), by, ks, {"h": "entropy"})


def majority_at_k(R: DataFrame, ks, by=(), gold: str | None = None) -> DataFrame:
    """Share of problems whose commonest valid answer of the first k (tie: seen first) is the gold one or was ever correct."""
    right = F.col("reward") > 0.5
    if gold:
        right = right | (F.col("pred") == F.col(gold))
    inside = F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k > F.col("rollout_idx"))).alias("k")
    rows = R.where(valid()).select(*by, "problem_id", "pred", right.alias("right"), "rollout_idx", inside)
    counts = rows.groupBy(*by, "problem_id", "k", "pred").agg(F.count("*").alias("n"), F.min("rollout_idx").alias("first"), F.max("right").alias("right"))
    best = counts.groupBy(*by, "problem_id", "k").agg(F.max(F.struct("n", -F.col("first"), "right")).alias("b"))
    won = best.groupBy(*by, "k").agg(F.count_if("b.right").alias("won"))
    total = R.select(*by, "problem_id").distinct().groupBy(*by).agg(F.count("*").alias("n_prompts"))
    ladder = total.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return ladder.join(won, [*by, "k"], "left").select(*by, "k", "n_prompts", (F.coalesce("won", F.lit(0)) / F.col("n_prompts")).alias("majority"))


def split_metric(R: DataFrame, ks, by=()) -> DataFrame:
    """Distinct answers@k apart for solved and unsolved problems; null when any problem of a part has fewer than k rollouts."""
    aggs = [F.count_distinct(F.when(valid() & (F.col("rollout_idx") < k), F.col("pred"))).alias(f"d{k}") for k in ks]
    pp = R.groupBy(*by, "problem_id").agg(F.count("*").alias("n"), (F.count_if(F.col("reward") > 0.5) > 0).alias("solved"), *aggs)
    means = [F.when(F.min("n") >= k, F.avg(f"d{k}")).alias(f"d{k}") for k in ks]
    return long_ladder(pp.groupBy(*by, "solved").agg(F.count("*").alias("n_prompts"), *means), [*by, "solved", "n_prompts"], ks, {"d": "distinct"})


def correct_hist(R: DataFrame, n: int, by=()) -> DataFrame:
    """Share of problems with exactly i correct of their first n rollouts, i = 0..n, zeros included."""
    pp = per_prompt(R.where(F.col("rollout_idx") < n), by)
    aggs = [F.avg((F.col("c") == i).cast("double")).alias(f"s{i}") for i in range(n + 1)]
    return long_ladder(pp.groupBy(*by).agg(*aggs), by, range(n + 1), {"s": "share"}).withColumnRenamed("k", "n_correct")


def mixed_rates(R: DataFrame, by=(), over: float = 0.5) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    n, c = F.col("n"), F.col("c")
    return per_prompt(R, by, over).groupBy(*by).agg(F.count("*").alias("n_prompts"), share((c > 0) & (c < n)).alias("mixed"), share(c == 0).alias("all_wrong"), share(c == n).alias("all_correct"))


def by_strata(R: DataFrame, M: DataFrame, over: float = 0.5) -> DataFrame:
    """Rollouts, problems, pass rate and any-correct: overall, by band, and by whether the gold answer is an integer."""
    pp = per_prompt(R, (), over).join(M.select("problem_id", "difficulty_band", F.col("gold").rlike("^-?[0-9]+$").alias("integer_gold")), "problem_id")
    grouped = pp.groupingSets([[], ["difficulty_band"], ["integer_gold"]], "difficulty_band", "integer_gold")
    return grouped.agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n_prompts"), F.sum("n").alias("n_rollouts"), (F.sum("c") / F.sum("n")).alias("pass_rate"), F.avg((F.col("c") > 0).cast("double")).alias("any_correct")
    ).select(F.expr("case gid when 3 then 'overall' when 1 then 'band' else 'integer_gold' end").alias("stratum"), "difficulty_band", "integer_gold", "n_prompts", "n_rollouts", "pass_rate", "any_correct")


def mean_reward_at_1(R: DataFrame, by=()) -> DataFrame:
    return R.where("rollout_idx = 0").groupBy(*by).agg(F.avg("reward").alias("reward_at_1"))


def cover_at_tau(R: DataFrame, tau: float, by=()) -> DataFrame:
    """Mean over problems of the share of correct clusters whose correct rollouts are tau of all or more; 0 without any."""
    n = R.groupBy(*by, "problem_id").agg(F.count("*").alias("n"))
    k = R.where("reward > 0.5").groupBy(*by, "problem_id", "cluster_id").agg(F.count("*").alias("s"))
    pp = n.join(k, [*by, "problem_id"], "left").groupBy(*by, "problem_id").agg(F.avg((F.col("s") / F.col("n") >= tau).cast("double")).alias("v"))
    return pp.groupBy(*by).agg(F.avg(F.coalesce("v", F.lit(0.0))).alias("cover"))


def cover_mass(R: DataFrame, tau: float, n: int, by=()) -> DataFrame:
    """Of problems with a correct rollout, the share whose largest cluster that holds one has tau * n rollouts or more."""
    k = R.groupBy(*by, "problem_id", "cluster_id").agg(F.count("*").alias("s"), F.max("reward").alias("r"))
    pp = k.where("r > 0.5").groupBy(*by, "problem_id").agg(F.max("s").alias("s"))
    return pp.groupBy(*by).agg(F.count("*").alias("n_eligible"), F.avg((F.col("s") / n >= tau).cast("double")).alias("cover"))


def worst_subset(R: DataFrame, q: float, rounding: str = "floor", by=()) -> DataFrame:
    """Mean accuracy of the worst share q of problems, one at least. Only the distinct accuracies are ordered."""
    pp = per_prompt(R, by).groupBy(*by, (F.col("c") / F.col("n")).alias("acc")).agg(F.count("*").alias("m"))
    w = Window.partitionBy(*by)
    ranked = pp.withColumns({"upto": F.sum("m").over(w.orderBy("acc")), "all": F.sum("m").over(w)})
    size = F.greatest(F.lit(1), (F.floor if rounding == "floor" else F.ceil)(F.col("all") * q))
    taken = ranked.withColumn("k", F.least("m", size - F.col("upto") + F.col("m"))).where("k > 0")
    return taken.groupBy(*by).agg(F.sum("k").alias("n_worst"), (F.sum(F.col("acc") * F.col("k")) / F.sum("k")).alias("worst"))


def _clusters(R: DataFrame, by=()) -> DataFrame:
    return R.groupBy(*by, "problem_id", "cluster_id").agg(F.count("*").alias("size"), F.count_if(F.col("reward") > 0.5).alias("right"))


def minority_correct(R: DataFrame, by=()) -> DataFrame:
    """Problems where some correct cluster has strictly fewer correct rollouts than another."""
    return _clusters(R, by).where("right > 0").groupBy(*by, "problem_id").agg((F.min("right") < F.max("right")).alias("minority"), F.count("*").alias("n_clusters"))


def minority_rate(R: DataFrame, by=()) -> DataFrame:
    return minority_correct(R, by).groupBy(*by).agg(F.count("*").alias("n_eligible"), F.avg(F.col("minority").cast("double")).alias("minority_rate"))


def largest_correct(R: DataFrame, by=()) -> DataFrame:
    return _clusters(R, by).groupBy(*by, "problem_id").agg(F.max(F.when(F.col("right") > 0, F.col("size"))).alias("largest_correct"))


def prompt_readout(R: DataFrame, other: str = "pred", by=()) -> DataFrame:
    """One wide row per problem: rollouts, correct ones, pass@1 and pass@8, distinct clusters of two labelings."""
    right, n, c = F.col("reward") > 0.5, F.col("n"), F.col("n_correct")
    distinct = lambda cond, col, name: F.count_distinct(F.when(cond, F.col(col))).alias(name)
    pp = R.groupBy(*by, "problem_id").agg(
        F.count("*").alias("n"),
        F.count_if(right).alias("n_correct"),
        *[distinct(cond, col, f"{col}_{part}") for col in ("cluster_id", other) for part, cond in (("all", F.lit(True)), ("correct", right), ("incorrect", ~right))],
    )
    return pp.withColumns({"pass_at_1": c / n, "pass_at_8": F.when(n >= 8, 1 - miss_all(n, c, 8))})


def cohort_summary(pp: DataFrame, value: str, cohort: Column) -> DataFrame:
    pp = pp.withColumn("cohort", cohort)
    stats = pp.groupBy("cohort").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return with_quantiles(stats, pp, value, {"median": 0.5}, ("cohort",))


def u_correct(R: DataFrame, by=(), zero_fill: bool = False) -> DataFrame:
    """Mean number of distinct, not degenerate clusters among correct rollouts."""
    label = F.when((F.col("reward") > 0.5) & (F.coalesce("cluster_id", F.lit(0)) >= 0), F.coalesce("cluster_id", F.lit(0)))
    pp = R.groupBy(*by, "problem_id").agg(F.count_distinct(label).alias("u"), F.count_if(F.col("reward") > 0.5).alias("c"))
    pp = pp if zero_fill else pp.where("c > 0")
    return pp.groupBy(*by).agg(F.count("*").alias("n_prompts"), F.avg("u").alias("u_correct"))


def ranked_clusters(R: DataFrame, by=()) -> DataFrame:
    """Clusters that are not degenerate, ranked in their problem by size, then id."""
    k = R.where("cluster_id >= 0").groupBy(*by, "problem_id", "cluster_id").agg(F.count("*").alias("size"), F.count_if(F.col("reward") > 0.5).alias("right"), F.min("rollout_idx").alias("first"))
    return k.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "problem_id").orderBy(F.desc("size"), "cluster_id")))


def rank_correctness(R: DataFrame, by=()) -> DataFrame:
    """How often the cluster at frequency rank r has the most correct rollouts (tie: seen first)."""
    w = Window.partitionBy(*by, "problem_id")
    k = ranked_clusters(R, by).withColumn("best", F.max(F.struct("right", -F.col("first"))).over(w))
    k = k.where("best.right > 0").withColumn("is_best", (F.col("right") == F.col("best.right")) & (F.col("first") == -F.col("best")["col2"]))
    return k.groupBy(*by, "rank").agg(F.count("*").alias("n_clusters"), F.avg(F.col("is_best").cast("double")).alias("p_best"), F.avg("size").alias("mean_size"))


def step_diagnostics(R: DataFrame, by=("arm", "step")) -> DataFrame:
    """A row of rates per step: all wrong or right, lengths by reward, finish shares, distinct and entropy of answers, and
    how often the rarest cluster is a correct one."""
    right = F.col("reward") > 0.5
    pp = R.groupBy(*by, "problem_id").agg(
        F.count("*").alias("n"), F.count_if(right).alias("c"), F.count_distinct(F.when(valid(), F.col("pred"))).alias("d"),
        F.sum(F.when(right, F.col("response_length"))).alias("len_right"), F.sum(F.when(~right, F.col("response_length"))).alias("len_wrong"),
        *[F.count_if(F.col("finish_reason") == f).alias(f"f_{f}") for f in ("length", "stop", "eos")],
    )
    k = R.where("cluster_id >= 0").groupBy(*by, "problem_id", "cluster_id").agg(F.count("*").alias("s"), F.max("reward").alias("r"))
    low = k.groupBy(*by, "problem_id").agg(F.min("s").alias("least"), F.sum("s").alias("t"), F.sum(F.col("s") * F.log2("s")).alias("l"), F.max(F.struct(-F.col("s"), (F.col("r") > 0.5).alias("ok"))).alias("rare"))
    j = pp.join(low, [*by, "problem_id"], "left")
    n = F.sum("n")
    return j.groupBy(*by).agg(
        F.count("*").alias("n_prompts"), n.alias("n_rollouts"), F.avg((F.col("c") == 0).cast("double")).alias("all_wrong"), F.avg((F.col("c") == F.col("n")).cast("double")).alias("all_right"),
        (F.sum("c") / n).alias("mean_reward"), (F.sum("len_right") / F.sum("c")).alias("len_right"), (F.sum("len_wrong") / F.sum(F.col("n") - F.col("c"))).alias("len_wrong"),
        *[(F.sum(f"f_{f}") / n).alias(f"share_{f}") for f in ("length", "stop", "eos")], F.avg("d").alias("distinct"),
        F.avg(F.when(F.col("t") > 0, F.log2("t") - F.col("l") / F.col("t"))).alias("cluster_entropy"), F.avg(F.col("rare.ok").cast("double")).alias("rarest_correct"),
    )


def paired(R: DataFrame, base: str, other: str) -> DataFrame:
    """n and c of the problems present in both arms: problem_id, n_base, c_base, n_other, c_other."""
    pp = per_prompt(R, ("arm",))
    side = lambda arm, tag: pp.where(F.col("arm") == arm).select("problem_id", F.col("n").alias(f"n_{tag}"), F.col("c").alias(f"c_{tag}"))
    return side(base, "base").join(side(other, "other"), "problem_id")


def paired_outcome(R: DataFrame, base: str, other: str) -> DataFrame:
    b, o = F.col("c_base") > 0, F.col("c_other") > 0
    full = (F.col("c_base") == F.col("n_base")) & (F.col("c_other") == F.col("n_other"))
    kind = F.when(full, "both_all").when(b & o, "both").when(b, "base_only").when(o, "other_only").otherwise("neither")
    return paired(R, base, other).groupBy(kind.alias("outcome")).agg(F.count("*").alias("n_prompts"))


def win_loss(R: DataFrame, base: str, other: str) -> DataFrame:
    d = F.col("c_other") - F.col("c_base")
    return paired(R, base, other).agg(F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"), F.sum(d).alias("net"), F.avg(d).alias("mean_delta"))


def delta_vs_base(metrics: DataFrame, base: str, keys, value: str) -> DataFrame:
    """Each arm's value less the base arm's at the same keys."""
    b = metrics.where(F.col("arm") == base).select(*keys, F.col(value).alias("base_value"))
    return metrics.join(b, list(keys), "left").withColumn("delta", F.col(value) - F.col("base_value"))


def percentiles_nearest(df: DataFrame, col: str, qs, rule: str = "half_even", by=()) -> DataFrame:
    """Nearest-rank percentiles: the value at index round(q (n - 1)), halves to even, or floor(q (n - 1)).

    Values are counted first, so what is ordered are distinct values.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("value")).agg(F.count("*").alias("m"))
    w = Window.partitionBy(*by)
    c = counts.withColumn("hi", F.sum("m").over(w.orderBy("value"))).withColumn("n", F.sum("m").over(w))
    at = lambda q: F.bround(F.lit(q) * (F.col("n") - 1), 0).cast("long") if rule == "half_even" else F.floor(F.lit(q) * (F.col("n") - 1))
    hit = lambda q: F.min(F.when(F.col("hi") > at(q), F.col("value")))
    wide = c.groupBy(*by).agg(*[hit(q).alias(f"q{i}") for i, q in enumerate(qs)])
    return wide.select(*by, F.expr("inline(array(" + ", ".join(f"named_struct('q', {q}D, 'value', q{i})" for i, q in enumerate(qs)) + "))"))


def length_stats(df: DataFrame, text: str, limit: int, by=()) -> DataFrame:
    n, w = F.length(text), F.size(F.expr(f"filter(split({text}, '\\\\s+'), x -> x <> '')"))
    return df.select(*by, n.alias("chars"), w.alias("words")).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("chars").alias("mean_chars"), F.max("chars").alias("max_chars"), F.avg("words").alias("mean_words"), F.max("words").alias("max_words"),
        F.count_if(F.col("words") > limit).alias("n_over"), F.avg((F.col("words") > limit).cast("double")).alias("share_over"),
    )


def history_quantiles(H: DataFrame, by=("arm", "metric")) -> DataFrame:
    H = H.where("value is not null")
    return with_quantiles(H.groupBy(*by).agg(F.count("*").alias("n")), H, "value", {"median": 0.5, "p95": 0.95}, by)


def billing_hours(usage: DataFrame, stamp: str, run: str, resource: str, cost: str) -> DataFrame:
    """Usage records to cost rows (run, hour, resource, cost): text or time stamps, folded to the hour that is billed."""
    hour = F.date_trunc("hour", F.to_timestamp(F.col(stamp)))
    return usage.select(F.col(run).alias("run"), hour.alias("hour"), F.col(resource).alias("resource"), F.col(cost).alias("cost")).groupBy("run", "hour", "resource").agg(F.sum("cost").alias("cost"))


def cost_rollup(B: DataFrame, rate: float, order=()) -> DataFrame:
    """Cost rows (run, hour, resource, cost) to totals, hours at a rate, and costs by resource.

    Sums of doubles depend on the order of addition. With ``order``, columns that tell all rows apart, the costs of a run and
    resource are added one after the other in that order, however the rows are spread, in running sums (Spark spills the rows of a large group).
    """
    if order:
        so_far = Window.partitionBy("run", "resource").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        B = B.withColumn("cost", F.sum("cost").over(so_far))
        inner = B.groupBy("run", "resource").agg(F.max_by("cost", F.struct(*order)).alias("cost"))
    else:
        inner = B.groupBy("run", "resource").agg(F.sum("cost").alias("cost"))
    return inner.groupBy("run").agg(F.sum("cost").alias("total"), F.sort_array(F.collect_list(F.struct("resource", "cost"))).alias("parts")).withColumn("hours", F.col("total") / rate)


def corr_matrix(df: DataFrame, cols) -> DataFrame:
    """Pearson and Spearman correlation of each pair of columns; ranks are averages over ties."""
    def rank(c: str) -> DataFrame:
        counts = with_running(df.groupBy(c).agg(F.count("*").alias("m")), c, "before", F.col("m"))
        return counts.select(F.col(c).alias(f"_{c}"), (F.col("before") + (F.col("m") + 1) / 2).alias(f"rank_{c}"))

    ranked = df.select(*cols)
    for c in cols:
        ranked = ranked.join(rank(c), F.col(c).eqNullSafe(F.col(f"_{c}"))).drop(f"_{c}")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    wide = ranked.agg(*[x for a, b in pairs for x in (F.corr(a, b).alias(f"p_{a}_{b}"), F.corr(f"rank_{a}", f"rank_{b}").alias(f"s_{a}_{b}"))])
    return wide.select(F.expr("inline(array(" + ", ".join(f"named_struct('a', '{a}', 'b', '{b}', 'pearson', p_{a}_{b}, 'spearman', s_{a}_{b})" for a, b in pairs) + "))"))


def sign_disagreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """How often two scores have opposite signs, by correctness and cluster size (capped at 4)."""
    return df.groupBy((F.col("reward") > 0.5).alias("correct"), F.least("cluster_size", F.lit(4)).alias("size")).agg(F.count("*").alias("n"), F.count_if(F.signum(a) * F.signum(b) < 0).alias("n_opposite"))


def score_distribution(S: DataFrame, value: str, by=()) -> DataFrame:
    v = F.col(value)
    return S.groupBy(*by).agg(F.count("*").alias("n"), F.avg((v == 0).cast("double")).alias("share_0"), F.avg((v == 1).cast("double")).alias("share_1"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def dist_table(df: DataFrame, col: str, most: int) -> DataFrame:
    """Count and share of each value 0..most, zeros included."""
    wide = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(col) == i).alias(f"c{i}") for i in range(most + 1)])
    rows = ", ".join(f"named_struct('value', {i}, 'n', c{i}, 'share', c{i} / n)" for i in range(most + 1))
    return wide.select(F.expr(f"inline(array({rows}))"))


def arm_scorecard(R: DataFrame) -> DataFrame:
    right = F.col("reward") > 0.5
    pp = R.groupBy("arm", "problem_id").agg(
        F.count("*").alias("n"), F.count_if(right).alias("c"), F.count_if(valid()).alias("ok"), F.count_if(F.col("finish_reason") == "length").alias("cut"), F.max(F.when(F.col("rollout_idx") == 0, F.col("reward"))).alias("r1")
    )
    return pp.groupBy("arm").agg(
        F.count("*").alias("n_prompts"), F.sum("n").alias("n_rollouts"), (F.sum("c") / F.sum("n")).alias("pass_rate"), F.avg((F.col("c") > 0).cast("double")).alias("any_correct"),
        F.avg(((F.col("c") > 0) & (F.col("c") < F.col("n"))).cast("double")).alias("mixed"), (F.sum("ok") / F.sum("n")).alias("parse_rate"), (F.sum("cut") / F.sum("n")).alias("cut_rate"), F.avg("r1").alias("reward_at_1"),
    )


def sanity(R: DataFrame, by=("arm",), empty: str = "") -> DataFrame:
    """Problems by number of correct rollouts, with the empty predictions in them and three samples of the first problems."""
    pp = R.groupBy(*by, "problem_id").agg(F.count_if(F.col("reward") > 0.5).alias("c"), F.count("*").alias("n"), F.count_if(F.coalesce("pred", F.lit("")) == empty).alias("empty"))
    # The limit is a number, so each task keeps three rows of a group before they are shuffled.
    first = pp.withColumn("i", F.row_number().over(Window.partitionBy(*by, "c").orderBy("problem_id"))).where("i <= 3")
    samples = first.groupBy(*by, "c").agg(F.concat_ws(",", F.sort_array(F.collect_list("problem_id"))).alias("samples"))
    return pp.groupBy(*by, "c").agg(F.count("*").alias("n_prompts"), F.sum("empty").alias("n_empty"), (F.sum("empty") / F.sum("n")).alias("share_empty")).join(samples, [*by, "c"])


def usable_prompts(R: DataFrame, keys) -> DataFrame:
    """For each choice of key: problems with a correct rollout and two or more different modes."""
    pp = R.groupBy("problem_id").agg(F.count_if(F.col("reward") > 0.5).alias("c"), *[F.count_distinct(k).alias(f"d_{k}") for k in keys])
    wide = pp.agg(F.count("*").alias("n"), *[F.count_if((F.col("c") > 0) & (F.col(f"d_{k}") >= 2)).alias(f"u_{k}") for k in keys])
    return wide.select(F.expr("inline(array(" + ", ".join(f"named_struct('key', '{k}', 'n_usable', u_{k}, 'n_prompts', n)" for k in keys) + "))"))


def singleton_mass(A: DataFrame, adv: str = "advantage", by=(), cluster=("problem_id", "cluster_id")) -> DataFrame:
    """Share of all absolute advantage on wrong rollouts that are alone in their cluster."""
    size = F.count("*").over(Window.partitionBy(*cluster))
    a = F.abs(F.col(adv))
    x = A.withColumn("_s", size)
    return x.groupBy(*by).agg((F.sum(F.when((F.col("_s") == 1) & (F.col("reward") <= 0.5), a).otherwise(0.0)) / F.sum(a)).alias("singleton_mass"))


def step_aggregate(R: DataFrame, adv: str = "advantage") -> DataFrame:
    pp = R.groupBy("step", "problem_id").agg(F.sum("reward").alias("r"), F.count("*").alias("n"), F.sum(adv).alias("a"), F.sum(F.col(adv) * F.col(adv)).alias("aa"), F.count_if(valid()).alias("ok"), F.count_distinct("cluster_id").alias("k"))
    low = minority_correct(R, ("step",)).select("step", "problem_id", "minority")
    n = F.sum("n")
    return pp.join(low, ["step", "problem_id"], "left").groupBy("step").agg(
        (F.sum("r") / n).alias("mean_reward"), (F.sum("aa") / n - (F.sum("a") / n) ** 2).alias("advantage_var"), (F.sum("ok") / n).alias("parse_rate"), F.count_if("minority").alias("n_minority"), F.avg("k").alias("mean_clusters")
    )


def pool_crosstab(L: DataFrame, pool: str, label: str, key: str, first: str, second: str) -> DataFrame:
    """Label counts per pool, and for keys of the first pool that the second lacks."""
    only = L.where(F.col(pool) == first).join(L.where(F.col(pool) == second).select(key), key, "left_anti").withColumn(pool, F.lit(f"{first}_only"))
    return L.unionByName(only.select(*L.columns)).groupBy(pool).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_1"), F.count_if(F.col(label) == 0).alias("n_0"))
