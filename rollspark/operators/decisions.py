"""Bootstrap intervals, decision gates, and double labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollspark.operators.order import with_running


def _digits(*parts) -> Column:
    """A number from the first eight hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def replicates(pp: DataFrame, B: int, seed, key: str = "problem_id") -> DataFrame:
    """B resamples of the problems with replacement: b and each drawn row. Draw j of replicate b is the row at
    md5(seed, b, j) mod N in key order. Draws are shuffled; for very many problems use ``poisson_replicates``."""
    ranked = with_running(pp, key, "_i")
    draws = ranked.select(F.col("_i").alias("_j"), F.explode(F.sequence(F.lit(0), F.lit(B - 1))).alias("b")).crossJoin(F.broadcast(pp.agg(F.count("*").alias("_n"))))
    draws = draws.select("b", "_j", (_digits(F.lit(str(seed)), "b", "_j") % F.col("_n")).cast("long").alias("_i"))
    return draws.join(ranked, "_i").drop("_i")


def poisson_replicates(pp: DataFrame, B: int, seed, key: str = "problem_id") -> DataFrame:
    """As weights: each row once per replicate where its Poisson(1) weight, from its own hash, is over 0. No shuffle."""
    u = _digits(F.lit(str(seed)), "b", F.col(key).cast("string")) / float(1 << 32)
    cdf, weight = 0.0, F.lit(0)
    for k in range(9):
        cdf += math.exp(-1) / math.factorial(k)
        weight = weight + (u >= cdf).cast("int")
    return pp.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(B - 1)))).withColumn("weight", weight).where("weight > 0")


def order_ci(stats: DataFrame, value: str, B: int, level: float = 0.95) -> DataFrame:
    """Order-statistic interval and spread over replicates (b, value)."""
    a = (1 - level) / 2
    v = F.array_sort(F.collect_list(value))
    return stats.agg(v.alias("v"), F.stddev_pop(value).alias("std")).select(F.col("v")[int(a * B)].alias("ci_low"), F.col("v")[int((1 - a) * B) - 1].alias("ci_high"), "std")


def bootstrap_ci(pp: DataFrame, metric: Column, B: int, seed, level: float = 0.95) -> DataFrame:
    """Point, interval and spread of an aggregate over problems."""
    stats = replicates(pp, B, seed).groupBy("b").agg(metric.alias("value"))
    return pp.agg(metric.alias("point")).join(order_ci(stats, "value", B, level), F.lit(True))


def bootstrap_mean(pp: DataFrame, col: str, B: int, seed) -> DataFrame:
    """Mean with the 2.5 and 97.5 percentiles (linear) of resampled means."""
    stats = replicates(pp, B, seed).groupBy("b").agg(F.avg(col).alias("m"))
    return pp.agg(F.avg(col).alias("point"), F.count(col).alias("n")).join(stats.agg(F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high")), F.lit(True))


def bootstrap_metric(pp: DataFrame, metric, B: int, seed, level: float = 0.95) -> DataFrame:
    """``metric`` maps a frame of replicates (column b) to rows (b, value); it may rank within each replicate."""
    point = metric(pp.withColumn("b", F.lit(0))).select(F.col("value").alias("point"))
    return point.join(order_ci(metric(replicates(pp, B, seed)), "value", B, level), F.lit(True))


def worst_in_sample(q: float, acc: str = "acc"):
    """The metric of ``bootstrap_metric`` that ranks each resample: mean of the worst share q. Only distinct values are ordered."""
    def metric(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("b")
        x = df.groupBy("b", F.col(acc).alias("_a")).agg(F.count("*").alias("_m"))
        x = x.withColumns({"_upto": F.sum("_m").over(w.orderBy("_a")), "_n": F.sum("_m").over(w)})
        size = F.greatest(F.lit(1), F.floor(F.col("_n") * q))
        taken = x.withColumn("_k", F.least("_m", size - F.col("_upto") + F.col("_m"))).where("_k > 0")
        return taken.groupBy("b").agg((F.sum(F.col("_a") * F.col("_k")) / F.sum("_k")).alias("value"))

    return metric


#: Thresholds of the gate, in percentage points but for the rate.
GATES = {"minority_rate_min": 0.05, "noise_max": 6.0, "tail_gain_min": 2.0, "pass1_drop_max": 2.0, "distinct_min": 1.0}


def gate(runs: DataFrame, minority_rate: DataFrame, tails=("cover", "worst"), gates=GATES) -> DataFrame:
    """One decision out of ordered checks over runs (run, pass_at_1, tails, tail intervals ``*_low``, ``*_high``).

    Runs: base, base_again, candidate, rival (which may be absent). Gives the decision, the measures and the reasons.
    """
    cols = ["pass_at_1", *tails, *[f"{t}_{e}" for t in tails for e in ("low", "high")]]
    one = lambda r: F.max(F.when(F.col("run") == r, F.struct(*cols))).alias(r)
    x = runs.agg(*[one(r) for r in ("base", "base_again", "candidate", "rival")]).join(minority_rate.select(F.col("minority_rate").alias("rate")), F.lit(True))
    pp = lambda a, b, k: 100 * (F.col(f"{a}.{k}") - F.col(f"{b}.{k}"))
    most = lambda f: F.greatest(*[f(t) for t in tails])
    x = x.withColumns({
        "noise": most(lambda t: F.abs(pp("base", "base_again", t))), "tail_gain": most(lambda t: pp("candidate", "base", t)), "pass1_drop": pp("base", "candidate", "pass_at_1"), "rival_gap": most(lambda t: F.abs(pp("candidate", "rival", t))),
    })
    clear = F.lit(False)
    for t in tails:
        clear = clear | (((F.col(f"candidate.{t}_low") > 0) | (F.col(f"candidate.{t}_high") < 0)) & (F.col(f"candidate.{t}") > F.col(f"base.{t}")))
    steps = [
        (F.col("rate").isNull() | F.col("base").isNull() | F.col("base_again").isNull(), "PENDING", "artifacts incomplete"),
        (F.col("rate") < gates["minority_rate_min"], "PIVOT_WORST_SUBSET", "minority rate too low"),
        (F.col("noise") > gates["noise_max"], "STOP_NO_SIGNAL", "baseline noise over the cap"),
        (F.col("candidate").isNull(), "PENDING", "candidate incomplete"),
        (~((F.col("tail_gain") >= gates["tail_gain_min"]) & clear), "PIVOT_WORST_SUBSET", "tail metrics did not move enough"),
        (F.col("pass1_drop") > gates["pass1_drop_max"], "PIVOT_SUBSTRATE_OR_ARCH", "pass@1 fell too far"),
        (F.col("rival").isNull(), "ESCALATE", "rival not run yet"),
        (F.col("rival_gap") <= gates["distinct_min"], "PIVOT_SUBSTRATE_OR_ARCH", "no different from the rival"),
    ]
    decision, reason = F.lit("ESCALATE"), F.lit("better than the base, different from the rival")
    for cond, name, why in reversed(steps):
        decision, reason = F.when(cond, name).otherwise(decision), F.when(cond, why).otherwise(reason)
    return x.select(decision.alias("decision"), F.array(reason).alias("reasons"), "noise", "tail_gain", "pass1_drop", "rival_gap")


def ab_verdict(card: DataFrame, base: str) -> DataFrame:
    """Arms against a base by two rates (parse_rate, mixed): beats, ties or loses."""
    b = card.where(F.col("arm") == base).select(F.col("parse_rate").alias("bp"), F.col("mixed").alias("bm"))
    x = card.where(F.col("arm") != base).join(b, F.lit(True))
    x = x.withColumns({"d_parse": 100 * (F.col("parse_rate") - F.col("bp")), "d_mixed": 100 * (F.col("mixed") - F.col("bm"))})
    verdict = F.when((F.col("d_parse") > 5) & (F.col("d_mixed") > 2), "beats").when((F.abs("d_parse") <= 2) & (F.abs("d_mixed") <= 2), "ties").otherwise("loses")
    return x.select("arm", "d_parse", "d_mixed", verdict.alias("verdict"))


def with_status(df: DataFrame, rules: dict[str, Column], ok: str = "ok", bad: str = "investigate") -> DataFrame:
    """``ok`` where all rules hold, else ``investigate``, with the names of those that do not."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("failed", F.array_join(failed, ",")).withColumn("status", F.when(F.col("failed") == "", ok).otherwise(bad))


def merge_labels(a: DataFrame, b: DataFrame, keys: DataFrame, on: str = "seq") -> DataFrame:
    """Two labelings and a key table to rows with agreed, needs_human and result (null where they differ)."""
    from rollspark.operators.joins import merge_full

    m = merge_full(a, b, keys, on)
    agreed = F.col("result_A") == F.col("result_B")
    human = ~agreed | (F.col("result_A") == "needs_review") | (F.col("result_B") == "needs_review")
    return m.withColumns({"agreed": agreed, "needs_human": human, "result": F.when(agreed, F.col("result_A")), "human_result": F.lit(None).cast("string")})


def review_queue(L: DataFrame) -> DataFrame:
    """Rows that a person must see, with the reason."""
    a, b = F.col("result_A") == "needs_review", F.col("result_B") == "needs_review"
    reason = F.when(~F.col("agreed"), "dispute").when(a & b, "needs_review_both").when(a, "needs_review_A").when(b, "needs_review_B").otherwise("needs_human")
    return L.where("needs_human").withColumn("review_reason", reason)


def apply_labels(L: DataFrame, H: DataFrame, lengths: DataFrame, cap: int | None, on: str = "seq") -> DataFrame:
    """Human labels by key; open rows whose text is ``cap`` tokens or more become ``runon``. ``source`` tells which."""
    j = L.join(H.select(on, F.col("human_result").alias("_h")), on, "left").join(lengths.select(on, "response_length"), on, "left")
    auto = F.col("_h").isNull() & F.col("needs_human") & F.col("human_result").isNull()
    auto = auto & (F.col("response_length") >= cap) if cap is not None else F.lit(False)
    auto = F.coalesce(auto, F.lit(False))
    new = F.when(F.col("_h").isNotNull(), F.col("_h")).when(auto, "runon")
    source = F.when(F.col("_h").isNotNull(), "human").when(auto, "auto").when(F.col("needs_human"), "open").otherwise("agreed")
    return j.select(
        *[c for c in L.columns if c not in ("human_result", "result", "needs_human")], F.coalesce(new, "human_result").alias("human_result"), F.coalesce(new, "result").alias("result"),
        (F.col("needs_human") & new.isNull()).alias("needs_human"), source.alias("source"),
    )


def review_priority(text: str, answer: str) -> Column:
    """No box, an empty or long answer, or an answer line near the end with a longish answer."""
    pa = F.trim(F.coalesce(F.col(answer), F.lit("")))
    t = F.coalesce(F.col(text), F.lit(""))
    near = F.contains(F.lower(F.expr(f"right(coalesce({text}, ''), 200)")), F.lit("answer:")) & (F.length(pa) > 25)
    return ~F.contains(t, F.lit("\\boxed")) | (pa == "") | (F.length(pa) > 60) | near


def nest_rollouts(R: DataFrame) -> DataFrame:
    """Problems with arrays of their rollouts, each with the size of its cluster."""
    from rollspark.operators.objectives import with_cluster_size

    row = F.struct("rollout_idx", "pred", "reward", "cluster_id", "cluster_size")
    return with_cluster_size(R).groupBy("problem_id").agg(F.array_sort(F.collect_list(row)).alias("rollouts"))
