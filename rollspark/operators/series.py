"""Training histories and other things in order of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ema(H: DataFrame, alpha: float, by=("arm", "metric"), step: str = "step", value: str = "value") -> DataFrame:
    """Exponential moving average y0 = x0, y = a y + (1 - a) x over the values that are there.

    A series is a few hundred points, so it is folded as one array; series are independent.
    """
    rows = H.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(value).cast("double").alias("x")))).alias("_p"))
    empty = "cast(array() as array<struct<s: int, x: double, y: double>>)"
    fold = f"aggregate(_p, named_struct('y', cast(null as double), 'out', {empty}), (a, p) -> named_struct('y', coalesce({alpha}D * a.y + {1 - alpha}D * p.x, p.x), 'out', concat(a.out, array(named_struct('s', cast(p.s as int), 'x', p.x, 'y', coalesce({alpha}D * a.y + {1 - alpha}D * p.x, p.x))))), a -> a.out)"
    return rows.select(*by, F.explode(F.expr(fold)).alias("e")).select(*by, F.col("e.s").alias(step), F.col("e.x").alias(value), F.col("e.y").alias("ema"))


def prompts_unlocked(R: DataFrame, by=("arm",)) -> DataFrame:
    """How many problems have ever been solved by each step."""
    first = R.where("reward > 0").groupBy(*by, "problem_id").agg(F.min("step").alias("step"))
    new = first.groupBy(*by, "step").agg(F.count("*").alias("n_new"))
    steps = R.select(*by, "step").distinct().join(new, [*by, "step"], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    return steps.withColumn("unlocked", F.sum("n_new").over(Window.partitionBy(*by).orderBy("step")))


def step_means(R: DataFrame, value: str, by=("arm",)) -> DataFrame:
    return R.groupBy(*by, "step").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def bin_steps(df: DataFrame, edges, by=("arm",)) -> DataFrame:
    """Step means and counts in bins [lo, hi); bins without data stay."""
    bins = list(zip(edges[:-1], edges[1:], strict=True))
    named = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in bins])
    all_bins = df.select(*by).distinct().select(*by, F.explode(named).alias("b")).select(*by, "b.lo", "b.hi")
    inside = df.select(*by, "step", "mean", "n", F.element_at(F.filter(named, lambda b: (b["lo"] <= F.col("step")) & (F.col("step") < b["hi"])), 1)["lo"].alias("lo")) if bins else df
    got = inside.where("lo is not null").groupBy(*by, "lo").agg(F.avg("mean").alias("mean"), F.sum("n").alias("n"))
    return all_bins.join(got, [*by, "lo"], "left").select(*by, "lo", "hi", "mean", F.coalesce("n", F.lit(0)).alias("n"))


def sample_steps(df: DataFrame, lo: int, hi: int, every: int, from_lo: bool = True) -> DataFrame:
    s = F.col("step")
    return df.where((s >= lo) & (s <= hi) & ((s - lo if from_lo else s) % every == 0))


def avg_over_steps(df: DataFrame, by=("arm",)) -> DataFrame:
    """Mean of per-step means, nulls skipped."""
    return df.groupBy(*by).agg(F.avg("mean").alias("mean"), F.avg("n").alias("mean_n"), F.count("mean").alias("n_steps"))


def at_steps(df: DataFrame, steps) -> DataFrame:
    return df.where(F.col("step").isin(*steps))


def final(df: DataFrame, by=("arm",)) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), "step").alias("r")).select(*by, "r.*")


def delta_series(df: DataFrame, control: str, value: str = "mean") -> DataFrame:
    """Arm less control at each step that both have."""
    c = df.where(F.col("arm") == control).select("step", F.col(value).alias("control"))
    return df.where(F.col("arm") != control).join(c, "step").select("arm", "step", value, "control", (F.col(value) - F.col("control")).alias("delta"))


def window_delta(deltas: DataFrame, lo: int, hi: int) -> DataFrame:
    return deltas.where(F.col("step").between(lo, hi)).groupBy("arm").agg(F.avg("delta").alias("mean_delta"), F.count("*").alias("n_steps"))


def calibrate(H: DataFrame, divisor: float, band: float, arms, value: str = "value") -> DataFrame:
    """Values divided, with a band around them, for some arms."""
    v = F.when(F.col("arm").isin(*arms), F.col(value) / divisor).otherwise(F.col(value))
    b = lambda k: F.when(F.col("arm").isin(*arms), v * k)
    return H.withColumns({"calibrated": v, "low": b(1 - band), "high": b(1 + band)})


def first_k(R: DataFrame, k: int, by=("problem_id",)) -> DataFrame:
    """The first k rollouts by index, whatever the indices are."""
    return R.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("rollout_idx"))).where(F.col("_i") <= k).drop("_i")


def stitch(H: DataFrame, by=("arm", "metric")) -> DataFrame:
    """Histories of resumed runs (column ``run``, higher is later): each step from the latest run that has it, and no step of
    an older run at or after a later run's first step."""
    starts = H.groupBy("arm", "run").agg(F.min("step").alias("_start"))
    w = Window.partitionBy("arm").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    cut = starts.withColumn("_cut", F.min("_start").over(w)).select("arm", "run", "_cut")
    return H.join(cut, ["arm", "run"]).where(F.col("_cut").isNull() | (F.col("step") < F.col("_cut"))).drop("_cut")


def top_k(df: DataFrame, order, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def epoch_batches(df: DataFrame, n: int, seed: str, epoch: int, key: str = "problem_id", digits: int = 2) -> DataFrame:
    """Batches of n keys in a seeded order of an epoch; the short tail is dropped.

    Positions come from prefix sums over the first hex ``digits`` of the order key, so no task sorts everything; each further
    digit makes the sorted parts a sixteenth.
    """
    md5 = F.md5(F.concat_ws("|", F.lit(seed), F.lit(epoch), F.col(key)))
    x = df.withColumn("_key", md5).withColumn("_part", F.substring("_key", 1, digits))
    counts = x.groupBy("_part").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", before.alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_all"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy("_key", key)) - 1
    placed = x.withColumn("_at", at).join(counts, "_part").withColumn("position", F.col("_before") + F.col("_at"))
    return placed.where(F.col("position") < F.floor(F.col("_all") / n) * n).withColumn("batch", F.floor(F.col("position") / n)).drop("_key", "_part", "_at", "_before", "_all")
