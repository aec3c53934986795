"""Positions and quantiles in a global order without a task that sorts everything."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollspark.sources.scratch import cut


def with_running(df: DataFrame, key: str, name: str, weight: Column | None = None, lead: Column | None = None, buckets: int = 256) -> DataFrame:
    """Add ``name``: the sum of ``weight`` (1: the position) over all rows before each one, by ``lead``, then ``key``.

    Quantiles of the numeric key cut the order into ``buckets``; rows are ordered inside theirs, and only the buckets' sums
    are ordered as a whole. Keys are distinct under a lead; null comes first. The quantiles are a job that runs at once.
    """
    weight = F.lit(1) if weight is None else weight
    found = df.agg(F.percentile_approx(key, [(i + 1) / buckets for i in range(buckets - 1)], 10 * buckets)).first()[0] or []
    splits = F.array(*map(F.lit, sorted(set(found)))) if found else F.array().cast("array<double>")
    x = df.withColumns({"_w": weight, "_lead": F.lit(0) if lead is None else lead, "_part": F.size(F.filter(splits, lambda s: s < F.col(key)))})
    before = F.sum("_s").over(Window.orderBy("_lead_", "_part_").rowsBetween(Window.unboundedPreceding, -1))
    sums = x.groupBy(F.col("_lead").alias("_lead_"), F.col("_part").alias("_part_")).agg(F.sum("_w").alias("_s")).withColumn("_b", F.coalesce(before, F.lit(0)))
    inside = F.sum("_w").over(Window.partitionBy("_lead", "_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_in", F.coalesce(inside, F.lit(0))).join(sums, F.col("_lead").eqNullSafe(F.col("_lead_")) & (F.col("_part") == F.col("_part_")))
    return x.withColumn(name, F.col("_b") + F.col("_in")).drop("_w", "_lead", "_part", "_lead_", "_part_", "_s", "_b", "_in")


#: Brackets (a row per group and quantile) that are sent to every task; more are joined by a shuffle.
MOST_SENT = 10_000


def exact_quantiles(df: DataFrame, col: Column | str, qs: dict[str, float], by=(), accuracy: int = 10_000) -> DataFrame:
    """by and a column for each name of ``qs``: the quantile of the numbers, linear between ranks, null without any.

    A sketch of bounded size brackets each quantile, the rows under the bracket are counted, and only the distinct values inside it (a few out of
    ``accuracy`` of the rows) are ordered. The ranks are checked against the counts, so the values are exact. The numbers are written first, as
    they are read three times; groups without a number are left out, unless ``by`` is empty.
    """
    col = F.col(col) if isinstance(col, str) else col
    keys = [f"_by{i}" for i in range(len(by))] or ["_all"]
    named = [F.col(b).alias(k) for b, k in zip(by, keys)] if by else [F.lit(0).alias("_all")]
    x = cut(df.select(*named, col.cast("double").alias("v")).where("v is not null"), "numbers")
    marks = [m for q in qs.values() for m in (max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy))]
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"), F.col("m")[2 * i].alias("lo"), F.col("m")[2 * i + 1].alias("hi")) for i, q in enumerate(qs.values())])
    bounds = x.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", marks, accuracy).alias("m")).select(*keys, "n", F.explode(pairs).alias("p")).select(*keys, "n", "p.*")
    bounds = cut(bounds, "bounds")
    # With few groups a join by group would put all numbers of a group into one task.
    few = bounds.count() <= MOST_SENT
    each = F.collect_list(F.struct("i", "q", "lo", "hi", "n")).alias("ps")
    near = _beside(x, bounds.groupBy(*keys).agg(each), keys, few=few).select(*keys, "v", F.explode("ps").alias("p")).select(*keys, "v", "p.*")
    # One value more on either side: ranks of a small group may lie just outside.
    wide = near.groupBy(*keys, "i", "q", "lo", "n").agg(F.count_if(F.col("v") < F.col("lo")).alias("under"), F.max(F.when(F.col("v") < F.col("lo"), F.col("v"))).alias("before"), F.min(F.when(F.col("v") > F.col("hi"), F.col("v"))).alias("after"), F.any_value("hi").alias("hi"))
    wide = cut(wide.select(*keys, "i", "q", "n", "lo", "under", F.coalesce("before", "lo").alias("from"), F.coalesce("after", "hi").alias("upto")), "brackets")
    each = F.collect_list(F.struct("i", "q", "n", "lo", "under", "from", "upto")).alias("ps")
    inside = _beside(x, wide.groupBy(*keys).agg(each), keys, few=few).select(*keys, "v", F.explode("ps").alias("p")).where("v between p.from and p.upto")
    counts = inside.select(*keys, "v", "p.*").groupBy(*keys, "i", "q", "n", "lo", "under", "v").agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("v") >= F.col("lo"), F.col("c")).otherwise(0)
    counts = counts.withColumn("upto", F.col("under") + F.sum(own).over(order)).withColumn("at", F.col("q") * (F.col("n") - 1))
    rank = F.floor("at")
    hit = lambda r: F.min(F.when(F.col("upto") > r, F.struct("v", (F.col("upto") - F.col("c")).alias("first"))))
    found = counts.groupBy(*keys, "i", "at").agg(hit(rank).alias("a"), hit(F.least(rank + 1, F.col("n") - 1)).alias("b"))
    sure = F.when((F.col("a.first") <= rank) & F.col("b.v").isNotNull(), F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("at") - rank))
    found = found.select(*keys, "i", F.coalesce(sure, F.raise_error(F.lit("a quantile lies outside of its bracket")).cast("double")).alias("value"))
    out = found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(name) for i, name in enumerate(qs)])
    if by:
        return out.withColumnsRenamed(dict(zip(keys, by)))
    return out.agg(*[F.max(name).alias(name) for name in qs])


def _beside(x: DataFrame, small: DataFrame, keys, how: str = "inner", few: bool = False) -> DataFrame:
    """Rows with what the groups have; null is a group. ``few`` groups are sent to the rows, which stay where they are."""
    renamed = small.withColumnsRenamed({k: f"_{k}" for k in keys})
    renamed = F.broadcast(renamed) if few else renamed
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return x.join(renamed, same, how).drop(*(f"_{k}" for k in keys))


def with_quantiles(stats: DataFrame, df: DataFrame, col: Column | str, qs: dict[str, float], by=()) -> DataFrame:
    """A row per group with the exact quantiles of ``df`` beside it."""
    found = exact_quantiles(df, col, qs, by)
    if not by:
        one = F.lit(0).alias("_all")
        return stats.select("*", one).join(found.select("*", one), "_all").drop("_all")
    return _beside(stats, found, list(by), "left")
