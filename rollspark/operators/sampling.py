"""Seeded samples, quotas, splits and chunks. Order keys are md5 of seed and id, so results do not depend on partitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollspark.operators.order import with_running


def md5key(seed, *ids: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def sample_n(df: DataFrame, n: int, seed, key: str = "problem_id", check: bool = False) -> DataFrame:
    """n rows by the seeded order; with ``check`` an error if there are fewer (runs a count)."""
    out = df.orderBy(md5key(seed, key), key).limit(n)
    if check and out.count() < n:
        raise ValueError(f"fewer than {n} rows")
    return out


def split_overlap(df: DataFrame, n: int, seed, key: str = "problem_id") -> DataFrame:
    """All rows are for training; ``is_val`` marks a seeded sample of n that is for validation too."""
    val = sample_n(df.select(key), n, seed, key).withColumn("_v", F.lit(True))
    return df.join(val, key, "left").withColumn("is_val", F.coalesce("_v", F.lit(False))).drop("_v")


def hamilton_quotas(counts: DataFrame, n: int, key="difficulty_band") -> DataFrame:
    """Largest-remainder shares of n over strata (key, count): floors first, then one more to the largest fractions (tie: lower
    key), at most one each and none to a fraction of 0. Strata are few."""
    keys = [key] if isinstance(key, str) else list(key)
    everything = Window.partitionBy(F.lit(0))
    exact = F.col("count") * F.lit(n) / F.sum("count").over(everything)
    whole = F.floor(F.col("count") * F.lit(n) / F.sum("count").over(everything))
    x = counts.withColumns({"_e": exact, "base": whole}).withColumn("frac", F.round(F.col("_e") - F.col("base"), 9))
    x = x.withColumn("_left", F.lit(n) - F.sum("base").over(everything))
    rank = F.row_number().over(everything.orderBy(F.desc("frac"), *keys))
    extra = ((rank <= F.col("_left")) & (F.col("frac") > 0)).cast("long")
    return x.withColumn("quota", F.col("base") + extra).select(*keys, "count", "quota")


def stratified_sample(df: DataFrame, n: int, seed, band: str = "difficulty_band", key: str = "problem_id") -> DataFrame:
    """Quotas by band, a seeded order in each band, and new ids 0, 1, ... in band order."""
    counts = df.groupBy(band).agg(F.count("*").alias("count"))
    quotas = hamilton_quotas(counts, n, band)
    starts = quotas.withColumn("_start", F.coalesce(F.sum("quota").over(Window.partitionBy(F.lit(0)).orderBy(band).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    # No quota is over n; as n is a number, each task keeps n rows of a band before they are shuffled.
    ranked = df.withColumn("_i", F.row_number().over(Window.partitionBy(band).orderBy(md5key(seed, key), key))).where(F.col("_i") <= n)
    return ranked.join(starts, band).where(F.col("_i") <= F.col("quota")).withColumn("new_id", F.col("_start") + F.col("_i") - 1).drop("_i", "_start", "quota")


def sample_per_band(df: DataFrame, k: int, seed, band: str = "difficulty_band", key: str = "problem_id") -> DataFrame:
    """k rows of each band."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(band).orderBy(md5key(seed, key), key))).where(F.col("_i") <= k).drop("_i")


def short_bands(df: DataFrame, k: int, band: str = "difficulty_band") -> DataFrame:
    return df.groupBy(band).agg(F.count("*").alias("n")).where(F.col("n") < k)


def proportional_sample(df: DataFrame, keys, n: int, seed, key: str = "problem_id") -> DataFrame:
    """Quotas over composite strata; what rounding leaves open is filled from the rest in the seeded order."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("count"))
    quotas = hamilton_quotas(counts, n, keys).drop("count")
    # The first n of a stratum are all that quotas and filling can take from it.
    ranked = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(md5key(seed, key), key))).where(F.col("_i") <= n).join(quotas, list(keys))
    first = ranked.withColumn("_p", (F.col("_i") > F.col("quota")).cast("int"))
    return first.orderBy("_p", md5key(seed, key), key).limit(n).drop("_i", "_p", "quota")


def rollout_seed(seed: int, n: int, key: str = "problem_id", idx: str = "rollout_idx") -> Column:
    return F.lit(seed) + F.col(key) * n + F.col(idx)


def hash_bucket(seed, k: int, *ids: str) -> Column:
    """A stable bucket 0..k-1 from the first eight hex digits of the md5."""
    return F.conv(F.substring(md5key(seed, *ids), 1, 8), 16, 10).cast("long") % k


def pack_by_budget(df: DataFrame, length: str, budget: int, part: str, order: str) -> DataFrame:
    """First-fit-decreasing groups of at most ``budget`` within each part (a bounded batch); longer items stand alone."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([length, order], ascending=[False, True], kind="stable")
        return frame.assign(pack=first_fit(frame[length].tolist(), budget))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(part).applyInPandas(pack, f"{kinds}, pack long")


def first_fit(lengths, budget: int) -> list[int]:
    """The first bin with room for each length, in order. A tournament tree holds the most room under each of its nodes, so a
    bin is found in as many steps as the tree is high."""
    base = 1 << max(0, len(lengths) - 1).bit_length()
    room = [budget] * (2 * base)
    out, used = [], 0
    for n in lengths:
        if n > budget:
            at = base + used
        else:
            at = 1
            while at < base:
                at *= 2
                if room[at] < n:
                    at += 1
        out.append(at - base)
        used = max(used, at - base + 1)
        room[at] -= n
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return out


def build_chunks(df: DataFrame, priority: Column, per_chunk: int, tail: int, text: str, key: str = "problem_id") -> DataFrame:
    """Review chunks: problems with a priority rollout first, ``per_chunk`` problems to a chunk, running ids within it, and
    the end of each text."""
    pp = df.groupBy(key).agg(F.max(priority).alias("_pri"))
    placed = with_running(pp, key, "_at", lead=F.when(F.col("_pri"), 0).otherwise(1))
    placed = placed.select(key, F.col("_pri").alias("priority"), F.floor(F.col("_at") / per_chunk).alias("chunk"))
    rows = df.join(placed, key)
    w = Window.partitionBy("chunk").orderBy(F.desc("priority"), key, "rollout_idx")
    return rows.select(key, "rollout_idx", "chunk", "priority", F.row_number().over(w).alias("id"), F.expr(f"right({text}, {tail})").alias("tail"))


def exemplars(df: DataFrame, cat, order, n: int) -> DataFrame:
    """The first n rows of each category in an order."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*cat).orderBy(*order))).where(F.col("_i") <= n).drop("_i")


def head_tail(col: str, head: int, tail: int) -> Column:
    return F.when(F.length(col) <= head + tail, F.col(col)).otherwise(F.concat(F.substring(col, 1, head), F.lit(" ... "), F.expr(f"right({col}, {tail})")))


def handcheck(pp: DataFrame, quotas: dict[str, int], seed) -> DataFrame:
    """Problems (problem_id, c) to check by hand: strata high (5-7), mixed (1-4), none (0) of 8 correct, so many of each."""
    s = F.when(F.col("c").between(5, 7), "high").when(F.col("c").between(1, 4), "mixed").when(F.col("c") == 0, "none")
    x = pp.withColumn("stratum", s).where("stratum is not null")
    ranked = x.withColumn("_i", F.row_number().over(Window.partitionBy("stratum").orderBy(md5key(seed, "problem_id"), "problem_id")))
    limit = F.create_map(*[F.lit(v) for kv in quotas.items() for v in kv])[F.col("stratum")]
    return ranked.where(F.col("_i") <= max(quotas.values(), default=0)).where(F.col("_i") <= limit).drop("_i")
