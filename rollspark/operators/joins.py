"""Joins of rollout tables, and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_manifest(R: DataFrame, M: DataFrame, columns=("gold", "difficulty_band"), key: str = "problem_id") -> DataFrame:
    """Manifest columns onto rollouts. Spark broadcasts the manifest if its size allows."""
    return R.join(M.select(key, *columns), key, "left")


def join_one_to_one(a: DataFrame, b: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """The inner join, and a row of violations: keys repeated on a side or missing on the other."""
    keys = list(keys)
    ka, kb = (x.groupBy(*keys).agg(F.count("*").alias(n)) for x, n in ((a, "na"), (b, "nb")))
    both = ka.join(kb, keys, "full")
    report = both.agg(
        F.count("*").alias("n_keys"), F.count_if(F.col("na") > 1).alias("repeated_left"), F.count_if(F.col("nb") > 1).alias("repeated_right"), F.count_if(F.col("nb").isNull()).alias("missing_right"), F.count_if(F.col("na").isNull()).alias("missing_left")
    )
    return a.join(b, keys), report


def left_with_singletons(a: DataFrame, b: DataFrame, keys, column: str) -> DataFrame:
    """Left join; a missing label becomes one of its own, named after the key."""
    own = F.concat(F.lit("_missing_"), F.concat_ws("_", *[F.col(k).cast("string") for k in keys]))
    return a.join(b.select(*keys, column), list(keys), "left").withColumn(column, F.coalesce(F.col(column).cast("string"), own))


def common_keys(df: DataFrame, key: str, part: str, n_parts: int) -> DataFrame:
    """Keys present in all of ``n_parts`` parts."""
    return df.groupBy(key).agg(F.count_distinct(part).alias("_n")).where(F.col("_n") == n_parts).select(key)


def paired_wide(R: DataFrame, arms, value: Column, key: str = "problem_id") -> DataFrame:
    """One column per arm, for keys that all arms have."""
    wide = R.groupBy(key).pivot("arm", list(arms)).agg(value)
    return wide.dropna(subset=list(arms))


def merge_full(a: DataFrame, b: DataFrame, keys: DataFrame, on: str, columns=("result",)) -> DataFrame:
    """Full outer join of two labelings and a key table; what is missing is ''."""
    left = a.select(on, *[F.col(c).alias(f"{c}_A") for c in columns])
    right = b.select(on, *[F.col(c).alias(f"{c}_B") for c in columns])
    merged = left.join(right, on, "full").join(keys, on, "full")
    return merged.fillna("", subset=[c for c in merged.columns if c != on])


def semi(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on, "left_anti")


def with_ladder(df: DataFrame, ks, name: str = "k") -> DataFrame:
    """Each row once for each constant."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, ks))))


def align_steps(df: DataFrame, arms, value: str, step: str = "step") -> DataFrame:
    """Values per arm side by side at the steps that all arms have."""
    return df.groupBy(step).pivot("arm", list(arms)).agg(F.first(value)).dropna(subset=list(arms))


def pairs(df: DataFrame, group: str, index: str, columns, pred: Column | str | None = None) -> DataFrame:
    """Pairs i < j within a bounded group (a problem's rollouts), columns suffixed _a and _b."""
    side = lambda s: df.select(group, *[F.col(c).alias(f"{c}_{s}") for c in dict.fromkeys([index, *columns])])
    found = side("a").join(side("b"), group).where(F.col(f"{index}_a") < F.col(f"{index}_b"))
    return found if pred is None else found.where(pred)


def with_rollout_idx(df: DataFrame, order, group: str = "problem_id") -> DataFrame:
    return df.withColumn("rollout_idx", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def union_chunks(*chunks: DataFrame) -> DataFrame:
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def key_diff(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """Keys on one side only, with the side."""
    ka, kb = a.select(*on).distinct(), b.select(*on).distinct()
    return ka.join(kb, list(on), "left_anti").withColumn("side", F.lit("left")).unionByName(kb.join(ka, list(on), "left_anti").withColumn("side", F.lit("right")))


def same_partition(a: DataFrame, b: DataFrame, group: str, index: str, label: str) -> DataFrame:
    """Whether two labelings of a bounded group cut it into the same parts."""
    def signature(df: DataFrame, name: str) -> DataFrame:
        parts = df.groupBy(group, label).agg(F.array_sort(F.collect_list(index)).alias("_p"))
        return parts.groupBy(group).agg(F.array_sort(F.collect_list("_p")).alias(name))

    return signature(a, "_a").join(signature(b, "_b"), group).select(group, (F.col("_a") == F.col("_b")).alias("same"))
