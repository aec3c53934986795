"""Cleaning, filtering and checking of prompt manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollspark.functions.text import prompt_flags

#: Fixed value: what is put behind each problem.
SUFFIX = "\nPlease reason step by step, and put your final answer within \\boxed{}."


def with_drop_reason(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``drop_reason``: the first rule that holds, null where none does."""
    reason = F.lit(None).cast("string")
    for name, cond in reversed(rules.items()):
        reason = F.when(cond, name).otherwise(reason)
    return df.withColumn("drop_reason", reason)


def filter_with_audit(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept rows, dropped rows with their reason, and counts by reason."""
    marked = with_drop_reason(df, rules)
    stats = marked.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return marked.where("drop_reason is null").drop("drop_reason"), marked.where("drop_reason is not null"), stats


def clean_manifest(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop rows without text or gold; golds are trimmed. Kept rows, counts by reason, counts by band."""
    rules = {"non_string_problem": F.col("problem").isNull(), "blank_problem": F.trim("problem") == "", "blank_gold": F.trim(F.coalesce("gold", F.lit(""))) == ""}
    kept, _, stats = filter_with_audit(df, rules)
    kept = kept.withColumn("gold", F.trim("gold"))
    return kept, stats, kept.groupBy("difficulty_band").agg(F.count("*").alias("n"))


def flagged(df: DataFrame) -> DataFrame:
    return df.withColumns(prompt_flags("problem", "gold"))


def train_filter(df: DataFrame) -> DataFrame:
    """Flags and the reason for which a prompt is left out of training."""
    f = flagged(df)
    prove = F.contains(F.lower("problem"), F.lit("prove"))
    leak = F.col("gold_in_prompt") & (prove | F.col("contains_show_that"))
    return with_drop_reason(f, {"last_starts_prove": F.col("last_starts_prove"), "gold_leak": leak})


FLAGS = ("last_starts_prove", "last_contains_prove", "contains_show_that", "gold_in_prompt")


def flag_summary(df: DataFrame, flags=FLAGS) -> DataFrame:
    """Count and percentage of each flag, of any and of all."""
    cols = {f: F.col(f) for f in flags}
    any_, all_ = F.lit(False), F.lit(True)
    for c in cols.values():
        any_, all_ = any_ | c, all_ & c
    cols |= {"any": any_, "all": all_}
    wide = df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"c_{k}") for k, c in cols.items()])
    return wide.select(F.expr("inline(array(" + ", ".join(f"named_struct('flag', '{k}', 'n', c_{k}, 'pct', 100D * c_{k} / n)" for k in cols) + "))"))


def top_combos(df: DataFrame, k: int, flags=FLAGS) -> DataFrame:
    name = F.concat_ws("+", *[F.when(F.col(f), f) for f in flags])
    return df.groupBy(name.alias("combo")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "combo").limit(k)


def filter_by_pass_rate(M: DataFrame, R: DataFrame, lo: float, hi: float, min_n: int) -> DataFrame:
    """Manifest rows with n_rollouts, pass_rate and the reason to drop: no rollouts, too few, too hard, too easy."""
    pp = R.groupBy("problem_id").agg(F.count("*").alias("n_rollouts"), F.avg((F.col("reward") > 0.5).cast("double")).alias("pass_rate"))
    j = M.join(pp, "problem_id", "left")
    rules = {"no_rollouts": F.col("n_rollouts").isNull(), "too_few": F.col("n_rollouts") < min_n, "too_hard": F.col("pass_rate") <= lo, "too_easy": F.col("pass_rate") >= hi}
    return with_drop_reason(j, rules)


def to_training_record(df: DataFrame, source: str, suffix: str = SUFFIX) -> DataFrame:
    """Nested chat records for training."""
    return df.select(
        F.array(F.struct(F.lit("user").alias("role"), F.concat("problem", F.lit(suffix)).alias("content"))).alias("prompt"),
        F.lit(source).alias("data_source"),
        F.struct(F.col("gold").alias("ground_truth"), F.lit("rule").alias("style")).alias("reward_model"),
        F.struct(F.col("problem_id").cast("string").alias("problem_id")).alias("extra_info"),
    )


def slice_rows(df: DataFrame, order: str, a: int, b: int) -> DataFrame:
    """Rows [a, b) in the order of a column."""
    return df.orderBy(order).offset(a).limit(max(0, b - a))


def check_manifest(df: DataFrame, pool: DataFrame) -> DataFrame:
    """One row of counts of what is wrong: repeated or missing ids, blank golds, bands over one point off the pool's share."""
    own = df.agg(
        F.count("*").alias("n"), (F.count("*") - F.count_distinct("problem_id")).alias("repeated_ids"), (F.max("problem_id") - F.min("problem_id") + 1 - F.count_distinct("problem_id")).alias("id_gaps"),
        F.count_if(F.trim(F.coalesce("gold", F.lit(""))) == "").alias("blank_golds"),
    )
    share = lambda x, name: x.groupBy("difficulty_band").agg(F.count("*").alias(f"n_{name}"))
    bands = share(df, "own").join(share(pool, "pool"), "difficulty_band", "full").fillna(0, ["n_own", "n_pool"])
    total = bands.agg(F.sum("n_own").alias("t_own"), F.sum("n_pool").alias("t_pool"))
    off = bands.join(F.broadcast(total), F.lit(True)).agg(
        F.count_if((F.col("n_own") == 0) & (F.col("n_pool") > 0)).alias("missing_bands"), F.count_if(F.abs(F.col("n_own") / F.col("t_own") - F.col("n_pool") / F.col("t_pool")) > 0.01).alias("bands_off")
    )
    return own.join(F.broadcast(off), F.lit(True))


def check_group_size(R: DataFrame, n: int) -> DataFrame:
    """Problems without exactly n rollouts."""
    return R.groupBy("problem_id").agg(F.count("*").alias("n_rollouts"), F.count_distinct("rollout_idx").alias("n_indices")).where((F.col("n_rollouts") != n) | (F.col("n_indices") != n))


def assemble(R: DataFrame, text: str, max_chars: int, budget: int, correct_only: bool = False, least: int = 1) -> DataFrame:
    """A numbered block of each problem's rollouts, cut to ``max_chars`` each, and whether it is over ``budget``."""
    rows = R.where("reward > 0.5") if correct_only else R
    row = F.struct("rollout_idx", F.substring(F.coalesce(F.col(text), F.lit("")), 1, max_chars).alias("t"))
    g = rows.groupBy("problem_id").agg(F.array_sort(F.collect_list(row)).alias("r")).where(F.size("r") >= least)
    block = F.array_join(F.transform("r", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"])), "\n")
    return g.select("problem_id", F.size("r").alias("n_responses"), block.alias("block")).withColumn("over_budget", F.length("block") > budget)
