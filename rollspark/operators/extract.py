"""Extraction and grading of answers as jobs over rollout tables, and reports on graders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollspark.functions import answers as X


def extract_ranked(R: DataFrame, hybrid: bool = True, text: str = "completion") -> DataFrame:
    """Answers from the last 300 characters: hybrid line, then box, then answer line; the path and which of them parse."""
    x = R.withColumn("_clip", F.expr(f"right(coalesce({text}, ''), 300)"))
    x = x.withColumns({"_h": X.normalize_final(X.last_match(F.col("_clip"), X.HYBRID)), "_b": X.normalize_final(X.extract_boxed("_clip")), "_a": X.normalize_final(X.answer_anywhere(F.col("_clip")))})
    ok = {c: F.coalesce((F.col(c) != "") & (F.col(c) != "[INVALID]"), F.lit(False)) for c in ("_h", "_b", "_a")}
    h = ok["_h"] if hybrid else F.lit(False)
    path = F.when(h, "hybrid").when(ok["_b"], "boxed").when(ok["_a"], "answer_line").otherwise("none")
    pick = F.when(h, F.col("_h")).when(ok["_b"], F.col("_b")).when(ok["_a"], F.col("_a"))
    return x.withColumns({"extract_path": path, "parsed_answer": pick, "parse_ok": path != "none", "ok_boxed": ok["_b"], "ok_answer_line": ok["_a"]}).drop("_clip", "_h", "_b", "_a")


def extract_clean(R: DataFrame, text: str = "completion") -> DataFrame:
    """Answers from the last closed box, else the last answer line, else the last line; run-on prose is rejected."""
    x = R.withColumn("_t", F.trim(F.coalesce(F.col(text), F.lit(""))))
    lines = F.filter(F.transform(F.split("_t", "\n"), lambda p: F.trim(p)), lambda p: p != "")
    x = x.withColumns({"_b": F.trim(X.extract_boxed("_t", last="closed")), "_a": X.answer_line(F.col("_t")), "_l": F.when(F.size(lines) > 0, F.element_at(lines, -1))})
    candidate = F.coalesce("_a", "_l")
    runon = F.col("_b").isNull() & X.is_runon(candidate)
    path = F.when(F.col("_t") == "", "empty").when(F.col("_b").isNotNull(), "boxed_balanced").when(runon, "runon_rejected").when(F.col("_a").isNotNull(), "answer_line").when(F.col("_l").isNotNull(), "last_line").otherwise("empty")
    value = F.when(path.isin("empty", "runon_rejected"), "").otherwise(F.coalesce("_b", candidate))
    return x.withColumns({"extract_path": path, "parsed_answer": value}).drop("_t", "_b", "_a", "_l")


def marker_flags(R: DataFrame, text: str = "completion") -> DataFrame:
    """Whether the last box is left open, and whether a nested box differs from its flat reading."""
    x = R.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    x = x.withColumns({"_last": X.extract_boxed("_t"), "_nested": F.trim(X.extract_boxed("_t", last="closed")), "_flat": F.trim(X.last_match(F.col("_t"), r"\\boxed\{([^{}]+)\}"))})
    has = F.contains("_t", F.lit(X.BOX))
    differ = F.col("_nested").isNotNull() & (F.col("_flat").isNull() | (X.canonical_key_clean(F.col("_nested")) != X.canonical_key_clean(F.col("_flat"))))
    return x.withColumns({"truncated_box": has & F.col("_last").isNull(), "nested_mismatch": has & differ}).drop("_t", "_last", "_nested", "_flat")


def extraction_summary(R: DataFrame, band: str, flags=("parse_ok",)) -> DataFrame:
    """Rates of flags and counts by path, overall (band null) and per band."""
    share = [F.avg(F.col(f).cast("double")).alias(f"rate_{f}") for f in flags]
    paths = R.rollup(band).agg(F.count("*").alias("n"), *share, F.array_sort(F.collect_set("extract_path")).alias("paths"))
    counts = R.groupBy(band, "extract_path").agg(F.count("*").alias("m"))
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "extract_path", F.col("m").cast("string")))), ",")
    total = counts.groupBy("extract_path").agg(F.sum("m").alias("m")).agg(text.alias("by_path")).withColumn("_b", F.lit(None).cast(R.schema[band].dataType))
    per = counts.groupBy(F.col(band).alias("_b")).agg(text.alias("by_path"))
    return paths.drop("paths").join(per.unionByName(total.select("_b", "by_path")), F.col(band).eqNullSafe(F.col("_b"))).drop("_b")


#: Graders by name: (answer, gold) to a boolean column.
MATCHERS = {
    "strict": lambda p, g: p == g,
    "final": lambda p, g: X.normalize_final(p) == X.normalize_final(g),
    "canonical": lambda p, g: X.canonical_key(p) == X.canonical_key(g),
    "clean": lambda p, g: X.canonical_key_clean(p) == X.canonical_key_clean(g),
    "latex": lambda p, g: X.latex_key(p) == X.latex_key(g),
}


def with_matchers(R: DataFrame, names=tuple(MATCHERS), pred: str = "parsed_answer", gold: str = "gold") -> DataFrame:
    return R.withColumns({f"ok_{n}": F.coalesce(MATCHERS[n](F.col(pred), F.col(gold)), F.lit(False)) for n in names})


def matcher_lift(R: DataFrame, band: str, names=tuple(MATCHERS), key: str = "problem_id") -> DataFrame:
    """Each matcher against the strict one, overall and per band: pass rate, lift, rescued rollouts, mixed problems."""
    x = with_matchers(R, names)
    rows = "inline(array(" + ", ".join(f"named_struct('matcher', '{n}', 'ok', ok_{n})" for n in names) + "))"
    long = x.select(band, key, "ok_strict", F.expr(rows))
    pp = long.groupBy(band, "matcher", key).agg(F.count("*").alias("n"), F.count_if("ok").alias("c"), F.count_if("ok_strict").alias("s"), F.count_if(F.col("ok") & ~F.col("ok_strict")).alias("rescued"))
    g = pp.groupingSets([["matcher"], [band, "matcher"]], band, "matcher").agg(
        F.sum("n").alias("n"), (F.sum("c") / F.sum("n")).alias("pass_rate"), (F.sum("c") / F.sum("n") - F.sum("s") / F.sum("n")).alias("lift"),
        F.when(F.sum("s") > 0, F.sum("c") / F.sum("s") - 1).alias("relative_lift"), F.sum("rescued").alias("n_rescued"), F.avg(((F.col("c") > 0) & (F.col("c") < F.col("n"))).cast("double")).alias("mixed"),
    )
    return g.withColumn("rescued_share", F.col("n_rescued") / F.col("n"))


def grader_delta(R: DataFrame, old: str, new: str, by=()) -> DataFrame:
    o, n = F.col(old), F.col(new)
    return R.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(o & n).alias("both"), F.count_if(n & ~o).alias("rescued"), F.count_if(o & ~n).alias("regressed"), (100 * (F.avg(n.cast("double")) - F.avg(o.cast("double")))).alias("lift_pp"))


def grader_agreement(R: DataFrame, a: str, b: str, n: int, seed, key: str = "problem_id", least: float = 0.9) -> DataFrame:
    """Agreement of two graders over the rollouts of n seeded problems."""
    from rollspark.operators.sampling import sample_n

    some = R.join(sample_n(R.select(key).distinct(), n, seed, key), key, "left_semi")
    x, y = F.col(a), F.col(b)
    out = some.agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("agree"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_left"), F.count_if(y & ~x).alias("only_right"))
    return out.withColumn("status", F.when(F.col("agree") >= least, "ok").otherwise("investigate"))


def rescore(R: DataFrame, ks, by, grader: str = "latex") -> DataFrame:
    """pass@k with stored rewards and with answers boxed in the completions graded anew, and the difference."""
    from rollspark.operators.metrics import pass_at_k

    pred = F.coalesce(X.extract_boxed("completion"), F.lit(""))
    again = R.withColumn("reward", F.coalesce(MATCHERS[grader](pred, F.col("gold")), F.lit(False)).cast("double"))
    old = pass_at_k(R, ks, by).withColumnRenamed("pass_at_k", "stored").drop("n_prompts")
    new = pass_at_k(again, ks, by).withColumnRenamed("pass_at_k", "rescored")
    return new.join(old, [*by, "k"]).withColumn("delta", F.col("rescored") - F.col("stored"))


def audit_labels(R: DataFrame) -> DataFrame:
    """How often stored answer, correctness and cluster differ from recomputed ones (``*_again``), and how many keys have many
    clusters or clusters many keys."""
    rates = R.agg(F.count("*").alias("n"), *[F.avg((~F.col(c).eqNullSafe(F.col(f"{c}_again"))).cast("double")).alias(f"mismatch_{c}") for c in ("parsed_answer", "correct")])
    key = R.select("problem_id", "cluster_id", X.canonical_key_clean(F.col("parsed_answer")).alias("key"))
    many = lambda a, b, name: key.groupBy("problem_id", a).agg(F.count_distinct(b).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias(name))
    return rates.join(many("key", "cluster_id", "keys_with_many_ids"), F.lit(True)).join(many("cluster_id", "key", "ids_with_many_keys"), F.lit(True))


def flip_report(R: DataFrame) -> DataFrame:
    """Per problem: changed answers, gained and lost correctness, distinct answers before and after, counts by path."""
    old, new = F.col("correct"), F.col("correct_again")
    paths = R.groupBy("problem_id", "extract_path").agg(F.count("*").alias("m")).groupBy("problem_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "extract_path", F.col("m").cast("string")))), ",").alias("paths"))
    pp = R.groupBy("problem_id").agg(
        F.count_if(~F.col("parsed_answer").eqNullSafe(F.col("parsed_answer_again"))).alias("n_changed"), F.count_if(new & ~old).alias("n_gained"), F.count_if(old & ~new).alias("n_lost"),
        F.count_distinct("parsed_answer").alias("distinct_before"), F.count_distinct("parsed_answer_again").alias("distinct_after"),
    )
    return pp.join(paths, "problem_id")


def cap_audit(R: DataFrame, labels: DataFrame, cap: int, key, length: str = "response_length") -> DataFrame:
    """Human labels of rollouts under, at and over the token cap."""
    where = F.when(F.col(length) > cap, "over").when(F.col(length) == cap, "at").otherwise("under")
    return R.join(labels, key).groupBy(where.alias("at_cap"), "label").agg(F.count("*").alias("n"))


def outcome_bucket() -> Column:
    return F.when(~F.col("parse_ok"), "parse_fail").when(F.col("reward") > 0.5, "parsed_correct").otherwise("parsed_wrong")


def finish_counts(R: DataFrame, col: str = "finish_reason", by=()) -> DataFrame:
    """Finish reasons of any vocabulary as length, eos or stop; nulls are left out."""
    f = F.lower(F.col(col))
    kind = F.when(f.isin("length", "max_tokens", "max_length"), "length").when(f.isin("eos", "eos_token", "end_turn"), "eos").when(f.isNotNull(), "stop")
    return R.groupBy(*by).agg(F.count(col).alias("n"), *[F.count_if(kind == k).alias(f"n_{k}") for k in ("length", "eos", "stop")])


def flip_categories(R: DataFrame) -> DataFrame:
    """Named causes of gained correctness, and of answers that changed without it."""
    old, new, path = F.col("correct"), F.col("correct_again"), F.col("extract_path")
    changed = ~F.col("parsed_answer").eqNullSafe(F.col("parsed_answer_again"))
    gained = F.when(path == "runon_rejected", "runon_rejected").when((F.coalesce("parsed_answer_again", F.lit("")) != "") & new, "format_fix_correct").otherwise("other_flip")
    only = F.when(path == "runon_rejected", "runon_rejected").when(path == "boxed_balanced", "boxed_balanced").when(path.isin("answer_line", "last_line"), "fallback_line").otherwise("other")
    kind = F.when(~old & new, F.concat(F.lit("gained:"), gained)).when(changed & (old == new), F.concat(F.lit("parsed_only:"), only))
    return R.select(kind.alias("category")).where("category is not null").groupBy("category").agg(F.count("*").alias("n"))


def first_rows(df: DataFrame, by, order, n: int) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_i") <= n).drop("_i")
