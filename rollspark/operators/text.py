"""Text diversity of rollouts, and token-level distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollspark.operators.order import with_quantiles
from rollspark.sources.scratch import cut

#: Words or single marks.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: Phrases that tell of reflection.
MARKERS = {
    "wait": r"(?i)\bwait\b",
    "however": r"(?i)\bhowever\b",
    "verify": r"(?i)\bverify\b",
    "because": r"(?i)\bbecause\b",
    "alternatively": r"(?i)\balternatively\b",
    "let_me_check": r"(?i)\blet me check\b",
    "let_me_reconsider": r"(?i)\blet me reconsider\b",
}


#: Characters of text whose grams are a task's share: four times as many grams at most (about 0.7 times in the test tables).
CHARS_PER_TASK = 1_000_000
#: Rows of a token log that are a task's share.
TOKENS_PER_TASK = 500_000


def tasks_for(spark: SparkSession, amount: int | None, each: int) -> int:
    """Tasks with a share of about ``each``, at least one per core: the shares stay as they are when the input grows."""
    return max(spark.sparkContext.defaultParallelism, (amount or 0) // each + 1)


def tokens(col: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(TOKEN), F.lit(0))


def tokenized(R: DataFrame, text: str, keys=("problem_id", "rollout_idx")) -> DataFrame:
    return R.where(F.coalesce(F.col(text), F.lit("")) != "").select(*keys, tokens(text).alias("tokens"))


def grams_of(n: int, col: str = "tokens") -> Column:
    """All n-grams of a token array, in order."""
    return F.expr(f"if(size({col}) < {n}, array(), transform(sequence(1, size({col}) - {n - 1}), i -> array_join(slice({col}, i, {n}), ' ')))")


def ngrams(R: DataFrame, text: str, n: int, keys=("problem_id", "rollout_idx")) -> DataFrame:
    """n-grams of each text with their counts."""
    return tokenized(R, text, keys).select(*keys, F.explode(grams_of(n)).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("c"))


def self_bleu(R: DataFrame, text: str, max_n: int = 4, max_rollouts: int | None = None) -> DataFrame:
    """Mean BLEU of each rollout against the problem's others: problem_id, n_rollouts, self_bleu.

    A gram's best count among the others is the problem's largest, or the runner-up if the largest is the rollout's own; so the
    work is linear in grams. Grams move once, as 64-bit hashes, and nothing gathers a problem's rollouts: windows find the best
    counts and the nearest lengths, so a problem may have any number of rollouts (``max_rollouts`` keeps those with smaller
    indices). A rollout with fewer than ``max_n`` tokens scores 0. The texts' length, a job that runs at once, sets the number of
    tasks: texts are dealt out before their grams are made, and grams by their hashes, so no task has more of a larger table.
    """
    R = R if max_rollouts is None else R.where(F.col("rollout_idx") < max_rollouts)
    tasks = tasks_for(R.sparkSession, R.agg(F.sum(F.length(text))).first()[0], CHARS_PER_TASK)
    T = tokenized(R.select("problem_id", "rollout_idx", text).repartition(tasks, "problem_id", "rollout_idx"), text)
    coded = T.select("problem_id", "rollout_idx", F.transform("tokens", lambda w: F.xxhash64(w)).alias("k"))
    # Grams of all sizes come from one projection; a gram's hash tells its size as well, since it takes so many numbers.
    sized = [F.expr(f"if(size(k) < {n}, array(), transform(sequence(0, size(k) - {n}), i -> struct({n} AS n, xxhash64({', '.join(f'k[i + {j}]' for j in range(n))}) AS gram)))") for n in range(1, max_n + 1)]
    long = coded.select("problem_id", "rollout_idx", F.explode(F.concat(*sized)).alias("x")).select("problem_id", "rollout_idx", "x.n", "x.gram")
    # One exchange serves the counts and the window.
    c = long.repartition(tasks, "problem_id", "n", "gram").groupBy("problem_id", "n", "gram", "rollout_idx").agg(F.count("*").alias("c"))
    ranked = Window.partitionBy("problem_id", "n", "gram").orderBy(F.desc("c"), "rollout_idx")
    clipped = c.select("problem_id", "rollout_idx", "n", "c", F.row_number().over(ranked).alias("at"), F.first("c").over(ranked).alias("most"), F.lead("c", 1, 0).over(ranked).alias("next"))
    best = F.when(F.col("at") == 1, F.col("next")).otherwise(F.col("most"))
    p = clipped.groupBy("problem_id", "rollout_idx", "n").agg(F.sum(F.least("c", best)).alias("hit"), F.sum("c").alias("total"))
    logs = p.groupBy("problem_id", "rollout_idx").agg(F.count("*").alias("orders"), F.avg(F.log((F.col("hit") + 1e-9) / F.col("total"))).alias("lp"))
    # The nearest length stands beside the own in the order of lengths.
    in_order = Window.partitionBy("problem_id").orderBy("len", "rollout_idx")
    lengths = T.select("problem_id", "rollout_idx", F.size("tokens").alias("len"))
    near = lengths.select("*", F.lag("len").over(in_order).alias("under"), F.lead("len").over(in_order).alias("over")).where("under is not null or over is not null")
    olen = F.when(F.col("over").isNull() | (F.col("len") - F.col("under") <= F.col("over") - F.col("len")), F.col("under")).otherwise(F.col("over"))
    bp = F.when(F.col("len") > olen, 1.0).otherwise(F.exp(1 - olen / F.greatest("len", F.lit(1))))
    s = near.join(logs, ["problem_id", "rollout_idx"], "left").withColumn("bleu", F.when(F.coalesce("orders", F.lit(0)) == max_n, bp * F.exp("lp")).otherwise(0.0))
    return s.groupBy("problem_id").agg(F.count("*").alias("n_rollouts"), F.avg("bleu").alias("self_bleu"))


def distinct_n(R: DataFrame, text: str, n: int, max_rollouts: int = 16) -> DataFrame:
    """Distinct over all n-grams per problem; 0 without any."""
    T = tokenized(R.where(F.col("rollout_idx") < max_rollouts), text)
    g = T.select("problem_id", F.explode_outer(grams_of(n)).alias("gram"))
    return g.groupBy("problem_id").agg(F.when(F.count("gram") > 0, F.count_distinct("gram") / F.count("gram")).otherwise(0.0).alias("distinct"))


def marker_rates(R: DataFrame, text: str, by=(), patterns=MARKERS) -> DataFrame:
    """Phrases per rollout, in all and per 1000 words."""
    x = R.where(F.coalesce(F.col(text), F.lit("")) != "")
    x = x.select(*by, F.greatest(F.size(F.expr(f"filter(split({text}, '\\\\s+'), w -> w <> '')")), F.lit(1)).alias("_w"), *[F.regexp_count(text, F.lit(p)).alias(k) for k, p in patterns.items()])
    total = sum((F.col(k) for k in patterns), F.lit(0))
    return x.groupBy(*by).agg(F.count("*").alias("n_rollouts"), *[F.avg(k).alias(k) for k in patterns], F.avg(total).alias("total_per_rollout"), F.avg(total * 1000.0 / F.col("_w")).alias("total_per_1k_tokens"))


def repetition(R: DataFrame, text: str, n: int, keys=("problem_id", "rollout_idx")) -> DataFrame:
    """How much each text loops: most repeats of an n-gram, share of repeats, longest run of one n-gram, tail seen before."""
    x = R.where(F.coalesce(F.col(text), F.lit("")) != "").select(*keys, text, tokens(text).alias("tokens"))
    flat = x.select(*keys, F.posexplode(grams_of(n)).alias("at", "gram"))
    counts = flat.groupBy(*keys, "gram").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.max("c").alias("most"), F.count("*").alias("distinct"), F.sum("c").alias("total"))
    islands = flat.withColumn("island", F.col("at") - F.row_number().over(Window.partitionBy(*keys, "gram").orderBy("at")))
    runs = islands.groupBy(*keys, "gram", "island").agg(F.count("*").alias("r")).groupBy(*keys).agg(F.max("r").alias("max_run_repeat"))
    tail = F.expr(f"if(length({text}) > 500, substr({text}, length({text}) - 299, 200), '')")
    head = F.expr(f"if(length({text}) > 500, substr({text}, 1, length({text}) - 500), '')")
    base = x.select(*keys, F.size("tokens").alias("n_tokens"), ((tail != "") & F.contains(head, tail)).alias("_loop"))
    j = base.join(counts, list(keys), "left").join(runs, list(keys), "left")
    return j.select(
        *keys, F.coalesce("most", F.lit(0)).alias("max_ngram_repeat"), F.coalesce(F.round(1 - F.col("distinct") / F.col("total"), 3), F.lit(0.0)).alias("repeat_ratio"), F.coalesce("max_run_repeat", F.lit(0)).alias("max_run_repeat"),
        (F.col("most").isNotNull() & F.col("_loop")).alias("tail_repeats_head"), "n_tokens",
    )


def looping(rep: DataFrame, by=()) -> DataFrame:
    """Shares of looping rollouts: five repeats of an n-gram or more, or a tail seen before."""
    loop = (F.col("max_ngram_repeat") >= 5) | F.col("tail_repeats_head")
    return rep.groupBy(*by).agg(F.count("*").alias("n"), F.avg("repeat_ratio").alias("repeat_ratio"), F.avg("max_ngram_repeat").alias("max_ngram_repeat"), F.avg("max_run_repeat").alias("max_run"), F.avg(F.col("tail_repeats_head").cast("double")).alias("tail_share"), F.avg(loop.cast("double")).alias("looping"))


# --- token distributions: problem_id, rollout_idx, pos, top (a map of token to log-probability) ---


def token_entropy(D: DataFrame, R: DataFrame) -> DataFrame:
    """Entropy in nats of the renormalised top tokens, per position, to a mean per rollout, split by correctness."""
    p = F.transform(F.map_values("top"), F.exp)
    z = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    h = F.aggregate(F.map_values("top"), F.lit(0.0), lambda a, l: a + F.exp(l) * l)
    x = D.where(F.size("top") > 0).select("problem_id", "rollout_idx", (F.log(z) - h / z).alias("h"))
    per = x.groupBy("problem_id", "rollout_idx").agg(F.avg("h").alias("h"))
    return per.join(R.select("problem_id", "rollout_idx", (F.col("reward") > 0.5).alias("correct")), ["problem_id", "rollout_idx"]).groupBy("correct").agg(F.count("*").alias("n_rollouts"), F.avg("h").alias("entropy"))


def token_kl(P: DataFrame, B: DataFrame, eps: float = 1e-12) -> DataFrame:
    """KL divergence in bits of P from B per position over the union of their tokens, to a mean per rollout.

    A token that one side lacks has mass ``eps`` there; positions that one side lacks are left out.
    """
    keys = ["problem_id", "rollout_idx", "pos"]
    both = P.where(F.size("top") > 0).select(*keys, F.col("top").alias("p")).join(B.where(F.size("top") > 0).select(*keys, F.col("top").alias("b")), keys)
    union = F.array_union(F.map_keys("p"), F.map_keys("b"))
    x = both.select(*keys, F.explode(union).alias("token"), "p", "b")
    mass = lambda m: F.coalesce(F.exp(F.col(m)[F.col("token")]), F.lit(eps))
    x = x.select(*keys, mass("p").alias("p"), mass("b").alias("b"))
    # sum p/zp (log p/zp - log b/zb) = (sum p (log p - log b)) / zp - log zp + log zb
    k = x.groupBy(*keys).agg(F.sum(F.col("p") * (F.log2("p") - F.log2("b"))).alias("s"), F.sum("p").alias("zp"), F.sum("b").alias("zb"))
    k = k.select("problem_id", "rollout_idx", (F.col("s") / F.col("zp") - F.log2("zp") + F.log2("zb")).alias("kl"))
    return k.groupBy("problem_id", "rollout_idx").agg(F.avg("kl").alias("kl"), F.count("*").alias("n_positions"))


def kl_summary(K: DataFrame, by=()) -> DataFrame:
    K = cut(K.select(*by, "kl"), "kl")
    return with_quantiles(K.groupBy(*by).agg(F.count("*").alias("n_rollouts"), F.avg("kl").alias("mean")), K, "kl", {"median": 0.5, "p90": 0.9}, by)


# --- token logs: problem_id, rollout_idx, pos, new_lp, old_lp, mask, token_reward ---


def ratio_stats(L: DataFrame, lo: float, hi: float, by=()) -> DataFrame:
    L = L.where("mask = 1").withColumn("r", F.exp(F.col("new_lp") - F.col("old_lp")))
    stats = L.groupBy(*by).agg(
        F.count("*").alias("n_tokens"), F.avg("r").alias("ratio_mean"), F.max("r").alias("ratio_max"), F.avg((F.col("r") < 1 - lo).cast("double")).alias("clipped_low"), F.avg((F.col("r") > 1 + hi).cast("double")).alias("clipped_high")
    )
    return with_quantiles(stats, L, "r", {"ratio_p95": 0.95}, by)


def surrogate(L: DataFrame, A: DataFrame, norm: str = "per_seq", lo: float = 0.2, hi: float = 0.2) -> DataFrame:
    """Loss of the clipped surrogate: tokens, then sequences (by their length, or the batch's longest), then kept sequences."""
    if norm not in ("per_seq", "batch_max"):
        raise ValueError(f"no length norm named {norm}")
    keys = ["problem_id", "rollout_idx"]
    r = F.exp(F.col("new_lp") - F.col("old_lp"))
    clipped = F.least(F.greatest(r, F.lit(1 - lo)), F.lit(1 + hi))
    x = by_rollout(L).join(A.select(*keys, "advantage", "keep"), keys)
    token = -F.least(r * F.col("advantage"), clipped * F.col("advantage")) * F.col("mask")
    s = x.groupBy(*keys).agg(F.sum(token).alias("s"), F.greatest(F.sum("mask"), F.lit(1)).alias("n"), F.max("keep").alias("keep"))
    kept = F.col("keep").cast("int")
    if norm == "per_seq":
        total = F.sum(F.col("s") / F.col("n") * kept)
    else:
        total = F.sum(F.col("s") * kept) / F.max("n")
    return s.agg(F.sum(kept).alias("n_kept"), (total / F.greatest(F.sum(kept), F.lit(1))).alias("loss"))


def by_rollout(L: DataFrame) -> DataFrame:
    """The log dealt out by rollout, to as many tasks as its rows ask for; they are counted at once.

    What is grouped or joined by rollout next stays where it is, and advantages that are derived from a log dealt out like this meet it without
    moving again. A task sums or sorts its share only, while one that sums before the shuffle would hold all rollouts of what it reads.
    """
    return L.repartition(tasks_for(L.sparkSession, L.count(), TOKENS_PER_TASK), "problem_id", "rollout_idx")


def reduce_token_rewards(L: DataFrame) -> DataFrame:
    """Sum of reward times mask per rollout; ``first_row`` keeps the order in which rollouts came."""
    return L.groupBy("problem_id", "rollout_idx").agg(F.sum(F.col("token_reward") * F.col("mask")).alias("reward"), F.min("row_pos").alias("first_row"))


def scatter_to_tokens(A: DataFrame, L: DataFrame) -> DataFrame:
    """Each rollout's advantage on its masked tokens, 0 on the others."""
    return by_rollout(L).join(A.select("problem_id", "rollout_idx", "advantage"), ["problem_id", "rollout_idx"]).withColumn("advantage", F.col("advantage") * F.col("mask"))
