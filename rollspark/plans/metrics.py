"""Queries of the metric operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.operators import metrics as M
from rollspark.operators import objectives as G
from rollspark.tables import EV, EV8, EVA, LI, MANIFEST, ROW_ORDER, ev, ev8, li, manifest, read

from .registry import query

KS = (1, 2, 4, 8, 16)


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def values(ks):
    return ", ".join(f"({k})" for k in ks)


def sql_miss(n, c, k):
    return f"CASE WHEN {n} - {c} < {k} THEN 0.0 ELSE list_aggregate(list_transform(range({k}), lambda i: ({n} - {c} - i)::DOUBLE / ({n} - i)), 'product') END"


PP = "pp AS (SELECT arm, problem_id, count(*) AS n, count(*) FILTER (reward > 0.5) AS c FROM ev GROUP BY ALL)"
LADDER = f"ks AS (SELECT k::INT AS k FROM (VALUES {values(KS)}) t(k))"
LAD = f"lad AS (SELECT arm, k, count(*) AS n_prompts, avg(1 - {sql_miss('n', 'c', 'k')}) AS pass_at_k FROM pp, ks WHERE n >= k GROUP BY arm, k)"


@query("m01_pass_at_k", f"WITH {EVA}, {PP}, {LADDER}, {LAD} SELECT arm, k, n_prompts, round(pass_at_k, 6) AS pass_at_k FROM lad")
def m01(s, d):
    return rounded(M.pass_at_k(ev(s, d, True), KS, ("arm",)))


@query("m01_pass_at_k_lineitem", f"WITH {LI}, {PP.replace('FROM ev', 'FROM li')}, {LADDER}, {LAD} SELECT arm, k, n_prompts, round(pass_at_k, 6) AS pass_at_k FROM lad WHERE k <= 4")
def m01b(s, d):
    return rounded(M.pass_at_k(li(s, d), (1, 2, 4), ("arm",)))


@query("m02_any_correct", f"WITH {EVA}, {PP} SELECT arm, count(*) AS n_prompts, round(avg((c > 0)::INT), 6) AS any_correct FROM pp GROUP BY arm")
def m02(s, d):
    return rounded(M.any_correct(ev(s, d, True), ("arm",)))


AUC = "SELECT arm, round(sum(coalesce((k - pk) * (p + pp) / 2, 0)), 6) AS auc FROM (SELECT arm, k, p, lag(k) OVER w AS pk, lag(p) OVER w AS pp FROM ({}) WINDOW w AS (PARTITION BY arm ORDER BY k)) GROUP BY arm"


@query("m03_auc_at_k", f"WITH {EVA}, {PP}, {LADDER}, {LAD} " + AUC.format("SELECT arm, k, pass_at_k AS p FROM lad"))
def m03(s, d):
    return rounded(M.auc_at_k(ev(s, d, True), KS, ("arm",)))


@query("m03_auc_stored", f"WITH {EVA}, {PP}, {LADDER}, {LAD} " + AUC.format("SELECT arm, k, CASE WHEN k = 2 THEN 0.25 ELSE pass_at_k END AS p FROM lad"))
def m03b(s, d):
    R = ev(s, d, True)
    stored = R.select("arm").distinct().select("arm", F.lit(2).alias("k"), F.lit(0.25).alias("pass_at_k"))
    return rounded(M.auc_at_k(R, KS, ("arm",), stored))


@query(
    "m04_potential_at_k",
    f"""WITH {EVA}, {LADDER}, f AS (SELECT arm, problem_id, k, count(*) AS n, count(*) FILTER (reward > 0.5) AS c, count(*) FILTER (reward > 0.5 AND rollout_idx < k) AS e FROM ev, ks GROUP BY ALL)
    SELECT arm, k, count(*) FILTER (n >= k AND e = 0) AS n_failed, count(*) FILTER (n >= k AND e = 0 AND c > 0) AS n_later,
    round(CASE WHEN count(*) FILTER (n >= k AND e = 0) > 0 THEN count(*) FILTER (n >= k AND e = 0 AND c > 0)::DOUBLE / count(*) FILTER (n >= k AND e = 0) ELSE 0 END, 6) AS potential FROM f GROUP BY arm, k""",
)
def m04(s, d):
    return rounded(M.potential_at_k(ev(s, d, True), KS, ("arm",)))


def _first(cond, out):
    return f"""WITH {EVA}, {LADDER}, f AS (SELECT arm, problem_id, k, count(DISTINCT CASE WHEN rollout_idx < k AND {cond} THEN pred END) AS v FROM ev, ks GROUP BY ALL)
    SELECT arm, k, round(avg(v), 6) AS {out} FROM f GROUP BY arm, k"""


@query("m05_coverage_first_k", _first("reward > 0.5", "coverage"))
def m05(s, d):
    return rounded(M.coverage_first_k(ev(s, d, True), KS, ("arm",)))


def _expected(label, cond, out="expected"):
    return f"""WITH {EVA}, {LADDER}, lab AS (SELECT *, {label} AS label FROM (SELECT *, count(*) FILTER (reward > 0.5) OVER (PARTITION BY arm, problem_id) AS nc FROM ev)),
    n AS (SELECT arm, problem_id, count(*) AS n FROM ev GROUP BY ALL), s AS (SELECT arm, problem_id, label, count(*) AS s FROM lab WHERE {cond} GROUP BY ALL),
    v AS (SELECT arm, problem_id, k, coalesce(sum(CASE WHEN s IS NULL THEN 0 ELSE 1 - {sql_miss('n', 's', 'k')} END), 0) AS v FROM n LEFT JOIN s USING (arm, problem_id), ks WHERE n >= k GROUP BY ALL)
    SELECT arm, k, round(avg(v), 6) AS {out} FROM v GROUP BY arm, k"""


@query("m06_expected_distinct", _expected("pred", "reward > 0.5"))
def m06(s, d):
    return rounded(M.expected_distinct(ev(s, d, True), "pred", KS, ("arm",)))


@query("m07_cot_diversity", _expected("CASE WHEN nc < 2 THEN 0 ELSE cluster_id END", "reward > 0.5 AND label >= 0"))
def m07(s, d):
    return rounded(M.cot_diversity(ev(s, d, True), KS, ("arm",)))


@query(
    "m08_conditional_mean",
    f"""WITH {EVA}, f AS (SELECT arm, problem_id, count(DISTINCT CASE WHEN reward > 0.5 THEN cluster_id END) AS v, max(reward) AS r FROM ev GROUP BY ALL)
    SELECT arm, round(avg(v), 6) AS v, count(*) AS n, count(*) FILTER (r > 0.5) AS nc, round(avg(v) * count(*) / count(*) FILTER (r > 0.5), 6) AS conditional FROM f GROUP BY arm""",
)
def m08(s, d):
    pp = ev(s, d, True).groupBy("arm", "problem_id").agg(F.count_distinct(F.when(F.col("reward") > 0.5, F.col("cluster_id"))).alias("v"), F.max("reward").alias("r"))
    means = pp.groupBy("arm").agg(F.avg("v").alias("v"), F.count("*").alias("n"), F.count_if(F.col("r") > 0.5).alias("nc"))
    return rounded(M.conditional_mean(means, "v", "n", "nc"))


@query("m09_distinct_at_k", _first("true", "distinct"))
def m09(s, d):
    return rounded(M.distinct_at_k(ev(s, d, True), KS, ("arm",)))


@query(
    "m10_entropy_at_k",
    f"""WITH {EVA}, {LADDER}, c AS (SELECT arm, problem_id, k, pred, count(*) AS c FROM ev, ks WHERE rollout_idx < k GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY arm, problem_id, k) AS t FROM c),
    h AS (SELECT arm, problem_id, k, -sum(c / t * log2(c / t)) AS h FROM t GROUP BY ALL) SELECT arm, k, round(avg(h), 6) AS entropy FROM h GROUP BY arm, k""",
)
def m10(s, d):
    return rounded(M.entropy_at_k(ev(s, d, True), KS, ("arm",)).withColumn("entropy", F.abs("entropy")))


@query(
    "m11_majority_at_k",
    f"""WITH {EVA}, {LADDER}, c AS (SELECT arm, problem_id, k, pred, count(*) AS c, min(rollout_idx) AS f, max(reward) AS r FROM ev, ks WHERE rollout_idx < k GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY arm, problem_id, k ORDER BY c DESC, f) AS i FROM c)
    SELECT arm, k, count(*) AS n_prompts, round(avg((r > 0.5)::INT), 6) AS majority FROM b WHERE i = 1 GROUP BY arm, k""",
)
def m11(s, d):
    return rounded(M.majority_at_k(ev(s, d, True), KS, ("arm",)))


@query(
    "m12_split_metric",
    f"""WITH {EVA}, {LADDER}, f AS (SELECT arm, problem_id, k, count(*) AS n, max(reward) > 0.5 AS solved, count(DISTINCT CASE WHEN rollout_idx < k THEN pred END) AS v FROM ev, ks GROUP BY ALL)
    SELECT arm, solved, count(*) AS n_prompts, k, round(CASE WHEN min(n) >= k THEN avg(v) END, 6) AS "distinct" FROM f GROUP BY arm, solved, k""",
)
def m12(s, d):
    return rounded(M.split_metric(ev(s, d, True), KS, ("arm",)))


@query(
    "m13_correct_hist",
    f"""WITH {EVA}, f AS (SELECT arm, problem_id, rollout_idx // 8 AS part, count(*) FILTER (reward > 0.5) AS c FROM ev GROUP BY ALL), i AS (SELECT unnest(range(9))::INT AS i)
    SELECT arm, i AS n_correct, round(count(*) FILTER (c = i)::DOUBLE / count(*), 6) AS share FROM f, i GROUP BY arm, i""",
)
def m13(s, d):
    """All rollouts of an arm in groups of eight."""
    R = ev(s, d, True).withColumns({"problem_id": F.expr("problem_id * 100000 + rollout_idx div 8"), "rollout_idx": F.col("rollout_idx") % 8})
    return rounded(M.correct_hist(R, 8, ("arm",)))


@query("m14_mixed_rates", f"WITH {EVA}, {PP} SELECT arm, count(*) AS n_prompts, round(avg((c > 0 AND c < n)::INT), 6) AS mixed, round(avg((c = 0)::INT), 6) AS all_wrong, round(avg((c = n)::INT), 6) AS all_correct FROM pp GROUP BY arm")
def m14(s, d):
    return rounded(M.mixed_rates(ev(s, d, True), ("arm",)))


@query(
    "m15_by_strata",
    f"""WITH {LI}, {MANIFEST}, p AS (SELECT problem_id, count(*) AS n, count(*) FILTER (reward > 0.5) AS c FROM li GROUP BY ALL), j AS (SELECT p.*, difficulty_band, regexp_full_match(gold, '-?[0-9]+') AS integer_gold FROM p JOIN manifest USING (problem_id)), g AS (
    SELECT 'overall' AS stratum, NULL::INT AS difficulty_band, NULL::BOOLEAN AS integer_gold, n, c FROM j UNION ALL SELECT 'band', difficulty_band, NULL, n, c FROM j UNION ALL SELECT 'integer_gold', NULL, integer_gold, n, c FROM j)
    SELECT stratum, difficulty_band, integer_gold, count(*) AS n_prompts, sum(n)::BIGINT AS n_rollouts, round(sum(c)::DOUBLE / sum(n), 6) AS pass_rate, round(avg((c > 0)::INT), 6) AS any_correct FROM g GROUP BY ALL""",
)
def m15(s, d):
    return rounded(M.by_strata(li(s, d), manifest(s, d)))


@query("m16_reward_at_1", f"WITH {EVA} SELECT arm, round(avg(reward), 6) AS reward_at_1 FROM ev WHERE rollout_idx = 0 GROUP BY arm")
def m16(s, d):
    return rounded(M.mean_reward_at_1(ev(s, d, True), ("arm",)))


@query(
    "m17_cover_at_tau",
    f"""WITH {EVA}, n AS (SELECT arm, problem_id, count(*) AS n FROM ev GROUP BY ALL), k AS (SELECT arm, problem_id, cluster_id, count(*) AS s FROM ev WHERE reward > 0.5 GROUP BY ALL),
    v AS (SELECT arm, problem_id, coalesce(avg((s::DOUBLE / n >= 0.05)::INT), 0) AS v FROM n LEFT JOIN k USING (arm, problem_id) GROUP BY ALL) SELECT arm, round(avg(v), 6) AS cover FROM v GROUP BY arm""",
)
def m17(s, d):
    return rounded(M.cover_at_tau(ev(s, d, True), 0.05, ("arm",)))


KK = "k AS (SELECT arm, problem_id, cluster_id, count(*) AS size, count(*) FILTER (reward > 0.5) AS rt, min(rollout_idx) AS f FROM ev GROUP BY ALL)"


@query("m18_cover_mass", f"WITH {EVA}, {KK}, v AS (SELECT arm, problem_id, max(size) AS s FROM k WHERE rt > 0 GROUP BY ALL) SELECT arm, count(*) AS n_eligible, round(avg((s::DOUBLE / 32 >= 0.25)::INT), 6) AS cover FROM v GROUP BY arm")
def m18(s, d):
    return rounded(M.cover_mass(ev(s, d, True), 0.25, 32, ("arm",)))


for _rule in ("floor", "ceil"):

    @query(
        f"m19_worst_subset_{_rule}",
        f"""WITH {EVA}, {PP}, r AS (SELECT *, c::DOUBLE / n AS acc, row_number() OVER (PARTITION BY arm ORDER BY c::DOUBLE / n, problem_id) AS i, count(*) OVER (PARTITION BY arm) AS m FROM pp)
        SELECT arm, count(*) AS n_worst, round(avg(acc), 6) AS worst FROM r WHERE i <= greatest(1, {_rule}(0.3 * m)) GROUP BY arm""",
    )
    def m19(s, d, rule=_rule):
        return rounded(M.worst_subset(ev(s, d, True), 0.3, rule, ("arm",)))


@query("m20_minority_correct", f"WITH {EVA}, {KK}, v AS (SELECT arm, problem_id, min(rt) < max(rt) AS m FROM k WHERE rt > 0 GROUP BY ALL) SELECT arm, count(*) AS n_eligible, round(avg(m::INT), 6) AS minority_rate FROM v GROUP BY arm")
def m20(s, d):
    return rounded(M.minority_rate(ev(s, d, True), ("arm",)))


@query("m21_largest_correct", f"WITH {EVA}, {KK} SELECT arm, problem_id, max(size) FILTER (rt > 0) AS largest_correct FROM k GROUP BY ALL")
def m21(s, d):
    return M.largest_correct(ev(s, d, True), ("arm",))


@query(
    "m22_prompt_readout",
    f"""WITH {EV}, f AS (SELECT problem_id, count(*) AS n, count(*) FILTER (reward > 0.5) AS n_correct, count(DISTINCT cluster_id) AS cluster_id_all, count(DISTINCT cluster_id) FILTER (reward > 0.5) AS cluster_id_correct, count(DISTINCT cluster_id) FILTER (reward <= 0.5) AS cluster_id_incorrect,
    count(DISTINCT pred) AS pred_all, count(DISTINCT pred) FILTER (reward > 0.5) AS pred_correct, count(DISTINCT pred) FILTER (reward <= 0.5) AS pred_incorrect FROM ev GROUP BY ALL)
    SELECT *, round(n_correct::DOUBLE / n, 6) AS pass_at_1, round(CASE WHEN n >= 8 THEN 1 - {sql_miss('n', 'n_correct', 8)} END, 6) AS pass_at_8 FROM f""",
)
def m22(s, d):
    return rounded(M.prompt_readout(ev(s, d)))


COHORT = "CASE WHEN c = 0 THEN 'none' WHEN c * 8 < n THEN 'some' ELSE 'many' END"


@query("m23_cohort_summary", f"WITH {EV}, {PP.replace('arm, ', '')} SELECT {COHORT} AS cohort, count(*) AS n, median(n::DOUBLE) AS median, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM pp GROUP BY {COHORT}")
def m23(s, d):
    return rounded(M.cohort_summary(M.per_prompt(ev(s, d)), "n", F.expr(COHORT)))


@query("m24_u_correct", f"WITH {EVA}, v AS (SELECT arm, problem_id, count(DISTINCT cluster_id) FILTER (reward > 0.5 AND cluster_id >= 0) AS u, max(reward) AS r FROM ev GROUP BY ALL) SELECT arm, count(*) AS n_prompts, round(avg(u), 6) AS u_correct FROM v WHERE r > 0.5 GROUP BY arm")
def m24(s, d):
    return rounded(M.u_correct(ev(s, d, True), ("arm",)))


@query(
    "m25_rank_correctness",
    f"""WITH {EVA}, {KK}, r AS (SELECT *, row_number() OVER (PARTITION BY arm, problem_id ORDER BY size DESC, cluster_id) AS rank, row_number() OVER (PARTITION BY arm, problem_id ORDER BY rt DESC, f) AS best, max(rt) OVER (PARTITION BY arm, problem_id) AS top FROM k WHERE cluster_id >= 0)
    SELECT arm, rank::INT AS rank, count(*) AS n_clusters, round(avg((best = 1)::INT), 6) AS p_best, round(avg(size), 6) AS mean_size FROM r WHERE top > 0 GROUP BY arm, rank""",
)
def m25(s, d):
    return rounded(M.rank_correctness(ev(s, d, True), ("arm",)))


@query(
    "m26_step_diagnostics",
    f"""WITH {EVA}, e AS (SELECT * REPLACE (problem_id % 15 AS problem_id) FROM ev), p AS (SELECT arm, step, problem_id, count(*) AS n, count(*) FILTER (reward > 0.5) AS c, count(DISTINCT pred) AS d FROM e GROUP BY ALL),
    k AS (SELECT arm, step, problem_id, cluster_id, count(*) AS s, max(reward) > 0.5 AS ok FROM e WHERE cluster_id >= 0 GROUP BY ALL), t AS (SELECT *, sum(s) OVER w AS t, row_number() OVER (PARTITION BY arm, step, problem_id ORDER BY s, ok DESC) AS i FROM k WINDOW w AS (PARTITION BY arm, step, problem_id)),
    q AS (SELECT arm, step, problem_id, -sum(s / t * log2(s / t)) AS h, max(CASE WHEN i = 1 THEN ok::INT END) AS rare FROM t GROUP BY ALL),
    a AS (SELECT arm, step, count(*) AS n_prompts, avg((c = 0)::INT) AS all_wrong, avg((c = n)::INT) AS all_right, avg(d) AS dd, avg(h) AS h, avg(rare) AS rare FROM p LEFT JOIN q USING (arm, step, problem_id) GROUP BY ALL),
    b AS (SELECT arm, step, count(*) AS n_rollouts, avg(reward) AS mean_reward, avg(response_length) FILTER (reward > 0.5) AS len_right, avg(response_length) FILTER (reward <= 0.5) AS len_wrong, avg((finish_reason = 'length')::INT) AS sl, avg((finish_reason = 'stop')::INT) AS ss, avg((finish_reason = 'eos')::INT) AS se FROM e GROUP BY ALL)
    SELECT arm, step, n_prompts, n_rollouts, round(all_wrong, 6) AS all_wrong, round(all_right, 6) AS all_right, round(mean_reward, 6) AS mean_reward, round(len_right, 6) AS len_right, round(len_wrong, 6) AS len_wrong, round(sl, 6) AS share_length, round(ss, 6) AS share_stop, round(se, 6) AS share_eos,
    round(dd, 6) AS "distinct", round(abs(h), 6) AS cluster_entropy, round(rare, 6) AS rarest_correct FROM a JOIN b USING (arm, step)""",
)
def m26(s, d):
    R = ev(s, d, True).withColumn("problem_id", F.col("problem_id") % 15)
    return rounded(M.step_diagnostics(R).withColumn("cluster_entropy", F.abs("cluster_entropy")))


PAIRED = "b AS (SELECT problem_id, p.n AS nb, p.c AS cb, q.n AS no, q.c AS co FROM pp p JOIN pp q USING (problem_id) WHERE p.arm = 'a0' AND q.arm = 'a1')"
OUTCOME = "CASE WHEN cb = nb AND co = no THEN 'both_all' WHEN cb > 0 AND co > 0 THEN 'both' WHEN cb > 0 THEN 'base_only' WHEN co > 0 THEN 'other_only' ELSE 'neither' END"


@query("m27_paired_outcome", f"WITH {EVA}, {PP}, {PAIRED} SELECT {OUTCOME} AS outcome, count(*) AS n_prompts FROM b GROUP BY 1")
def m27(s, d):
    return M.paired_outcome(ev(s, d, True), "a0", "a1")


@query(
    "m28_win_loss",
    f"WITH {EVA}, {PP}, {PAIRED} SELECT count(*) FILTER (co > cb) AS wins, count(*) FILTER (co < cb) AS losses, count(*) FILTER (co = cb) AS ties, sum(co - cb)::BIGINT AS net, round(avg(co - cb), 6) AS mean_delta FROM b",
)
def m28(s, d):
    return rounded(M.win_loss(ev(s, d, True), "a0", "a1"))


@query("m29_delta_vs_base", f"WITH {EVA}, {PP}, {LADDER}, {LAD} SELECT a.arm, a.k, round(a.pass_at_k, 6) AS pass_at_k, round(b.pass_at_k, 6) AS base_value, round(a.pass_at_k - b.pass_at_k, 6) AS delta FROM lad a LEFT JOIN lad b ON a.k = b.k AND b.arm = 'a0'")
def m29(s, d):
    table = M.pass_at_k(ev(s, d, True), KS, ("arm",)).drop("n_prompts")
    return rounded(M.delta_vs_base(table, "a0", ("k",), "pass_at_k").select("arm", "k", "pass_at_k", "base_value", "delta"))


for _rule, _at in (("half_even", "round_even(q * (n - 1), 0)"), ("floor", "floor(q * (n - 1))")):

    @query(
        f"m30_percentiles_{_rule}",
        f"""WITH {EVA}, q AS (SELECT q::DOUBLE AS q FROM (VALUES (0.5), (0.9), (0.95)) t(q)), r AS (SELECT arm, response_length AS v, row_number() OVER (PARTITION BY arm ORDER BY response_length) - 1 AS i, count(*) OVER (PARTITION BY arm) AS n FROM ev)
        SELECT arm, q, v AS value FROM r, q WHERE i = {_at}""",
    )
    def m30(s, d, rule=_rule):
        return M.percentiles_nearest(ev(s, d, True), "response_length", (0.5, 0.9, 0.95), rule, ("arm",))


@query(
    "m31_length_stats",
    """SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, max(length(text))::INT AS max_chars, round(avg(w), 6) AS mean_words, max(w)::INT AS max_words, count(*) FILTER (w > 500) AS n_over, round(avg((w > 500)::INT), 6) AS share_over
    FROM (SELECT lang, text, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY lang""",
)
def m31(s, d):
    return rounded(M.length_stats(read(s, d, "documents"), "text", 500, ("lang",)))


def history(s, d):
    """A training history: per arm and step, mean reward and mean length."""
    R = ev(s, d, True).groupBy("arm", "step").agg(F.avg("reward").alias("reward"), F.avg("response_length").alias("length"))
    return R.unpivot(["arm", "step"], ["reward", "length"], "metric", "value")


HISTORY = "h AS (UNPIVOT (SELECT arm, step, avg(reward) AS reward, avg(response_length) AS length FROM ev GROUP BY ALL) ON reward, length INTO NAME metric VALUE value)"


@query("m32_history_quantiles", f"WITH {EVA}, {HISTORY} SELECT arm, metric, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM h GROUP BY ALL")
def m32(s, d):
    return rounded(M.history_quantiles(history(s, d)))


@query("m33_billing_hours", "SELECT 'u' || (user_id % 7) AS run, date_trunc('hour', ts) AS hour, event_type AS resource, round(sum(value), 2) AS cost FROM events GROUP BY ALL")
def m33h(s, d):
    usage = read(s, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("run"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_type", "value")
    return M.billing_hours(usage, "at", "run", "event_type", "value").withColumn("cost", F.round("cost", 2))


@query(
    "m33_cost_rollup",
    """WITH c AS (SELECT l_suppkey AS run, l_returnflag AS resource, sum(l_extendedprice) AS cost FROM lineitem GROUP BY ALL)
    SELECT run, round(sum(cost), 2) AS total, string_agg(resource || '=' || round(cost)::BIGINT, ',' ORDER BY resource) AS parts, round(sum(cost) / 3.95, 2) AS hours FROM c GROUP BY run""",
)
def m33(s, d):
    # The SQL adds in the order of the rows; where a sum ends in about a half, another order rounds to another number.
    b = read(s, d, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_returnflag").alias("resource"), F.col("l_extendedprice").alias("cost"), *ROW_ORDER)
    parts = F.array_join(F.transform("parts", lambda p: F.concat(p["resource"], F.lit("="), F.round(p["cost"]).cast("long").cast("string"))), ",")
    return M.cost_rollup(b, 3.95, ("file_path", "row_index")).select("run", F.round("total", 2).alias("total"), parts.alias("parts"), F.round("hours", 2).alias("hours"))


SCORED = f"""WITH {EV8}, a AS (SELECT *, reward - avg(reward) OVER (PARTITION BY problem_id) AS g, count(*) OVER (PARTITION BY problem_id, cluster_id) AS cluster_size, count(*) OVER (PARTITION BY problem_id) AS n FROM e8),
    w AS (SELECT *, least(power(cluster_size, -0.5) * n / sum(power(cluster_size, -0.5)) OVER (PARTITION BY problem_id), 2.0) * g AS f FROM a)"""


def scored(s, d):
    return G.inverse_freq(G.grpo_advantage(ev8(s, d)), 0.5, 2.0)


@query(
    "m34_corr_matrix",
    SCORED + """, x AS (SELECT response_length::DOUBLE AS x1, value AS x2 FROM w), r AS (SELECT x1, x2, rank() OVER (ORDER BY x1) + (count(*) OVER (PARTITION BY x1) - 1) / 2.0 AS r1, rank() OVER (ORDER BY x2) + (count(*) OVER (PARTITION BY x2) - 1) / 2.0 AS r2 FROM x)
    SELECT 'response_length' AS a, 'value' AS b, round(corr(x1, x2), 6) AS pearson, round(corr(r1, r2), 6) AS spearman FROM r""",
)
def m34(s, d):
    return rounded(M.corr_matrix(scored(s, d), ["response_length", "value"]))


@query("m35_sign_disagreement", SCORED + " SELECT reward > 0.5 AS correct, least(cluster_size, 4)::BIGINT AS size, count(*) AS n, count(*) FILTER (sign(g) * sign(value - 50) < 0) AS n_opposite FROM w GROUP BY ALL")
def m35(s, d):
    x = scored(s, d).withColumn("other", F.col("value") - 50)
    return M.sign_disagreement(x, "advantage", "other")


@query("m36_score_distribution", f"WITH {EVA} SELECT arm, count(*) AS n, round(avg((reward = 0)::INT), 6) AS share_0, round(avg((reward = 1)::INT), 6) AS share_1, round(avg(reward), 6) AS mean, round(stddev_pop(reward), 6) AS std FROM ev GROUP BY arm")
def m36(s, d):
    return rounded(M.score_distribution(ev(s, d, True), "reward", ("arm",)))


@query(
    "m37_dist_table",
    f"""WITH {EV8}, f AS (SELECT problem_id, count(*) FILTER (reward > 0.5) AS c FROM e8 GROUP BY ALL), i AS (SELECT unnest(range(9))::INT AS i)
    SELECT i AS value, count(*) FILTER (c = i) AS n, round(count(*) FILTER (c = i)::DOUBLE / count(*), 6) AS share FROM f, i GROUP BY i""",
)
def m37(s, d):
    return rounded(M.dist_table(M.per_prompt(ev8(s, d)), "c", 8))


@query(
    "m38_arm_scorecard",
    f"""WITH {EVA}, p AS (SELECT arm, problem_id, count(*) AS n, count(*) FILTER (reward > 0.5) AS c, max(CASE WHEN rollout_idx = 0 THEN reward END) AS r1 FROM ev GROUP BY ALL), e AS (SELECT arm, count(*) AS n, avg((reward > 0.5)::INT) AS pr, avg((finish_reason = 'length')::INT) AS cut FROM ev GROUP BY arm)
    SELECT arm, count(*) AS n_prompts, max(e.n)::BIGINT AS n_rollouts, round(max(pr), 6) AS pass_rate, round(avg((c > 0)::INT), 6) AS any_correct, round(avg((c > 0 AND c < p.n)::INT), 6) AS mixed, 1.0::DOUBLE AS parse_rate, round(max(cut), 6) AS cut_rate, round(avg(r1), 6) AS reward_at_1 FROM p JOIN e USING (arm) GROUP BY arm""",
)
def m38(s, d):
    return rounded(M.arm_scorecard(ev(s, d, True)))


@query(
    "m39_sanity",
    f"""WITH {EVA}, p AS (SELECT arm, problem_id, count(*) FILTER (reward > 0.5) AS c, count(*) AS n, count(*) FILTER (pred = 'error') AS e FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY arm, c ORDER BY problem_id) AS i FROM p)
    SELECT arm, c, count(*) AS n_prompts, sum(e)::BIGINT AS n_empty, round(sum(e)::DOUBLE / sum(n), 6) AS share_empty, string_agg(problem_id::VARCHAR, ',' ORDER BY problem_id) FILTER (i <= 3) AS samples FROM r GROUP BY arm, c""",
)
def m39(s, d):
    return rounded(M.sanity(ev(s, d, True), ("arm",), "error"))


@query(
    "m40_usable_prompts",
    f"""WITH {EV8}, p AS (SELECT problem_id, count(*) FILTER (reward > 0.5) AS c, count(DISTINCT pred) AS a, count(DISTINCT cluster_id) AS b, count(DISTINCT finish_reason) AS f FROM e8 GROUP BY ALL)
    SELECT key, n_usable, (SELECT count(*) FROM p) AS n_prompts FROM (SELECT 'pred' AS key, count(*) FILTER (c > 0 AND a >= 2) AS n_usable FROM p UNION ALL SELECT 'cluster_id', count(*) FILTER (c > 0 AND b >= 2) FROM p UNION ALL SELECT 'finish_reason', count(*) FILTER (c > 0 AND f >= 2) FROM p)""",
)
def m40(s, d):
    return M.usable_prompts(ev8(s, d), ("pred", "cluster_id", "finish_reason"))


@query("m41_singleton_mass", SCORED + " SELECT arm, round(sum(CASE WHEN cluster_size = 1 AND reward <= 0.5 THEN abs(g) ELSE 0 END) / sum(abs(g)), 6) AS singleton_mass FROM w GROUP BY arm")
def m41(s, d):
    return rounded(M.singleton_mass(scored(s, d), "advantage", ("arm",), ("problem_id", "cluster_id")))


STEPS = f"WITH {EVA}, e AS (SELECT * REPLACE (problem_id % 15 AS problem_id) FROM ev), a AS (SELECT *, reward - avg(reward) OVER (PARTITION BY step, problem_id) AS g FROM e)"


@query(
    "m42_step_aggregate",
    STEPS + """, k AS (SELECT step, problem_id, cluster_id, count(*) FILTER (reward > 0.5) AS r FROM e GROUP BY ALL), m AS (SELECT step, problem_id, min(r) FILTER (r > 0) < max(r) AS mi, count(*) AS k FROM k GROUP BY ALL),
    b AS (SELECT step, count(*) FILTER (mi) AS n_minority, avg(k) AS mean_clusters FROM m GROUP BY step), c AS (SELECT step, avg(reward) AS mean_reward, var_pop(g) AS v, avg((pred <> '')::INT) AS parse_rate FROM a GROUP BY step)
    SELECT step, round(mean_reward, 6) AS mean_reward, round(v, 6) AS advantage_var, round(parse_rate, 6) AS parse_rate, n_minority, round(mean_clusters, 6) AS mean_clusters FROM b JOIN c USING (step)""",
)
def m42(s, d):
    R = ev(s, d, True).withColumn("problem_id", F.col("problem_id") % 15)
    return rounded(M.step_aggregate(G.grpo_advantage(R, by=("step",))))


@query(
    "m43_pool_crosstab",
    """WITH l AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'p' ELSE 'q' END AS pool, doc_id % 100 AS key, quality FROM labels), o AS (SELECT 'p_only' AS pool, key, quality FROM l WHERE pool = 'p' AND key NOT IN (SELECT key FROM l WHERE pool = 'q')), u AS (SELECT * FROM l UNION ALL SELECT * FROM o)
    SELECT pool, count(*) AS n, count(*) FILTER (quality = 1) AS n_1, count(*) FILTER (quality = 0) AS n_0 FROM u GROUP BY pool""",
)
def m43(s, d):
    L = read(s, d, "labels").select(F.when(F.col("doc_id") % 2 == 0, "p").otherwise("q").alias("pool"), (F.col("doc_id") % 100).alias("key"), "quality")
    return M.pool_crosstab(L, "pool", "quality", "key", "p", "q")
