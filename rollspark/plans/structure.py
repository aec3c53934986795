"""Queries of joins, set operations, series and objectives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rollspark.operators import joins as J
from rollspark.operators import objectives as G
from rollspark.operators import series as W
from rollspark.operators.subset_counts import marginal_by_counting
from rollspark.operators.subset_table import scored_subsets
from rollspark.tables import EV, EV8, EVA, LI, MANIFEST, ev, ev8, li, manifest, read

from .metrics import HISTORY, SCORED, history, rounded, scored
from .registry import query


@query("j01_with_manifest", f"WITH {LI}, {MANIFEST} SELECT difficulty_band, count(*) AS n, count(*) FILTER (gold = pred) AS n_match FROM li LEFT JOIN manifest USING (problem_id) GROUP BY 1")
def j01(s, d):
    return J.with_manifest(li(s, d), manifest(s, d)).groupBy("difficulty_band").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("n_match"))


@query(
    "j02_one_to_one",
    f"""WITH {EV}, a AS (SELECT problem_id, rollout_idx, count(*) AS na FROM ev GROUP BY ALL), b AS (SELECT problem_id, rollout_idx + 2 AS rollout_idx, count(*) AS nb FROM ev GROUP BY ALL)
    SELECT count(*) AS n_keys, count(*) FILTER (na > 1) AS repeated_left, count(*) FILTER (nb > 1) AS repeated_right, count(*) FILTER (nb IS NULL) AS missing_right, count(*) FILTER (na IS NULL) AS missing_left FROM a FULL JOIN b USING (problem_id, rollout_idx)""",
)
def j02(s, d):
    R = ev(s, d).select("problem_id", "rollout_idx", "cluster_id")
    return J.join_one_to_one(R, R.withColumn("rollout_idx", F.col("rollout_idx") + 2).withColumnRenamed("cluster_id", "label"), ("problem_id", "rollout_idx"))[1]


@query(
    "j03_left_with_singletons",
    f"""WITH {EV} SELECT problem_id, rollout_idx, coalesce(CASE WHEN cluster_id >= 0 THEN cluster_id::VARCHAR END, '_missing_' || problem_id || '_' || rollout_idx) AS cluster_id FROM ev""",
)
def j03(s, d):
    R = ev(s, d)
    keys = ("problem_id", "rollout_idx")
    return J.left_with_singletons(R.select(*keys), R.where("cluster_id >= 0"), keys, "cluster_id").select(*keys, "cluster_id")


def by_step(s, d):
    """A problem per user and step, so that many stand in one arm only."""
    return ev(s, d, True).withColumn("problem_id", F.col("problem_id") * 100 + F.col("step"))


@query(
    "j04_paired_arms",
    f"WITH {EVA}, c AS (SELECT problem_id * 100 + step AS problem_id, count(*) FILTER (reward > 0.5 AND arm = 'a0') AS a0, count(*) FILTER (reward > 0.5 AND arm = 'a1') AS a1, count(DISTINCT arm) AS n FROM ev GROUP BY ALL) SELECT problem_id, a0, a1 FROM c WHERE n = 2",
)
def j04(s, d):
    return J.paired_wide(by_step(s, d), ("a0", "a1"), F.count_if(F.col("reward") > 0.5))


@query(
    "j05_full_merge",
    """WITH a AS (SELECT doc_id, quality::VARCHAR AS r FROM labels), b AS (SELECT doc_id + 7 AS doc_id, (1 - toxic)::VARCHAR AS r FROM labels), k AS (SELECT doc_id + 100 AS doc_id, source FROM documents)
    SELECT doc_id, coalesce(a.r, '') AS result_A, coalesce(b.r, '') AS result_B, coalesce(source, '') AS source FROM a FULL JOIN b USING (doc_id) FULL JOIN k USING (doc_id)""",
)
def j05(s, d):
    """Keys are shifted, so that each table has some of its own."""
    L = read(s, d, "labels")
    a = L.select("doc_id", F.col("quality").cast("string").alias("result"))
    b = L.select(F.col("doc_id") + 7, (1 - F.col("toxic")).cast("string").alias("result")).toDF("doc_id", "result")
    return J.merge_full(a, b, read(s, d, "documents").select((F.col("doc_id") + 100).alias("doc_id"), "source"), "doc_id")


@query("j06_semi_join", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def j06(s, d):
    keys = read(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.semi(read(s, d, "orders"), keys, "o_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("j06_anti_join", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def j06b(s, d):
    return J.anti(read(s, d, "orders"), read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("j07_with_ladder", f"WITH {EV} SELECT k::INT AS k, count(*) AS n, count(*) FILTER (rollout_idx < k) AS inside FROM ev, (VALUES (1), (4), (16)) t(k) GROUP BY 1")
def j07(s, d):
    return J.with_ladder(ev(s, d), (1, 4, 16)).groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("rollout_idx") < F.col("k")).alias("inside"))


STEP = f"WITH {EVA}, m AS (SELECT arm, step, avg(reward) AS mean, count(*) AS n FROM ev GROUP BY ALL)"


@query("j08_align_steps", STEP + " SELECT a.step, round(a.mean, 6) AS a0, round(b.mean, 6) AS a1 FROM m a JOIN m b ON a.step = b.step WHERE a.arm = 'a0' AND b.arm = 'a1' AND a.step > 3")
def j08(s, d):
    m = W.step_means(ev(s, d, True), "reward").where("arm = 'a1' or step > 3")
    return rounded(J.align_steps(m, ("a0", "a1"), "mean"))


@query("j09_pairs", f"WITH {EV8}, e AS (FROM e8) SELECT a.problem_id, count(*) AS n_pairs, count(*) FILTER (a.pred = b.pred) AS n_same FROM e a JOIN e b ON a.problem_id = b.problem_id AND a.rollout_idx < b.rollout_idx GROUP BY 1")
def j09(s, d):
    p = J.pairs(ev8(s, d), "problem_id", "rollout_idx", ("pred",))
    return p.groupBy("problem_id").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("pred_a") == F.col("pred_b")).alias("n_same"))


@query("j10_rollout_idx", "SELECT user_id AS problem_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS rollout_idx FROM events")
def j10(s, d):
    return J.with_rollout_idx(read(s, d, "events").select(F.col("user_id").alias("problem_id"), "event_id", "ts"), ("ts", "event_id")).drop("ts")


@query("u01_union_chunks", "SELECT src, count(*) AS n, count(quality) AS n_quality, count(toxic) AS n_toxic FROM (SELECT 'a' AS src, quality, NULL AS toxic FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT 'b', NULL, toxic FROM labels WHERE doc_id % 2 = 1) GROUP BY 1")
def u01(s, d):
    L = read(s, d, "labels")
    u = J.union_chunks(L.where("doc_id % 2 = 0").select(F.lit("a").alias("src"), "quality"), L.where("doc_id % 2 = 1").select(F.lit("b").alias("src"), "toxic"))
    return u.groupBy("src").agg(F.count("*").alias("n"), F.count("quality").alias("n_quality"), F.count("toxic").alias("n_toxic"))


@query("u02_common_keys", f"WITH {EVA}, k AS (SELECT arm, problem_id * 100 + step AS problem_id FROM ev) SELECT problem_id FROM k WHERE arm = 'a0' INTERSECT SELECT problem_id FROM k WHERE arm = 'a1'")
def u02(s, d):
    return J.common_keys(by_step(s, d), "problem_id", "arm", 2)


@query("u03_key_diff", f"WITH {EVA}, k AS (SELECT DISTINCT arm, problem_id * 100 + step AS problem_id FROM ev), a AS (SELECT problem_id FROM k WHERE arm = 'a0'), b AS (SELECT problem_id FROM k WHERE arm = 'a1') SELECT problem_id, 'left' AS side FROM a WHERE problem_id NOT IN (FROM b) UNION ALL SELECT problem_id, 'right' FROM b WHERE problem_id NOT IN (FROM a)")
def u03(s, d):
    R = by_step(s, d)
    return J.key_diff(R.where("arm = 'a0'"), R.where("arm = 'a1'"), ("problem_id",))


@query(
    "u04_same_partition",
    f"""WITH {EV8}, e AS (FROM e8), q AS (SELECT a.problem_id, (a.pred = b.pred) AS x, (a.finish_reason = b.finish_reason) AS y FROM e a JOIN e b USING (problem_id)) SELECT problem_id, bool_and(x = y) AS same FROM q GROUP BY 1""",
)
def u04(s, d):
    R = ev8(s, d)
    return J.same_partition(R.select("problem_id", "rollout_idx", F.col("pred").alias("l")), R.select("problem_id", "rollout_idx", F.col("finish_reason").alias("l")), "problem_id", "rollout_idx", "l")


# --- series ---

EMA = f"""WITH RECURSIVE {EVA}, {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY arm, metric ORDER BY step) AS i FROM h),
e AS (SELECT arm, metric, step, value, value AS ema, i FROM r WHERE i = 1 UNION ALL SELECT r.arm, r.metric, r.step, r.value, 0.8 * e.ema + 0.2 * r.value, r.i FROM e JOIN r ON r.arm = e.arm AND r.metric = e.metric AND r.i = e.i + 1)
SELECT arm, metric, step, round(value, 6) AS value, round(ema, 6) AS ema FROM e"""


@query("w01_ema", EMA)
def w01(s, d):
    return rounded(W.ema(history(s, d), 0.8))


UNLOCKED = f"""WITH {EVA}, f AS (SELECT arm, problem_id, min(step) AS step FROM ev WHERE reward > 0 GROUP BY ALL), s AS (SELECT DISTINCT arm, step FROM ev)
SELECT s.arm, s.step, count(problem_id) FILTER (f.step = s.step) AS n_new, count(problem_id) AS unlocked FROM s LEFT JOIN f ON f.arm = s.arm AND f.step <= s.step GROUP BY ALL"""


@query("w02_prompts_unlocked", UNLOCKED)
def w02(s, d):
    return W.prompts_unlocked(ev(s, d, True))


@query("w03_bin_steps", STEP + ", b AS (SELECT lo::INT AS lo, hi::INT AS hi FROM (VALUES (1, 10), (10, 20), (20, 40), (40, 50)) t(lo, hi)), a AS (SELECT DISTINCT arm FROM m) SELECT a.arm, lo, hi, round(avg(mean), 6) AS mean, coalesce(sum(n), 0)::BIGINT AS n FROM a CROSS JOIN b LEFT JOIN m ON m.arm = a.arm AND step >= lo AND step < hi GROUP BY ALL")
def w03(s, d):
    return rounded(W.bin_steps(W.step_means(ev(s, d, True), "reward"), (1, 10, 20, 40, 50)))


for _name, _cond, _from in (("from_lo", "(step - 3) % 5 = 0", True), ("absolute", "step % 5 = 0", False)):

    @query(f"w04_sample_steps_{_name}", STEP + f" SELECT arm, step, round(mean, 6) AS mean, n FROM m WHERE step BETWEEN 3 AND 25 AND {_cond}")
    def w04(s, d, from_lo=_from):
        return rounded(W.sample_steps(W.step_means(ev(s, d, True), "reward"), 3, 25, 5, from_lo))


@query("w05_avg_over_steps", STEP + " SELECT arm, round(avg(mean), 6) AS mean, round(avg(n), 6) AS mean_n, count(mean) AS n_steps FROM m WHERE step >= 5 GROUP BY arm")
def w05(s, d):
    return rounded(W.avg_over_steps(W.step_means(ev(s, d, True), "reward").where("step >= 5")))


@query("w06_at_steps", STEP + " SELECT arm, step, round(mean, 6) AS mean, n FROM m WHERE step IN (1, 15, 30)")
def w06(s, d):
    return rounded(W.at_steps(W.step_means(ev(s, d, True), "reward"), (1, 15, 30)))


@query("w06_final", STEP + " SELECT arm, step, round(mean, 6) AS mean, n FROM m WHERE (arm, step) IN (SELECT (arm, max(step)) FROM m GROUP BY arm)")
def w06b(s, d):
    return rounded(W.final(W.step_means(ev(s, d, True), "reward")))


DELTA = STEP + ", dl AS (SELECT a.arm, a.step, a.mean, c.mean AS control, a.mean - c.mean AS delta FROM m a JOIN m c ON a.step = c.step AND c.arm = 'a0' WHERE a.arm <> 'a0')"


@query("w07_delta_series", DELTA + " SELECT arm, step, round(mean, 6) AS mean, round(control, 6) AS control, round(delta, 6) AS delta FROM dl")
def w07(s, d):
    return rounded(W.delta_series(W.step_means(ev(s, d, True), "reward"), "a0"))


@query("w07_window_delta", DELTA + " SELECT arm, round(avg(delta), 6) AS mean_delta, count(*) AS n_steps FROM dl WHERE step BETWEEN 10 AND 20 GROUP BY arm")
def w07b(s, d):
    return rounded(W.window_delta(W.delta_series(W.step_means(ev(s, d, True), "reward"), "a0"), 10, 20))


@query(
    "w08_calibrate",
    f"WITH {EVA}, {HISTORY} SELECT arm, step, metric, round(value, 6) AS value, round(CASE WHEN arm = 'a1' THEN value / 1.25 ELSE value END, 6) AS calibrated, round(CASE WHEN arm = 'a1' THEN value / 1.25 * 0.85 END, 6) AS low, round(CASE WHEN arm = 'a1' THEN value / 1.25 * 1.15 END, 6) AS high FROM h",
)
def w08(s, d):
    return rounded(W.calibrate(history(s, d), 1.25, 0.15, ("a1",)))


@query("w09_cluster_rank", f"WITH {EV}, k AS (SELECT problem_id, cluster_id, count(*) AS size, count(*) FILTER (reward > 0.5) AS \"right\", min(rollout_idx) AS first FROM ev WHERE cluster_id >= 0 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY size DESC, cluster_id)::INT AS rank FROM k")
def w09(s, d):
    from rollspark.operators.metrics import ranked_clusters

    return ranked_clusters(ev(s, d))


@query("w10_first_k", f"WITH {EVA}, r AS (SELECT *, row_number() OVER (PARTITION BY problem_id, arm ORDER BY rollout_idx) AS i FROM ev WHERE pred <> 'view') SELECT arm, problem_id, rollout_idx, pred FROM r WHERE i <= 3")
def w10(s, d):
    return W.first_k(ev(s, d, True).where("pred <> 'view'"), 3, ("problem_id", "arm")).select("arm", "problem_id", "rollout_idx", "pred")


@query(
    "w11_stitch",
    f"""WITH {EVA}, h AS (SELECT arm, step, run, avg(reward) AS value FROM (SELECT *, r AS run FROM ev, (VALUES (0), (1)) t(r) WHERE (r = 0 AND step <= 20) OR (r = 1 AND step >= 15)) GROUP BY ALL)
    SELECT arm, run::INT AS run, step, round(value, 6) AS value FROM h WHERE run = 1 OR step < 15""",
)
def w11(s, d):
    R = ev(s, d, True)
    H = R.where("step <= 20").withColumn("run", F.lit(0)).unionByName(R.where("step >= 15").withColumn("run", F.lit(1))).groupBy("arm", "step", "run").agg(F.avg("reward").alias("value"))
    return rounded(W.stitch(H).select("arm", "run", "step", "value"))


@query("w12_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50")
def w12(s, d):
    return W.top_k(read(s, d, "lineitem"), (F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"), 50).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "z05_epoch_batches",
    "WITH r AS (SELECT o_orderkey AS problem_id, row_number() OVER (ORDER BY md5('7|0|' || o_orderkey), o_orderkey) - 1 AS position, count(*) OVER () AS n FROM orders) SELECT problem_id, position, (position // 64)::BIGINT AS batch FROM r WHERE position < (n // 64) * 64",
)
def z05(s, d):
    return W.epoch_batches(read(s, d, "orders").select(F.col("o_orderkey").alias("problem_id")), 64, "7", 0).select("problem_id", "position", "batch")


# --- objectives ---

G8 = f"WITH {EV8}, a AS (SELECT *, reward - avg(reward) OVER w AS g, min(reward) OVER w < max(reward) OVER w AS keep, avg(reward) OVER w AS m, count(*) OVER (PARTITION BY problem_id, cluster_id) AS cs FROM e8 WINDOW w AS (PARTITION BY problem_id))"


@query("g01_grpo_advantage", G8 + " SELECT problem_id, rollout_idx, round(g, 6) AS advantage, keep FROM a")
def g01(s, d):
    return rounded(G.grpo_advantage(ev8(s, d)).select("problem_id", "rollout_idx", "advantage", "keep"))


@query("g01_filtered_share", G8 + ", p AS (SELECT problem_id, bool_or(keep) AS keep FROM a GROUP BY 1) SELECT count(*) AS n_prompts, count(*) FILTER (keep) AS n_kept, round(avg((NOT keep)::INT), 6) AS filtered FROM p")
def g01b(s, d):
    return rounded(G.filtered_share(G.grpo_advantage(ev8(s, d))))


@query("g02_inverse_freq", SCORED + " SELECT problem_id, rollout_idx, round(f, 6) AS weighted FROM w")
def g02(s, d):
    return rounded(scored(s, d).select("problem_id", "rollout_idx", "weighted"))


@query("g02_size_divided", G8 + " SELECT problem_id, rollout_idx, round(g / cs, 6) AS weighted FROM a")
def g02b(s, d):
    return rounded(G.size_divided(G.grpo_advantage(ev8(s, d))).select("problem_id", "rollout_idx", "weighted"))


@query("g03_focal", G8 + " SELECT problem_id, rollout_idx, round(power(1 - m, 2) * g, 6) AS weighted FROM a")
def g03(s, d):
    return rounded(G.focal(G.grpo_advantage(ev8(s, d)), 2.0).select("problem_id", "rollout_idx", "weighted"))


SUBS = "sub AS (SELECT b::BIGINT AS subset FROM range(256) t(b) WHERE bit_count(b::INT) = 4), mem AS (SELECT subset, i::INT AS rollout_idx FROM sub, range(8) t(i) WHERE (subset >> i) % 2 = 1)"


@query("g04_subsets", f"WITH {SUBS}, n AS (SELECT count(DISTINCT problem_id) AS n_problems FROM (SELECT user_id AS problem_id, count(*) AS c FROM events GROUP BY 1 HAVING count(*) >= 8)) SELECT subset, string_agg(rollout_idx, ',' ORDER BY rollout_idx) AS members, any_value(n_problems) AS n_problems FROM mem, n GROUP BY 1")
def g04(s, d):
    rows = G.subset_rows(ev(s, d), 8, 4)
    return rows.groupBy("subset").agg(F.array_join(F.array_sort(F.collect_set("rollout_idx")), ",").alias("members"), F.count_distinct("problem_id").alias("n_problems"))


ROWS = f"WITH {EV}, {SUBS}, x AS (SELECT e.*, subset FROM ev e JOIN mem USING (rollout_idx) WHERE problem_id IN (SELECT problem_id FROM ev GROUP BY 1 HAVING count(*) >= 8))"
RAREST = "c AS (SELECT problem_id, subset, cluster_id, count(*) AS s, sum(reward) AS r FROM x GROUP BY ALL), lo AS (SELECT *, min(s) OVER (PARTITION BY problem_id, subset) AS ms FROM c), f AS (SELECT problem_id, subset, sum(r) / sum(s) AS f FROM lo WHERE s = ms GROUP BY ALL)"
POLY = "f AS (SELECT problem_id, subset, avg(reward) * count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) / 4.0 AS f FROM x GROUP BY ALL)"
WORST = "f AS (SELECT problem_id, subset, min(reward) AS f FROM x GROUP BY ALL)"
PICK = "c AS (SELECT problem_id, subset, cluster_id, count(*) AS s, sum(reward) AS r FROM x GROUP BY ALL), f AS (SELECT problem_id, subset, r / s AS f FROM (SELECT *, row_number() OVER (PARTITION BY problem_id, subset ORDER BY s, md5('3|' || problem_id || '|' || subset || '|' || cluster_id)) AS i FROM c) WHERE i = 1)"
MARGINAL = "g AS (SELECT problem_id, avg(f) AS m, min(f) < max(f) AS keep FROM f GROUP BY 1), o AS (SELECT problem_id, rollout_idx, avg(f) AS own FROM f JOIN mem USING (subset) GROUP BY ALL), adv AS (SELECT problem_id, rollout_idx, CASE WHEN keep THEN own - m ELSE 0 END AS advantage, keep FROM o JOIN g USING (problem_id))"

for _id, _kind, _sql in (("g05_rarest", "rarest", RAREST), ("g06_poly", "poly", POLY), ("g07_worst", "worst", WORST)):

    @query(f"{_id}_score", f"{ROWS}, {_sql} SELECT problem_id, subset, round(f, 6) AS f FROM f")
    def g567(s, d, kind=_kind):
        return rounded(G.subset_score(ev(s, d), kind).select("problem_id", "subset", "f"))

    @query(f"g08_marginal_{_kind}", f"{ROWS}, {_sql}, {MARGINAL} SELECT problem_id, rollout_idx, round(advantage, 6) AS advantage, keep FROM adv")
    def g08(s, d, kind=_kind):
        return rounded(G.marginal_advantage(G.subset_score(ev(s, d), kind)).select("problem_id", "rollout_idx", "advantage", "keep"))


@query("g05_rarest_picked", f"{ROWS}, {PICK} SELECT problem_id, subset, round(f, 6) AS f FROM f")
def g05b(s, d):
    return rounded(G.subset_score(ev(s, d), "rarest", tie="md5", seed="3"))


@query("g06_poly_with_degenerate", f"{ROWS}, f AS (SELECT problem_id, subset, avg(reward) * count(DISTINCT cluster_id) / 4.0 AS f FROM x GROUP BY ALL) SELECT problem_id, subset, round(f, 6) AS f FROM f")
def g06b(s, d):
    return rounded(G.subset_score(ev(s, d), "poly", drop_degenerate=False))


@query("g08_quantiles", f"{ROWS}, {RAREST}, {MARGINAL} SELECT round(quantile_cont(advantage, 0.05), 6) AS p05, round(quantile_cont(advantage, 0.5), 6) AS p50, round(quantile_cont(advantage, 0.95), 6) AS p95 FROM adv")
def g08q(s, d):
    return rounded(G.advantage_quantiles(G.marginal_advantage(G.subset_score(ev(s, d), "rarest"))))


@query("g08_global_baseline", f"{ROWS}, {RAREST}, {MARGINAL}, z AS (SELECT avg(f) AS a FROM f) SELECT problem_id, rollout_idx, round(CASE WHEN keep THEN own - a ELSE 0 END, 6) AS advantage FROM o JOIN g USING (problem_id), z")
def g08g(s, d):
    return rounded(G.marginal_advantage(G.subset_score(ev(s, d), "rarest"), baseline="global").select("problem_id", "rollout_idx", "advantage"))


@query(
    "g09_marginal_over_seeds",
    f"""{ROWS}, c AS (SELECT problem_id, subset, cluster_id, count(*) AS s, sum(reward) AS r FROM x GROUP BY ALL), p AS (SELECT seed, problem_id, subset, r / s AS f, row_number() OVER (PARTITION BY seed, problem_id, subset ORDER BY s, md5(seed || '|' || problem_id || '|' || subset || '|' || cluster_id)) AS i FROM c, (VALUES ('0'), ('1'), ('2')) t(seed)),
    f AS (SELECT * FROM p WHERE i = 1), g AS (SELECT seed, problem_id, avg(f) AS m FROM f GROUP BY ALL), o AS (SELECT seed, problem_id, rollout_idx, avg(f) AS own FROM f JOIN mem USING (subset) GROUP BY ALL)
    SELECT problem_id, rollout_idx, round(avg(own - m), 6) AS mean, round(stddev_pop(own - m), 6) AS std FROM o JOIN g USING (seed, problem_id) GROUP BY ALL""",
)
def g09(s, d):
    return rounded(G.marginal_over_seeds(ev(s, d), range(3)))


@query(
    "g10_mechanism_signal",
    SCORED + ", k AS (SELECT problem_id, cluster_id, count(*) AS r FROM e8 WHERE reward > 0.5 GROUP BY ALL), m AS (SELECT problem_id FROM k GROUP BY 1 HAVING min(r) < max(r)) SELECT count(*) AS n_rollouts, round(coalesce(corr(g * (1 + response_length / 500.0), f), 1), 6) AS signal FROM w WHERE problem_id IN (FROM m)",
)
def g10(s, d):
    A = G.grpo_advantage(ev8(s, d)).withColumn("recorded", F.col("advantage") * (1 + F.col("response_length") / 500))
    return rounded(G.mechanism_signal(A.drop("advantage", "keep"), 0.5, 2.0))


@query("g11_dispatch", f"{ROWS}, {POLY}, {MARGINAL} SELECT problem_id, rollout_idx, round(advantage, 6) AS advantage FROM adv")
def g11(s, d):
    return rounded(G.advantages(ev(s, d), "poly").select("problem_id", "rollout_idx", "advantage"))


def best_two(rows, keys):
    """A score of one's own: the mean of a subset's two highest rewards plus its share of distinct answers."""
    return rows.groupBy(*keys).agg((F.least(F.sum("reward"), F.lit(2.0)) / 2 + F.count_distinct("pred") / 4).alias("f"))


@query("g11_custom_score", f"{ROWS}, f AS (SELECT problem_id, subset, least(sum(reward), 2.0) / 2 + count(DISTINCT pred) / 4.0 AS f FROM x GROUP BY ALL), {MARGINAL} SELECT problem_id, rollout_idx, round(advantage, 6) AS advantage FROM adv")
def g11c(s, d):
    return rounded(G.advantages(ev(s, d), best_two).select("problem_id", "rollout_idx", "advantage"))


KEYED = ROWS.replace("SELECT e.*", "SELECT e.* REPLACE (CASE WHEN pred = 'error' THEN 'e' || e.rollout_idx ELSE pred END AS cluster_id)")


@query("g11_cluster_source", f"{KEYED}, {RAREST}, {MARGINAL} SELECT problem_id, rollout_idx, round(advantage, 6) AS advantage FROM adv")
def g11s(s, d):
    return rounded(G.advantages(ev(s, d), "rarest", cluster_source="key", valid=F.col("pred") != "error").select("problem_id", "rollout_idx", "advantage"))


@query("g12_kept", G8 + " SELECT count(*) AS n_rows, count(DISTINCT problem_id) AS n_prompts, count(*) = 0 AS empty FROM a WHERE keep")
def g12(s, d):
    R = ev8(s, d)
    return G.kept(R, G.grpo_advantage(R))[1]


# --- the same by counting, as a table function, and with a score of one's own as a grouped pandas UDF ---

#: All rollouts in groups of at most eight; subsets of four within what a group holds.
PARTIAL = f"WITH {EV8}, {SUBS}, x AS (SELECT * FROM (SELECT e.*, subset, count(*) OVER (PARTITION BY problem_id, subset) AS held FROM e8 e JOIN mem USING (rollout_idx)) WHERE held = 4)"
WHOLE = "SELECT e.problem_id, e.rollout_idx, round(coalesce(a.advantage, 0), 6) AS advantage, coalesce(a.keep, false) AS keep FROM e8 e LEFT JOIN (SELECT o.problem_id, o.rollout_idx, CASE WHEN keep THEN own - m ELSE 0 END AS advantage, keep FROM own o JOIN g USING (problem_id)) a USING (problem_id, rollout_idx)"
OWN = "g AS (SELECT problem_id, avg(f) AS m, min(f) < max(f) AS keep FROM f GROUP BY 1), own AS (SELECT x.problem_id, x.rollout_idx, avg(f) AS own FROM f JOIN x USING (problem_id, subset) GROUP BY ALL)"

for _kind, _sql in (("rarest", RAREST), ("poly", POLY), ("worst", WORST)):

    @query(f"g08_counted_{_kind}", f"{PARTIAL}, {_sql}, {OWN} {WHOLE}")
    def g08n(s, d, kind=_kind):
        return rounded(marginal_by_counting(ev8(s, d), kind, 4).select("problem_id", "rollout_idx", "advantage", "keep"))


#: With rewards of 0 and 1 the least is 1 only where all are.
@query(
    "g07_worst_wide",
    f"""WITH {EV}, n AS (SELECT *, count(*) OVER w AS n, sum(reward) OVER w AS c FROM ev WINDOW w AS (PARTITION BY problem_id)),
    o AS (SELECT problem_id, rollout_idx, n, c, reward * list_product(list_transform(range(7), lambda i: greatest(c - 1 - i, 0) / (n - 1 - i))) AS own FROM n WHERE n >= 8)
    SELECT problem_id, rollout_idx, round(CASE WHEN c < 8 OR c = n THEN 0 ELSE own - avg(own) OVER (PARTITION BY problem_id) END, 6) AS advantage FROM o UNION ALL SELECT problem_id, rollout_idx, 0 FROM n WHERE n < 8""",
)
def g07w(s, d):
    """All rollouts of each user, subsets of eight."""
    return rounded(marginal_by_counting(ev(s, d), "worst", 8).select("problem_id", "rollout_idx", "advantage"))


@query("g08_rarest_wide")
def g08w(s, d):
    """All rollouts of each user, subsets of eight: more than 10 ** 9 a user, held against enumeration in the tests for small groups."""
    return rounded(marginal_by_counting(ev(s, d), "rarest", 8).select("problem_id", "rollout_idx", "advantage", "spread", "keep"))


@query("g04_subsets_wide", "WITH RECURSIVE t AS (SELECT 0 AS n, 0::BIGINT AS subset, -1 AS last UNION ALL SELECT n + 1, subset + (1::BIGINT << i), i::INT FROM t, range(30) r(i) WHERE n < 3 AND i > last) SELECT subset, (SELECT string_agg(i, ',' ORDER BY i) FROM range(30) r(i) WHERE (subset >> i) % 2 = 1) AS members, (SELECT count(DISTINCT user_id) FROM events) AS n_problems FROM t WHERE n = 3")
def g04w(s, d):
    """Three out of thirty, for as many problems as there are."""
    problems = read(s, d, "events").agg(F.count_distinct("user_id").alias("n_problems"))
    return G.subsets(s, 30, 3).select("subset", F.array_join("members", ",").alias("members")).join(problems)


@query("g05_rarest_udtf", f"{PARTIAL}, {RAREST} SELECT problem_id, subset, round(f, 6) AS f FROM f")
def g05t(s, d):
    return rounded(scored_subsets(ev8(s, d)))


@query("g06_poly_udtf", f"{PARTIAL}, {POLY} SELECT problem_id, subset, round(f, 6) AS f FROM f")
def g06t(s, d):
    return rounded(scored_subsets(ev8(s, d), score="poly"))


@query("g11_pandas_score", f"{ROWS}, f AS (SELECT problem_id, subset, least(sum(reward), 2.0) / 2 + count(DISTINCT pred) / 4.0 AS f FROM x GROUP BY ALL), {MARGINAL} SELECT problem_id, rollout_idx, round(advantage, 6) AS advantage FROM adv")
def g11p(s, d):
    """The score of ``best_two`` as a pandas UDF: a call takes a batch of subsets, each with arrays of its rollouts' values."""

    @F.pandas_udf("double")
    def two_best(reward: pd.Series, pred: pd.Series) -> pd.Series:
        if reward.empty:
            return pd.Series(dtype="float64")
        r = np.array(reward.tolist(), np.float64)
        p = np.sort(pd.factorize(np.concatenate(pred.tolist()))[0].reshape(r.shape), axis=1)
        distinct = 1 + (np.diff(p, axis=1) != 0).sum(1) - (p[:, 0] < 0)
        return pd.Series(np.minimum(np.nansum(r, axis=1), 2.0) / 2 + distinct / 4)

    return rounded(G.advantages(ev(s, d), G.ScoreOfArrays(two_best, ("reward", "pred"))).select("problem_id", "rollout_idx", "advantage"))
