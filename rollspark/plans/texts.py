"""Queries of text, token distributions, intervals, decisions and labels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rollspark.operators import decisions as D
from rollspark.operators import metrics as M
from rollspark.operators import text as N
from rollspark.tables import EV, EV8, EVA, ev, ev8, read

from .metrics import rounded
from .registry import query


def conv(s, d):
    return read(s, d, "conversations").select(F.col("conv_id").alias("problem_id"), F.col("turn").cast("int").alias("rollout_idx"), "text", "role")


TOK = "t AS (SELECT conv_id AS problem_id, turn::INT AS rollout_idx, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]') AS k FROM conversations WHERE text <> '')"


def _grams(n, extra=""):
    return f"SELECT problem_id, rollout_idx, {n} AS n, unnest(list_transform(range(1, len(k) - {n - 2}), lambda i: array_to_string(list_slice(k, i, i + {n - 1}), ' '))) AS gram FROM t WHERE len(k) >= {n} {extra}"


@query("n01_ngrams", f"WITH {TOK}, g AS ({_grams(2)}) SELECT problem_id, rollout_idx, gram, count(*) AS c FROM g GROUP BY ALL")
def n01(s, d):
    return N.ngrams(conv(s, d), "text", 2)


@query(
    "n02_self_bleu",
    f"""WITH t0 AS (SELECT * FROM (WITH {TOK} SELECT *, count(*) OVER (PARTITION BY problem_id) AS m FROM t)), t AS (SELECT * FROM t0 WHERE m >= 2), g AS ({' UNION ALL '.join(_grams(n) for n in range(1, 5))}),
    c AS (SELECT problem_id, rollout_idx, n, gram, count(*) AS c FROM g GROUP BY ALL), o AS (SELECT a.problem_id, a.rollout_idx, a.n, a.gram, any_value(a.c) AS c, coalesce(max(b.c), 0) AS best FROM c a LEFT JOIN c b ON a.problem_id = b.problem_id AND a.n = b.n AND a.gram = b.gram AND a.rollout_idx <> b.rollout_idx GROUP BY ALL),
    p AS (SELECT problem_id, rollout_idx, n, sum(least(c, best)) AS hit, sum(c) AS total FROM o GROUP BY ALL), l AS (SELECT problem_id, rollout_idx, count(*) AS orders, avg(ln((hit + 1e-9) / total)) AS lp FROM p GROUP BY ALL),
    q AS (SELECT a.problem_id, a.rollout_idx, len(a.k) AS n, arg_min(len(b.k), abs(len(b.k) - len(a.k)) * 1000000 + len(b.k)) AS r FROM t a JOIN t b ON a.problem_id = b.problem_id AND a.rollout_idx <> b.rollout_idx GROUP BY ALL),
    z AS (SELECT q.problem_id, CASE WHEN coalesce(orders, 0) = 4 THEN CASE WHEN q.n > r THEN 1 ELSE exp(1 - r / greatest(q.n, 1)::DOUBLE) END * exp(lp) ELSE 0 END AS v FROM q LEFT JOIN l USING (problem_id, rollout_idx))
    SELECT problem_id, count(*) AS n_rollouts, round(avg(v), 6) AS self_bleu FROM z GROUP BY 1""",
)
def n02(s, d):
    return rounded(N.self_bleu(conv(s, d), "text"))


@query("n03_distinct_n", f"WITH {TOK}, g AS ({_grams(2)}) SELECT problem_id, round(coalesce(count(DISTINCT gram)::DOUBLE / nullif(count(gram), 0), 0), 6) AS \"distinct\" FROM (SELECT DISTINCT problem_id FROM t) LEFT JOIN g USING (problem_id) GROUP BY 1")
def n03(s, d):
    return rounded(N.distinct_n(conv(s, d), "text", 2))


MARKS = {"the": "(?i)\\bthe\\b", "and": "(?i)\\band\\b"}


@query(
    "n04_marker_rates",
    """WITH c AS (SELECT role, greatest(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')), 1) AS w, len(regexp_extract_all(text, '(?i)\\bthe\\b')) AS the, len(regexp_extract_all(text, '(?i)\\band\\b')) AS "and" FROM conversations WHERE text <> '')
    SELECT role, count(*) AS n_rollouts, round(avg(the), 6) AS the, round(avg("and"), 6) AS "and", round(avg(the + "and"), 6) AS total_per_rollout, round(avg((the + "and") * 1000.0 / w), 6) AS total_per_1k_tokens FROM c GROUP BY role""",
)
def n04(s, d):
    return rounded(N.marker_rates(conv(s, d), "text", ("role",), MARKS))


@query(
    "n05_repetition",
    f"""WITH {TOK}, g AS (SELECT problem_id, rollout_idx, unnest(range(1, len(k))) AS pos, unnest(list_transform(range(1, len(k)), lambda i: array_to_string(list_slice(k, i, i + 1), ' '))) AS gram FROM t WHERE len(k) >= 2),
    c AS (SELECT problem_id, rollout_idx, gram, count(*) AS c FROM g GROUP BY ALL), a AS (SELECT problem_id, rollout_idx, max(c) AS most, round(1 - count(*)::DOUBLE / sum(c), 3) AS ratio FROM c GROUP BY ALL),
    i AS (SELECT *, pos - row_number() OVER (PARTITION BY problem_id, rollout_idx, gram ORDER BY pos) AS isl FROM g), r AS (SELECT problem_id, rollout_idx, max(n) AS run FROM (SELECT problem_id, rollout_idx, gram, isl, count(*) AS n FROM i GROUP BY ALL) GROUP BY ALL)
    SELECT t.problem_id, t.rollout_idx, coalesce(most, 0) AS max_ngram_repeat, coalesce(ratio, 0) AS repeat_ratio, coalesce(run, 0) AS max_run_repeat, most IS NOT NULL AND length(x.text) > 500 AND contains(substr(x.text, 1, greatest(length(x.text) - 500, 0)), substr(x.text, length(x.text) - 299, 200)) AS tail_repeats_head, len(k)::INT AS n_tokens
    FROM t LEFT JOIN a USING (problem_id, rollout_idx) LEFT JOIN r USING (problem_id, rollout_idx) JOIN (SELECT conv_id, turn, text FROM conversations) x ON x.conv_id = t.problem_id AND x.turn = t.rollout_idx""",
)
def n05(s, d):
    return N.repetition(conv(s, d), "text", 2)


def token_maps(s, d):
    """Two token distributions per position out of the vectors: 16 tokens at each of 4 positions, some missing on a side."""
    e = read(s, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("problem_id"), (F.col("vec_id") % 8).cast("int").alias("rollout_idx"), F.posexplode("embedding").alias("i", "x"))
    e = e.withColumns({"pos": F.floor(F.col("i") / 16).cast("int"), "token": (F.col("i") % 16).cast("int"), "x": F.col("x").cast("double")})
    make = lambda cond, lp: e.where(cond).groupBy("problem_id", "rollout_idx", "pos").agg(F.map_from_entries(F.collect_list(F.struct("token", lp.alias("lp")))).alias("top"))
    return make("i % 5 <> 0", -1 - 10 * F.abs("x")), make("i % 7 <> 0", -1 - 5 * F.abs("x"))


MAPS = """e AS (SELECT vec_id // 8 AS problem_id, (vec_id % 8)::INT AS rollout_idx, i // 16 AS pos, i % 16 AS token, i, v[i + 1]::DOUBLE AS x FROM (SELECT vec_id, embedding AS v, unnest(range(64)) AS i FROM embeddings)),
p AS (SELECT *, -1 - 10 * abs(x) AS lp FROM e WHERE i % 5 <> 0), b AS (SELECT *, -1 - 5 * abs(x) AS lp FROM e WHERE i % 7 <> 0)"""


@query(
    "n06_token_entropy",
    f"""WITH {MAPS}, h AS (SELECT problem_id, rollout_idx, pos, ln(sum(exp(lp))) - sum(exp(lp) * lp) / sum(exp(lp)) AS h FROM p GROUP BY ALL), r AS (SELECT problem_id, rollout_idx, avg(h) AS h FROM h GROUP BY ALL)
    SELECT (problem_id + rollout_idx) % 3 = 0 AS correct, count(*) AS n_rollouts, round(avg(h), 6) AS entropy FROM r GROUP BY 1""",
)
def n06(s, d):
    P, _ = token_maps(s, d)
    R = P.select("problem_id", "rollout_idx").distinct().withColumn("reward", F.when((F.col("problem_id") + F.col("rollout_idx")) % 3 == 0, 1.0).otherwise(0.0))
    return rounded(N.token_entropy(P, R))


@query(
    "n07_token_kl",
    f"""WITH {MAPS}, j AS (SELECT coalesce(p.problem_id, b.problem_id) AS problem_id, coalesce(p.rollout_idx, b.rollout_idx) AS rollout_idx, coalesce(p.pos, b.pos) AS pos, coalesce(exp(p.lp), 1e-12) AS x, coalesce(exp(b.lp), 1e-12) AS y FROM p FULL JOIN b ON p.problem_id = b.problem_id AND p.rollout_idx = b.rollout_idx AND p.i = b.i),
    n AS (SELECT *, x / sum(x) OVER w AS px, y / sum(y) OVER w AS py FROM j WINDOW w AS (PARTITION BY problem_id, rollout_idx, pos)), k AS (SELECT problem_id, rollout_idx, pos, sum(px * (log2(px) - log2(py))) AS kl FROM n GROUP BY ALL), r AS (SELECT problem_id, rollout_idx, avg(kl) AS kl FROM k GROUP BY ALL)
    SELECT count(*) AS n_rollouts, round(avg(kl), 6) AS mean, round(quantile_cont(kl, 0.5), 6) AS median, round(quantile_cont(kl, 0.9), 6) AS p90 FROM r""",
)
def n07(s, d):
    return rounded(N.kl_summary(N.token_kl(*token_maps(s, d))))


def token_log(s, d):
    x = read(s, d, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("problem_id"), (F.col("l_suppkey") % 4).alias("rollout_idx"), (-10 * F.col("l_discount")).alias("new_lp"), (-10 * F.col("l_tax")).alias("old_lp"),
        F.when(F.col("l_linenumber") % 5 == 0, 0).otherwise(1).alias("mask"), F.col("l_quantity").alias("token_reward"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("row_pos"),
    )


LOG = "l AS (SELECT l_orderkey AS problem_id, l_suppkey % 4 AS rollout_idx, -10 * l_discount AS new_lp, -10 * l_tax AS old_lp, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE 1 END AS mask, l_quantity AS token_reward, l_partkey * 10 + l_linenumber AS row_pos FROM lineitem), a AS (SELECT DISTINCT problem_id, rollout_idx, (problem_id % 5 - 2) / 2.0 AS advantage, problem_id % 4 <> 0 AS keep FROM l)"


def token_adv(L):
    return N.by_rollout(L).select("problem_id", "rollout_idx").distinct().withColumns({"advantage": (F.col("problem_id") % 5 - 2) / 2.0, "keep": F.col("problem_id") % 4 != 0})


@query("n08_ratio_stats", f"WITH {LOG}, r AS (SELECT exp(new_lp - old_lp) AS r FROM l WHERE mask = 1) SELECT count(*) AS n_tokens, round(avg(r), 6) AS ratio_mean, round(max(r), 6) AS ratio_max, round(quantile_cont(r, 0.95), 6) AS ratio_p95, round(avg((r < 0.8)::INT), 6) AS clipped_low, round(avg((r > 1.2)::INT), 6) AS clipped_high FROM r")
def n08(s, d):
    return rounded(N.ratio_stats(token_log(s, d), 0.2, 0.2))


for _norm, _total in (("per_seq", "sum(s / n * keep::INT)"), ("batch_max", "sum(s * keep::INT) / max(n)")):

    @query(
        f"n09_surrogate_{_norm}",
        f"""WITH {LOG}, t AS (SELECT *, exp(new_lp - old_lp) AS r FROM l JOIN a USING (problem_id, rollout_idx)), q AS (SELECT problem_id, rollout_idx, bool_or(keep) AS keep, sum(-least(r * advantage, least(greatest(r, 0.8), 1.2) * advantage) * mask) AS s, greatest(sum(mask), 1) AS n FROM t GROUP BY ALL)
        SELECT sum(keep::INT)::BIGINT AS n_kept, round({_total} / greatest(sum(keep::INT), 1), 6) AS loss FROM q""",
    )
    def n09(s, d, norm=_norm):
        L = token_log(s, d)
        return rounded(N.surrogate(L, token_adv(L), norm))


@query("n10_reduce_token_rewards", f"WITH {LOG} SELECT problem_id, rollout_idx, sum(token_reward * mask) AS reward, min(row_pos) AS first_row FROM l GROUP BY ALL")
def n10(s, d):
    return N.reduce_token_rewards(token_log(s, d))


@query("n11_scatter_to_tokens", f"WITH {LOG} SELECT problem_id, rollout_idx, count(*) AS n, round(sum(advantage * mask), 6) AS total FROM l JOIN a USING (problem_id, rollout_idx) GROUP BY ALL")
def n11(s, d):
    L = token_log(s, d)
    return rounded(N.scatter_to_tokens(token_adv(L), L).groupBy("problem_id", "rollout_idx").agg(F.count("*").alias("n"), F.sum("advantage").alias("total")))


# --- intervals and decisions ---

BOOT = f"""WITH {EV}, pp AS (SELECT problem_id, count(*) FILTER (reward > 0.5)::DOUBLE / count(*) AS acc, row_number() OVER (ORDER BY problem_id) - 1 AS i, count(*) OVER () AS n FROM ev GROUP BY problem_id),
dr AS (SELECT b, pp.i AS j, (('0x' || substr(md5('42|' || b || '|' || pp.i), 1, 8))::BIGINT % n) AS i FROM pp, range(40) t(b)), s AS (SELECT dr.b, q.problem_id, q.acc FROM dr JOIN pp q USING (i)), m AS (SELECT b, avg(acc) AS v FROM s GROUP BY b)"""


def acc(s, d):
    return M.per_prompt(ev(s, d)).select("problem_id", (F.col("c") / F.col("n")).alias("acc"))


@query("b01_bootstrap_ci", BOOT + ", o AS (SELECT list_sort(list(v)) AS l, stddev_pop(v) AS std FROM m) SELECT round((SELECT avg(acc) FROM pp), 6) AS point, round(l[2], 6) AS ci_low, round(l[39], 6) AS ci_high, round(std, 6) AS std FROM o")
def b01(s, d):
    return rounded(D.bootstrap_ci(acc(s, d), F.avg("acc"), 40, 42))


@query("b02_bootstrap_mean", BOOT + " SELECT round((SELECT avg(acc) FROM pp), 6) AS point, (SELECT count(*) FROM pp) AS n, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high FROM m")
def b02(s, d):
    return rounded(D.bootstrap_mean(acc(s, d), "acc", 40, 42))


@query(
    "b03_bootstrap_worst",
    BOOT + """, w AS (SELECT b, acc, row_number() OVER (PARTITION BY b ORDER BY acc, problem_id) AS r, count(*) OVER (PARTITION BY b) AS n FROM s), v AS (SELECT b, avg(acc) AS v FROM w WHERE r <= greatest(1, floor(0.25 * n)) GROUP BY b), o AS (SELECT list_sort(list(v)) AS l, stddev_pop(v) AS std FROM v),
    p AS (SELECT avg(acc) AS point FROM (SELECT acc, row_number() OVER (ORDER BY acc, problem_id) AS r, count(*) OVER () AS n FROM pp) WHERE r <= greatest(1, floor(0.25 * n))) SELECT round(point, 6) AS point, round(l[2], 6) AS ci_low, round(l[39], 6) AS ci_high, round(std, 6) AS std FROM o, p""",
)
def b03(s, d):
    return rounded(D.bootstrap_metric(acc(s, d), D.worst_in_sample(0.25), 40, 42))


CDF = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


@query(
    "b01_poisson_replicates",
    f"WITH {EV}, pp AS (SELECT problem_id, avg((reward > 0.5)::INT) AS acc FROM ev GROUP BY 1), u AS (SELECT b, acc, ('0x' || substr(md5('42|' || b || '|' || problem_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM pp, (SELECT unnest(range(40)) AS b)), w AS (SELECT b, acc, {' + '.join(f'(u >= {c!r}::DOUBLE)::INT' for c in CDF)} AS w FROM u), v AS (SELECT b, sum(acc * w) / sum(w) AS v FROM w GROUP BY b HAVING sum(w) > 0) SELECT count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM v",
)
def b01p(s, d):
    x = D.poisson_replicates(acc(s, d), 40, 42).groupBy("b").agg((F.sum(F.col("acc") * F.col("weight")) / F.sum("weight")).alias("v"))
    return rounded(x.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")))


RUNS = f"""WITH {EVA}, e AS (SELECT CASE WHEN step <= 8 THEN 'base' WHEN step <= 15 THEN 'base_again' WHEN step <= 22 THEN 'candidate' ELSE 'rival' END AS run, * FROM ev), p AS (SELECT run, problem_id, avg(reward) AS acc, max(reward) AS hit FROM e GROUP BY ALL), m AS (SELECT run, avg(acc) AS pass_at_1, avg(hit) AS cover, avg(acc * acc) AS worst FROM p GROUP BY run)"""


def runs(s, d):
    step = F.col("step")
    e = ev(s, d, True).withColumn("run", F.when(step <= 8, "base").when(step <= 15, "base_again").when(step <= 22, "candidate").otherwise("rival"))
    p = e.groupBy("run", "problem_id").agg(F.avg("reward").alias("acc"), F.max("reward").alias("hit"))
    m = p.groupBy("run").agg(F.avg("acc").alias("pass_at_1"), F.avg("hit").alias("cover"), F.avg(F.col("acc") * F.col("acc")).alias("worst"))
    return m.withColumns({f"{t}_{e}": F.col(t) + x for t in ("cover", "worst") for e, x in (("low", -0.01), ("high", 0.01))})


GATE = """g AS (SELECT greatest(abs(100 * (b.cover - a.cover)), abs(100 * (b.worst - a.worst))) AS noise, greatest(100 * (c.cover - b.cover), 100 * (c.worst - b.worst)) AS tail_gain, 100 * (b.pass_at_1 - c.pass_at_1) AS pass1_drop, greatest(abs(100 * (c.cover - r.cover)), abs(100 * (c.worst - r.worst))) AS rival_gap,
((c.cover - 0.01 > 0 OR c.cover + 0.01 < 0) AND c.cover > b.cover) OR ((c.worst - 0.01 > 0 OR c.worst + 0.01 < 0) AND c.worst > b.worst) AS clear FROM m a, m b, m c, m r WHERE a.run = 'base_again' AND b.run = 'base' AND c.run = 'candidate' AND r.run = 'rival')"""


@query("d01_gate", RUNS + ", " + GATE + " SELECT CASE WHEN noise > 40 THEN 'STOP_NO_SIGNAL' WHEN NOT (tail_gain >= 2 AND clear) THEN 'PIVOT_WORST_SUBSET' WHEN pass1_drop > 2 THEN 'PIVOT_SUBSTRATE_OR_ARCH' WHEN rival_gap <= 1 THEN 'PIVOT_SUBSTRATE_OR_ARCH' ELSE 'ESCALATE' END AS decision, round(noise, 6) AS noise, round(tail_gain, 6) AS tail_gain, round(pass1_drop, 6) AS pass1_drop, round(rival_gap, 6) AS rival_gap FROM g")
def d01(s, d):
    rate = M.minority_rate(ev(s, d))
    return rounded(D.gate(runs(s, d), rate, gates=D.GATES | {"noise_max": 40.0, "minority_rate_min": 0.0}).drop("reasons"))


@query("d02_ab_verdict", f"WITH {EVA}, p AS (SELECT arm, problem_id, count(*) AS n, count(*) FILTER (reward > 0.5) AS c, count(*) FILTER (pred <> 'error') AS ok FROM ev GROUP BY ALL), k AS (SELECT arm, sum(ok)::DOUBLE / sum(n) AS parse_rate, avg((c > 0 AND c < n)::INT) AS mixed FROM p GROUP BY arm), x AS (SELECT a.arm, 100 * (a.parse_rate - b.parse_rate) AS d_parse, 100 * (a.mixed - b.mixed) AS d_mixed FROM k a JOIN k b ON b.arm = 'a0' WHERE a.arm <> 'a0') SELECT arm, round(d_parse, 6) AS d_parse, round(d_mixed, 6) AS d_mixed, CASE WHEN d_parse > 5 AND d_mixed > 2 THEN 'beats' WHEN abs(d_parse) <= 2 AND abs(d_mixed) <= 2 THEN 'ties' ELSE 'loses' END AS verdict FROM x")
def d02(s, d):
    R = ev(s, d, True).withColumn("pred", F.when(F.col("pred") == "error", "").otherwise(F.col("pred")))
    return rounded(D.ab_verdict(M.arm_scorecard(R), "a0"))


@query("d03_with_status", f"WITH {EV}, p AS (SELECT problem_id, count(*) AS n, avg(reward) AS r FROM ev GROUP BY 1) SELECT problem_id, concat_ws(',', CASE WHEN n < 30 THEN 'enough' END, CASE WHEN r <= 0.1 THEN 'rewarded' END) AS failed, CASE WHEN n >= 30 AND r > 0.1 THEN 'ok' ELSE 'investigate' END AS status FROM p")
def d03(s, d):
    pp = ev(s, d).groupBy("problem_id").agg(F.count("*").alias("n"), F.avg("reward").alias("r"))
    return D.with_status(pp, {"enough": F.col("n") >= 30, "rewarded": F.col("r") > 0.1}).select("problem_id", "failed", "status")


# --- labels ---

LAB = """WITH a AS (SELECT doc_id AS seq, CASE WHEN doc_id % 11 = 0 THEN 'needs_review' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS r FROM labels WHERE doc_id % 9 <> 0), b AS (SELECT doc_id AS seq, CASE WHEN doc_id % 22 = 0 THEN 'needs_review' WHEN quality = 1 AND toxic = 0 THEN 'good' ELSE 'bad' END AS r FROM labels), k AS (SELECT doc_id + 50 AS seq, n_chars::VARCHAR AS gold FROM documents),
m AS (SELECT seq, coalesce(a.r, '') AS result_A, coalesce(b.r, '') AS result_B, coalesce(gold, '') AS gold FROM a FULL JOIN b USING (seq) FULL JOIN k USING (seq)), l AS (SELECT *, result_A = result_B AS agreed, result_A <> result_B OR result_A = 'needs_review' OR result_B = 'needs_review' AS needs_human, CASE WHEN result_A = result_B THEN result_A END AS result FROM m)"""


def labelled(s, d):
    L = read(s, d, "labels").withColumn("seq", F.col("doc_id"))
    a = L.where("doc_id % 9 <> 0").select("seq", F.when(F.col("seq") % 11 == 0, "needs_review").when(F.col("quality") == 1, "good").otherwise("bad").alias("result"))
    b = L.select("seq", F.when(F.col("seq") % 22 == 0, "needs_review").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good").otherwise("bad").alias("result"))
    k = read(s, d, "documents").select((F.col("doc_id") + 50).alias("seq"), F.col("n_chars").cast("string").alias("gold"))
    return D.merge_labels(a, b, k)


@query("l01_merge_labels", LAB + " SELECT seq, result_A, result_B, gold, agreed, needs_human, result FROM l")
def l01(s, d):
    return labelled(s, d).drop("human_result")


REASON = "CASE WHEN NOT agreed THEN 'dispute' WHEN result_A = 'needs_review' AND result_B = 'needs_review' THEN 'needs_review_both' WHEN result_A = 'needs_review' THEN 'needs_review_A' WHEN result_B = 'needs_review' THEN 'needs_review_B' ELSE 'needs_human' END"


@query("l02_review_queue", LAB + f" SELECT seq, {REASON} AS review_reason FROM l WHERE needs_human")
def l02(s, d):
    return D.review_queue(labelled(s, d)).select("seq", "review_reason")


@query("l02_review_counts", LAB + f" SELECT {REASON} AS review_reason, count(*) AS n FROM l WHERE needs_human GROUP BY 1")
def l02b(s, d):
    return D.review_queue(labelled(s, d)).groupBy("review_reason").agg(F.count("*").alias("n"))


@query(
    "l03_apply_labels",
    LAB + """, h AS (SELECT seq, 'human_' || (seq % 3) AS h FROM l WHERE seq % 5 = 0 AND needs_human), z AS (SELECT doc_id AS seq, n_chars FROM documents), j AS (SELECT l.*, h, coalesce(h IS NULL AND needs_human AND n_chars >= 3000, false) AS auto FROM l LEFT JOIN h USING (seq) LEFT JOIN z USING (seq))
    SELECT seq, coalesce(h, CASE WHEN auto THEN 'runon' END) AS human_result, coalesce(h, CASE WHEN auto THEN 'runon' END, result) AS result, needs_human AND h IS NULL AND NOT auto AS needs_human, CASE WHEN h IS NOT NULL THEN 'human' WHEN auto THEN 'auto' WHEN needs_human THEN 'open' ELSE 'agreed' END AS source FROM j""",
)
def l03(s, d):
    L = labelled(s, d)
    H = L.where("needs_human and seq % 5 = 0").select("seq", F.concat(F.lit("human_"), F.col("seq") % 3).alias("human_result"))
    lengths = read(s, d, "documents").select(F.col("doc_id").alias("seq"), F.col("n_chars").alias("response_length"))
    return D.apply_labels(L, H, lengths, 3000).select("seq", "human_result", "result", "needs_human", "source")


@query("l04_review_priority", "SELECT doc_id, doc_id % 3 = 0 OR doc_id % 4 = 0 OR (doc_id % 5 = 0 AND doc_id % 7 = 0) OR doc_id % 13 = 0 AS priority FROM documents")
def l04(s, d):
    i = F.col("doc_id")
    x = read(s, d, "documents").withColumn("text", F.concat("text", F.when(i % 3 != 0, " \\boxed{1}").otherwise(""), F.when(i % 5 == 0, " Answer: x").otherwise("")))
    a = F.when(i % 4 == 0, " ").when(i % 13 == 0, F.repeat(F.lit("x"), F.lit(61))).when(i % 7 == 0, F.repeat(F.lit("x"), F.lit(26))).otherwise("1")
    return x.withColumn("answer", a).select("doc_id", D.review_priority("text", "answer").alias("priority"))


@query("l05_nest_rollouts", f"WITH {EV8}, e AS (SELECT *, count(*) OVER (PARTITION BY problem_id, cluster_id) AS cs FROM e8) SELECT problem_id, count(*)::INT AS n, string_agg(rollout_idx || ':' || pred || ':' || cs, ',' ORDER BY rollout_idx) AS rollouts FROM e GROUP BY 1")
def l05(s, d):
    x = D.nest_rollouts(ev8(s, d))
    text = F.array_join(F.transform("rollouts", lambda r: F.concat_ws(":", r["rollout_idx"].cast("string"), r["pred"], r["cluster_size"].cast("string"))), ",")
    return x.select("problem_id", F.size("rollouts").alias("n"), text.alias("rollouts"))
