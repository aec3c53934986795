"""Queries of manifests and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.functions import text as T
from rollspark.operators import manifest as P
from rollspark.operators import sampling as A
from rollspark.operators.metrics import per_prompt
from rollspark.tables import EV, EV8, LI, MANIFEST, ev, ev8, li, manifest, read

from .metrics import rounded
from .registry import query

WITH = f"WITH {MANIFEST}"


@query("p01_first_nonblank", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE lang END), ''), nullif(trim(source), '')) AS v FROM documents")
def p01(s, d):
    x = read(s, d, "documents").withColumn("a", F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("lang")))
    return x.select("doc_id", T.first_nonblank("a", "source").alias("v"))


@query("p02_ground_truth", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars::VARCHAR ELSE lang END AS gold FROM documents")
def p02(s, d):
    stored = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("{'ground_truth': '"), "n_chars", F.lit("', 'style': 'rule'}"))).otherwise(F.concat(F.lit(" "), "lang"))
    return read(s, d, "documents").withColumn("stored", stored).select("doc_id", T.ground_truth("stored").alias("gold"))


DIRTY = WITH + ", dirty AS (SELECT problem_id, CASE WHEN problem_id % 13 = 0 THEN NULL WHEN problem_id % 17 = 0 THEN ' ' ELSE problem END AS problem, gold, difficulty_band FROM manifest), c AS (SELECT *, CASE WHEN problem IS NULL THEN 'non_string_problem' WHEN trim(problem) = '' THEN 'blank_problem' WHEN trim(gold) = '' THEN 'blank_gold' ELSE 'kept' END AS reason FROM dirty)"


def dirty(s, d):
    return manifest(s, d).withColumn("problem", F.when(F.col("problem_id") % 13 == 0, None).when(F.col("problem_id") % 17 == 0, " ").otherwise(F.col("problem")))


@query("p03_clean_reasons", DIRTY + " SELECT reason, count(*) AS n FROM c GROUP BY 1")
def p03(s, d):
    return P.clean_manifest(dirty(s, d))[1]


@query("p03_clean_bands", DIRTY + " SELECT difficulty_band, count(*) AS n FROM c WHERE reason = 'kept' GROUP BY 1")
def p03b(s, d):
    return P.clean_manifest(dirty(s, d))[2]


@query("p04_integer_gold", WITH + ", g AS (SELECT problem_id, CASE WHEN problem_id % 4 = 0 THEN '-1,234' WHEN problem_id % 4 = 1 THEN '3.5' ELSE gold END AS gold FROM manifest) SELECT problem_id, regexp_full_match(replace(trim(gold), ',', ''), '-?[0-9]+') AS is_integer FROM g")
def p04(s, d):
    m = manifest(s, d).withColumn("gold", F.when(F.col("problem_id") % 4 == 0, "-1,234").when(F.col("problem_id") % 4 == 1, "3.5").otherwise(F.col("gold")))
    return m.select("problem_id", T.is_integer_gold("gold").alias("is_integer"))


@query(
    "p05_last_sentence",
    "SELECT doc_id, coalesce(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(10), 'g'), '\\n+'), lambda p: trim(p)), lambda p: p <> '')[-1], '') AS last FROM documents",
)
def p05(s, d):
    return read(s, d, "documents").select("doc_id", T.last_sentence("text").alias("last"))


FLAG = WITH + """, f AS (SELECT *, regexp_matches(problem, '(?i)\\bProve it\\.$') AS last_starts_prove, regexp_matches(problem, 'Prove it\\.$') AS last_contains_prove, regexp_matches(problem, '(?i)show that') AS contains_show_that, gold <> '' AND contains(lower(problem), lower(gold)) AS gold_in_prompt FROM manifest),
r AS (SELECT *, CASE WHEN last_starts_prove THEN 'last_starts_prove' WHEN gold_in_prompt AND (contains(lower(problem), 'prove') OR contains_show_that) THEN 'gold_leak' END AS drop_reason FROM f)"""


@query("p06_prompt_flags", FLAG + " SELECT problem_id, last_starts_prove, last_contains_prove, contains_show_that, gold_in_prompt FROM f")
def p06(s, d):
    return P.flagged(manifest(s, d)).select("problem_id", *P.FLAGS)


@query("p07_train_filter", FLAG + " SELECT problem_id, drop_reason FROM r")
def p07(s, d):
    return P.train_filter(manifest(s, d)).select("problem_id", "drop_reason")


@query(
    "p08_flag_summary",
    FLAG + " , u AS (UNPIVOT (SELECT last_starts_prove, last_contains_prove, contains_show_that, gold_in_prompt, last_starts_prove OR last_contains_prove OR contains_show_that OR gold_in_prompt AS \"any\", last_starts_prove AND last_contains_prove AND contains_show_that AND gold_in_prompt AS \"all\" FROM f) ON COLUMNS(*) INTO NAME flag VALUE v) SELECT flag, count(*) FILTER (v) AS n, round(100.0 * count(*) FILTER (v) / count(*), 6) AS pct FROM u GROUP BY 1",
)
def p08(s, d):
    return rounded(P.flag_summary(P.flagged(manifest(s, d))))


@query("p08_top_combos", FLAG + ", k AS (SELECT concat_ws('+', CASE WHEN last_starts_prove THEN 'last_starts_prove' END, CASE WHEN last_contains_prove THEN 'last_contains_prove' END, CASE WHEN contains_show_that THEN 'contains_show_that' END, CASE WHEN gold_in_prompt THEN 'gold_in_prompt' END) AS combo FROM f) SELECT combo, count(*) AS n FROM k GROUP BY 1 ORDER BY n DESC, combo LIMIT 12")
def p08b(s, d):
    return P.top_combos(P.flagged(manifest(s, d)), 12)


RATE = f"WITH {MANIFEST}, {LI}, p AS (SELECT problem_id, count(*) AS n_rollouts, avg((reward > 0.5)::INT) AS pass_rate FROM li GROUP BY 1), j AS (SELECT m.*, n_rollouts, pass_rate FROM manifest m LEFT JOIN p USING (problem_id))"


@query("p09_pass_rate_filter", RATE + " SELECT problem_id, n_rollouts, round(pass_rate, 6) AS pass_rate, CASE WHEN n_rollouts IS NULL THEN 'no_rollouts' WHEN n_rollouts < 3 THEN 'too_few' WHEN pass_rate <= 0 THEN 'too_hard' WHEN pass_rate >= 0.6 THEN 'too_easy' END AS drop_reason FROM j")
def p09(s, d):
    return rounded(P.filter_by_pass_rate(manifest(s, d), li(s, d), 0.0, 0.6, 3).select("problem_id", "n_rollouts", "pass_rate", "drop_reason"))


@query("p10_training_record", WITH + " SELECT problem_id::VARCHAR AS id, 'user' AS role, problem || chr(10) || 'Please reason step by step, and put your final answer within \\boxed{}.' AS content, 'orders' AS data_source, gold AS ground_truth, 'rule' AS style FROM manifest")
def p10(s, d):
    r = P.to_training_record(manifest(s, d), "orders")
    return r.select(F.col("extra_info.problem_id").alias("id"), F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "data_source", "reward_model.ground_truth", "reward_model.style")


@query("p11_format_prompt", WITH + " SELECT problem_id, problem || ' Let''s think step by step and output the final answer within \\boxed{}.' AS math, length(problem) + 240 AS n_dapo FROM manifest")
def p11(s, d):
    return manifest(s, d).select("problem_id", T.format_prompt("problem", "verl_math_boxed").alias("math"), F.length(T.format_prompt("problem", "dapo_answer_v1")).alias("n_dapo"))


@query("p12_extract_problem", WITH + " SELECT problem_id, problem AS extracted FROM manifest")
def p12(s, d):
    m = manifest(s, d).withColumn("chat", F.concat(F.lit("<|im_start|>system\nx\n<|im_end|>\n<|im_start|>user\n"), T.format_prompt("problem", "verl_polaris_maxrl"), F.lit("\n<|im_end|>\n<|im_start|>assistant\n")))
    return m.select("problem_id", T.extract_problem("chat").alias("extracted"))


@query("p13_rewrite_tokens", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '\\\\arcsin(' || doc_id || ') + \\\\sqrt{2}' ELSE 'sqrt(' || doc_id || ')' END AS v FROM documents".replace("\\\\\\\\", "\\\\"))
def p13(s, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" np.arcsin("), "doc_id", F.lit(") + np.sqrt{2}"))).otherwise(F.concat(F.lit("sqrt("), "doc_id", F.lit(")")))
    return read(s, d, "documents").withColumn("raw", raw).select("doc_id", T.rewrite_tokens("raw").alias("v"))


@query("p14_slice_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 60")
def p14(s, d):
    return P.slice_rows(read(s, d, "orders").select("o_orderkey"), "o_orderkey", 60, 100)


@query(
    "p15_check_manifest",
    WITH + """, o AS (SELECT * FROM manifest WHERE problem_id % 3 <> 0 AND difficulty_band <> 5), a AS (SELECT count(*) AS n, count(*) - count(DISTINCT problem_id) AS repeated_ids, max(problem_id) - min(problem_id) + 1 - count(DISTINCT problem_id) AS id_gaps, count(*) FILTER (trim(gold) = '') AS blank_golds FROM o),
    b AS (SELECT coalesce(x.difficulty_band, y.difficulty_band) AS b, coalesce(x.n, 0) AS n, coalesce(y.n, 0) AS m FROM (SELECT difficulty_band, count(*) AS n FROM o GROUP BY 1) x FULL JOIN (SELECT difficulty_band, count(*) AS n FROM manifest GROUP BY 1) y USING (difficulty_band))
    SELECT a.*, (SELECT count(*) FROM b WHERE n = 0 AND m > 0) AS missing_bands, (SELECT count(*) FROM b WHERE abs(n::DOUBLE / (SELECT sum(n) FROM b) - m::DOUBLE / (SELECT sum(m) FROM b)) > 0.01) AS bands_off FROM a""",
)
def p15(s, d):
    m = manifest(s, d)
    return P.check_manifest(m.where("problem_id % 3 <> 0 and difficulty_band <> 5"), m)


@query("p16_check_group_size", f"WITH {LI} SELECT problem_id, count(*) AS n_rollouts, count(DISTINCT rollout_idx) AS n_indices FROM li GROUP BY 1 HAVING count(*) <> 4")
def p16(s, d):
    return P.check_group_size(li(s, d), 4)


@query(
    "p17_assemble",
    "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, substr(text, 1, 100) AS t FROM conversations) SELECT conv_id AS problem_id, count(*)::INT AS n_responses, string_agg(i || '. ' || t, chr(10) ORDER BY turn) AS block, length(string_agg(i || '. ' || t, chr(10) ORDER BY turn)) > 400 AS over_budget FROM r GROUP BY 1 HAVING count(*) >= 2",
)
def p17(s, d):
    R = read(s, d, "conversations").select(F.col("conv_id").alias("problem_id"), F.col("turn").alias("rollout_idx"), "text", F.lit(1.0).alias("reward"))
    return P.assemble(R, "text", 100, 400, least=2)


# --- samples ---


@query("a01_sample_n", WITH + " SELECT problem_id FROM manifest ORDER BY md5('42|' || problem_id), problem_id LIMIT 100")
def a01(s, d):
    return A.sample_n(manifest(s, d).select("problem_id"), 100, 42)


@query("a02_split_overlap", WITH + ", r AS (SELECT problem_id, row_number() OVER (ORDER BY md5('42|' || problem_id), problem_id) AS i FROM manifest) SELECT problem_id, i <= 100 AS is_val FROM r")
def a02(s, d):
    return A.split_overlap(manifest(s, d).select("problem_id"), 100, 42)


QUOTA = WITH + """, c AS (SELECT difficulty_band, count(*) AS n FROM manifest GROUP BY 1), e AS (SELECT *, n * 101::DOUBLE / sum(n) OVER () AS x FROM c), f AS (SELECT *, floor(x)::BIGINT AS base, round(x - floor(x), 9) AS frac FROM e),
g AS (SELECT *, 101 - sum(base) OVER () AS lft, row_number() OVER (ORDER BY frac DESC, difficulty_band) AS i FROM f), q AS (SELECT difficulty_band, n, (base + CASE WHEN i <= lft AND frac > 0 THEN 1 ELSE 0 END)::BIGINT AS quota FROM g)"""


@query("a03_hamilton_quotas", QUOTA + ' SELECT difficulty_band, n AS "count", quota FROM q')
def a03(s, d):
    return A.hamilton_quotas(manifest(s, d).groupBy("difficulty_band").agg(F.count("*").alias("count")), 101)


@query("a04_stratified_sample", QUOTA + ", s AS (SELECT *, coalesce(sum(quota) OVER (ORDER BY difficulty_band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM q), r AS (SELECT problem_id, difficulty_band, row_number() OVER (PARTITION BY difficulty_band ORDER BY md5('7|' || problem_id), problem_id) AS i FROM manifest) SELECT problem_id, difficulty_band, (st + i - 1)::BIGINT AS new_id FROM r JOIN s USING (difficulty_band) WHERE i <= quota")
def a04(s, d):
    return A.stratified_sample(manifest(s, d).select("problem_id", "difficulty_band"), 101, 7)


@query("a05_sample_per_band", WITH + ", r AS (SELECT problem_id, difficulty_band, row_number() OVER (PARTITION BY difficulty_band ORDER BY md5('7|' || problem_id), problem_id) AS i FROM manifest) SELECT problem_id, difficulty_band FROM r WHERE i <= 9")
def a05(s, d):
    return A.sample_per_band(manifest(s, d).select("problem_id", "difficulty_band"), 9, 7)


@query(
    "a06_proportional_sample",
    """WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT *, n * 77::DOUBLE / sum(n) OVER () AS x FROM c), f AS (SELECT *, floor(x) AS base, round(x - floor(x), 9) AS frac FROM e),
    g AS (SELECT *, 77 - sum(base) OVER () AS lft, row_number() OVER (ORDER BY frac DESC, o_orderpriority, o_orderstatus) AS i FROM f), q AS (SELECT o_orderpriority, o_orderstatus, base + CASE WHEN i <= lft AND frac > 0 THEN 1 ELSE 0 END AS quota FROM g),
    r AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5('5|' || o_orderkey), o_orderkey) AS i FROM orders)
    SELECT o_orderkey, o_orderpriority, o_orderstatus FROM r JOIN q USING (o_orderpriority, o_orderstatus) ORDER BY (i > quota)::INT, md5('5|' || o_orderkey), o_orderkey LIMIT 77""",
)
def a06(s, d):
    return A.proportional_sample(read(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), ("o_orderpriority", "o_orderstatus"), 77, 5, "o_orderkey")


@query("a07_rollout_seed", f"WITH {EV} SELECT problem_id, rollout_idx, 1000 + problem_id * 8 + rollout_idx AS seed FROM ev")
def a07(s, d):
    return ev(s, d).select("problem_id", "rollout_idx", A.rollout_seed(1000, 8).alias("seed"))


@query("a08_hash_bucket", f"WITH {EV} SELECT problem_id, rollout_idx, (('0x' || substr(md5('9|' || problem_id || '|' || rollout_idx), 1, 8))::BIGINT % 5)::BIGINT AS bucket FROM ev")
def a08(s, d):
    return ev(s, d).select("problem_id", "rollout_idx", A.hash_bucket(9, 5, "problem_id", "rollout_idx").alias("bucket"))


@query("a09_pack_by_budget")
def a09(s, d):
    return A.pack_by_budget(ev(s, d).select("problem_id", "rollout_idx", "response_length"), "response_length", 200, "problem_id", "rollout_idx")


@query(
    "a10_build_chunks",
    f"""WITH {EV}, p AS (SELECT problem_id, bool_or(value > 300) AS pri FROM ev GROUP BY 1), c AS (SELECT problem_id, pri, ((row_number() OVER (ORDER BY pri DESC, problem_id) - 1) // 10)::BIGINT AS chunk FROM p)
    SELECT problem_id, rollout_idx, chunk, pri AS priority, row_number() OVER (PARTITION BY chunk ORDER BY pri DESC, problem_id, rollout_idx)::INT AS id, right(pred || '-' || finish_reason, 6) AS tail FROM ev JOIN c USING (problem_id)""",
)
def a10(s, d):
    R = ev(s, d).withColumn("text", F.concat_ws("-", "pred", "finish_reason"))
    return A.build_chunks(R, F.col("value") > 300, 10, 6, "text")


@query("a11_exemplars", f"WITH {EV}, r AS (SELECT pred, problem_id, rollout_idx, value, row_number() OVER (PARTITION BY pred ORDER BY value DESC, problem_id, rollout_idx) AS i FROM ev) SELECT pred, problem_id, rollout_idx, value FROM r WHERE i <= 3")
def a11(s, d):
    return A.exemplars(ev(s, d), ("pred",), (F.desc("value"), "problem_id", "rollout_idx"), 3).select("pred", "problem_id", "rollout_idx", "value")


@query(
    "a12_handcheck",
    f"""WITH {EV8}, p AS (SELECT problem_id, count(*) FILTER (value > 60) AS c FROM e8 GROUP BY 1), s AS (SELECT *, CASE WHEN c BETWEEN 5 AND 7 THEN 'high' WHEN c BETWEEN 1 AND 4 THEN 'mixed' WHEN c = 0 THEN 'none' END AS stratum FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('11|' || problem_id), problem_id) AS i FROM s WHERE stratum IS NOT NULL) SELECT problem_id, c, stratum FROM r WHERE i <= CASE stratum WHEN 'none' THEN 4 ELSE 3 END""",
)
def a12(s, d):
    R = ev8(s, d).withColumn("reward", (F.col("value") > 60).cast("double"))
    return A.handcheck(per_prompt(R).select("problem_id", "c"), {"high": 3, "mixed": 3, "none": 4}, 11)
