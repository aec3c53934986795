"""Queries of clusterings."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollspark.functions.repeats import repeats_in_a_row
from rollspark.operators import clusters as C
from rollspark.operators.objectives import with_cluster_size
from rollspark.tables import EV8, LI, ev8, li, read

from .metrics import rounded
from .registry import query

E8 = f"WITH {EV8}, e AS (SELECT *, count(*) OVER (PARTITION BY problem_id) AS size FROM e8)"


@query("c01_cluster_by_key", E8 + ", k AS (SELECT *, CASE WHEN pred <> 'error' THEN upper(pred) END AS k FROM e), r AS (SELECT *, dense_rank() OVER (PARTITION BY problem_id, k IS NULL ORDER BY k) - 1 AS r FROM k) SELECT problem_id, rollout_idx, CASE WHEN k IS NULL THEN -1 - rollout_idx ELSE r END::BIGINT AS cluster FROM r")
def c01(s, d):
    return C.cluster_by_key(ev8(s, d), F.upper("pred"), F.col("pred") != "error").select("problem_id", "rollout_idx", "cluster")


@query(
    "c02_cluster_by_equivalence",
    f"""WITH {LI}, k AS (SELECT DISTINCT problem_id, pred::INT AS q FROM li), g AS (SELECT *, CASE WHEN q - lag(q) OVER (PARTITION BY problem_id ORDER BY q) <= 3 THEN 0 ELSE 1 END AS b FROM k), i AS (SELECT *, sum(b) OVER (PARTITION BY problem_id ORDER BY q) AS i FROM g)
    SELECT problem_id, q, min(q) OVER (PARTITION BY problem_id, i) AS label FROM i""",
)
def c02(s, d):
    keys = li(s, d).select("problem_id", F.col("pred").cast("int").alias("q")).distinct()
    return C.cluster_by_equivalence(keys, "q", "abs(a - b) <= 3")


def methods(s, d):
    return ev8(s, d).select("problem_id", "rollout_idx", "reward", F.col("pred").alias("by_pred"), F.col("finish_reason").alias("by_finish"), F.substring("pred", 1, 1).alias("by_letter"))


METHODS = E8 + ", m AS (SELECT problem_id, rollout_idx, reward, pred AS by_pred, finish_reason AS by_finish, substr(pred, 1, 1) AS by_letter FROM e)"


@query(
    "c03_partition_agreement",
    METHODS + """, q AS (SELECT x.problem_id, bool_and((x.by_pred = y.by_pred) = (x.by_finish = y.by_finish)) AS s1, bool_and((x.by_pred = y.by_pred) = (x.by_letter = y.by_letter)) AS s2, bool_and((x.by_finish = y.by_finish) = (x.by_letter = y.by_letter)) AS s3 FROM m x JOIN m y USING (problem_id) GROUP BY 1)
    SELECT 'by_pred' AS a, 'by_finish' AS b, count(*) AS n_prompts, count(*) FILTER (s1) AS n_same, round(avg(s1::INT), 6) AS share FROM q UNION ALL SELECT 'by_pred', 'by_letter', count(*), count(*) FILTER (s2), round(avg(s2::INT), 6) FROM q UNION ALL SELECT 'by_finish', 'by_letter', count(*), count(*) FILTER (s3), round(avg(s3::INT), 6) FROM q""",
)
def c03(s, d):
    return rounded(C.partition_agreement(methods(s, d), ("by_pred", "by_finish", "by_letter")))


@query(
    "c04_cluster_by_features",
    """WITH f AS (SELECT conv_id, turn, contains(lower(text), 'mod ') OR contains(lower(text), 'modulo') OR contains(lower(text), 'remainder') OR contains(lower(text), 'congruent') AS m, contains(text, '```') AS c, regexp_full_match((turn * 1.5)::VARCHAR, '-?[0-9]+(\\.[0-9]+)?') AND turn % 2 = 0 AS p FROM conversations)
    SELECT conv_id AS problem_id, turn, (dense_rank() OVER (PARTITION BY conv_id ORDER BY c, m, p) - 1)::INT AS cluster FROM f""",
)
def c04(s, d):
    t = read(s, d, "conversations").withColumn("answer", F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).otherwise("x"))
    return C.cluster_by_features(t.withColumnRenamed("conv_id", "problem_id"), "text", "answer", features=("has_code_fence", "has_modular", "parsed_is_numeric")).select("problem_id", "turn", "cluster")


@query("c05_cluster_by_embedding")
def c05(s, d):
    e = read(s, d, "embeddings").withColumn("g", F.floor(F.col("vec_id") / 32))
    return C.cluster_by_embedding(e, "g", 0.7, "vec_id", "embedding")


@query("c05_threshold_sweep")
def c05s(s, d):
    """Groups of 128, five thresholds from one tree each."""
    e = read(s, d, "embeddings").withColumn("g", F.floor(F.col("vec_id") / 128))
    return C.embedding_sweep(e, "g", (0.3, 0.5, 0.7, 0.9, 1.1), "vec_id", "embedding")


@query("c04_repetition")
def c04r(s, d):
    """Whole texts with 30 characters or more three times in a row."""
    return read(s, d, "documents").select("doc_id", repeats_in_a_row("text").alias("repeats"))


@query(
    "c06_cosine_pairs",
    """WITH e AS (SELECT vec_id, vec_id // 16 AS g, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.g, a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON a.g = b.g AND a.vec_id < b.vec_id""",
)
def c06(s, d):
    e = read(s, d, "embeddings").withColumn("g", F.floor(F.col("vec_id") / 16))
    return rounded(C.cosine_pairs(e, "g", "vec_id", "embedding"))


def responses(s, d):
    """Recorded cluster answers: fenced, whole, short of a key, cut off or absent, by problem; n: the problem's rollouts."""
    entry = F.concat(F.lit('"'), (F.col("rollout_idx") + 1).cast("string"), F.lit('": {"cluster_id": '), F.when(F.col("cluster_id") < 0, 100).otherwise(F.col("cluster_id")).cast("string"), F.lit(', "chain_of_thought": "x"}'))
    k = F.col("problem_id") % 5
    there = F.when(~((k == 2) & (F.col("rollout_idx") == 0)), F.struct("rollout_idx", entry.alias("e")))
    g = ev8(s, d).groupBy("problem_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(there)), lambda x: x["e"]), ", ").alias("j"), F.count("*").cast("int").alias("n"))
    body = F.concat(F.lit("{"), "j", F.lit("}"))
    text = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 3, F.concat(F.lit("{"), "j")).when(k == 4, None).otherwise(body)
    return g.select("problem_id", text.alias("response"), "n")


@query("c07_parse_assignments", E8 + " SELECT problem_id, problem_id % 5 < 2 AS parse_ok, rollout_idx, cluster_id FROM e WHERE problem_id % 5 < 2 UNION ALL SELECT DISTINCT problem_id, false, NULL::INT, NULL::BIGINT FROM e WHERE problem_id % 5 >= 2")
def c07(s, d):
    return C.parse_assignments(responses(s, d), "n")


@query("c08_parse_lenient", E8 + " SELECT problem_id, rollout_idx, CASE WHEN problem_id % 5 IN (0, 1) OR (problem_id % 5 = 2 AND rollout_idx <> 0) THEN cluster_id ELSE -1 END AS cluster_id FROM e")
def c08(s, d):
    return C.parse_assignments_lenient(responses(s, d), "n")


@query(
    "c09_fill_degenerate",
    E8 + """, f AS (SELECT problem_id, CASE WHEN problem_id % 5 < 2 THEN cluster_id ELSE -1 END AS c FROM e), p AS (SELECT problem_id, count(DISTINCT c) AS d, count(*) FILTER (c = -1) AS deg FROM f GROUP BY 1)
    SELECT count(*) AS n_prompts, round(avg(d), 6) AS distinct_clusters_mean, sum(deg)::BIGINT AS degenerate_rollouts, round(avg((problem_id % 5 < 2)::INT), 6) AS parse_ok_rate, count(*) FILTER (problem_id % 7 = 0) AS overflow_skipped FROM (SELECT *, 1 FROM p) WHERE true""".replace("(problem_id % 5 < 2)::INT", "(problem_id % 5 < 2 AND problem_id % 7 <> 0)::INT").replace("CASE WHEN problem_id % 5 < 2 THEN", "CASE WHEN problem_id % 5 < 2 AND problem_id % 7 <> 0 THEN"),
)
def c09(s, d):
    parsed = C.parse_assignments(responses(s, d).where("problem_id % 7 <> 0"), "n")
    return rounded(C.fill_degenerate(ev8(s, d), parsed)[1])


@query(
    "c10_repeat_agreement",
    E8 + """, q AS (SELECT problem_id, problem_id % 5 < 2 AS ok, count(*) FILTER (cluster_id = -1) AS deg, count(*) AS n, bool_or(rollout_idx = 0 AND problem_id % 3 = 0 AND cluster_id <> 0) AS diff FROM e GROUP BY 1)
    SELECT count(*) AS n, round(avg(ok::INT), 6) AS both_parse, round(avg((ok AND NOT diff)::INT), 6) AS identical, sum(CASE WHEN ok THEN 2 * deg ELSE 0 END)::BIGINT - (SELECT count(*) FROM e WHERE problem_id % 5 < 2 AND problem_id % 3 = 0 AND rollout_idx = 0 AND cluster_id = -1) AS degenerate FROM q""",
)
def c10(s, d):
    a = C.parse_assignments(responses(s, d), "n")
    b = a.withColumn("cluster_id", F.when((F.col("problem_id") % 3 == 0) & (F.col("rollout_idx") == 0), 0).otherwise(F.col("cluster_id")))
    return rounded(C.repeat_agreement(a, b))


ARI = """c AS (SELECT problem_id, {a} AS a, {b} AS b, count(*) AS m FROM m GROUP BY ALL), s AS (SELECT problem_id, sum(m * (m - 1) / 2.0) AS ij, sum(m) AS n FROM c GROUP BY 1), x AS (SELECT problem_id, sum(k * (k - 1) / 2.0) AS i FROM (SELECT problem_id, a, sum(m) AS k FROM c GROUP BY ALL) GROUP BY 1), y AS (SELECT problem_id, sum(k * (k - 1) / 2.0) AS j FROM (SELECT problem_id, b, sum(m) AS k FROM c GROUP BY ALL) GROUP BY 1),
ari AS (SELECT problem_id, CASE WHEN n < 2 THEN 1 WHEN (i + j) / 2 = i * j / (n * (n - 1) / 2) THEN 1 ELSE (ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)) END AS ari FROM s JOIN x USING (problem_id) JOIN y USING (problem_id))"""
VM = """vc AS (SELECT problem_id, {a} AS a, {b} AS b, count(*) AS m FROM m GROUP BY ALL), vt AS (SELECT *, sum(m) OVER (PARTITION BY problem_id) AS n, sum(m) OVER (PARTITION BY problem_id, a) AS ma, sum(m) OVER (PARTITION BY problem_id, b) AS mb FROM vc),
vh AS (SELECT problem_id, -sum(m / n * ln(ma / n)) AS ha, -sum(m / n * ln(mb / n)) AS hb, -sum(m / n * ln(m / mb)) AS hab, -sum(m / n * ln(m / ma)) AS hba FROM vt GROUP BY 1), vp AS (SELECT problem_id, CASE WHEN ha <= 1e-12 THEN 1 ELSE 1 - hab / ha END AS homogeneity, CASE WHEN hb <= 1e-12 THEN 1 ELSE 1 - hba / hb END AS completeness FROM vh),
v AS (SELECT *, CASE WHEN homogeneity + completeness > 0 THEN 2 * homogeneity * completeness / (homogeneity + completeness) ELSE 0 END AS v FROM vp)"""


@query("c11_adjusted_rand", METHODS + ", " + ARI.format(a="by_pred", b="by_letter") + " SELECT problem_id, round(ari, 6) AS ari FROM ari")
def c11(s, d):
    return rounded(C.adjusted_rand(methods(s, d), "problem_id", "by_pred", "by_letter"))


@query("c12_v_measure", METHODS + ", " + VM.format(a="by_pred", b="by_finish") + " SELECT problem_id, round(homogeneity, 5) + 0 AS homogeneity, round(completeness, 5) + 0 AS completeness, round(v, 5) + 0 AS v FROM v")
def c12(s, d):
    return C.v_measure(methods(s, d), "problem_id", "by_pred", "by_finish").select("problem_id", *[(F.round(c, 5) + 0).alias(c) for c in ("homogeneity", "completeness", "v")])


CON = """ka AS (SELECT problem_id, {a} AS l, count(*) FILTER (reward > 0.5) AS r FROM m GROUP BY ALL), kb AS (SELECT problem_id, {b} AS l, count(*) FILTER (reward > 0.5) AS r FROM m GROUP BY ALL),
sa AS (SELECT problem_id, count(*) AS n, coalesce(min(r) FILTER (r > 0) < max(r), false) AS x FROM ka GROUP BY 1), sb AS (SELECT problem_id, count(*) AS n, coalesce(min(r) FILTER (r > 0) < max(r), false) AS x FROM kb GROUP BY 1),
con AS (SELECT count(*) AS n, avg(abs(sa.n - sb.n)) AS mean_diff, count(*) FILTER (sa.x AND sb.x) AS yes_yes, count(*) FILTER (sa.x AND NOT sb.x) AS yes_no, count(*) FILTER (sb.x AND NOT sa.x) AS no_yes, count(*) FILTER (NOT sa.x AND NOT sb.x) AS no_no FROM sa JOIN sb USING (problem_id))"""


@query("c13_concordance", METHODS + ", " + CON.format(a="by_pred", b="by_finish") + " SELECT n, round(mean_diff, 6) AS mean_diff, yes_yes, yes_no, no_yes, no_no FROM con")
def c13(s, d):
    return rounded(C.concordance(methods(s, d), "problem_id", "by_pred", "by_finish"))


@query("c14_cluster_size", E8 + " SELECT problem_id, rollout_idx, count(*) OVER (PARTITION BY problem_id, cluster_id) AS cluster_size FROM e")
def c14(s, d):
    return with_cluster_size(ev8(s, d)).select("problem_id", "rollout_idx", "cluster_size")


@query("c15_composition", E8 + ", k AS (SELECT problem_id, cluster_id, count(*) AS s, count(*) FILTER (reward > 0.5) AS r FROM e GROUP BY ALL) SELECT problem_id, string_agg(s, '-' ORDER BY s DESC) AS sizes, coalesce(string_agg(r, '-' ORDER BY r DESC) FILTER (r > 0), '') AS correct_sizes FROM k GROUP BY 1")
def c15(s, d):
    return C.composition(ev8(s, d)).select("problem_id", F.array_join("sizes", "-").alias("sizes"), F.array_join("correct_sizes", "-").alias("correct_sizes"))


@query("c15_stacked_order", E8 + ", k AS (SELECT *, count(*) OVER (PARTITION BY problem_id, cluster_id) AS s FROM e) SELECT problem_id, rollout_idx, (row_number() OVER (PARTITION BY problem_id ORDER BY s DESC, cluster_id, reward DESC, rollout_idx) - 1)::INT AS position FROM k")
def c15b(s, d):
    return C.stacked_order(ev8(s, d)).select("problem_id", "rollout_idx", "position")


def _board(b):
    return f"""(WITH {ARI.format(a='by_pred', b=b)}, {VM.format(a='by_pred', b=b)}, {CON.format(a='by_pred', b=b)}, z AS (SELECT avg(ari) AS g, 1.96 * stddev_samp(ari) / sqrt(count(*)) AS hw FROM ari)
    SELECT '{b}' AS labeling, round(g, 6) AS mean_ari, round(g - hw, 6) AS ari_low, round(g + hw, 6) AS ari_high, round((SELECT avg(v) FROM v), 6) AS mean_v, n, round(mean_diff, 6) AS mean_diff, yes_yes, yes_no, no_yes, no_no, round((yes_yes + no_no)::DOUBLE / n, 6) AS minority_accuracy FROM z, con)"""


@query("c16_labeling_leaderboard", METHODS + f" SELECT * FROM {_board('by_finish')} UNION ALL SELECT * FROM {_board('by_letter')}")
def c16(s, d):
    return rounded(C.labeling_leaderboard(methods(s, d), "by_pred", ("by_finish", "by_letter")))


@query("c17_worst_cases", METHODS + ", " + ARI.format(a="by_pred", b="by_finish") + " SELECT problem_id, 'by_finish' AS labelings, round(ari, 6) AS least_ari FROM ari ORDER BY ari, problem_id LIMIT 7")
def c17(s, d):
    return rounded(C.worst_cases(methods(s, d), "by_pred", ("by_finish",), 7))


@query(
    "c18_parse_failures",
    E8 + """, q AS (SELECT DISTINCT problem_id, CASE problem_id % 5 WHEN 2 THEN 'invalid' WHEN 3 THEN 'invalid' ELSE 'missing' END AS kind FROM e WHERE problem_id % 5 >= 2) SELECT kind, count(*) AS n FROM q GROUP BY 1""",
)
def c18(s, d):
    r = responses(s, d)
    ok = C.parse_assignments(r, "n").groupBy("problem_id").agg(F.max("parse_ok").alias("parse_ok"))
    return C.parse_failures(r.join(ok, "problem_id")).select("kind", "n")
