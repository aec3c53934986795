"""Literal cases, properties and invariance of the rollout operators."""

import itertools
import math
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rollspark.functions import answers as A
from rollspark.functions import text as T
from rollspark.functions.repeats import has_triple
from rollspark.operators import clusters as C
from rollspark.operators import decisions as D
from rollspark.operators import extract as X
from rollspark.operators import joins as J
from rollspark.operators import manifest as P
from rollspark.operators import metrics as M
from rollspark.operators import objectives as G
from rollspark.operators import sampling as S
from rollspark.operators import series as W
from rollspark.operators import text as N
from rollspark.operators.order import exact_quantiles, with_quantiles
from rollspark.plans import catalog
from rollspark.sources import files

R_SCHEMA = "problem_id long, rollout_idx int, reward double, cluster_id long, pred string"


def rollouts(spark, rewards, clusters=None, preds=None):
    rows = []
    for p, rs in enumerate(rewards):
        for i, r in enumerate(rs):
            rows.append((p, i, float(r), clusters[p][i] if clusters else 0, preds[p][i] if preds else "x"))
    return spark.createDataFrame(rows, R_SCHEMA)


def one(df):
    return df.first().asDict()


def test_pass_at_k_edges(spark):
    got = {r.k: r.pass_at_k for r in M.pass_at_k(rollouts(spark, [[0] * 8]), (8,)).collect()}
    assert got == {8: 0.0}
    assert M.pass_at_k(rollouts(spark, [[1] + [0] * 7]), (8,)).first().pass_at_k > 0.99
    assert M.pass_at_k(rollouts(spark, [[1, 0]]), (4,)).count() == 0


def test_pass_at_k_equals_subset_count(spark):
    rewards = [[1, 0, 1, 0, 0], [0, 0, 0, 1, 0]]
    for k in (1, 2, 3):
        want = np.mean([np.mean([max(s) for s in itertools.combinations(r, k)]) for r in rewards])
        assert M.pass_at_k(rollouts(spark, rewards), (k,)).first().pass_at_k == pytest.approx(want)


def test_expected_distinct_at_n_is_distinct(spark):
    R = rollouts(spark, [[1, 1, 1, 0]], preds=[["a", "b", "a", "c"]])
    assert M.expected_distinct(R, "pred", (4,)).first().expected == pytest.approx(2)
    assert M.coverage_first_k(R, (4,)).first().coverage == pytest.approx(2)


def test_histogram_and_mixed(spark):
    R = rollouts(spark, [[0] * 8, [1] * 8, [1] + [0] * 7])
    h = {r.n_correct: r.share for r in M.correct_hist(R, 8).collect()}
    assert h[0] == h[1] == h[8] == pytest.approx(1 / 3) and sum(h.values()) == pytest.approx(1)
    m = one(M.mixed_rates(rollouts(spark, [[1, 0, 0, 0], [0] * 4, [1, 1, 0, 0]])))
    assert m["mixed"] == pytest.approx(2 / 3)
    assert one(M.any_correct(rollouts(spark, [[1, 0, 0, 0], [0] * 4, [1, 1, 0, 0]])))["any_correct"] == pytest.approx(2 / 3)


def test_percentile_floor_rule(spark):
    df = spark.createDataFrame([(100,), (200,)], "n int")
    assert M.percentiles_nearest(df, "n", (0.95,), "floor").first().value == 100


def test_clean_manifest(spark):
    rows = [(1, "p", "1", 1, 1), (2, " ", "1", 1, 2), (3, "p", " ", 1, 3), (4, None, "1", 1, 4), (5, "p", "1/2", 2, 5), (6, "p", "  32.5 ", 2, 6)]
    kept, stats, bands = P.clean_manifest(spark.createDataFrame(rows, "problem_id long, problem string, gold string, difficulty_band int, hf_index long"))
    assert kept.count() == 3 and kept.orderBy("problem_id").collect()[-1].gold == "32.5"
    assert {r.reason: r.n for r in stats.collect()} == {"kept": 3, "blank_problem": 1, "blank_gold": 1, "non_string_problem": 1}
    assert {r.difficulty_band: r.n for r in bands.collect()} == {1: 1, 2: 2}


def test_quota_tie_goes_to_the_lower_band(spark):
    q = S.hamilton_quotas(spark.createDataFrame([(1, 10), (2, 10)], "difficulty_band int, count long"), 3)
    assert {r.difficulty_band: r.quota for r in q.collect()} == {1: 2, 2: 1}


def test_stratified_sample(spark):
    df = spark.range(160).select(F.col("id").alias("problem_id"), (F.col("id") % 8).cast("int").alias("difficulty_band"))
    a = sorted(map(tuple, S.stratified_sample(df, 40, 3).select("new_id", "difficulty_band", "problem_id").collect()))
    b = sorted(map(tuple, S.stratified_sample(df.repartition(7), 40, 3).select("new_id", "difficulty_band", "problem_id").collect()))
    assert a == b and [x[0] for x in a] == list(range(40)) and [x[1] for x in a] == [i // 5 for i in range(40)]


def test_sample_fails_when_short(spark):
    with pytest.raises(ValueError):
        S.sample_n(spark.range(3).select(F.col("id").alias("problem_id")), 5, 1, check=True)


def keys(spark, f, texts):
    return [r.k for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t")).alias("k")).collect()]


def test_canonical_keys(spark):
    assert set(keys(spark, A.canonical_key, ["36", "\\(36\\)", "$36$", "36.", "\\boxed{36}"])) == {"36"}
    assert keys(spark, A.canonical_key, ["1,234", "60.0", "3160.0000000000002", "  Hello ", None]) == ["1234", "60", "3160", "hello", ""]
    assert keys(spark, A.canonical_key_clean, ["\\frac{1}{2}", "50\\%", "202 mod 7", "3.19", None]) == ["1/2", "50", "202", "3.19", ""]


def test_clusters_of_failed_parses_are_their_own(spark):
    R = spark.createDataFrame([(1, 0, None, False), (1, 1, None, False), (1, 2, "5", True)], "problem_id long, rollout_idx int, a string, ok boolean")
    ids = [r.cluster for r in C.cluster_by_key(R, F.col("a"), F.col("ok")).orderBy("rollout_idx").collect()]
    assert ids[0] < 0 and ids[1] < 0 and ids[0] != ids[1] and ids[2] >= 0


def brute_marginals(rewards, clusters, n=8, m=4):
    subs = list(itertools.combinations(range(n), m))

    def f(s):
        count = {}
        for i in s:
            count.setdefault(clusters[i], []).append(rewards[i])
        low = min(map(len, count.values()))
        rare = [v for v in count.values() if len(v) == low]
        return sum(map(sum, rare)) / sum(map(len, rare))

    fs = [f(s) for s in subs]
    mean = np.mean(fs)
    return [np.mean([v for s, v in zip(subs, fs) if i in s]) - mean for i in range(n)]


def test_marginal_advantages(spark):
    cases = [([1] + [0] * 7, [1] + [0] * 7), ([1, 1, 1, 0, 0, 0, 0, 0], [0, 0, 1, 1, 2, 2, 3, 3])]
    R = rollouts(spark, [c[0] for c in cases], [c[1] for c in cases])
    got = G.marginal_advantage(G.subset_score(R, "rarest")).orderBy("problem_id", "rollout_idx").collect()
    for p, (r, c) in enumerate(cases):
        own = [x.advantage for x in got if x.problem_id == p]
        assert own == pytest.approx(brute_marginals(r, c)) and sum(own) == pytest.approx(0) and all(x.keep for x in got if x.problem_id == p)
    first = [x.advantage for x in got if x.problem_id == 0]
    assert first[0] > 0 and all(x < 0 for x in first[1:])


def test_collapsed_groups_are_filtered(spark):
    A_ = G.marginal_advantage(G.subset_score(rollouts(spark, [[1] * 8], [[0] * 8]), "rarest"))
    assert all(r.advantage == 0 and not r.keep for r in A_.collect())


def plain_scores(rows, n, m):
    """Scores of each subset of (cluster, reward) by kind, as SQL's aggregates give them."""
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    for s in itertools.combinations(range(n), m):
        part = [rows[i] for i in s]
        sizes = {c: sum(x == c for x, _ in part) for c, _ in part}
        rare = [(c, r) for c, r in part if sizes[c] == min(sizes.values())]
        rewards = [r for _, r in part if r is not None]
        got = [r for _, r in rare if r is not None]
        poly = None if not rewards else mean(rewards) * len({c for c in sizes if c not in (None, -1)}) / m
        yield sum(1 << i for i in s), {"rarest": sum(got) / len(rare) if got else None, "poly": poly, "worst": min(rewards, default=None)}


def test_subset_scores_and_marginals_with_nulls(spark):
    rng = random.Random(3)
    groups = [[(rng.choice([None, -1, 0, 1, 2]), rng.choice([None, 0.0, 1.0, 0.25])) for _ in range(6)] for _ in range(12)]
    full = [(p, i, r, c, "x") for p, g in enumerate(groups) for i, (c, r) in enumerate(g)]
    R = spark.createDataFrame(full + [(99, i, 1.0, 0, "x") for i in (0, 1, 2, 3, 5)], R_SCHEMA)
    for kind in ("rarest", "poly", "worst"):
        S = G.subset_score(R, kind, 6, 3)
        want = {(p, b): f[kind] for p, g in enumerate(groups) for b, f in plain_scores(g, 6, 3)}
        assert {(r.problem_id, r.subset): r.f for r in S.collect()} == pytest.approx(want, nan_ok=True)
        got = {(r.problem_id, r.rollout_idx): (r.advantage, r.keep) for r in G.marginal_advantage(S, 6, 3).collect()}
        assert len(got) == 72
        for p in range(12):
            fs = {b: want[p, b] for q, b in want if q == p and want[p, b] is not None}
            for i in range(6):
                own = [f for b, f in fs.items() if b >> i & 1]
                keep = min(fs.values()) < max(fs.values())
                assert got[p, i] == ((pytest.approx(np.mean(own) - np.mean(list(fs.values()))) if own else None) if keep else 0.0, keep)


def test_subset_scores_shuffle_rollouts_only(spark):
    # Not a row per rollout and subset: one exchange by problem, and no table of subsets in a task's memory.
    A_ = G.marginal_advantage(G.subset_score(rollouts(spark, [[1, 0] * 4]), "rarest"))
    plan = A_._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and plan.count("Generate explode") == 1


def test_score_of_arrays(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def best(reward: pd.Series, pred: pd.Series) -> pd.Series:
        calls.add(1)
        return pd.Series([max(r) + len(set(p)) for r, p in zip(reward, pred, strict=True)])

    R = rollouts(spark, [[i % 3 for i in range(8)]] * 50, preds=[["a", "b", "a", "c", "a", "b", "d", "a"]] * 50)
    S = G.subset_score(R, G.ScoreOfArrays(best, ("reward", "pred")))
    want = {(r.problem_id, r.subset): r.f for r in G.subset_score(R, F.max("reward") + F.count_distinct("pred")).collect()}
    assert {(r.problem_id, r.subset): r.f for r in S.collect()} == want and len(want) == 3500
    assert calls.value <= 16  # a call scores a batch of subsets, not one


def test_poly_leaves_degenerate_out(spark):
    R = rollouts(spark, [[1] * 4], [[-1, 0, 1, 2]])
    f = lambda drop: G.subset_score(R, "poly", 4, 4, drop_degenerate=drop).first().f
    assert f(True) == pytest.approx(0.75) and f(False) == pytest.approx(1.0)


def test_grpo_sums_to_zero(spark):
    rng = random.Random(1)
    R = rollouts(spark, [[rng.random() for _ in range(5)] for _ in range(4)])
    assert all(abs(r.s) < 1e-9 for r in G.grpo_advantage(R).groupBy("problem_id").agg(F.sum("advantage").alias("s")).collect())


def test_extraction(spark):
    texts = ["so \\boxed{\\frac{1}{2}} ok", "Answer: 7", "Answer: \\boxed{3}", "\\boxed{open", "word " * 30, "", None, "x \\boxed{2} \\boxed{3"]
    R = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, completion string")
    ranked = [(r.extract_path, r.parsed_answer) for r in X.extract_ranked(R).orderBy("i").collect()]
    assert ranked[:4] == [("boxed", "\\frac{1}{2}"), ("answer_line", "7"), ("hybrid", "3"), ("none", None)]
    clean = [(r.extract_path, r.parsed_answer) for r in X.extract_clean(R).orderBy("i").collect()]
    assert clean[0] == ("boxed_balanced", "\\frac{1}{2}") and clean[1] == ("answer_line", "7") and clean[4] == ("runon_rejected", "") and clean[5] == clean[6] == ("empty", "") and clean[7] == ("boxed_balanced", "2")
    flags = [(r.truncated_box, r.nested_mismatch) for r in X.marker_flags(R).orderBy("i").collect()]
    assert flags[3] == (True, False) and flags[0] == (False, True)
    tail = [r.b for r in R.orderBy("i").select(A.extract_boxed("completion", "tail").alias("b")).collect()]
    assert tail[3] == "open" and tail[0] == "\\frac{1}{2}" and tail[1] is None


def test_prompt_flags(spark):
    rows = [("Prove that x. Prove it now.", "q"), ("You can show  that 5 holds.", "5"), ("Find it.\nImprove", ""), ("", None)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "problem string, gold string").select(*[c.alias(n) for n, c in T.prompt_flags("problem", "gold").items()]).collect()]
    assert got == [(True, True, False, False), (False, False, True, True), (False, True, False, False), (False, False, False, False)]


def test_parse_assignments(spark):
    good = '{"1": {"cluster_id": 0}, "2": {"cluster_id": 100}}'
    rows = [(0, good), (1, f"```json\n{good}\n```"), (2, '{"1": {"cluster_id": 0}}'), (3, "no"), (4, None)]
    df = spark.createDataFrame(rows, "problem_id long, response string")
    got = {}
    for r in C.parse_assignments(df, 2).collect():
        got.setdefault((r.problem_id, r.parse_ok), {})[r.rollout_idx] = r.cluster_id
    assert got[(0, True)] == got[(1, True)] == {0: 0, 1: -1} and {k for k in got if not k[1]} == {(2, False), (3, False), (4, False)}
    lenient = {(r.problem_id, r.rollout_idx): r.cluster_id for r in C.parse_assignments_lenient(df, 2).collect()}
    assert lenient[(2, 0)] == 0 and lenient[(2, 1)] == -1 and lenient[(3, 0)] == -1 and lenient[(1, 0)] == 0


def plain_linkage(v, threshold):
    """Average linkage from the distance matrix, the two nearest clusters at a time."""
    d = [[1 - float(a @ b) for b in v] for a in v]
    parts = [[i] for i in range(len(v))]
    while len(parts) > 1:
        mean, i, j = min((np.mean([d[x][y] for x in a for y in b]), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts[:i]))
        if mean >= threshold:
            break
        parts[j] += parts.pop(i)
    names = {x: min(p) for p in parts for x in p}
    order = sorted(set(names.values()))
    return [order.index(names[i]) for i in range(len(v))]


def test_linkage_at_each_threshold():
    rng = np.random.default_rng(3)
    cuts = [0.05, 0.2, 0.5, 0.8, 1.0, 1.2, 2.5]
    for n in (1, 2, 3, 10, 40):
        v = rng.normal(0, 1, (n, 5)) + rng.integers(0, 3, (n, 1)) * 2
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        assert C.cut_tree(C.linkage_tree(v), n, cuts) == [plain_linkage(v, t) for t in cuts]
    same = np.tile([[1.0, 0.0]], (70, 1))
    assert C.cut_tree(C.linkage_tree(same), 70, [0.1]) == [[0] * 70]


def test_embedding_sweep(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, [float(x) for x in rng.normal(0, 1, 4)]) for g in range(3) for i in range(90)] + [(7, 1, None), (7, 2, [1.0, 0.0, 0.0, 0.0]), (7, 3, [2.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "g int, k int, v array<double>")
    got = {(r.g, r.k, r.threshold): r.cluster for r in C.embedding_sweep(df, "g", (0.6, 0.2), "k", "v").collect()}
    assert len(got) == 2 * len(rows) and [got[7, k, 0.2] for k in (1, 2, 3)] == [0, 1, 1]
    unit = [np.array(v) / np.linalg.norm(v) for g, _, v in rows if g == 1]
    for t in (0.2, 0.6):
        assert [got[1, k, t] for k in range(90)] == plain_linkage(unit, t)
    assert C.embedding_sweep(df.where("false"), "g", (0.5,), "k", "v").count() == 0


def test_three_times_in_a_row():
    rng = random.Random(1)
    pattern, seen = re.compile(r"(.{30,}?)\1\1"), set()
    for _ in range(600):
        letters = rng.choice(["ab", "abc\n", "a", "abcdefgh é\U0001f642"])
        unit = "".join(rng.choice(letters.strip()) for _ in range(rng.randint(20, 45)))
        noise = "".join(rng.choice(letters) for _ in range(rng.randint(0, 200)))
        text = noise[:50] + (unit * 5)[: int(rng.choice([0, 1, 2, 2.9, 3, 3.1, 4]) * len(unit))] + noise[50:]
        seen.add(has_triple(text))
        assert has_triple(text) == bool(pattern.search(text))
    assert seen == {True, False} and not has_triple("")
    long_ = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    began = time.time()
    assert not has_triple(long_) and has_triple(long_ + "x" * 90) and time.time() - began < 30


def brute_bleu(texts):
    import re
    from collections import Counter

    toks = [re.findall(r"\w+|[^\w\s]", t.lower()) for t in texts]
    out = []
    for i, c in enumerate(toks):
        refs = [t for j, t in enumerate(toks) if j != i]
        lp = []
        for n in range(1, 5):
            g = lambda t: Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1))  # noqa: B023, E731
            own = g(c)
            if not own:
                lp = None
                break
            hit = sum(min(v, max(g(r)[k] for r in refs)) for k, v in own.items())
            lp.append(math.log((hit + 1e-9) / sum(own.values())))
        if lp is None:
            out.append(0.0)
            continue
        near = min((abs(len(r) - len(c)), len(r)) for r in refs)[1]
        out.append((1.0 if len(c) > near else math.exp(1 - near / len(c))) * math.exp(sum(lp) / 4))
    return sum(out) / len(out)


def test_self_bleu(spark):
    texts = ["the cat sat on the mat today", "the cat sat on a mat today ok", "a dog ran off with the cat", "hi"]
    R = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "problem_id long, rollout_idx int, text string")
    assert N.self_bleu(R, "text").first().self_bleu == pytest.approx(brute_bleu(texts))
    alone = R.where("rollout_idx = 0")
    assert N.self_bleu(alone, "text").count() == 0  # nothing to compare with


def test_self_bleu_of_many_rollouts(spark):
    words = "the a cat dog sat ran on off mat log".split()
    pick = random.Random(3)
    texts = [" ".join(pick.choice(words) for _ in range(pick.randint(1, 14))) for _ in range(60)]
    texts += texts[:9]  # the same text again and again
    R = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "problem_id long, rollout_idx int, text string").repartition(5)
    got = N.self_bleu(R, "text").first()
    assert (got.n_rollouts, got.self_bleu) == (69, pytest.approx(brute_bleu(texts)))
    assert N.self_bleu(R, "text", max_rollouts=16).first().self_bleu == pytest.approx(brute_bleu(texts[:16]))


def tasks_in(df):
    """Numbers of tasks that repartitions ask for."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [int(n) for n in re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan)]


def test_self_bleu_has_more_tasks_for_more_text(spark, monkeypatch):
    texts = [f"the cat sat on the mat {i % 7}" for i in range(40)]
    R = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate([*texts, None])], "problem_id long, rollout_idx int, text string")
    before = {r.problem_id: (r.n_rollouts, r.self_bleu) for r in N.self_bleu(R, "text").collect()}
    assert set(tasks_in(N.self_bleu(R, "text"))) == {spark.sparkContext.defaultParallelism}
    monkeypatch.setattr(N, "CHARS_PER_TASK", 50)
    many = N.self_bleu(R, "text")
    # Texts (for their grams and their lengths) and grams are dealt out by the characters: 40 texts of 24.
    assert tasks_in(many) and set(tasks_in(many)) == {sum(map(len, texts)) // 50 + 1}
    after = {r.problem_id: (r.n_rollouts, r.self_bleu) for r in many.collect()}
    assert set(after) == set(before) and all(after[k] == (before[k][0], pytest.approx(before[k][1])) for k in after)
    assert N.self_bleu(R.where("text is null"), "text").count() == 0


def token_log(spark, rollouts=60):
    rows = [(i % 7, i, pos, -0.1 * (i % 5), -0.1 * (pos % 3), int(pos != 2)) for i in range(rollouts) for pos in range(i % 6)]
    return spark.createDataFrame(rows, "problem_id long, rollout_idx int, pos int, new_lp double, old_lp double, mask int"), rows


def test_scatter_has_more_tasks_for_more_tokens(spark, monkeypatch):
    L, rows = token_log(spark)
    A = spark.createDataFrame([(i % 7, i, i / 4) for i in range(60)], "problem_id long, rollout_idx int, advantage double")
    monkeypatch.setattr(N, "TOKENS_PER_TASK", 10)
    got = N.scatter_to_tokens(A, L)
    assert tasks_in(got) == [len(rows) // 10 + 1]
    assert sorted((r.problem_id, r.rollout_idx, r.pos, r.advantage) for r in got.collect()) == sorted((p, i, pos, i / 4 * mask) for p, i, pos, _, _, mask in rows)
    # Advantages that come from the log dealt out are summed after the shuffle only, and meet it without moving again.
    own = N.by_rollout(L).select("problem_id", "rollout_idx").distinct().withColumn("advantage", F.lit(1.0))
    plan = N.scatter_to_tokens(own, L)._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and plan.count("REPARTITION_BY_NUM") == 2
    assert N.scatter_to_tokens(A, L.where("false")).count() == 0


@pytest.mark.parametrize("norm", ["per_seq", "batch_max"])
def test_surrogate_has_more_tasks_for_more_tokens(spark, monkeypatch, norm):
    L, rows = token_log(spark)
    A = spark.createDataFrame([(i % 7, i, (i % 5 - 2) / 2, i % 4 > 0) for i in range(60)], "problem_id long, rollout_idx int, advantage double, keep boolean")
    monkeypatch.setattr(N, "TOKENS_PER_TASK", 10)
    got = N.surrogate(L, A, norm)
    assert tasks_in(got) == [len(rows) // 10 + 1]
    s, n = {}, {}
    for _, i, _, new, old, mask in rows:
        r, a = math.exp(new - old), (i % 5 - 2) / 2
        s[i], n[i] = s.get(i, 0) - min(r * a, min(max(r, 0.8), 1.2) * a) * mask, n.get(i, 0) + mask
    kept = [i for i in s if i % 4]
    longest = max(n.values())
    loss = sum(s[i] / (max(n[i], 1) if norm == "per_seq" else longest) for i in kept) / len(kept)
    assert (got.first().n_kept, got.first().loss) == (len(kept), pytest.approx(loss))


@pytest.mark.parametrize("norm", ["per_seq", "batch_max"])
def test_surrogate_query_is_dealt_by_its_rows(spark, monkeypatch, norm):
    run, sf_dir = catalog.queries()[f"n09_surrogate_{norm}"], "/root/testdata/sf0.001"
    before = run(spark, sf_dir).first()
    monkeypatch.setattr(N, "TOKENS_PER_TASK", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = run(spark, sf_dir)
        plan = got._jdf.queryExecution().executedPlan().toString()
        after = got.first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The log and its sequences' advantages are dealt out alike, whatever spark.sql.shuffle.partitions is; only the tasks' sums move again.
    tasks = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 100 + 1
    assert tasks_in(got) == [tasks, tasks]
    assert plan.count("REPARTITION_BY_NUM") == 2 and re.findall(r"Exchange (\w+).*ENSURE_REQUIREMENTS", plan) == ["SinglePartition"]
    assert (after.n_kept, after.loss) == (before.n_kept, pytest.approx(before.loss, abs=2e-6))


def test_bootstrap_is_deterministic(spark):
    pp = spark.createDataFrame([(i, i % 3 / 2) for i in range(30)], "problem_id long, acc double")
    a, b = (one(D.bootstrap_ci(x, F.avg("acc"), 100, 42)) for x in (pp, pp.repartition(5)))
    assert a == pytest.approx(b) and set(a) == {"point", "ci_low", "ci_high", "std"} and a["ci_low"] <= a["point"] <= a["ci_high"]
    w = D.poisson_replicates(pp, 50, 1).agg(F.sum("weight")).first()[0]
    assert 0.8 < w / (30 * 50) < 1.2


def test_pack_by_budget(spark):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([5, 4, 3, 2, 9])], "p int, i int, n int")
    packs = {}
    for r in S.pack_by_budget(df, "n", 7, "p", "i").collect():
        packs.setdefault(r.pack, []).append(r.n)
    assert sorted(map(sorted, packs.values())) == [[2, 5], [3, 4], [9]]


def test_rollouts_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    R = rollouts(spark, [[rng.randint(0, 1) for _ in range(8)] for _ in range(9)], [[rng.randint(-1, 3) for _ in range(8)] for _ in range(9)])
    seen = set()
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(map(tuple, M.rank_correctness(R.repartition(n)).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1


def test_latex_keys_of_short_texts(spark, tmp_path):
    import compare

    from rollspark.plans import catalog

    spark.range(6 * 3000).select(F.col("id").alias("doc_id"), F.expr("cast(id div 6 as int)").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare.differ(catalog.queries()["x09_latex_key"](spark, str(tmp_path)), con, catalog.oracle_sql()["x09_latex_key"]) is None
    half = spark.createDataFrame([(".5",)], "x string")
    assert half.select(A.latex_key(F.col("x"))).first()[0] == "\\frac{1}{2}" and half.select(A.latex_key(F.col("x"), halves=False)).first()[0] == "0.5"


def test_equivalence_closure(spark):
    R = spark.createDataFrame([(1, v) for v in (1, 3, 5, 9)] + [(2, 1)], "problem_id long, v int")
    got = {(r.problem_id, r.v): r.label for r in C.cluster_by_equivalence(R, "v", "abs(a - b) <= 2").collect()}
    assert got == {(1, 1): 1, (1, 3): 1, (1, 5): 1, (1, 9): 9, (2, 1): 1}


def test_equivalence_of_small_groups_needs_no_rounds(spark):
    rng = random.Random(8)
    groups = {p: rng.sample(range(300), n) for p, n in enumerate([1, 2, 3, 7, 20, 40, 64] * 4 + [65, 90])}
    R = spark.createDataFrame([(p, v) for p, vs in groups.items() for v in vs * 2] + [(0, None)], "problem_id long, v int")
    spark.udf.register("near_enough", lambda a, b: b - a in (1, 2, 50), "boolean")
    want = {}
    for p, vs in groups.items():
        for v in sorted(vs):  # linked from either side, whichever way the predicate says so
            seen, todo = {v}, [v]
            while todo:
                x = todo.pop()
                todo += (new := {y for y in vs if abs(y - x) in (1, 2, 50)} - seen)
                seen |= new
            want[p, v] = min(seen)
    for equal, small in (("b - a in (1, 2, 50)", True), ("near_enough(a, b)", False)):
        rounds = []
        got = C.cluster_by_equivalence(R.where("problem_id < 28") if small else R, "v", equal, rounds=rounds).where("v is not null").collect()
        assert {(r.problem_id, r.v): r.label for r in got} == {k: x for k, x in want.items() if not small or k[0] < 28}
        assert (len(rounds) > 0) == (not small)
    got = C.cluster_by_equivalence(R, "v", "b - a in (1, 2, 50)").where("v is not null").collect()
    assert {(r.problem_id, r.v): r.label for r in got} == want


def test_closure_of_a_long_chain(spark):
    # In the order of the keys, and in none: 1009 and 3001 have no common factor with 10 000.
    for step in (1, 3001):
        chain = spark.range(2000).select(F.lit(1).alias("problem_id"), (F.col("id") * step % 2000).alias("v"))
        near = f"pmod((a - b) * {pow(step, -1, 2000)}L, 2000) = 1 and pmod(a * {pow(step, -1, 2000)}L, 2000) <> 0"
        rounds = []
        got = C.cluster_by_equivalence(chain, "v", near, rounds=rounds).agg(F.min("label"), F.max("label"), F.count("*")).first()
        assert tuple(got) == (0, 0, 2000) and len(rounds) < 20


def test_ema_skips_nulls(spark):
    H = spark.createDataFrame([("a", "m", 1, 1.0), ("a", "m", 2, None), ("a", "m", 3, 2.0)], "arm string, metric string, step int, value double")
    assert [r.ema for r in W.ema(H, 0.5).orderBy("step").collect()] == pytest.approx([1.0, 1.5])


def test_shards_must_be_complete(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "problem_id long, rollout_idx int, shard int")
    df.write.partitionBy("shard").json(str(tmp_path / "s"))
    with pytest.raises(ValueError):
        files.merge_shards(spark, str(tmp_path / "s"), 3, "problem_id long, rollout_idx int, shard int")


def test_one_to_one_report(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert one(J.join_one_to_one(a, b, ("k",))[1]) == {"n_keys": 3, "repeated_left": 1, "repeated_right": 0, "missing_right": 1, "missing_left": 1}


def test_first_fit_takes_the_first_bin():
    def plain(lengths, budget):
        room, out = [], []
        for n in lengths:
            at = next((i for i, r in enumerate(room) if n <= r), len(room))
            if at == len(room):
                room.append(budget)
            room[at] -= n
            out.append(at)
        return out

    rng = random.Random(5)
    for n in [0, 1, 2, 3, *range(10, 400, 37)]:
        lengths = [rng.randint(0, 130) for _ in range(n)]
        assert S.first_fit(lengths, 100) == plain(lengths, 100)
        assert S.first_fit(sorted(lengths, reverse=True), 100) == plain(sorted(lengths, reverse=True), 100)
    began = time.time()
    S.first_fit(sorted((rng.randint(1, 100) for _ in range(100_000)), reverse=True), 100)
    assert time.time() - began < 10


def test_exact_quantiles(spark):
    rng = np.random.default_rng(9)
    qs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    groups = {"one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 500 + [7.0] * 2, "many": rng.normal(0, 1, 60_000).tolist(), "few": rng.normal(0, 1, 10).tolist(), "none": [None], None: [1.0, 9.0, 4.0]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double").repartition(7)
    for accuracy in (10_000, 100):
        got = {r.g: r for r in exact_quantiles(df, "x", qs, ("g",), accuracy).collect()}
        assert set(got) == set(groups) - {"none"}
        for g, r in got.items():
            assert [r[q] for q in qs] == pytest.approx(np.quantile(groups[g], list(qs.values())).tolist(), abs=1e-12)
    every = [x for xs in groups.values() for x in xs if x is not None]
    assert list(one(exact_quantiles(df, "x", qs)).values()) == pytest.approx(np.quantile(every, list(qs.values())).tolist(), abs=1e-12)
    assert one(exact_quantiles(df.where("false"), "x", qs)) == dict.fromkeys(qs)
    assert {r.g: r.c for r in with_quantiles(df.groupBy("g").agg(F.count("*").alias("n")), df, "x", {"c": 0.5}, ("g",)).collect()}["none"] is None


def test_quantiles_of_one_group_stay_dealt_out(spark):
    """No join by group, which would put all numbers into one task."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.range(10_001).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
        for by, want in (((), [(None, 9500.0)]), (("g",), [(0, 9500.0), (1, 9499.1)])):
            got = exact_quantiles(df, "x", {"q": 0.95}, by)
            assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
            assert sorted((r["g"] if by else None, round(r.q, 6)) for r in got.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
