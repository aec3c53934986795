"""Clusterings of rollouts within problems: making, reading and comparing them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollspark.functions.repeats import repeats_in_a_row
from rollspark.sources.scratch import cut


def _group(*by) -> Window:
    return Window.partitionBy(*by)


def cluster_by_key(R: DataFrame, key: Column, ok: Column, group: str = "problem_id", index: str = "rollout_idx") -> DataFrame:
    """Equal keys in a problem get the same id; a failed parse gets an id of its own, -1 - index."""
    w = _group(group).orderBy("_k")
    return R.withColumn("_k", F.when(ok, key)).withColumn("_r", F.dense_rank().over(w)).withColumn("_m", F.min(F.when(F.col("_k").isNotNull(), F.col("_r"))).over(_group(group))).withColumn(
        "cluster", F.when(F.col("_k").isNull(), -1 - F.col(index)).otherwise(F.col("_r") - F.col("_m")).cast("bigint")
    ).drop("_k", "_r", "_m")


#: Groups of more keys are clustered by rounds over tables.
IN_A_ROW = 64


def cluster_by_equivalence(R: DataFrame, key: str, equal: str, group: str = "problem_id", rounds: list | None = None) -> DataFrame:
    """Clusters of keys linked by a pairwise predicate ``equal`` over (a.key, b.key), named after their smallest key.

    Links are found within a problem (a bounded group). A group of up to ``IN_A_ROW`` keys is clustered in its row: each key merges
    the clusters that it is linked with. Larger groups, and all if the predicate cannot stand in a lambda (a Python function), go by
    rounds, which are written as tables; ``rounds`` takes up how many pointers changed in each.
    """
    groups = cut(R.select(group, F.col(key).alias("v")).where("v is not null").groupBy(group).agg(F.collect_set("v").alias("vs")), "groups")
    true = f"coalesce({equal}, false)"
    linked = f"(exists(_c, a -> {true}) or exists(array(b), a -> exists(_c, b -> {true})))"
    start = f"cast(array() AS array<{groups.schema['vs'].dataType.simpleString()}>)"
    merged = f"aggregate(vs, {start}, (_cs, b) -> concat(filter(_cs, _c -> not {linked}), array(array_append(flatten(filter(_cs, _c -> {linked})), b))))"
    most = IN_A_ROW
    try:
        found = groups.where(F.size("vs") <= most).select(group, F.explode(F.expr(merged)).alias("_c"))
    except AnalysisException as refused:
        if "LAMBDA" not in (refused.getCondition() or ""):
            raise
        most = 0
    keys = groups.where(F.size("vs") > most).select(group, F.explode("vs").alias("v"))
    if most:
        labels = found.select(group, F.explode("_c").alias("v"), F.array_min("_c").alias("to"))
        if not keys.isEmpty():
            labels = labels.union(_pointed(cut(keys, "keys"), equal, group, rounds))
    else:
        labels = _pointed(cut(keys, "keys"), equal, group, rounds)
    return R.join(labels.withColumnsRenamed({"v": key, "to": "label"}), [group, key], "left")


def _pointed(keys: DataFrame, equal: str, group: str, rounds: list | None) -> DataFrame:
    """group, v, to: the smallest key that each key is linked with.

    Each key has a pointer to a smaller one; in a round, pointers skip to where they lead, and a key and what it points to
    take the smallest pointer that a neighbour has reached, so a chain's length shrinks by a factor.
    """
    a, b = keys.select(group, F.col("v").alias("a")), keys.select(group, F.col("v").alias("b"))
    one_way = a.join(b, group).where("a <> b").where(equal)
    links = cut(one_way.union(one_way.select(group, F.col("b"), F.col("a"))).distinct(), "links")
    labels, changed = keys.withColumn("to", F.col("v")), 1
    while changed:
        ahead = labels.select(group, F.col("v").alias("to"), F.col("to").alias("far"))
        far = cut(labels.join(ahead, [group, "to"]), "ahead")
        near = links.join(far.select(group, F.col("v").alias("b"), "far"), [group, "b"]).groupBy(group, F.col("a").alias("v")).agg(F.min("far").alias("near"))
        seen = far.join(near, [group, "v"], "left").select(group, "v", "to", F.least("far", F.coalesce("near", "far")).alias("best"))
        given = seen.select(group, "v", "best", F.col("to").alias("was")).union(seen.select(group, F.col("to"), "best", F.lit(None)))
        new = cut(given.groupBy(group, "v").agg(F.min("best").alias("to"), F.max("was").alias("was")), "labels")
        changed = new.where("to <> was").count()
        labels = new.drop("was")
        if rounds is not None:
            rounds.append(changed)
    return labels


def partition_agreement(R: DataFrame, methods, group: str = "problem_id", index: str = "rollout_idx") -> DataFrame:
    """For each pair of labelings, how many problems they cut into the same parts."""
    rows = ", ".join(f"named_struct('method', '{m}', 'label', cast({m} as string))" for m in methods)
    long = R.select(group, index, F.expr(f"inline(array({rows}))"))
    first = long.withColumn("rep", F.min(index).over(_group(group, "method", "label")))
    # A partition is known by the first member of each rollout's part.
    sig = first.groupBy(group, "method").agg(F.array_sort(F.collect_list(F.struct(index, "rep"))).alias("sig"))
    wide = sig.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("method", "sig"))).alias("m"))
    pairs = [(a, b) for i, a in enumerate(methods) for b in list(methods)[i + 1 :]]
    out = wide.agg(F.count("*").alias("n"), *[F.count_if(F.col("m")[a] == F.col("m")[b]).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    return out.select(F.expr("inline(array(" + ", ".join(f"named_struct('a', '{a}', 'b', '{b}', 'n_prompts', n, 'n_same', s{i}, 'share', s{i} / n)" for i, (a, b) in enumerate(pairs)) + "))"))


#: Text features by name, as SQL over ``t`` (the text), ``l`` (in lower case) and ``p`` (the answer), or as a function of t.
FEATURES = {
    "has_boxed": "contains(t, '\\\\boxed{')",
    "has_sympy_code": "contains(t, 'import sympy') or contains(t, '```python') or contains(t, 'sp.')",
    "has_repetition": repeats_in_a_row,
    "has_code_fence": "contains(t, '```')",
    "has_modular": "contains(l, 'modulo') or contains(l, 'mod ') or contains(l, 'remainder') or contains(l, 'congruent')",
    "has_coord": "contains(l, 'coordinate') or contains(l, '(x,') or contains(l, 'x-axis') or contains(l, 'vector')",
    "parsed_is_numeric": "p rlike '^-?[0-9]+(\\\\.[0-9]+)?$'",
    "parsed_is_latex_fraction": "contains(p, '\\\\frac') or contains(p, '\\\\dfrac')",
}


def cluster_by_features(R: DataFrame, text: str, answer: str, group: str = "problem_id", features=tuple(FEATURES)) -> DataFrame:
    """Rollouts with the same features of text and answer share a cluster."""
    x = R.withColumns({"t": F.coalesce(F.col(text), F.lit("")), "p": F.coalesce(F.col(answer).cast("string"), F.lit(""))}).withColumn("l", F.lower("t"))
    x = x.withColumns({f: FEATURES[f]("t") if callable(FEATURES[f]) else F.expr(FEATURES[f]) for f in features}).drop("t", "l", "p")
    return x.withColumn("cluster", F.dense_rank().over(_group(group).orderBy(*features)) - 1)


def with_clusters(R: DataFrame, cluster_source: str, canonical=None, valid=None, text: str = "completion", answer: str = "pred", features=tuple(FEATURES)) -> DataFrame:
    """Rollouts with ``cluster_id`` from a source: ``recorded`` (as it stands), ``key`` (the canonical answer) or ``features``."""
    if cluster_source == "recorded":
        return R
    if cluster_source == "key":
        key = F.col(answer) if canonical is None else canonical
        found = cluster_by_key(R.drop("cluster_id"), key, key.isNotNull() if valid is None else valid)
    elif cluster_source == "features":
        found = cluster_by_features(R.drop("cluster_id"), text, answer, features=features)
    else:
        raise ValueError(f"no cluster source named {cluster_source}")
    return found.withColumn("cluster_id", F.col("cluster").cast("bigint")).drop("cluster")


def cluster_by_embedding(df: DataFrame, group: str, threshold: float, key: str, vector: str) -> DataFrame:
    """Average-linkage clusters by cosine distance within groups: group, key, cluster. See ``embedding_sweep``."""
    return embedding_sweep(df, group, (threshold,), key, vector).drop("threshold")


def embedding_sweep(df: DataFrame, group: str, thresholds, key: str, vector: str) -> DataFrame:
    """Average-linkage clusters by cosine distance at many thresholds: group, key, threshold, cluster.

    Clusters merge while their mean distance is under the threshold; ids follow the first member by key. One tree per group serves all thresholds.
    A group is one task: memory in proportion to its vectors, time to the square of their number. A null vector, or one with a null in it, is
    at distance 1 from all, as the zero vector is; vectors of a group have one length. Keys are distinct in a group.
    """
    cuts = sorted(map(float, thresholds))

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)
        width = max((len(v) for v in frame[vector] if v is not None), default=1)
        v = np.array([np.zeros(width) if x is None else np.asarray(x, np.float64) for x in frame[vector]]).reshape(len(frame), width)
        v[~np.isfinite(v).all(1)] = 0
        v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
        labels = cut_tree(linkage_tree(v), len(v), cuts)
        return pd.concat([frame[[group, key]].assign(threshold=t, cluster=x) for t, x in zip(cuts, labels, strict=True)])

    kind = lambda c: df.schema[c].dataType.simpleString()
    return df.select(group, key, vector).groupBy(group).applyInPandas(cluster, f"{group} {kind(group)}, {key} {kind(key)}, threshold double, cluster long")


def linkage_tree(v: np.ndarray) -> list[tuple[int, int, float]]:
    """Average linkage of unit (or zero) vectors by cosine distance: (a member of one, a member of the other, height), lowest first.

    The mean distance of two clusters is one less the product of their mean vectors, so clusters are kept as sums. Chains of nearest
    neighbours end in two that are each other's nearest; these merge, which gives the same tree as merging the nearest of all.
    """
    n = len(v)
    total, size, low, alive = v.copy(), np.ones(n), np.zeros(n), np.ones(n, bool)
    out, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            d = 1 - total @ total[a] / (size * size[a])
            d[~alive] = np.inf
            d[a] = np.inf
            b = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[b] + 1e-12:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        height = max(float(d[b]), low[a], low[b])
        out.append((a, b, height))
        total[b], size[b], low[b] = total[a] + total[b], size[a] + size[b], height
        alive[a] = False
    return sorted(out, key=lambda m: m[2])


def cut_tree(tree: list[tuple[int, int, float]], n: int, thresholds) -> list[list[int]]:
    """Cluster ids (by first member) at each of the rising thresholds: what merges under it."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, at = [], 0
    for t in thresholds:
        while at < len(tree) and tree[at][2] < t:
            a, b = find(tree[at][0]), find(tree[at][1])
            root[max(a, b)] = min(a, b)
            at += 1
        names: dict[int, int] = {}
        out.append([names.setdefault(find(i), len(names)) for i in range(n)])
    return out


def cosine_pairs(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """Cosine similarity of each pair in a bounded group."""
    from rollspark.operators.joins import pairs

    p = pairs(df.withColumn(vector, F.col(vector).cast("array<double>")), group, key, (vector,))
    dot = lambda a, b: F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    a, b = f"{vector}_a", f"{vector}_b"
    return p.select(group, f"{key}_a", f"{key}_b", (dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))).alias("cosine"))


def unfenced(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def _entries(text: Column) -> Column:
    return F.from_json(text, "map<string,struct<cluster_id:string,chain_of_thought:string>>")


def parse_assignments(df: DataFrame, n: str | int, response: str = "response", group: str = "problem_id") -> DataFrame:
    """Cluster answers ``{"1": {"cluster_id": ...}, ...}`` to rows (group, parse_ok, rollout_idx, cluster_id).

    Keys count from 1 and must be exactly 1..n; 100 means degenerate (-1). Anything else is parse_ok = false in one row.
    """
    size = F.col(n) if isinstance(n, str) else F.lit(n)
    x = df.select(group, size.alias("_n"), _entries(unfenced(F.col(response))).alias("_m"))
    keys = F.filter(F.map_keys("_m"), lambda k: k.rlike("^[0-9]+$"))
    want = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: i.cast("string"))
    ids = F.forall(want, lambda k: F.coalesce(F.col("_m")[k]["cluster_id"].rlike("^-?[0-9]+$"), F.lit(False)))
    ok = F.coalesce(F.col("_m").isNotNull() & (F.array_sort(keys) == F.array_sort(want)) & ids, F.lit(False))
    x = x.withColumn("parse_ok", ok)
    rows = F.when(F.col("parse_ok"), F.transform(want, lambda k: F.struct((k.cast("int") - 1).alias("rollout_idx"), F.nullif(F.col("_m")[k]["cluster_id"].try_cast("bigint"), F.lit(100)).alias("c"))))
    return x.select(group, "parse_ok", F.explode_outer(rows).alias("r")).select(group, "parse_ok", "r.rollout_idx", F.when(F.col("parse_ok"), F.coalesce("r.c", F.lit(-1))).alias("cluster_id"))


def parse_assignments_lenient(df: DataFrame, n: str | int, response: str = "response", group: str = "problem_id") -> DataFrame:
    """As above, but a bad or missing entry is degenerate, and the first {...} block of a broken answer is tried."""
    size = F.col(n) if isinstance(n, str) else F.lit(n)
    whole = _entries(F.trim(F.col(response)))
    block = _entries(F.regexp_extract(F.col(response), r"(?s)\{.*\}", 0))
    x = df.select(group, size.alias("_n"), F.coalesce(whole, block).alias("_m"))
    x = x.select(group, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("i"), "_m")
    raw = F.col("_m")[F.col("i").cast("string")]["cluster_id"].try_cast("bigint")
    return x.select(group, (F.col("i") - 1).alias("rollout_idx"), F.coalesce(F.nullif(raw, F.lit(100)), F.lit(-1)).alias("cluster_id"))


def fill_degenerate(R: DataFrame, parsed: DataFrame, group: str = "problem_id", index: str = "rollout_idx") -> tuple[DataFrame, DataFrame]:
    """Rollouts with their parsed cluster, -1 where there is none, and a row of diagnostics. -1 counts as a cluster there."""
    j = R.select(group, index).join(parsed.where("parse_ok").select(group, index, "cluster_id"), [group, index], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    pp = j.groupBy(group).agg(F.count_distinct("cluster_id").alias("d"), F.count_if(F.col("cluster_id") == -1).alias("deg"))
    ok = parsed.groupBy(group).agg(F.max("parse_ok").alias("ok"))
    diag = pp.join(ok, group, "left").agg(
        F.count("*").alias("n_prompts"), F.avg("d").alias("distinct_clusters_mean"), F.sum("deg").alias("degenerate_rollouts"), F.avg(F.coalesce("ok", F.lit(False)).cast("double")).alias("parse_ok_rate"), F.count_if(F.col("ok").isNull()).alias("overflow_skipped")
    )
    return j, diag


def repeat_agreement(a: DataFrame, b: DataFrame, group: str = "problem_id") -> DataFrame:
    """Two runs over the same problems: how often both parse, how often they agree, and degenerate rollouts in all."""
    def one(df: DataFrame, tag: str) -> DataFrame:
        row = F.array_sort(F.collect_list(F.struct("rollout_idx", "cluster_id")))
        return df.groupBy(group).agg(F.max("parse_ok").alias(f"ok{tag}"), row.alias(f"v{tag}"), F.count_if(F.col("cluster_id") == -1).alias(f"d{tag}"))

    both = F.col("oka") & F.col("okb")
    return one(a, "a").join(one(b, "b"), group).agg(
        F.count("*").alias("n"), F.avg(both.cast("double")).alias("both_parse"), F.avg((both & (F.col("va") == F.col("vb"))).cast("double")).alias("identical"), F.sum(F.col("da") + F.col("db")).alias("degenerate")
    )


def _contingency(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    return df.groupBy(group, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("m"))


def adjusted_rand(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings per group; 1 where both are trivial in the same way."""
    c = _contingency(df, group, a, b)
    two = lambda x: F.sum(x * (x - 1) / 2)
    side = lambda k, name: c.groupBy(group, k).agg(F.sum("m").alias("m")).groupBy(group).agg(two(F.col("m")).alias(name))
    both = c.groupBy(group).agg(two(F.col("m")).alias("ij"), F.sum("m").alias("n"))
    j = both.join(side("_a", "i"), group).join(side("_b", "j"), group)
    all_ = F.col("n") * (F.col("n") - 1) / 2
    expected = F.when(all_ > 0, F.col("i") * F.col("j") / all_).otherwise(0.0)
    top = (F.col("i") + F.col("j")) / 2
    return j.select(group, F.when(top == expected, 1.0).otherwise((F.col("ij") - expected) / (top - expected)).alias("ari"))


def v_measure(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Homogeneity, completeness and their harmonic mean, with a as the truth."""
    c = _contingency(df, group, a, b)
    n = F.sum("m").over(_group(group))
    c = c.withColumns({"n": n, "ma": F.sum("m").over(_group(group, "_a")), "mb": F.sum("m").over(_group(group, "_b"))})
    m = F.col("m")
    h = c.groupBy(group).agg(
        (-F.sum(m / F.col("n") * F.log(F.col("ma") / F.col("n")))).alias("ha"), (-F.sum(m / F.col("n") * F.log(F.col("mb") / F.col("n")))).alias("hb"),
        (-F.sum(m / F.col("n") * F.log(m / F.col("mb")))).alias("hab"), (-F.sum(m / F.col("n") * F.log(m / F.col("ma")))).alias("hba"),
    )
    part = lambda rest, whole: F.when(F.col(whole) <= 1e-12, 1.0).otherwise(1 - F.col(rest) / F.col(whole))
    x = h.select(group, part("hab", "ha").alias("homogeneity"), part("hba", "hb").alias("completeness"))
    s = F.col("homogeneity") + F.col("completeness")
    return x.withColumn("v", F.when(s > 0, 2 * F.col("homogeneity") * F.col("completeness") / s).otherwise(0.0))


def shape(df: DataFrame, group: str, label: str) -> DataFrame:
    """Clusters of a labeling per group, and whether a correct minority exists."""
    k = df.groupBy(group, label).agg(F.count_if(F.col("reward") > 0.5).alias("r"))
    return k.groupBy(group).agg(F.count("*").alias("n_clusters"), F.coalesce(F.min(F.when(F.col("r") > 0, F.col("r"))) < F.max("r"), F.lit(False)).alias("minority"))


def concordance(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Mean difference in numbers of clusters, and the 2 x 2 table of having a correct minority."""
    x, y = (shape(df, group, c).select(group, F.col("n_clusters").alias(f"n{t}"), F.col("minority").alias(f"m{t}")) for c, t in ((a, "a"), (b, "b")))
    p, q = F.col("ma"), F.col("mb")
    return x.join(y, group).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("na") - F.col("nb"))).alias("mean_diff"), F.count_if(p & q).alias("yes_yes"), F.count_if(p & ~q).alias("yes_no"), F.count_if(~p & q).alias("no_yes"), F.count_if(~p & ~q).alias("no_no"))


def composition(R: DataFrame, group: str = "problem_id", label: str = "cluster_id") -> DataFrame:
    """Cluster sizes of each problem, largest first: all, and of correct rollouts only."""
    k = R.groupBy(group, label).agg(F.count("*").alias("s"), F.count_if(F.col("reward") > 0.5).alias("r"))
    down = lambda c: F.reverse(F.array_sort(F.collect_list(c)))
    return k.groupBy(group).agg(down(F.col("s")).alias("sizes"), down(F.when(F.col("r") > 0, F.col("r"))).alias("correct_sizes"))


def stacked_order(R: DataFrame, group: str = "problem_id", label: str = "cluster_id") -> DataFrame:
    """Rollouts in display order: largest cluster first, correct ones first in it."""
    x = R.withColumn("_s", F.count("*").over(_group(group, label)))
    return x.withColumn("position", F.row_number().over(_group(group).orderBy(F.desc("_s"), label, F.desc("reward"), "rollout_idx")) - 1).drop("_s")


def labeling_leaderboard(df: DataFrame, truth: str, labelings, group: str = "problem_id") -> DataFrame:
    """Labelings against a true one: mean ARI and V, difference in clusters, accuracy of the minority flag; best first."""
    out = None
    for name in labelings:
        one = adjusted_rand(df, group, truth, name).agg(F.avg("ari").alias("mean_ari"), F.stddev_samp("ari").alias("sd"), F.count("*").alias("n"))
        half = 1.96 * F.col("sd") / F.sqrt("n")
        one = one.select(F.lit(name).alias("labeling"), "mean_ari", (F.col("mean_ari") - half).alias("ari_low"), (F.col("mean_ari") + half).alias("ari_high"))
        one = one.join(v_measure(df, group, truth, name).agg(F.avg("v").alias("mean_v")), F.lit(True)).join(concordance(df, group, truth, name), F.lit(True))
        one = one.withColumn("minority_accuracy", (F.col("yes_yes") + F.col("no_no")) / F.col("n"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("mean_ari"), "labeling")


def worst_cases(df: DataFrame, truth: str, labelings, k: int, group: str = "problem_id") -> DataFrame:
    """The k problems of lowest ARI of each labeling, one row per problem with the labelings that it is worst in."""
    long = None
    for name in labelings:
        one = adjusted_rand(df, group, truth, name).orderBy("ari", group).limit(k).withColumn("labeling", F.lit(name))
        long = one if long is None else long.unionByName(one)
    return long.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("labeling")), ",").alias("labelings"), F.min("ari").alias("least_ari"))


def parse_failures(df: DataFrame, response: str = "response", key: str = "problem_id", n: int = 3) -> DataFrame:
    """Failed answers by kind, with a count and the ends of the first few."""
    r = F.col(response)
    kind = F.when(r.isNull(), "missing").when(~F.endswith(F.trim(r), F.lit("}")), "truncated").otherwise("invalid")
    x = df.where("not parse_ok").withColumn("kind", kind)
    # The limit is a number, so each task keeps n rows of a kind before they are shuffled.
    first = x.withColumn("_i", F.row_number().over(_group("kind").orderBy(key))).where(F.col("_i") <= n)
    sample = F.concat_ws(":", F.col(key).cast("string"), F.expr(f"right(coalesce({response}, ''), 20)"))
    samples = first.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list(sample)), "|").alias("samples"))
    return x.groupBy("kind").agg(F.count("*").alias("n")).join(samples, "kind")
