"""Queries of sources, sinks and streams; the files are written from the driver's tables first."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollspark.operators.manifest import filter_with_audit
from rollspark.operators.metrics import pass_at_k
from rollspark.operators.sampling import split_overlap
from rollspark.sources import evaldoc as E
from rollspark.sources import files as S
from rollspark.sources.scratch import cut, shared_path
from rollspark.streaming import steps as Z
from rollspark.tables import EV, EVA, MANIFEST, ev, manifest, read

from .metrics import LAD, LADDER, PP, rounded
from .registry import query
from .structure import UNLOCKED

ROLLOUT = "arm string, step int, problem_id bigint, rollout_idx int, pred string, reward double"


def json_rollouts(s, d):
    path = shared_path(s, "rollouts")
    ev(s, d, True).select("arm", "step", "problem_id", "rollout_idx", "pred", "reward").write.json(path)
    return path


@query("s01_read_jsonl", f"WITH {EVA} SELECT arm, step, problem_id, rollout_idx, pred, reward FROM ev")
def s01(s, d):
    return S.read_jsonl(s, json_rollouts(s, d), ROLLOUT)


def broken(s, d):
    """Rollout lines of which every seventh is cut off."""
    path = shared_path(s, "broken")
    R = ev(s, d, True)
    line = F.to_json(F.struct("arm", "step", "problem_id", "rollout_idx", "pred", "reward"))
    R.select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return path


@query("s02_permissive_good", f"WITH {EVA} SELECT arm, step, problem_id, rollout_idx, pred, reward FROM ev WHERE event_id % 7 <> 0")
def s02(s, d):
    return S.read_jsonl_permissive(s, broken(s, d), ROLLOUT)[0]


@query("s02_permissive_bad", "SELECT length('x') * 20 AS n_chars, count(*) AS n FROM events WHERE event_id % 7 = 0")
def s02b(s, d):
    return S.read_jsonl_permissive(s, broken(s, d), ROLLOUT)[1].groupBy(F.length("line").cast("bigint").alias("n_chars")).agg(F.count("*").alias("n"))


def eval_docs(s, d):
    """One evaluation document per (arm, problem), as JSON lines."""
    R = ev(s, d, True)
    g = R.groupBy("arm", "problem_id").agg(F.array_sort(F.collect_list(F.struct("rollout_idx", "reward", "pred", "finish_reason"))).alias("r"), F.count_if(F.col("reward") > 0.5).alias("c"))
    pp = F.struct(
        F.col("problem_id").cast("string").alias("problem_id"), F.lit("purchase").alias("ground_truth"), F.col("c").alias("n_correct"), F.transform("r", lambda x: x["reward"]).alias("rewards"), F.transform("r", lambda x: x["pred"]).alias("preds"), F.transform("r", lambda x: x["finish_reason"]).alias("rollouts")
    )
    n = F.size("r").cast("double")
    ds = F.struct(F.lit(1).cast("bigint").alias("n_prompts"), F.create_map(F.lit("1"), F.col("c") / n).alias("pass_at_k"), F.col("r")[0]["reward"].alias("mean_reward_at_1"), F.array(pp).alias("per_prompt"))
    path = shared_path(s, "eval")
    g.select(F.col("arm").alias("label"), F.lit("x").alias("ckpt_path"), F.size("r").alias("n_rollouts"), F.create_map(F.concat(F.lit("d"), (F.col("problem_id") % 3).cast("string")), ds).alias("datasets")).write.json(path)
    return path


@query("s03_flatten_eval", f"WITH {EVA} SELECT arm, 'd' || (problem_id % 3) AS dataset, problem_id::VARCHAR AS problem_id, 'purchase' AS gold, rollout_idx, reward, pred, finish_reason AS completion FROM ev")
def s03(s, d):
    return S.flatten_eval(S.read_jsonl(s, eval_docs(s, d), S.EVAL_DOC))


@query("s04_dedup_latest", f"WITH {EVA} SELECT arm, problem_id, step, rollout_idx FROM (SELECT *, row_number() OVER (PARTITION BY arm, problem_id ORDER BY step DESC, rollout_idx DESC) AS i FROM ev) WHERE i = 1")
def s04(s, d):
    return S.dedup_latest(ev(s, d, True).select("arm", "problem_id", "step", "rollout_idx"), ("arm", "problem_id"), ("step", "rollout_idx"))


@query("s05_compact_eval", f"WITH {EVA} SELECT arm AS label, 'd' || (problem_id % 3) AS dataset, problem_id::VARCHAR AS problem_id, count(*) FILTER (reward > 0.5) AS n_correct, count(*)::INT AS n FROM ev GROUP BY ALL")
def s05(s, d):
    c = S.compact_eval(S.read_jsonl(s, eval_docs(s, d), S.EVAL_DOC)).select("label", "dataset", F.explode("per_prompt").alias("p"))
    return c.select("label", "dataset", "p.problem_id", "p.n_correct", F.size("p.rewards").alias("n"))


@query("s06_eval_header", f"WITH {EVA}, p AS (SELECT arm, problem_id, avg(reward) AS v FROM ev GROUP BY ALL) SELECT arm AS label, 'd' || (problem_id % 3) AS dataset, 1 AS k, count(*) AS n, round(avg(v), 6) AS pass_at_k FROM p GROUP BY ALL")
def s06(s, d):
    h = S.eval_header(S.read_jsonl(s, eval_docs(s, d), S.EVAL_HEADER))
    return rounded(h.groupBy("label", "dataset", "k").agg(F.sum("n_prompts").alias("n"), F.avg("pass_at_k").alias("pass_at_k")))


def large_docs(s, d):
    """One evaluation document for each arm and 40 problems, over many lines, with heavy fields that no query wants."""
    R = ev(s, d, True).withColumns({"doc": F.concat("arm", F.lit("-"), F.expr("problem_id div 40")), "dataset": F.concat(F.lit("d"), F.col("problem_id") % 3)})
    keys = ["doc", "arm", "dataset"]
    g = R.groupBy(*keys, "problem_id").agg(F.array_sort(F.collect_list(F.struct("rollout_idx", "reward", "pred", "finish_reason"))).alias("r"), F.count_if(F.col("reward") > 0.5).alias("c"))
    g = cut(g, "prompts")  # read for heads, lists, records and ends
    got = lambda c: F.transform("r", lambda x: x[c])
    heavy = F.transform("r", lambda x: F.array(F.create_map(x["rollout_idx"].cast("string"), x["reward"] - 1.5)))
    prompt = F.concat(F.lit('a "problem_id": in a text, {[ "'), F.lit("\\"), F.lit('" per_prompt'))
    record = F.struct(F.col("problem_id").cast("string").alias("problem_id"), F.lit("purchase").alias("ground_truth"), prompt.alias("rendered_prompt"), F.col("c").alias("n_correct"), got("reward").alias("rewards"), got("pred").alias("preds"), got("finish_reason").alias("rollouts"), heavy.alias("logprobs"))
    first = Window.partitionBy("doc", "dataset").orderBy("problem_id")
    records = g.select(*keys, F.col("problem_id").alias("at"), F.concat(F.when(F.row_number().over(first) == 1, "").otherwise(","), F.to_json(record, {"pretty": "true"})).alias("value"))
    first = Window.partitionBy("doc").orderBy("dataset")
    parts = g.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("c") / F.size("r")).alias("p"), F.avg(F.col("r")[0]["reward"]).alias("m"))
    opens = parts.select(*keys, F.lit(-1).alias("at"), F.concat(F.when(F.row_number().over(first) == 1, "").otherwise(","), F.format_string('"%s": {\n "n_prompts": %d,\n "pass_at_k": {"1": %s},\n "mean_reward_at_1": %s,\n "per_prompt": [', "dataset", "n", F.col("p").cast("string"), F.col("m").cast("string"))).alias("value"))
    closes = parts.select(*keys, F.lit(1 << 60).alias("at"), F.lit("]}").alias("value"))
    docs = g.select("doc", "arm").distinct()
    heads = docs.select("doc", "arm", F.lit("").alias("dataset"), F.lit(0).alias("at"), F.format_string('{\n "label": "%s",\n "ckpt_path": "x",\n "n_rollouts": 8,\n "datasets": {', "arm").alias("value"))
    ends = docs.select("doc", "arm", F.lit("~").alias("dataset"), F.lit(0).alias("at"), F.lit("}}").alias("value"))
    lines = heads.unionByName(opens).unionByName(records).unionByName(closes).unionByName(ends)
    path = shared_path(s, "documents")
    lines.repartition("doc").sortWithinPartitions("doc", "dataset", "at").select("doc", "value").write.partitionBy("doc").text(path)
    return f"{path}/doc=*/part-*"


#: Small ranges, so that each of the documents is read by several tasks.
RANGE = 64 << 10


@query("s03_flatten_large", f"WITH {EVA} SELECT arm, 'd' || (problem_id % 3) AS dataset, problem_id::VARCHAR AS problem_id, 'purchase' AS gold, rollout_idx, reward, pred, finish_reason AS completion FROM ev")
def s03l(s, d):
    return E.flatten_records(E.read_eval_document(s, large_docs(s, d), range_bytes=RANGE))


@query("s05_compact_large", f"WITH {EVA} SELECT arm AS label, 'd' || (problem_id % 3) AS dataset, problem_id::VARCHAR AS problem_id, count(*) FILTER (reward > 0.5) AS n_correct, count(*)::INT AS n, sum(reward) AS reward FROM ev GROUP BY ALL")
def s05l(s, d):
    slim = E.read_eval_document(s, large_docs(s, d), ("problem_id", "n_correct", "rewards", "preds"), RANGE)
    return slim.select("label", "dataset", "problem_id", "n_correct", F.size("rewards").alias("n"), F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x).alias("reward"))


@query("s06_header_large", f"WITH {EVA}, p AS (SELECT arm, problem_id, avg(reward) AS v FROM ev GROUP BY ALL) SELECT arm AS label, 'd' || (problem_id % 3) AS dataset, 1 AS k, count(*) AS n, round(avg(v), 6) AS pass_at_k FROM p GROUP BY ALL")
def s06l(s, d):
    h = E.read_eval_headers(s, large_docs(s, d), range_bytes=RANGE).select("label", "dataset", "n_prompts", F.explode("pass_at_k").alias("k", "p"))
    return rounded(h.groupBy("label", "dataset", F.col("k").cast("int").alias("k")).agg(F.sum("n_prompts").alias("n"), (F.sum(F.col("p") * F.col("n_prompts")) / F.sum("n_prompts")).alias("pass_at_k")))


@query("s06_first_header", f"WITH {EVA}, p AS (SELECT DISTINCT arm, problem_id FROM ev), q AS (SELECT arm, problem_id // 40 AS b, problem_id % 3 AS d, count(*) AS n FROM p GROUP BY ALL), f AS (SELECT *, min(d) OVER (PARTITION BY arm, b) AS low FROM q) SELECT arm AS label, 'd' || d AS dataset, count(*) AS documents, sum(n)::BIGINT AS n FROM f WHERE d = low GROUP BY ALL")
def s06f(s, d):
    """Only the documents' beginnings are read."""
    h = E.read_eval_headers(s, large_docs(s, d), all_datasets=False)
    return h.groupBy("label", "dataset").agg(F.count("*").alias("documents"), F.sum("n_prompts").alias("n"))


def step_logs(s, d):
    """Step logs under run folders: steps to 20 by one run, from 15 on by its resumption."""
    root = shared_path(s, "logs")
    R = ev(s, d, True).select(F.col("step").alias("global_step"), F.col("problem_id").cast("string").alias("prompt_id"), "rollout_idx", F.col("pred").alias("parsed_answer"), "reward", "cluster_id", "finish_reason", "response_length", "step")
    for run, part in (("main", R.where("step <= 20")), ("resume", R.where("step >= 15"))):
        # One folder per step, named like the logs' files.
        part.withColumn("step_dir", F.col("step")).drop("step").repartition("step_dir").write.partitionBy("step_dir").json(f"{root}/raw/{run}")
        jvm = s.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/raw/{run}/step_dir=*")
        fs = at.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{root}/logs/{run}"))
        for f in fs.globStatus(at):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{root}/logs/{run}/step_{f.getPath().getName().split('=')[1]}"))
    return f"{root}/logs"


RUNS = f"{EVA}, logs AS (SELECT *, 'main' AS run FROM ev WHERE step <= 20 UNION ALL SELECT *, 'resume' FROM ev WHERE step >= 15)"


@query("s07_read_step_log", f"WITH {RUNS} SELECT run, step, count(*) AS n, sum(reward) AS reward FROM logs WHERE step BETWEEN 4 AND 24 AND (step - 4) % 5 = 0 GROUP BY ALL")
def s07(s, d):
    return S.read_step_log(s, step_logs(s, d), 4, 24, 5).groupBy("run", "step").agg(F.count("*").alias("n"), F.sum("reward").alias("reward"))


@query("s08_resolve_resumes", f"WITH {RUNS} SELECT run, step, count(*) AS n FROM logs WHERE run = 'resume' OR step < 15 GROUP BY ALL")
def s08(s, d):
    x = S.read_step_log(s, step_logs(s, d)).withColumns({"arm": F.lit("a"), "is_resume": F.col("run") == "resume"})
    return S.resolve_resumes(x).groupBy("run", "step").agg(F.count("*").alias("n"))


@query("s08_resolve_by_mtime", f"WITH {EVA} SELECT run, step, count(*) AS n FROM (SELECT step, CASE WHEN step % 2 = 0 THEN 'old' ELSE 'new' END AS run FROM ev) GROUP BY ALL")
def s08b(s, d):
    R = ev(s, d, True).select("step", F.lit("a").alias("arm"))
    old = R.withColumns({"run": F.lit("old"), "mtime": F.lit(1), "is_resume": F.lit(False)})
    new = R.withColumns({"run": F.lit("new"), "mtime": F.when(F.col("step") % 2 == 1, 2).otherwise(0), "is_resume": F.lit(True)})
    return S.resolve_resumes(old.unionByName(new), "mtime").groupBy("run", "step").agg(F.count("*").alias("n"))


@query("s09_merge_shards", f"WITH {EVA} SELECT problem_id, rollout_idx, arm, pred, reward, (problem_id % 4)::INT AS shard FROM ev")
def s09(s, d):
    root = shared_path(s, "shards")
    R = ev(s, d, True).select("problem_id", "rollout_idx", "arm", "pred", "reward").withColumn("shard", F.col("problem_id") % 4)
    R.write.partitionBy("shard").json(root)
    return S.merge_shards(s, root, 4, "problem_id bigint, rollout_idx int, arm string, pred string, reward double, shard int")


@query("s10_shard", f"WITH {EV} SELECT problem_id, count(*) AS n FROM ev WHERE problem_id % 4 = 1 GROUP BY 1")
def s10(s, d):
    return S.shard(ev(s, d), 1, 4).groupBy("problem_id").agg(F.count("*").alias("n"))


@query("s11_tsv", "SELECT conv_id, turn::INT AS turn, trim(regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g')) AS text FROM conversations")
def s11(s, d):
    path = shared_path(s, "tsv")
    S.write_tsv(read(s, d, "conversations").select("conv_id", "turn", "text"), path)
    return S.read_tsv(s, path, "conv_id bigint, turn int, text string").withColumn("text", F.trim(F.coalesce("text", F.lit(""))))


@query("s12_write_split", f"WITH {MANIFEST} SELECT 'train' AS part, count(*) AS n FROM manifest UNION ALL SELECT 'val', least(100, count(*)) FROM manifest")
def s12(s, d):
    return S.write_split(split_overlap(manifest(s, d), 100, 42), shared_path(s, "split"))


@query("s13_filter_with_audit", f"WITH {MANIFEST} SELECT CASE WHEN gold = '' THEN 'blank_gold' WHEN difficulty_band = 1 THEN 'band' ELSE 'kept' END AS reason, count(*) AS n FROM manifest GROUP BY 1")
def s13(s, d):
    return filter_with_audit(manifest(s, d), {"blank_gold": F.col("gold") == "", "band": F.col("difficulty_band") == 1})[2]


@query("s14_pivot_report", f"WITH {EVA}, {PP}, {LADDER}, {LAD} SELECT arm, round(max(pass_at_k) FILTER (k = 1), 6) AS k1, round(max(pass_at_k) FILTER (k = 4), 6) AS k4, round(max(pass_at_k) FILTER (k = 16), 6) AS k16 FROM lad GROUP BY arm")
def s14(s, d):
    long = pass_at_k(ev(s, d, True), (1, 4, 16), ("arm",)).withColumn("k", F.concat(F.lit("k"), F.col("k").cast("string")))
    return rounded(S.pivot_report(long, "arm", "k", "pass_at_k", ("k1", "k4", "k16")))


@query("s15_fingerprint", "SELECT count(*) AS n, sum(('0x' || substr(sha256(o_orderkey || '|' || o_orderstatus), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM orders")
def s15(s, d):
    return S.fingerprint(read(s, d, "orders"), ("o_orderkey", "o_orderstatus"))


@query("s16_latest_run", "SELECT l_suppkey AS run_id, arg_max(p, st) AS path FROM (SELECT l_suppkey, CASE WHEN l_linenumber = 1 THEN 'flat' ELSE 'run/' || l_shipdate::DATE || '-' || lpad(l_orderkey::VARCHAR, 9, '0') || lpad(l_partkey::VARCHAR, 9, '0') END AS p, CASE WHEN l_linenumber = 1 THEN '' ELSE l_shipdate::DATE || '-' || lpad(l_orderkey::VARCHAR, 9, '0') || lpad(l_partkey::VARCHAR, 9, '0') END AS st FROM lineitem) GROUP BY 1")
def s16(s, d):
    stamp = F.concat(F.to_date("l_shipdate").cast("string"), F.lit("-"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
    x = read(s, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.when(F.col("l_linenumber") > 1, stamp).alias("stamp"))
    return S.latest_run(x.withColumn("path", F.coalesce(F.concat(F.lit("run/"), "stamp"), F.lit("flat"))))


# --- streams, over JSON files written from the events ---

EVENTS = "arm string, step int, problem_id bigint, rollout_idx int, pred string, reward double, cluster_id bigint, finish_reason string, response_length int, event_id bigint, ts timestamp, value double"


def landed(s, d, twice: bool = False):
    """The rollouts as JSON files; with ``twice`` every third row is there again."""
    R = ev(s, d, True)
    if twice:
        R = R.unionByName(R.where("event_id % 3 = 0"))
    path = shared_path(s, "landed")
    R.write.json(path)
    return path


@query("z01_stream_step_metrics", f"WITH {EVA} SELECT arm, step, count(*) AS n_rollouts, round(avg(reward), 6) AS mean_reward, round(avg(response_length), 6) AS mean_length, count(*) FILTER (reward > 0) AS n_correct, count(*) FILTER (finish_reason = 'length') AS n_cut FROM ev GROUP BY ALL")
def z01(s, d):
    return rounded(Z.run_available(Z.step_metrics(Z.source(s, landed(s, d), EVENTS)), "complete"))


@query(
    "z01_stream_step_rates",
    f"""WITH {EVA}, k AS (SELECT arm, step, problem_id, cluster_id, count(*) AS n, count(*) FILTER (reward > 0) AS c FROM ev GROUP BY ALL), p AS (SELECT arm, step, problem_id, sum(n) AS n, sum(c) AS c, sum(n) FILTER (cluster_id <> -1) AS ok, coalesce(min(c) FILTER (c > 0 AND cluster_id <> -1) < max(c) FILTER (c > 0 AND cluster_id <> -1), false) AS m FROM k GROUP BY ALL)
    SELECT arm, step, count(*) AS n_prompts, round(avg((c > 0)::INT), 6) AS any_correct, round(avg((c > 0 AND c < n)::INT), 6) AS mixed, round(avg((c = 0)::INT), 6) AS all_wrong, round(avg((c = n)::INT), 6) AS all_correct, round(avg(m::INT), 6) AS minority_rate, round(coalesce(sum(ok), 0)::DOUBLE / sum(n), 6) AS parse_rate FROM p GROUP BY ALL""",
)
def z01b(s, d):
    return rounded(Z.step_rates(Z.run_available(Z.cluster_counts(Z.source(s, landed(s, d), EVENTS)), "complete")))


@query("z02_stream_unlocked", UNLOCKED.replace("SELECT s.arm, s.step, count(problem_id) FILTER (f.step = s.step) AS n_new, count(problem_id) AS unlocked FROM s LEFT JOIN f ON f.arm = s.arm AND f.step <= s.step GROUP BY ALL", "SELECT arm, count(*) AS unlocked FROM f GROUP BY arm"))
def z02(s, d):
    return Z.run_available(Z.solved(Z.source(s, landed(s, d), EVENTS)), "append").groupBy("arm").agg(F.count("*").alias("unlocked"))


@query("z03_stream_dedup", f"WITH {EVA} SELECT arm, count(*) AS n, sum(reward) AS reward FROM ev GROUP BY arm")
def z03(s, d):
    out = Z.run_available(Z.deduplicated(Z.source(s, landed(s, d, True), EVENTS), late="40 days"), "append")
    return out.groupBy("arm").agg(F.count("*").alias("n"), F.sum("reward").alias("reward"))


@query("z04_stream_call_rates", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS \"end\", count(*) AS n_calls, round(avg(value), 6) AS mean_value, max(value) AS max_value FROM events GROUP BY ALL")
def z04(s, d):
    return rounded(Z.run_available(Z.call_rates(Z.source(s, landed(s, d), EVENTS), size="6 hours", late="40 days"), "complete"))


@query("z04_sliding_call_rates", "SELECT start, start + INTERVAL '12 hours' AS \"end\", count(*) AS n_calls, round(avg(value), 6) AS mean_value, max(value) AS max_value FROM (SELECT value, unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS start FROM events) GROUP BY ALL")
def z04b(s, d):
    return rounded(Z.run_available(Z.call_rates(Z.source(s, landed(s, d), EVENTS), size="12 hours", slide="6 hours", late="40 days"), "complete"))
