"""Files of rollouts, logs and labels: readers with fixed schemas, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nested evaluation documents.
EVAL_DOC = "label string, ckpt_path string, n_rollouts int, datasets map<string, struct<n_prompts: bigint, pass_at_k: map<string, double>, mean_reward_at_1: double, per_prompt: array<struct<problem_id: string, ground_truth: string, n_correct: bigint, rewards: array<double>, preds: array<string>, rollouts: array<string>>>>>"
#: The same without rollouts, so that they are never parsed.
EVAL_HEADER = "label string, n_rollouts int, datasets map<string, struct<n_prompts: bigint, pass_at_k: map<string, double>, mean_reward_at_1: double>>"
STEP_LOG = "global_step int, prompt_id string, rollout_idx int, parsed_answer string, reward double, cluster_id bigint, finish_reason string, response_length int"


def read_jsonl(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped, bad ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_permissive(spark: SparkSession, path, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and the text of the lines that do not."""
    full = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", full, {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt"), parsed.where(bad).select(F.col("value").alias("line"))


def flatten_eval(docs: DataFrame, arm: str = "label") -> DataFrame:
    """Evaluation documents to a row per (arm, dataset, problem, rollout)."""
    per = docs.select(F.col(arm).alias("arm"), F.explode("datasets").alias("dataset", "d")).select("arm", "dataset", F.explode("d.per_prompt").alias("p"))
    return per.select("arm", "dataset", F.col("p.problem_id").alias("problem_id"), F.col("p.ground_truth").alias("gold"), F.posexplode(F.arrays_zip("p.rewards", "p.preds", "p.rollouts")).alias("rollout_idx", "r")).select(
        "arm", "dataset", "problem_id", "gold", "rollout_idx", F.col("r.rewards").alias("reward"), F.col("r.preds").alias("pred"), F.col("r.rollouts").alias("completion")
    )


def dedup_latest(df: DataFrame, keys, order) -> DataFrame:
    """The row of each key that is last in an order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def compact_eval(docs: DataFrame) -> DataFrame:
    """Evaluation documents without rollouts: an array of small structs per document and dataset."""
    per = docs.select("label", F.explode("datasets").alias("dataset", "d"))
    slim = F.transform("d.per_prompt", lambda p: F.struct(p["problem_id"].alias("problem_id"), p["n_correct"].alias("n_correct"), p["rewards"].alias("rewards"), p["preds"].alias("preds")))
    return per.select("label", "dataset", F.col("d.n_prompts").alias("n_prompts"), slim.alias("per_prompt"))


def eval_header(docs: DataFrame) -> DataFrame:
    """pass@k and prompt counts, without a look at per-prompt rows."""
    per = docs.select("label", F.explode("datasets").alias("dataset", "d"))
    return per.select("label", "dataset", "d.n_prompts", F.explode("d.pass_at_k").alias("k", "pass_at_k")).withColumn("k", F.col("k").cast("int"))


def read_step_log(spark: SparkSession, root: str, lo: int | None = None, hi: int | None = None, every: int = 1, schema: str = STEP_LOG) -> DataFrame:
    """Step logs ``<root>/<run>/step_N*`` with run and step from the path; other steps' files are never opened."""
    # The glob lists files once; those of other steps are left out before reading.
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/*/step_*")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    paths = [str(f.getPath()) for f in found]
    number = lambda p: int(p.rsplit("step_", 1)[1].split(".")[0].split("/")[0])
    chosen = [p for p in paths if (lo is None or number(p) >= lo) and (hi is None or number(p) <= hi) and (number(p) - (lo or 0)) % every == 0]
    if not chosen:
        return spark.createDataFrame([], T._parse_datatype_string(schema)).withColumns({"run": F.lit(""), "step": F.lit(0)})
    name = F.col("_metadata.file_path")
    return spark.read.schema(schema).json(chosen).withColumns({"run": F.regexp_extract(name, r"/([^/]+)/step_[0-9]+[^/]*", 1), "step": F.regexp_extract(name, r"/step_([0-9]+)", 1).cast("int"), "mtime": F.col("_metadata.file_modification_time")})


def resolve_resumes(df: DataFrame, policy: str = "resume", resumed: Column | str = "is_resume", by=("arm", "step")) -> DataFrame:
    """Rows of one run for each (arm, step): a resumed run before others, or the file changed last."""
    order = {"resume": [F.desc(resumed), F.desc("mtime")], "mtime": [F.desc("mtime"), F.desc(resumed)]}[policy]
    w = Window.partitionBy(*by).orderBy(*order, F.desc("run"))
    pick = df.select(*by, "run", "mtime", F.col(resumed) if isinstance(resumed, str) else resumed.alias("is_resume")).distinct()
    pick = pick.withColumn("_i", F.row_number().over(w)).where("_i = 1").select(*by, "run")
    return df.join(pick, [*by, "run"], "left_semi")


def merge_shards(spark: SparkSession, root: str, expect: int, schema: str) -> DataFrame:
    """All shards ``<root>/shard=i``, sorted by problem and rollout; an error if there are not as many as expected."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/shard=*")
    found = len(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or [])
    if found != expect:
        raise ValueError(f"{found} shards found, {expect} expected")
    rows = spark.read.schema(schema).option("basePath", root).json(f"{root}/shard=*")
    return rows.repartitionByRange("problem_id", "rollout_idx").sortWithinPartitions("problem_id", "rollout_idx")


def shard(df: DataFrame, i: int, n: int, key: str = "problem_id") -> DataFrame:
    return df.where(F.pmod(F.col(key), F.lit(n)) == i)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; tabs and line ends in cells become spaces."""
    cells = [F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " ").alias(c) for c in df.columns]
    df.select(*cells).write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write_split(df: DataFrame, out: str, flag: str = "is_val") -> DataFrame:
    """Train and validation Parquet tables under a path (validation may overlap train), and their row counts."""
    df.drop(flag).write.parquet(f"{out}/train")
    df.where(flag).drop(flag).write.parquet(f"{out}/val")
    count = lambda part: df.sparkSession.read.parquet(f"{out}/{part}").agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return count("train").unionByName(count("val"))


def pivot_report(df: DataFrame, rows: str, cols: str, value: str, names) -> DataFrame:
    """A long result as a table with one column per name."""
    return df.groupBy(rows).pivot(cols, list(names)).agg(F.first(value))


def markdown(df: DataFrame, rows: str) -> DataFrame:
    """A line of Markdown per row of a small report."""
    return df.select(rows, F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]), F.lit(" |")).alias("line"))


def fingerprint(df: DataFrame, cols) -> DataFrame:
    """A hash of a table that does not depend on the order of its rows."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256), 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.sum(h).alias("fingerprint"))


def latest_run(df: DataFrame, run: str = "run_id", stamp: str = "stamp", path: str = "path") -> DataFrame:
    """The newest stamped path of each run; a path without a stamp only if there is no other."""
    return df.groupBy(run).agg(F.max_by(path, F.coalesce(F.col(stamp), F.lit(""))).alias(path))
