"""Step logs and call logs as streams; each has a batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollspark.sources.files import STEP_LOG
from rollspark.sources.scratch import shared_path


def source(spark: SparkSession, path: str, schema: str = STEP_LOG, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of JSON files as they land."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def step_metrics(rows: DataFrame) -> DataFrame:
    """Rates per arm and step that a single aggregation can give, for batch and stream alike."""
    right = F.col("reward") > 0
    return rows.groupBy("arm", "step").agg(
        F.count("*").alias("n_rollouts"), F.avg("reward").alias("mean_reward"), F.avg("response_length").alias("mean_length"),
        F.count_if(right).alias("n_correct"), F.count_if(F.col("finish_reason") == "length").alias("n_cut"),
    )


def cluster_counts(rows: DataFrame) -> DataFrame:
    """Rollouts and correct ones by cluster of a problem, for batch and stream alike; state is a row per cluster."""
    return rows.groupBy("arm", "step", "problem_id", "cluster_id").agg(F.count("*").alias("n"), F.count_if(F.col("reward") > 0).alias("c"))


def step_rates(counts: DataFrame) -> DataFrame:
    """From ``cluster_counts``: per arm and step the shares of problems with any correct rollout, with some, none or all
    correct, and with a correct minority among their clusters, and the share of rollouts that have a cluster."""
    right = F.when((F.col("c") > 0) & (F.col("cluster_id") != -1), F.col("c"))
    pp = counts.groupBy("arm", "step", "problem_id").agg(
        F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum(F.when(F.col("cluster_id") != -1, F.col("n")).otherwise(0)).alias("ok"), F.coalesce(F.min(right) < F.max(right), F.lit(False)).alias("minority")
    )
    rate = lambda x: F.avg(x.cast("double"))
    return pp.groupBy("arm", "step").agg(
        F.count("*").alias("n_prompts"), rate(F.col("c") > 0).alias("any_correct"), rate((F.col("c") > 0) & (F.col("c") < F.col("n"))).alias("mixed"), rate(F.col("c") == 0).alias("all_wrong"),
        rate(F.col("c") == F.col("n")).alias("all_correct"), rate(F.col("minority")).alias("minority_rate"), (F.sum("ok") / F.sum("n")).alias("parse_rate"),
    )


def solved(rows: DataFrame) -> DataFrame:
    """Problems solved for the first time, one row each; state is a row per (arm, problem)."""
    return rows.where("reward > 0").select("arm", "problem_id").dropDuplicates(["arm", "problem_id"])


def deduplicated(rows: DataFrame, stamp: str = "ts", late: str = "10 minutes") -> DataFrame:
    """One row for each (arm, step, problem, rollout) that repeats within ``late``; later rows are dropped as too late."""
    keys = ["arm", "step", "problem_id", "rollout_idx"]
    if rows.isStreaming:
        return rows.withWatermark(stamp, late).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)


def call_rates(rows: DataFrame, stamp: str = "ts", size: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Calls per tumbling or sliding window, with means of their diagnostics."""
    w = F.window(stamp, size, slide) if slide else F.window(stamp, size)
    return rows.withWatermark(stamp, late).groupBy(w.alias("w")).agg(F.count("*").alias("n_calls"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_calls", "mean_value", "max_value")


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and give its result as a table.

    Complete and append results are written batch by batch to a shared folder; a complete result is its last batch.
    """
    spark = stream.sparkSession
    out, state = shared_path(spark, "stream"), shared_path(spark, "stream-state")
    last: list[int] = []

    def sink(batch: DataFrame, number: int) -> None:
        # The path follows the batch number, so a batch that is tried again replaces itself.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last.append(number)

    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{out}/batch={max(last)}")
    return spark.read.schema(stream.schema).option("basePath", out).parquet(*[f"{out}/batch={n}" for n in sorted(set(last))]).select(*stream.columns)
