"""Rollout tables read from the driver's tables, as DataFrames and as SQL for the oracles.

A rollout table R has: arm, step, problem_id, rollout_idx, pred, reward, cluster_id, finish_reason, response_length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where a row of ``read`` stands: its file, and its number there.
ROW_ORDER = ("_metadata.file_path", "_metadata.row_index")


def ev(spark: SparkSession, sf_dir: str, by_arm: bool = False) -> DataFrame:
    """Rollouts from ``events``: users are problems, event types answers and clusters (``error`` is degenerate)."""
    e = read(spark, sf_dir, "events")
    keys = ["problem_id", "arm"] if by_arm else ["problem_id"]
    k = F.get_json_object("props", "$.k").cast("int")
    return (
        e.withColumn("arm", F.concat(F.lit("a"), (F.col("event_id") % 2).cast("string")))
        .withColumn("problem_id", F.col("user_id"))
        .select(
            "arm",
            F.dayofmonth("ts").alias("step"),
            "problem_id",
            (F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id")) - 1).alias("rollout_idx"),
            F.col("event_type").alias("pred"),
            F.when(F.col("value") >= 100, 1.0).otherwise(0.0).alias("reward"),
            F.expr("case event_type when 'click' then 0L when 'purchase' then 1L when 'signup' then 2L when 'view' then 3L else -1L end").alias("cluster_id"),
            F.when(k >= 80, "length").when(k >= 40, "stop").otherwise("eos").alias("finish_reason"),
            k.alias("response_length"),
            "event_id",
            "ts",
            "value",
        )
    )


def ev8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rollouts of ``ev`` in groups of eight: each user's rollouts 0 to 7 are a problem, 8 to 15 the next, and so on."""
    return ev(spark, sf_dir).withColumns({"problem_id": F.expr("problem_id * 100000 + rollout_idx div 8"), "rollout_idx": F.col("rollout_idx") % 8})


def _ev_sql(name: str, keys: str) -> str:
    return f"""{name} AS (SELECT 'a' || (event_id % 2) AS arm, day(ts)::INT AS step, user_id AS problem_id,
    (row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) - 1)::INT AS rollout_idx, event_type AS pred,
    CASE WHEN value >= 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward,
    CASE event_type WHEN 'click' THEN 0::BIGINT WHEN 'purchase' THEN 1::BIGINT WHEN 'signup' THEN 2::BIGINT WHEN 'view' THEN 3::BIGINT ELSE (-1)::BIGINT END AS cluster_id,
    CASE WHEN k >= 80 THEN 'length' WHEN k >= 40 THEN 'stop' ELSE 'eos' END AS finish_reason, k AS response_length, event_id, ts, value
    FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events))"""


EV = _ev_sql("ev", "user_id")
EV8 = EV + ", e8 AS (SELECT * REPLACE (problem_id * 100000 + rollout_idx // 8 AS problem_id, (rollout_idx % 8)::INT AS rollout_idx) FROM ev)"
EVA = _ev_sql("ev", "user_id, event_id % 2")


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts from ``lineitem``: orders are problems; the band is the order's priority, which ``orders`` holds."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), "l_linestatus").alias("arm"),
        F.col("l_orderkey").alias("problem_id"),
        (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1).alias("rollout_idx"),
        F.col("l_quantity").cast("int").cast("string").alias("pred"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward"),
        (F.col("l_suppkey") % 4).alias("cluster_id"),
        (F.col("l_partkey") % 1000).cast("int").alias("response_length"),
    )


LI = """li AS (SELECT 's' || l_linestatus AS arm, l_orderkey AS problem_id,
    (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1)::INT AS rollout_idx,
    l_quantity::INT::VARCHAR AS pred, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward, (l_suppkey % 4)::BIGINT AS cluster_id, (l_partkey % 1000)::INT AS response_length
    FROM lineitem)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt manifest from ``orders``: problem_id, problem, gold, difficulty_band, hf_index."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("problem_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 7 == 0, ". Prove it.").when(F.col("o_orderkey") % 5 == 0, ". Show that it is so.").otherwise(". Find it.")).alias("problem"),
        F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("gold"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("difficulty_band"),
        F.col("o_orderkey").alias("hf_index"),
    )


MANIFEST = """manifest AS (SELECT o_orderkey AS problem_id, 'Order ' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '. Prove it.' WHEN o_orderkey % 5 = 0 THEN '. Show that it is so.' ELSE '. Find it.' END AS problem,
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_custkey::VARCHAR END AS gold, substr(o_orderpriority, 1, 1)::INT AS difficulty_band, o_orderkey AS hf_index FROM orders)"""
