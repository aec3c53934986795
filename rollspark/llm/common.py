"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java's ``\s`` is exactly space and U+0009 to U+000D, the word separators of every operator here.
WORDS = r"filter(split({text}, '\\s+'), w -> w <> '')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a folder of our own in local
    mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in folders ``by`` a column if one is given, and read it back: lineage is
    cut, and lost executors lose nothing.

    The table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # Small row groups, so that a large file is read by several tasks.
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path, partitionBy=by)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str | tuple[str, ...], buckets: int, sort: bool = False) -> DataFrame:
    """Like ``written``, in buckets of columns, sorted by them on demand: what groups by them afterwards reads the table without
    a shuffle."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{name}"
    columns = [column] if isinstance(column, str) else list(column)
    writer = df.write.bucketBy(buckets, columns)
    writer = writer.sortBy(columns) if sort else writer
    writer.format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    return spark.table(name)


def released(df: DataFrame) -> None:
    """Delete what ``written`` has written for ``df``, once all that was made of it is written itself."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(conf).delete(at, True)


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def crc_mod(key: str, n: int):
    """crc32 of the key as text, mod n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def parts(spark: SparkSession, rows: int, per_part: int, least: int = 1) -> int:
    """A count of partitions that grows with the rows."""
    return max(least, -(-rows // per_part))
