"""Lines that many documents share are kept in one of them: line hashes in levelled sorted runs."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, written

SPACE = b" \t\n\x0b\x0c\r"
PAIR = np.dtype([("h1", "<i8"), ("h2", "<i8")])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of a lower-cased line stripped at both ends; None where it has fewer code points."""
    key = line.strip(SPACE)
    if len(key) < min_chars or len(key) < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """doc, h1, h2: the distinct long lines of each row (doc, text). Null and empty texts have none."""

    def hashes(batches):
        for batch in batches:
            owner, made = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    keys = {line_key(line, min_chars) for line in text.encode().lower().split(b"\n")}
                    keys.discard(None)
                    owner += [i] * len(keys)
                    made += keys
            pairs = np.frombuffer(b"".join(made), PAIR)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), pa.array(pairs["h1"]), pa.array(pairs["h2"])], ["doc", "h1", "h2"])

    return docs.mapInArrow(hashes, f"doc {docs.schema['doc'].dataType.simpleString()}, h1 long, h2 long")


class LineRuns:
    """Runs of line hashes (h1, h2, docs, owner), each sorted and bucketed by the hash, in levels.

    A batch of documents brings the lines' hashes with the number of its documents. Hashes that no run holds are new: the
    batch's largest document owns them. The others only add to the count. Both go into a run of the batch's own at level 0; ``fanout`` runs
    of a level are merged into one of the next, so there are at most ``fanout - 1`` runs a level to look into, and a hash is
    rewritten once a level. Runs are tables: a lost executor loses none, and a join with them moves only the batch.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4):
        """As many buckets as Spark's shuffles have partitions, so that a batch is dealt once, as it is counted."""
        self.buckets, self.fanout = int(spark.conf.get("spark.sql.shuffle.partitions")), fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of distinct (doc, h1, h2); gives the batch's run."""
        batch = lines.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("last"))
        owner = F.col("last")
        if self.runs():
            fresh = batch.select("h1", "h2", F.lit(True).alias("fresh"))
            for run in self.runs():
                fresh = fresh.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            batch = batch.join(fresh.hint("merge"), ["h1", "h2"], "left")
            owner = F.when(F.col("fresh"), owner)
        run = self._write(batch.select("h1", "h2", "docs", owner.alias("owner")))
        self._place(run, 0)
        return run

    def merged(self) -> DataFrame:
        """All runs as one: h1, h2, docs, owner."""
        return self._merge(self.runs())

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for run in runs[1:]:
            both = both.unionByName(run)
        # By a struct: Spark 4.1 takes a union of bucketed tables for dealt by the columns, and then reads them as if they were not.
        merged = both.groupBy(F.struct("h1", "h2").alias("h")).agg(F.sum("docs").alias("docs"), F.max("owner").alias("owner"))
        return merged.select("h.h1", "h.h2", "docs", "owner")

    def _write(self, run: DataFrame) -> DataFrame:
        return bucketed(run, "run", ("h1", "h2"), self.buckets, sort=True)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = self._write(self._merge(self.levels[level]))
            self.levels[level] = []
            self._place(merged, level + 1)


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    key: str = "doc_id",
    text: str = "text",
    batches: int = 6,
    fanout: int = 3,
    broadcast_lines: int = 500_000,
) -> DataFrame:
    """Drop the lines of at least ``min_chars`` code points that at least ``min_docs`` documents hold, but in the largest document
    that holds them: key, kept (the text left), n_lines, n_dropped.

    Lines are compared without white space at both ends and with A-Z lower-cased, by 128-bit hashes. Documents are taken in
    batches from the largest ids down, so the first batch that brings a line holds its owner; see ``LineRuns``. The lines over
    the threshold then go to all tasks where they are at most ``broadcast_lines`` (24 bytes each); otherwise each document gets
    its own lines to drop by a join. Either way every line of every text is judged.

    Null or empty text is one empty line. A document is an id: repeated rows of one id count once and are cut alike; a null id is one
    document under all others. Repeated lines go or stay together. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    ids = rows.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    batch = F.lit(batches - 1)
    for i, mark in enumerate(sorted(set(ids))):
        batch = F.when(F.col("doc") > F.lit(mark), batches - 2 - i).otherwise(batch)
    lines = line_hashes(rows, min_chars)
    if rows.groupBy("doc").count().where("count > 1").head(1):
        lines = lines.distinct()
    lines = written(lines.withColumn("batch", batch), "lines", by="batch")
    runs = LineRuns(spark, fanout)
    for i in range(batches):
        runs.add(lines.where(F.col("batch") == i).drop("batch"))
    shared = written(runs.merged().where(F.col("docs") >= min_docs).select("h1", "h2", "owner"), "shared")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, kept string, n_lines long, n_dropped long"
    if shared.count() <= broadcast_lines:
        sent = spark.sparkContext.broadcast(_packed(shared))
        return rows.mapInArrow(lambda batches: _cut(batches, min_chars, names=(key, "kept", "n_lines", "n_dropped"), shared=sent.value), schema)
    gone = lines.join(shared, ["h1", "h2"]).where("owner is distinct from doc")
    packed = F.concat(*(F.lpad(F.hex(h), 16, "0") for h in ("h1", "h2")))
    gone = gone.groupBy("doc").agg(F.collect_set(packed).alias("gone")).withColumnRenamed("doc", "at")
    joined = rows.join(gone, F.col("doc").eqNullSafe(F.col("at")), "left").select("doc", "text", "gone")
    return joined.mapInArrow(lambda batches: _cut(batches, min_chars, names=(key, "kept", "n_lines", "n_dropped")), schema)


def _packed(shared: DataFrame) -> dict[bytes, int]:
    """Line hash to owner, as the tasks look them up."""
    t = shared.toArrow()
    pairs = np.empty(t.num_rows, PAIR)
    pairs["h1"], pairs["h2"] = t.column("h1").to_numpy(), t.column("h2").to_numpy()
    data = pairs.tobytes()
    return {data[16 * i : 16 * i + 16]: owner for i, owner in enumerate(t.column("owner").to_pylist())}


def _cut(batches, min_chars: int, names, shared: dict | None = None):
    """Texts without the lines that go: those of ``shared`` with another owner, or those named in the third column."""
    for batch in batches:
        kept, n_lines, n_dropped = [], [], []
        named = batch.column(2).to_pylist() if shared is None else [None] * batch.num_rows
        for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), named, strict=True):
            gone = {np.array([int(x[:16], 16), int(x[16:], 16)], "<u8").tobytes() for x in own or ()}
            lines = (text or "").split("\n")
            left = lines
            if shared or gone:
                keys = [line_key(x, min_chars) for x in (text or "").encode().lower().split(b"\n")]
                if shared:
                    left = [x for x, k in zip(lines, keys, strict=True) if k is None or shared.get(k, doc) == doc]
                else:
                    left = [x for x, k in zip(lines, keys, strict=True) if k not in gone]
            kept.append("\n".join(left)), n_lines.append(len(lines)), n_dropped.append(len(lines) - len(left))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], list(names))


def line_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The result with a digest in place of the text."""
    return found.select(key, "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
