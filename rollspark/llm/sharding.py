"""Sharding by sampled splitters, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import let, written


def shard_by_splitters(
    docs: DataFrame,
    n_shards: int = 8,
    key: str = "doc_id",
    text: str = "text",
    ranges: int = 2048,
    oversample: int = 8,
    rows_per_range: int = 50_000,
    max_ranges: int = 65_536,
    least_lots: int = 256,
) -> DataFrame:
    """Range-partition documents by the hash of their text so that every shard holds nearly the same bytes.

    1. Records enter a sample with probability proportional to size (UTF-8 bytes plus one); about ``ranges * oversample``
       keys are drawn, whatever the input. 2. Quantiles of the sample are the splitters of ``ranges`` fine ranges (more
       when there are more rows than ``rows_per_range`` for each, to ``max_ranges``). 3. Exact range sizes are summed; an
       range over its share of the bytes or over ``rows_per_range`` rows (one text, or one row, may be a third of all) is
       subdivided by the hash of the key and the row's number among its equals (counted in ``least_lots`` lots, or more so that a
       lot of even the whole table has about ``rows_per_range`` rows). 4. Ranges and pieces,
       in order, go to shards by exact prefix sums, so equal texts stay together unless their range is overfull or a
       shard ends inside it.

    Law: ``bytes``. Null text: size 1 and the crc of no bytes. Repeated rows and null keys are separate records with slots of their own.
    An empty table gives an empty result. Slots follow (range, piece, key, crc) and are gapless from 0 in each shard.
    Only samples, splitters and sizes of ranges (bounded by ``max_ranges``) reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"),
    )
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # tells repeated rows apart, once written
    rows = written(rows.withColumn("u", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("draw"), "h")), "sizes")
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 1
    ranges = int(min(max_ranges, max(ranges, n // rows_per_range)))
    want = ranges * oversample
    # Size-weighted: kept when a uniform draw from the record's own hash is under size * want / total.
    uniform = (F.shiftrightunsigned("u", 11).cast("double")) / float(1 << 53)
    drawn = rows.where(uniform < F.col("size") * F.lit(want / total)).select("h")
    # Quantiles of the sample, each an existing key; equal splitters collapse.
    marks = [(i + 1) / ranges for i in range(ranges - 1)]
    found = drawn.agg(F.percentile_approx("h", marks, 10 * ranges)).first()[0] or []
    splitters = sorted(set(found))
    ranged = rows.withColumn("range", _range_of(splitters)).drop("u")

    # Exact sizes; a range over its share of bytes or rows is dealt into pieces by the key's hash and, since rows may be
    # repeated, each row's number among its equals.
    sizes = {r["range"]: r for r in ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    share = max(1, total // ranges)
    pieces = [1] * (len(splitters) + 1)
    for i, r in sizes.items():
        pieces[i] = max(-(-r["b"] // share) if r["b"] > 2 * share else 1, -(-r["n"] // rows_per_range))
    count = F.element_at(F.lit(pieces), F.col("range") + 1).cast("long")
    counted = ranged.withColumn("pieces", count)
    whole = counted.where("pieces = 1").withColumn("piece", F.lit(0).cast("long")).drop("pieces", "row")
    split = numbered(counted.where("pieces > 1"), ["doc_id", "h"], "row", max(least_lots, n // rows_per_range))
    split = split.withColumn("piece", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "h", "number"), "pieces")).drop("pieces", "number")
    dealt = whole.unionByName(split)

    # Prefix sums over pieces: their number follows the ranges, not the rows.
    unit = dealt.groupBy("range", "piece").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    placed = unit.withColumn("before", F.sum("b").over(Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)))
    middle = F.coalesce(F.col("before"), F.lit(0)) + F.col("b") / 2
    placed = placed.withColumn("shard", F.least(F.floor(middle * n_shards / F.lit(float(total))), F.lit(n_shards - 1)).cast("int"))
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.select("range", "piece", "shard", F.coalesce(first, F.lit(0)).alias("first"))

    inside = Window.partitionBy("range", "piece").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("at", F.row_number().over(inside))
        .join(placed, ["range", "piece"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("at") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def numbered(rows: DataFrame, by: list[str], row: str, salts: int) -> DataFrame:
    """Add ``number``: 0, 1, ... among the rows with equal ``by``, in place of the column ``row``, which tells all rows apart.

    Equals are counted in ``salts`` lots of their own, so that no window holds all of a group.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(row), F.lit(salts)))
    lots = salted.groupBy(*by, "salt").agg(F.count("*").alias("lot"))
    before = F.sum("lot").over(Window.partitionBy(*by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    lots = lots.withColumn("before", F.coalesce(before, F.lit(0))).select(*[F.col(c).alias(f"{c}_lot") for c in (*by, "salt")], "before")
    inside = F.row_number().over(Window.partitionBy(*by, "salt").orderBy(row)) - 1
    same = [F.col(c).eqNullSafe(F.col(f"{c}_lot")) for c in (*by, "salt")]
    found = salted.withColumn("inside", inside)
    for c in same[1:]:
        same[0] = same[0] & c
    return found.join(lots, same[0]).withColumn("number", F.col("before") + F.col("inside")).select(*[c for c in rows.columns if c != row], "number")


def _range_of(splitters: list[int]):
    """How many splitters are at or under the hash, by two steps of about the square root of their number."""
    if not splitters:
        return F.lit(0)
    step = max(1, round(len(splitters) ** 0.5))
    coarse = splitters[::step]
    fine = [splitters[i : i + step] for i in range(0, len(splitters), step)]

    def longs(xs):
        return "array(" + ",".join(f"{x}L" if x != -(1 << 63) else "bigint(-9223372036854775808)" for x in xs) + ")"

    inner = f"(c - 1) * {step} + size(filter(array({','.join(map(longs, fine))})[c - 1], b -> b <= h))"
    return F.expr(let(f"size(filter({longs(coarse)}, b -> b <= h))", "c", f"if(c = 0, 0, {inner})")).cast("int")
