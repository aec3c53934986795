"""A Merkle manifest of a dataset: leaves per record, roots per language and for all, and a proof for each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, let, parts, written

#: Children of a node, and hexadecimal digits of a digest.
FAN, HEX = 8, 64
#: Levels inside a block: 8 ** 3 nodes, a string of 32 KB.
LEVELS = 3
BLOCK = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(**instead) -> Column:
    """SHA-256 of the record's fields: each ``-`` if null, else byte count, colon, value."""
    fields = []
    for c in COLUMNS:
        value = instead.get(c, F.col(c)).cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def ranked(rows: DataFrame, group: str, order: list[str], rows_per_part: int = 100_000) -> DataFrame:
    """Add ``rank``, 0, 1, ... in each group by ``order``, and ``n``, the group's rows; no task sorts a whole group.

    ``rows`` is a written table. Rows are dealt by ranges of group and order, equal ones by their place in the table as well,
    numbered within (range, group), and shifted by what the earlier ranges hold.
    """
    spark = rows.sparkSession
    ranges = parts(spark, rows.count(), rows_per_part, 64)
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, group, *order, "_row")
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = dealt.groupBy(group, "_range").agg(F.count("*").alias("_size"))
    whole = Window.partitionBy(group)
    before = F.sum("_size").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(group, "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order, "_row")) - 1
    found = dealt.withColumn("_inside", inside).join(sizes, [group, "_range"])
    return found.withColumn("rank", F.col("_before") + F.col("_inside")).drop("_row", "_range", "_inside", "_before")


def level_strings(nodes: DataFrame, item: str = "item") -> DataFrame:
    """Blocks of ``BLOCK`` consecutive nodes (g, rank, n, node, item): g, n, b, items, s0 .. s3, height, top.

    s0 is the block's digests as one string; s1 hashes its substrings of eight digests, and so on, as far as the group has
    levels (``height``; the same in all blocks of a group). ``top`` is the block's last digest.
    """
    blocks = nodes.groupBy("g", "n", F.expr(f"rank div {BLOCK}").alias("b")).agg(F.sort_array(F.collect_list(F.struct("rank", "node", item))).alias("items"))
    height = F.expr(f"least({LEVELS}, size(filter(sequence(0, 20), k -> shiftleft(1L, 3 * k) < n)))")
    blocks = blocks.withColumns({"height": height, "s0": F.concat_ws("", F.col("items.node"))})
    for k in range(LEVELS):
        run = f"concat_ws('', transform(sequence(0, cast((length(s{k}) - 1) div {FAN * HEX} as int)), i -> sha2(substring(s{k}, i * {FAN * HEX} + 1, {FAN * HEX}), 256)))"
        blocks = blocks.withColumn(f"s{k + 1}", F.expr(f"if(height > {k}, {run}, s{k})"))
    return blocks.withColumn("top", F.col(f"s{LEVELS}"))


#: What stands left and right of node p of a block at each of its levels: of the run of eight, without the node itself.
LEFT = f"substring(s, shiftright(p, 3 * k + 3) * {FAN * HEX} + 1, (shiftright(p, 3 * k) % {FAN}) * {HEX})"
RIGHT = f"substring(s, shiftright(p, 3 * k) * {HEX} + {HEX + 1}, ({FAN - 1} - shiftright(p, 3 * k) % {FAN}) * {HEX})"
FLANKS = f"transform(slice(array({', '.join(f's{k}' for k in range(LEVELS))}), 1, height), (s, k) -> struct({LEFT} as l, {RIGHT} as r))"


def climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Written tables of blocks, from the nodes (g, rank, n, node, item) up to one block per group."""
    levels = []
    while True:
        blocks = written(level_strings(nodes), f"{name}{len(levels)}")
        levels.append(blocks)
        if not blocks.where("b > 0").head(1):
            return levels
        nodes = blocks.select("g", F.col("b").alias("rank"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("top").alias("node"), F.lit(None).cast("int").alias("item"))


def descend(levels: list[DataFrame], crowns: DataFrame) -> DataFrame:
    """item, node, flanks and the columns of ``crowns`` for every lowest node.

    ``crowns`` has a row per group: g, flanks (above the group's root) and more. Going down, a block's nodes get their own
    flanks before those of the block. Joins are on (group, block) and a row per block is joined, never one per node.
    """
    more = [c for c in crowns.columns if c not in ("g", "flanks")]
    above = crowns.withColumn("b", F.lit(0).cast("long"))
    for i, blocks in reversed(list(enumerate(levels))):
        joined = blocks.join(above.withColumnRenamed("flanks", "higher"), ["g", "b"])
        member = let(f"cast(e.rank % {BLOCK} as int)", "p", f"struct(e.rank, e.node, e.item, concat({FLANKS}, higher) as flanks)")
        spread = joined.select(*more, "g", F.explode(F.expr(f"transform(items, e -> {member})")).alias("e"))
        if not i:
            return spread.select("e.item", "e.node", "e.flanks", *more)
        above = written(spread.select("g", F.col("e.rank").alias("b"), "e.flanks", *more), "flanks")
    raise ValueError("no levels")


def merkle_manifest(docs: DataFrame, tampered=None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every record of ``docs``.

    Leaves of a language stand by doc_id (null first, equal ones by leaf). While there is more than one node, every eight
    consecutive ones become the SHA-256 of their hexadecimal digits; the languages' roots, null first and then by bytes, are
    joined likewise. Blocks of 512 aligned nodes hold each level as one string and reduce it by three levels; blocks are nodes
    of the next round, so nothing larger than a block is in one row and a language with all rows is dealt like any other.
    ``folded_root`` folds a record's leaf, with ``tampered`` in place of its text, with the flanks of its path.

    ``tampered`` is a column for the text as found later (default: A-Z lower-cased where 3 divides crc32 of doc_id; a null doc_id counts as empty
    there). Null fields have a digest of their own, other than empty ones. Repeated rows are leaves of their own. Other
    columns are not read. An empty table gives an empty result.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    if tampered is None:
        tampered = F.when(crc_mod("doc_id", 3) == 0, F.translate("text", upper, lower)).otherwise(F.col("text"))
    rows = docs.select(
        "doc_id",
        # In the order of the languages: none first.
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang").cast("string"))).alias("g"),
        leaf_digest().alias("node"),
        leaf_digest(text=tampered).alias("found"),
    ).withColumn("found", F.when(F.col("found") != F.col("node"), F.col("found")))
    leaves = ranked(written(rows, "leaves"), "g", ["doc_id", "node"])
    levels = climb(leaves.select("g", "rank", "n", "node", F.struct("doc_id", "found").alias("item")), "blocks")

    roots = written(levels[-1].select(F.lit(0).alias("all"), F.col("g").alias("lang_key"), F.col("top").alias("node")), "roots")
    tops = ranked(roots, "all", ["lang_key"]).select(F.lit("").alias("g"), "rank", "n", "node", F.col("lang_key").alias("item"))
    crown = climb(tops, "crown")
    last = crown[-1].select("g", F.expr("cast(array() as array<struct<l string, r string>>)").alias("flanks"), F.col("top").alias("root"))
    subroots = descend(crown, last).select(F.col("item").alias("g"), F.col("node").alias("subroot"), "flanks", "root")

    found = descend(levels, written(subroots, "subroots"))
    folded = F.expr("aggregate(flanks, coalesce(item.found, node), (x, f) -> sha2(concat(f.l, x, f.r), 256))")
    proof = F.expr("sha2(cast(concat_ws('', transform(flanks, f -> concat(f.l, f.r))) as binary), 256)")
    out = found.select("item.doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
