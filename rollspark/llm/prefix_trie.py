"""The trie of conversation prefixes: how many conversations share each beginning, and what storing it once would save."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, written
from .merkle import ranked
from .perfect_hash import SlotTable

NODE = "d1 long, d2 long, p1 long, p2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
#: Ids whose numbers differ in these low bits alone are joined to one string before a node's ids are hashed.
ID_BITS = 7


def ordered_turns(convs: DataFrame) -> DataFrame:
    """c, pos (from 0), own (turns of c), t1, t2 (128 bits of role and text), words: the turns in order; texts are left behind
    at the scan. A conversation with a third of all turns is ordered by ranges, as any other (``ranked``)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = convs.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"),
        "turn",
        F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit(2), role, text).alias("t2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return ranked(written(turns, "turn-hashes"), "c", ["turn", "t1", "t2"]).select("c", F.col("rank").alias("pos"), F.col("n").alias("own"), "t1", "t2", "words")


def rebuilt_turns(turns: DataFrame, span: int = 20, heads: int = 4, chunk: int = 4096) -> DataFrame:
    """c, d, n, chunk, t1, t2, words: the first h turns of conversation c - c % span, then c's own after its first h.

    h = crc32(decimal c) % heads; d counts the n rebuilt turns from 1. A row with d = 0 stands for the conversation itself. Long
    conversations go in chunks of their own turns, and what is joined to them once per chunk.
    """
    share = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    firsts = turns.where("pos = 0").select("c", (F.col("c") - F.col("c") % span).alias("b"), share.alias("h"), "own")
    lenders = turns.where((F.col("c") % span == 0) & (F.col("pos") < heads - 1)).select(F.col("c").alias("b"), "pos", "t1", "t2", "words")
    sizes = lenders.groupBy("b").agg(F.count("*").alias("has"))
    convs = firsts.join(sizes, "b", "left").withColumn("lent", F.least("h", F.coalesce("has", F.lit(0))))
    convs = convs.select("c", "b", "h", "own", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    zero, first = F.lit(0).cast("long"), F.lit(0).cast("long").alias("chunk")
    start = convs.select("c", zero.alias("d"), "n", first, zero.alias("t1"), zero.alias("t2"), zero.alias("words"))
    lent = convs.where("lent > 0").join(lenders, "b").where("pos < lent").select("c", (F.col("pos") + 1).alias("d"), "n", first, "t1", "t2", "words")
    spread = convs.select("c", "h", "lent", "n", F.explode(F.expr(f"sequence(0L, own div {chunk})")).alias("chunk"))
    rest = turns.withColumn("chunk", F.expr(f"pos div {chunk}")).join(spread, ["c", "chunk"]).where("pos >= h")
    rest = rest.select("c", (F.col("pos") - F.col("h") + F.col("lent") + 1).alias("d"), "n", "chunk", "t1", "t2", "words")
    return start.unionByName(lent).unionByName(rest)


def prefix_digests(rows: DataFrame) -> DataFrame:
    """c, d, n, d1, d2, p1, p2, t1, t2, words: each prefix with its digest, its parent's digest and the turns n of c.

    A digest is the exclusive or of the turns' hashes, keyed by position: a running aggregate within a chunk, to which the
    earlier chunks of a long conversation are added.
    """
    zero = F.lit(0).cast("long")
    keyed = rows.withColumns({f"x{i}": F.when(F.col("d") > 0, F.xxhash64(F.lit(i), "d", "t1", "t2")).otherwise(zero) for i in (1, 2)})
    long_ = keyed.where("chunk > 0").select("c").distinct()
    sums = keyed.join(long_, "c", "left_semi").groupBy("c", "chunk").agg(*(F.bit_xor(f"x{i}").alias(f"b{i}") for i in (1, 2)))
    earlier = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("c", "chunk", *(F.bit_xor(f"b{i}").over(earlier).alias(f"b{i}") for i in (1, 2)))
    inside = Window.partitionBy("c", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    found = keyed.withColumns({f"d{i}": F.bit_xor(f"x{i}").over(inside) for i in (1, 2)}).join(sums, ["c", "chunk"], "left")
    found = found.withColumns({f"d{i}": F.col(f"d{i}").bitwiseXOR(F.coalesce(F.col(f"b{i}"), zero)) for i in (1, 2)})
    return found.select("c", "d", "n", "d1", "d2", *(F.col(f"d{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)), "t1", "t2", "words")


def distinct_nodes(paths: DataFrame) -> DataFrame:
    """One row per distinct prefix: d1, d2, p1, p2, depth, words, n_convs, conv_id (smallest) and weight, the rows of
    ``paths`` at and under it. Depth, parent and last turn must be one for a digest, else the job fails."""
    what = F.struct("d", "p1", "p2", "t1", "t2", "words")
    nodes = paths.groupBy("d1", "d2").agg(
        F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.sum(F.col("n") - F.col("d") + 1).alias("weight"), F.min(what).alias("one"), F.max(what).alias("other")
    )
    sure = F.when(F.col("one") == F.col("other"), F.col("one")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast(nodes.schema["one"].dataType))
    nodes = nodes.withColumn("one", sure)
    return nodes.select("d1", "d2", "one.p1", "one.p2", F.col("one.d").alias("depth"), "one.words", "n_convs", "conv_id", "weight")


def id_digests(ends: DataFrame) -> DataFrame:
    """d1, d2, ends_sha256: SHA-256 of a node's ids in ascending order, joined by commas.

    Ids (distinct) are first joined in runs of ``2 ** ID_BITS`` consecutive numbers, which bounds such a string; the runs of a
    node then stream, sorted, through one running hash, so a node that ends a third of all conversations is never held.
    """
    runs = ends.groupBy("d1", "d2", F.shiftright("c", ID_BITS).alias("run")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))
    runs = runs.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "run")

    def digest(batches):
        node, state = None, None
        for batch in batches:
            made: list[tuple] = []
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (a, b) == node:
                    state.update(b",")
                else:
                    if node:
                        made.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            if made:
                yield _columns(made)
        if node:
            yield _columns([(*node, state.hexdigest())])

    return runs.mapInArrow(digest, "d1 long, d2 long, ends_sha256 string")


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], ["d1", "d2", "ends_sha256"])


def accumulate(shard: pa.Table) -> pa.Table:
    """Sums over the subtrees of one shard's nodes: leaves, saved tokens; children of each node and its parent's name.

    Slots come from a minimal perfect hash of the digests. Columns are scattered into flat arrays by slot, parents are found
    by slot, and levels are added to their parents from the deepest up. ``got_...`` is what shards further down have sent.
    """
    col = {c: shard.column(c).to_numpy() for c in shard.column_names}
    n = shard.num_rows
    table = SlotTable(col["d1"], col["d2"])
    slot = table.slots(col["d1"], col["d2"])

    def scattered(name):
        out = np.empty(n, np.int64)
        out[slot] = col[name]
        return out

    at = {c: scattered(c) for c in col}
    parent = table.slots(at["p1"], at["p2"])
    parent[at["depth"] == 0] = -1
    inside = parent >= 0
    children = at["got_children"]
    np.add.at(children, parent[inside], 1)
    leaves = np.where(children == 0, 1, at["got_leaves"])
    saved = (at["n_convs"] - 1) * at["words"] + at["got_saved"]
    order = np.argsort(-at["depth"], kind="stable")
    ends = np.flatnonzero(np.diff(at["depth"][order])) + 1
    for level in np.split(order, ends):
        level = level[inside[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    above = np.where(inside, at["conv_id"][parent], at["above"])
    root = at["depth"] == 0
    return pa.table(
        {
            **{c: pa.array(at[c]) for c in ("d1", "d2", "p1", "p2", "conv_id", "depth")},
            "parent_conv_id": pa.array(above, mask=root),
            "n_convs": pa.array(at["n_convs"]),
            "n_children": pa.array(children),
            "n_leaves": pa.array(leaves),
            "saved_tokens": pa.array(saved),
            "top": pa.array(~inside & ~root),
        }
    )


def prefix_trie(convs: DataFrame, span: int = 20, heads: int = 4, subtree: int = 65_536, least_shards: int = 64, factor: int = 16, broadcast_rows: int = 100_000, chunk: int = 4096) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    1. Turns become 128-bit hashes at the scan, prefixes running digests; distinct digests are the nodes, with the conversations
    that share them. 2. A node's weight is the number of path rows under it. Subtrees of at most ``subtree`` rows (less
    where the input is small) are whole within a shard; a common first turn is therefore split further down. What lies
    above is sharded the same way by weights ``factor`` times as large, until the root is in. 3. Each shard accumulates
    in flat arrays (``accumulate``) and sends what its topmost nodes sum up to their parents, level of shards by level.

    A shard holds about ``subtree`` rows; above the first level, at most ``factor`` nodes of each depth, so its memory follows the longest
    conversation. Only counts reach the driver.

    Null turns come first; equal turns are ordered by the hashes of role and text; null role or text is empty; rows without conv_id belong
    to no conversation. Repeated rows are turns of their own. An empty table has no nodes, not even a root. Other columns are not read.
    """
    spark = convs.sparkSession
    turns = written(ordered_turns(convs), "turns")
    rebuilt = written(rebuilt_turns(turns, span, heads, chunk), "rebuilt")
    paths = written(prefix_digests(rebuilt), "paths")
    nodes = written(distinct_nodes(paths), "nodes")
    n_nodes, total = nodes.agg(F.count("*"), F.max("weight")).first()
    limit = min(subtree, max(256, (total or 0) // least_shards))
    limits = [limit]
    while limits[-1] < (total or 0):
        limits.append(limits[-1] * factor)
    placed = written(_placed(paths, nodes, limits, broadcast_rows), "placed")

    shards = parts(spark, n_nodes, subtree, least_shards)
    done, sent = [], None
    none = F.lit(0).cast("long")
    for k in range(len(limits)):
        mine = placed.where(F.col("level") == k)
        if sent is None:
            mine = mine.withColumns({"got_children": none, "got_leaves": none, "got_saved": none})
        else:
            got = sent.groupBy("p1", "p2").agg(F.count("*").alias("got_children"), F.sum("n_leaves").alias("got_leaves"), F.sum("saved_tokens").alias("got_saved"))
            got = got.withColumnsRenamed({"p1": "d1", "p2": "d2"})
            mine = mine.join(got, ["d1", "d2"], "left").na.fill(0, ["got_children", "got_leaves", "got_saved"])
        summed = mine.withColumn("shard", F.pmod(F.xxhash64("r1", "r2"), F.lit(shards))).drop("level", "r1", "r2", "weight")
        out = written(summed.groupBy("shard").applyInArrow(accumulate, f"{NODE}, top boolean"), "summed")
        tops = out.where("top").select("p1", "p2", "n_leaves", "saved_tokens")
        sent = tops if sent is None else sent.unionByName(tops)
        done.append(out)
    found = done[0]
    for out in done[1:]:
        found = found.unionByName(out)
    ends = id_digests(paths.where("d = n").select("d1", "d2", "c"))
    return found.join(ends, ["d1", "d2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )


def _placed(paths: DataFrame, nodes: DataFrame, limits: list[int], broadcast_rows: int) -> DataFrame:
    """The nodes with level, r1, r2 (the digest of the root of their subtree) and above (who its parent is named by).

    A node is of the first level whose limit its weight keeps. Weights fall along a path, so a subtree's root is the node
    after the last one that is over the limit: found on the path of the node's smallest member.
    """
    none = F.lit(0).cast("long")
    level = F.lit(len(limits) - 1)
    for k in reversed(range(len(limits) - 1)):
        level = F.when(F.col("weight") <= limits[k], k).otherwise(level)
    nodes = nodes.withColumn("level", level)
    if len(limits) == 1:
        return nodes.withColumns({"r1": none, "r2": none, "above": none})
    heavy = written(nodes.where(F.col("weight") > limits[0]).select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), "weight", F.col("conv_id").alias("owner")), "heavy")
    steps = paths.where("d > 0").select("c", "d", "d1", "d2", "p1", "p2")
    if heavy.count() <= broadcast_rows:
        steps = steps.join(F.broadcast(heavy), ["p1", "p2"])
    else:  # the heavy ones are the frequent ones: dealt by the conversation as well
        salts = 32
        salted = heavy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        steps = steps.withColumn("salt", F.pmod(F.hash("c"), F.lit(salts))).join(salted, ["p1", "p2", "salt"])
    cuts = steps.groupBy("c").agg(*(F.max(F.when(F.col("weight") > t, F.struct("d", "d1", "d2", "owner"))).alias(f"cut{k}") for k, t in enumerate(limits[:-1])))
    cut = F.lit(None).cast(cuts.schema["cut0"].dataType)
    for k in range(len(limits) - 1):
        cut = F.when(F.col("level") == k, F.col(f"cut{k}")).otherwise(cut)
    found = nodes.join(cuts.withColumnRenamed("c", "conv_id"), "conv_id", "left").withColumn("cut", cut)
    return found.select(*nodes.columns, *(F.coalesce(f"cut.{c}", none).alias(a) for a, c in (("r1", "d1"), ("r2", "d2"), ("above", "owner"))))
