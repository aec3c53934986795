"""N-gram Jaccard join: prefix filters under several global token orders, verification, and the groups of linked texts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, released, written
from .components import connected_components
from .shingles import set_key, shingle_set

#: Hash factors of the global token orders. The first order is by exact counts, the others by rough counts (powers of two);
#: ties are broken by the hashes, so the orders differ from each other.
ORDERS = (np.uint64(1), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
#: Bytes of a token that travel to its slot; the slot itself tells tokens apart by further bits.
TOKEN_BYTES = 6
#: Set in an owner's number: not an owner but the count of the block's sets that hold the token.
MANY = np.uint32(1 << 31)

DOCUMENT, LOCAL, MESSAGE, REPLY = range(4)


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def _short(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // TOKEN_BYTES, 8), np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view(np.uint64).ravel()


def _numbers(values: np.ndarray) -> bytes:
    """Small numbers in few bytes: the plain size, then zstd."""
    data = np.ascontiguousarray(values, np.uint32).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _from_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint32)


def _groups(by: np.ndarray):
    """(value, indices) of each distinct value."""
    order = np.argsort(by, kind="stable")
    cuts = np.flatnonzero(np.diff(by[order])) + 1
    return [(by[i[0]], i) for i in np.split(order, cuts)] if len(by) else []


def _block_rows(sets: list[np.ndarray], slots: int) -> list[tuple]:
    """(kind, slot, tokens, owners) of a block of different sets.

    A token of one set goes to its slot with its owner. A token of several sets goes once, with their count, however many
    they are; who holds it stays in the block's local list.
    """
    tokens = np.concatenate([*sets, np.empty(0, np.uint64)])
    owners = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    sorted_ = tokens[order]
    begins = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]][: len(sorted_)])
    counts = np.diff(np.append(begins, len(sorted_)))
    once, many = order[begins[counts == 1]], begins[counts > 1]
    once.sort()  # by owner, so that owners' numbers are small steps
    sent = np.concatenate([tokens[once], sorted_[many]])
    marks = np.concatenate([owners[once], counts[counts > 1].astype(np.uint32) | MANY])
    slot = ((sent >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
    rows = [(MESSAGE, int(s), _short(sent[i]), _numbers(marks[i])) for s, i in _groups(slot)]
    held = np.repeat(counts > 1, counts)
    if held.any():
        # Local tokens are named as the slots name them.
        local, own = sorted_[held], owners[order][held]
        rows.append((LOCAL, None, _named(local, ((local >> np.uint64(32)) % np.uint64(slots))).tobytes(), _numbers(own)))
    return rows


def _named(tokens: np.ndarray, slot) -> np.ndarray:
    """What a token is called after its exchange: the bytes that travelled and its slot."""
    low = tokens & np.uint64((1 << 8 * TOKEN_BYTES) - 1)
    return low ^ (np.asarray(slot, np.uint64) << np.uint64(8 * TOKEN_BYTES))


def _exchange(rows: DataFrame, slots: int, flush: int, k: int) -> DataFrame:
    """Give each block of sets the global counts of its tokens that two sets or more hold.

    Rows: doc_id, rid and either text, or n, cls and tokens (a set made before). The result has a row of kind DOCUMENT for
    every row (at: its number in its block if it is the first of its set there), one of kind LOCAL at most for a block, and
    REPLY rows (tokens, owners, counts).
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = "text" in rows.columns
    schema = f"kind int, slot int, block long, at int, doc_id {kind}, rid long, n long, cls long, tokens binary, owners binary, counts binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def send(batches):
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        sets: list[np.ndarray] = []
        seen: dict[int, int] = {}
        held: list[pa.RecordBatch] = []
        size = turn = 0

        def flushed():
            name = xxhash.xxh3_64_intdigest(b"%d:%d" % (part, turn)) - (1 << 63)
            for b in held:
                m = b.num_rows
                home = pa.array((abs(name) + np.arange(m)) % slots, pa.int32())  # they only pass through
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, DOCUMENT), pa.int32()), home, pa.array(np.full(m, name), pa.int64()), *b.columns, *(pa.nulls(m, pa.binary()) for _ in range(3))], names)
            found = _block_rows(sets, slots)
            m = len(found)
            slot = [abs(name) % slots if s is None else s for _, s, _, _ in found]
            nulls = [pa.nulls(m, t) for t in (pa.int32(), key_type, pa.int64(), pa.int64(), pa.int64())]
            blobs = [pa.array([f[i] for f in found], pa.binary()) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array(slot, pa.int32()), pa.array(np.full(m, name), pa.int64()), *nulls, *blobs, pa.nulls(m, pa.binary())], names)

        for batch in batches:
            key_type = batch.column(0).type
            begin, at, ns, classes = 0, [], [], []

            def hold(end):
                held.append(pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin), pa.array(ns, pa.int64()), pa.array(classes, pa.int64())], ["at", "doc_id", "rid", "n", "cls"]))

            columns = [batch.column(i).to_pylist() for i in range(2, batch.num_columns)]
            for i in range(batch.num_rows):
                if texts:
                    tokens = shingle_set(columns[0][i], k)
                    n, cls = len(tokens), set_key(tokens)
                else:
                    n, cls, tokens = columns[0][i], columns[1][i], np.frombuffer(columns[2][i], np.uint64)
                new = len(tokens) > 0 and cls not in seen
                at.append(len(sets) if new else None), ns.append(n), classes.append(cls)
                if new:
                    seen[cls] = len(sets)
                    sets.append(tokens)
                    size += len(tokens)
                if size >= flush:
                    hold(i + 1)
                    yield from flushed()
                    sets, seen, held, size, turn = [], {}, [], 0, turn + 1
                    begin, at, ns, classes = i + 1, [], [], []
            hold(batch.num_rows)
        if held:
            yield from flushed()

    def count(group: pa.Table) -> pa.Table:
        """A slot: the counts of its tokens over all blocks; what else came here goes on as it is."""
        is_message = pa.compute.equal(group["kind"], MESSAGE)
        rest, sent = group.filter(pa.compute.invert(is_message)), group.filter(is_message)
        if not sent.num_rows:
            return rest
        slot = sent["slot"][0].as_py()
        tokens = [_long(b) for b in sent["tokens"].to_pylist()]
        owners = [_from_numbers(b) for b in sent["owners"].to_pylist()]
        lengths = [len(t) for t in tokens]
        tokens, owners = np.concatenate(tokens), np.concatenate(owners)
        weight = np.where(owners & MANY, owners & ~MANY, 1)
        order = np.argsort(tokens, kind="stable")
        begins = np.flatnonzero(np.r_[True, tokens[order][1:] != tokens[order][:-1]])
        sums = np.add.reduceat(weight[order].astype(np.int64), begins)
        counts = np.empty(len(tokens), np.int64)
        counts[order] = np.repeat(sums, np.diff(np.append(begins, len(tokens))))
        keep = np.flatnonzero(counts >= 2)
        message = np.repeat(np.arange(len(lengths)), lengths)[keep]
        names_ = _named(tokens, slot)
        found = [(int(b), keep[i]) for b, i in _groups(message)]
        blocks = sent["block"].to_numpy()
        m = len(found)
        reply = [
            pa.array(np.full(m, REPLY), pa.int32()),
            pa.array(np.full(m, slot), pa.int32()),
            pa.array([int(blocks[b]) for b, _ in found], pa.int64()),
            *(pa.nulls(m, group.schema.field(c).type) for c in ("at", "doc_id", "rid", "n", "cls")),
            pa.array([names_[i].tobytes() for _, i in found], pa.binary()),
            pa.array([_numbers(owners[i]) for _, i in found], pa.binary()),
            pa.array([_numbers(counts[i]) for _, i in found], pa.binary()),
        ]
        return pa.concat_tables([rest, pa.table(reply, schema=group.schema)])

    return rows.mapInArrow(send, schema).groupBy("slot").applyInArrow(count, schema)


def _block_sets(group: pa.Table):
    """(cls, n, tokens, counts) of a block's sets: their tokens that two sets or more hold."""
    kinds = group["kind"].to_numpy()
    docs = group.filter(pa.array(kinds == DOCUMENT))
    docs = docs.take(pa.compute.sort_indices(docs["at"]))
    tokens, owners, counts = [], [], []
    for t, o, c in zip(*(group.filter(pa.array(kinds == REPLY))[x].to_pylist() for x in ("tokens", "owners", "counts")), strict=True):
        tokens.append(np.frombuffer(t, np.uint64)), owners.append(_from_numbers(o)), counts.append(_from_numbers(c))
    if not tokens:
        return
    tokens, owners, counts = np.concatenate(tokens), np.concatenate(owners), np.concatenate(counts)
    many = (owners & MANY) > 0
    local = group.filter(pa.array(kinds == LOCAL))
    if local.num_rows:
        own_tokens, own = np.frombuffer(local["tokens"][0].as_py(), np.uint64), _from_numbers(local["owners"][0].as_py())
        order = np.argsort(tokens[many])
        counts_ = counts[many][order][np.searchsorted(tokens[many][order], own_tokens)]
        tokens, owners, counts = np.concatenate([tokens[~many], own_tokens]), np.concatenate([owners[~many], own]), np.concatenate([counts[~many], counts_])
    ns, classes = docs["n"].to_pylist(), docs["cls"].to_pylist()
    for at, i in _groups(owners):
        yield classes[at], ns[at], tokens[i], counts[i]


def _shared_sets(exchanged: DataFrame, percent: int) -> DataFrame:
    """cls, n, tokens of the sets of which enough tokens occur in other sets for any link at all."""

    def assemble(group: pa.Table) -> pa.Table:
        found = [(c, n, t.tobytes()) for c, n, t, _ in _block_sets(group) if len(t) >= _ceil(percent * n, 100)]
        return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["cls", "n", "tokens"])

    return exchanged.where(f"kind <> {DOCUMENT} or at is not null").groupBy("block").applyInArrow(assemble, "cls long, n long, tokens binary")


def _filters(exchanged: DataFrame, percent: int) -> DataFrame:
    """cls, n, sh (how many tokens other sets hold), degree, tokens, and prefix: those of ``sh`` in the prefix by order.

    A set's prefix under an order, rare tokens first, is all but the last ``ceil(percent * n / 100) - 1`` of its tokens.
    Tokens that no other set holds come first in every order; they only make the rest of the prefix shorter.
    """

    def assemble(group: pa.Table) -> pa.Table:
        found = []
        for cls, n, tokens, counts in _block_sets(group):
            length = len(tokens) - _ceil(percent * n, 100) + 1
            if length > 0:
                rough = np.floor(np.log2(counts))
                orders = [np.lexsort((tokens * m, rough if i else counts))[:length] for i, m in enumerate(ORDERS)]
                found.append((cls, n, len(tokens), int(counts[orders[0]].sum()), np.sort(tokens).tobytes(), [tokens[o].view(np.int64).tolist() for o in orders]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64())))
        return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], ["cls", "n", "sh", "degree", "tokens", "prefix"])

    return exchanged.where(f"kind <> {DOCUMENT} or at is not null").groupBy("block").applyInArrow(assemble, "cls long, n long, sh long, degree long, tokens binary, prefix array<array<bigint>>")


def least_shared(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """How many prefix tokens two sets of these sizes share under any order if they are linked.

    The overlap is at least percent / (100 + percent) of both sizes; all of it but what lies beyond one of the prefixes is
    in both. In whole numbers, so nothing is rounded.
    """
    need = -(-percent * (na + nb) // (100 + percent))
    beyond = -(-percent * np.maximum(na, nb) // 100) - 1
    return np.maximum(1, need - beyond)


def _fits(a: str, b: str, percent: int) -> str:
    """SQL: two sets may be linked as far as their sizes and their tokens shared with any other set tell."""
    return (
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {percent} * ({a}.n + {b}.n) <= {100 + percent} * least({a}.sh, {b}.sh)"
    )


def verified(pairs: DataFrame, sets: DataFrame, percent: int, spokes: int = 64, tokens: int = 100_000) -> DataFrame:
    """The pairs (hub, spoke) of sets that are linked, as (a, b). Sets: cls, n, sh, tokens.

    A hub meets its spokes in groups of about ``spokes`` sets and ``tokens`` tokens, so a hub of a third of all sets is dealt
    over many.
    """
    pairs = written(pairs.join(sets.selectExpr("cls as spoke", "sh as m"), "spoke"), "pairs")
    salts = pairs.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / spokes, F.sum("m") / tokens)).alias("salts"))
    dealt = written(pairs.join(salts, "hub").select("hub", "spoke", F.pmod(F.xxhash64("spoke"), "salts").cast("int").alias("salt")), "dealt")
    own = sets.select("cls", "n", "tokens")
    others = dealt.join(own, F.col("spoke") == F.col("cls")).select("hub", "salt", "cls", "n", "tokens")
    hubs = dealt.select("hub", "salt").distinct().join(own, F.col("hub") == F.col("cls")).select("hub", "salt", "cls", "n", "tokens")

    def verify(group: pa.Table) -> pa.Table:
        hub = group["hub"][0].as_py()
        classes, ns = group["cls"].to_pylist(), group["n"].to_pylist()
        sets_ = [np.frombuffer(t, np.uint64) for t in group["tokens"].to_pylist()]
        at = classes.index(hub)
        found = []
        for cls, n, own_ in zip(classes, ns, sets_, strict=True):
            if cls != hub:
                common = len(np.intersect1d(sets_[at], own_, assume_unique=True))
                if 100 * common >= percent * (n + ns[at] - common):
                    found.append(cls)
        return pa.table([pa.array([hub] * len(found), pa.int64()), pa.array(found, pa.int64())], ["a", "b"])

    return others.unionByName(hubs).groupBy("hub", "salt").applyInArrow(verify, "a long, b long")


def _grouped(filters: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The filters with g: the group of each set, itself where it has none."""
    if groups is None:
        return filters.withColumn("g", F.col("cls"))
    return filters.join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("g", F.coalesce("component", "cls")).drop("component")


def _postings(rows: DataFrame) -> DataFrame:
    """ord, token, cls, n, sh, degree, g: a row for each prefix token of each set under each order."""
    rows = rows.select("cls", "n", "sh", "degree", "g", F.posexplode("prefix").alias("ord", "prefix"))
    return rows.select("ord", F.explode("prefix").alias("token"), "cls", "n", "sh", "degree", "g")


def _hub_pairs(postings: DataFrame, percent: int, turn: int) -> DataFrame:
    """hub, spoke: each set with the first of its postings, if it is that under every order. Pairs grow with the postings."""
    first = F.struct(F.col("degree") if turn == 0 else F.xxhash64("cls", F.lit(turn)), F.col("cls"), F.col("n"), F.col("sh"), F.col("g"))
    hubs = postings.groupBy("ord", "token").agg(F.max(first).alias("h"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").drop("lo", "hi")
    met = postings.alias("x").join(hubs, ["ord", "token"]).where(f"x.g <> h.g and {_fits('x', 'h', percent)}")
    pairs = met.groupBy(F.col("h.cls").alias("hub"), F.col("x.cls").alias("spoke")).agg(F.bit_or(F.expr("shiftleft(1, ord)")).alias("orders"))
    return pairs.where(F.col("orders") == (1 << len(ORDERS)) - 1).select("hub", "spoke")


def _common(one: list[np.ndarray], two: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many tokens each set of one side shares with each of the other."""
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(t) for t in x])) for x in (one, two)]
    both = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(one), len(two)), np.float32)
    for i in range(0, len(both), columns):
        part = both[i : i + columns]
        held = []
        for (tokens, who), n in zip(sides, out.shape, strict=True):
            at = np.searchsorted(part, tokens)
            hit = part[np.minimum(at, len(part) - 1)] == tokens
            matrix = np.zeros((n, len(part)), np.float32)
            matrix[who[hit], at[hit]] = 1
            held.append(matrix)
        out += held[0] @ held[1].T
    return out


def _open_pairs(rows: DataFrame, percent: int, block: int, block_tokens: int = 2_000_000) -> DataFrame:
    """hub, spoke: all pairs of sets of different groups that share enough prefix tokens under every order.

    Sets with the same leading neighbour stand in blocks of about ``block`` sets and ``block_tokens`` tokens. Where two
    neighbours' sets share a prefix token of the first order, their blocks meet, and pairs are counted inside a meeting, so
    no rows of pairs are made by tokens.
    """
    first = rows.select("cls", "degree", "g", F.explode(F.col("prefix")[0]).alias("token"))
    leads = first.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.max(F.struct("degree", "cls")).alias("h")).where("lo <> hi")
    spots = written(first.join(leads, "token").select("cls", "token", "h"), "spots")
    hub_of = spots.groupBy("cls").agg(F.max("h").alias("h")).select("cls", F.col("h.cls").alias("hub"))
    hub_of = written(rows.select("cls", "n", "sh", "g", "prefix").join(hub_of, "cls"), "open-sets")
    room = written(hub_of.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("sh") / block_tokens)).alias("salts")), "rooms")
    placed = hub_of.join(room, "hub").withColumn("block", F.xxhash64("hub", F.pmod(F.xxhash64("cls"), F.col("salts"))))
    placed = written(placed.drop("salts"), "placed")
    at = written(spots.join(placed.select("cls", "hub"), "cls").select("token", "hub").distinct(), "hub-tokens")
    near = at.withColumnRenamed("hub", "x").join(at.withColumnRenamed("hub", "y"), "token").where("x <= y").select("x", "y").distinct()
    blocks = room.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("hub", F.xxhash64("hub", "salt").alias("block"))
    near = near.join(blocks.select(F.col("hub").alias("x"), F.col("block").alias("one")), "x").join(blocks.select(F.col("hub").alias("y"), F.col("block").alias("two")), "y")
    meets = written(near.select(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).distinct(), "meets")
    sides = meets.join(placed, F.col("one") == F.col("block")).unionByName(meets.where("one <> two").join(placed, F.col("two") == F.col("block")))

    def meet(group: pa.Table) -> pa.Table:
        blocks, (cls, n, sh, g) = group["block"].to_numpy(), (group[c].to_numpy() for c in ("cls", "n", "sh", "g"))
        same = group["one"][0].as_py() == group["two"][0].as_py()
        a = np.flatnonzero(blocks == group["one"][0].as_py())
        b = np.flatnonzero(blocks == group["two"][0].as_py())
        na, nb = n[a][:, None], n[b][None, :]
        ok = (g[a][:, None] != g[b]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
        ok &= percent * (na + nb) <= (100 + percent) * np.minimum(sh[a][:, None], sh[b])
        if same:
            ok &= cls[a][:, None] < cls[b]
        least = least_shared(na, nb, percent)
        prefixes = [p.values for p in group["prefix"].combine_chunks()]
        for i in range(len(ORDERS)):
            if ok.any():
                own = [np.asarray(p[i].values) for p in prefixes]
                ok &= _common([own[j] for j in a], [own[j] for j in b]) >= least
        x, y = np.nonzero(ok)
        return pa.table([pa.array(cls[a[x]], pa.int64()), pa.array(cls[b[y]], pa.int64())], ["hub", "spoke"])

    return sides.select("one", "two", "block", "cls", "n", "sh", "g", "prefix").groupBy("one", "two").applyInArrow(meet, "hub long, spoke long")


def _classes(docs: DataFrame, key: str, text: str, k: int, percent: int, rows_per_slot: int, flush: int, hub_rounds: int, block: int) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, rid: hash of key and text, n, cls), and the groups (node: a class, component) of linked classes."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text")
    shared = written(_exchange(rows, parts(spark, rows.count(), rows_per_slot, 64), flush, k), "shared-tokens")
    members = shared.where(f"kind = {DOCUMENT}").select("doc_id", "rid", "n", "cls")

    # Sets whose tokens mostly occur nowhere else go; those left are counted anew among themselves.
    sets = written(_shared_sets(shared, percent).dropDuplicates(["cls"]), "shared-sets")
    members = written(members, "members")
    released(shared)
    left = sets.select(F.lit(None).cast("string").alias("doc_id"), F.col("cls").alias("rid"), "n", "cls", "tokens")
    again = written(_exchange(left, parts(spark, left.count(), rows_per_slot, 64), flush, k), "shared-again")
    filters = written(_filters(again, percent), "filters")
    released(sets), released(again)

    links, groups = [], None
    for turn in range(hub_rounds):
        found = written(verified(_hub_pairs(_postings(_grouped(filters, groups)), percent, turn), filters, percent), "hub-links")
        if not found.take(1):
            break
        links.append(found)
        groups = written(connected_components(reduce(DataFrame.unionByName, links)), "groups")
    found = written(verified(_open_pairs(_grouped(filters, groups), percent, block), filters, percent), "open-links")
    if groups is None or found.take(1):
        groups = written(connected_components(reduce(DataFrame.unionByName, [*links, found])), "groups")
    return members, groups


def jaccard_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    k: int = 5,
    percent: int = 75,
    rows_per_slot: int = 8000,
    flush: int = 2_000_000,
    hub_rounds: int = 1,
    block: int = 256,
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every document.

    Two documents link when their sets of k-word shingles have a Jaccard similarity of ``percent`` / 100 or more. Texts
    with equal sets are one class throughout.

    Tokens (shingles) are counted once over all documents: blocks of about ``flush`` tokens send each token to its slot, and
    get back those that other sets hold. A set can be linked only if ``percent`` of its tokens are such; the others go, and
    the rest is counted again by class. Three global orders of tokens, rarest first, give each class three prefixes and
    postings. A candidate pair must share prefix tokens under every order; the orders' pairs are intersected before any set
    moves, and only then are pairs verified on the whole sets.

    ``hub_rounds``: every class is first paired with the leading class of its postings only, a number of pairs that grows
    with the postings, and linked ones join groups. Last, all pairs across groups that share as many prefix tokens under each
    order as their sizes ask for are verified. Nothing is capped: links within a group that is connected already are the only
    ones left out, and rounds, slots and blocks change no result. The last pairs are counted inside meetings of blocks of
    ``block`` sets, never as rows.

    Null, empty or blank text: 0 shingles, linked with nothing, a component of its own. Repeated rows and equal texts share
    a component. Null keys stay null and name no component. Other columns take no part. An empty table gives an empty
    result. Sets are compared by hashes of shingles of 48 bits and the slot's number. Documents must come from a source that
    gives a partition's rows again in the same order, as a table does. For far larger inputs raise ``flush`` with
    ``rows_per_slot``: a message holds about flush / slots tokens.
    """
    members, groups = _classes(docs, key, text, k, percent, rows_per_slot, flush, hub_rounds, block)

    # Every document's class, the class's group, and the group's smallest document.
    classes = members.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    classes = written(classes.join(groups.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least", F.coalesce("component", "cls").alias("g")), "class-groups")
    lowest = classes.groupBy("g").agg(F.min("least").alias("component_id"))
    named = written(classes.join(lowest, "g").select("cls", "component_id"), "named")
    full = members.where("n > 0").join(named, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def first_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, rows_per_slot: int = 8000, flush: int = 2_000_000, hub_rounds: int = 1, block: int = 256) -> DataFrame:
    """rid (xxhash64 of key and text): one row of each group of ``jaccard_groups``, told by texts alone, so equal and null keys
    are no groups. It has the least key, null keys last, then the least rid. Of texts without shingles every rid is there."""
    members, groups = _classes(docs, key, text, k, percent, rows_per_slot, flush, hub_rounds, block)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least")
    classes = members.where("n > 0").groupBy("cls").agg(least)
    classes = classes.join(groups.withColumnRenamed("node", "cls"), "cls", "left").select("least", F.coalesce("component", "cls").alias("g"))
    firsts = classes.groupBy("g").agg(F.min("least").alias("least")).select("least.rid")
    return firsts.unionByName(members.where("n = 0").select("rid").distinct())
