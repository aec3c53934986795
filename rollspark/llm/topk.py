"""Exact top-k inner-product search by ball trees per shard."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The id of a place that no vector has taken; it sorts behind all others.
FREE = np.iinfo(np.int64).max


def _raised(bound: np.ndarray) -> np.ndarray:
    """A bound that rounding cannot make too low."""
    return bound + 1e-6 + 1e-9 * np.abs(bound)


class BallTree:
    """A ball tree over a shard's vectors; leaves hold ``leaf`` vectors at most. ``visited`` counts pairs of query and node."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = 128):
        self.vectors, self.ids, self.visited = vectors, ids, 0
        centers, radii, self.children, self.rows = [], [], [], []
        stack = [(np.arange(len(ids)), None)]
        while stack:
            rows, parent = stack.pop()
            own = vectors[rows].astype(np.float64)
            center = own.mean(0)
            away = np.sqrt(((own - center) ** 2).sum(1))
            node = len(centers)
            if parent is not None:
                self.children[parent].append(node)
            centers.append(center), radii.append(away.max()), self.children.append([])
            self.rows.append(rows if len(rows) <= leaf else None)
            if len(rows) > leaf:
                a = own[away.argmax()]
                b = own[((own - a) ** 2).sum(1).argmax()]
                order = np.argsort(own @ (a - b), kind="stable")
                half = len(rows) // 2
                stack.append((rows[order[:half]], node)), stack.append((rows[order[half:]], node))
        self.centers, self.radii = np.array(centers).reshape(len(centers), -1), np.array(radii)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of each query among vectors with a score of at least ``floor``, ties to smaller ids.

        A node's bound is q.c + |q| r. Nodes wait on a stack with the queries that may still need them; each query goes down
        its child with the higher bound first, and once it has a kth score or floor, with the most of such. A node is dropped for a query once its bound is under the query's kth score
        or floor, and nothing under it is looked at. Places that stay free have the id ``FREE``.
        """
        low = np.iinfo(np.int64).min
        scores = np.full((len(queries), k), low, np.int64)
        ids = np.full((len(queries), k), FREE, np.int64)
        wide = queries.astype(np.float64)
        norm = np.sqrt((wide**2).sum(1))
        bound_of = lambda node, q: _raised(wide[q] @ self.centers[node] + norm[q] * self.radii[node])
        every = np.arange(len(queries))
        stack = [(0, every, bound_of(0, every))]
        while stack:
            node, q, bound = stack.pop()
            q = q[bound >= np.maximum(scores[q, -1].astype(np.float64), floor[q].astype(np.float64))]
            if not len(q):
                continue
            self.visited += len(q)
            rows = self.rows[node]
            if rows is None:
                one, two = self.children[node]
                a, b = bound_of(one, q), bound_of(two, q)
                ahead = a >= b
                known = np.maximum(scores[q, -1], floor[q]) > low + 2
                ahead[known] = 2 * ahead[known].sum() >= known.sum()
                for first, second, mine, x, y in ((one, two, ahead, a, b), (two, one, ~ahead, b, a)):
                    if mine.any():
                        stack.append((second, q[mine], y[mine])), stack.append((first, q[mine], x[mine]))
                continue
            got = queries[q] @ self.vectors[rows].T
            over = (got >= np.maximum(scores[q, -1], floor[q])[:, None]).any(1)  # only these may change
            q, got = q[over], np.rint(got[over]).astype(np.int64) if got.dtype == np.float64 else got[over]
            names = np.broadcast_to(self.ids[rows], got.shape)
            out = (names == own[q][:, None]) | (got < floor[q][:, None])
            got = np.concatenate([scores[q], np.where(out, low, got)], 1)
            names = np.concatenate([ids[q], np.where(out, FREE, names)], 1)
            scores[q], ids[q] = _best(got, names, k)
        return scores, ids


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties to smaller ids."""
    best = np.lexsort((ids, -np.maximum(scores, np.iinfo(np.int64).min + 1)), axis=1)[:, :k]
    return np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)


def _matrix(column) -> np.ndarray:
    """A column of lists of the same length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """A column of lists of these lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.int64()))


def _narrow(x: np.ndarray) -> np.ndarray:
    """Integers in 16 bits where they fit."""
    return x.astype(np.int16 if not x.size or np.abs(x).max() < 1 << 15 else np.int64)


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """In float64 where sums of products are exact in it."""
    arrays = [x.astype(np.int64) for x in arrays]
    largest = max((int(np.abs(x).max()) for x in arrays if x.size), default=0)
    small = largest * largest * max(1, arrays[0].shape[1]) < 1 << 53
    return [x.astype(np.float64) for x in arrays] if small else arrays


def exact_top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = 4096,
    block_rows: int = 512,
    pivots: int = 64,
    shelves: int = 64,
) -> DataFrame:
    """Each query's k candidates of highest integer inner product: query_id, rank, vec_id, score.

    Components become floor(scale * x). Queries are the rows whose key is divisible by ``every``; candidates all rows but
    the query's own key. Vectors (or keys) null, or holding null or non-finite components, take no part; vectors of another
    length than the query's are no candidates. Ties go to the smaller key; repeated rows are candidates each. Scores must fit
    64 bits. Fewer candidates than k: all of them. Other columns take no part. An empty table gives an empty result.

    Vectors are split coarsely around at most ``pivots`` of them for each length (drawn by hash; they only shape the split),
    then into shards of about ``shard_rows`` vectors, each with a ball tree that is written once. Each query first searches
    one shard near it; the kth score is then shared as a floor. The other shards stand on about ``shelves`` shelves, of 32 at
    most each. Blocks of ``block_rows`` queries go to the shelves; a query whose floor is over the bounds of all of a shelf's
    splits is left out before anything is shuffled, and the trees are searched by branch and bound. Trees and blocks reach a
    task as rows in order, trees first, so that nothing is joined and nothing goes through the driver: a task holds the trees
    of one shelf and one block at a time.
    """
    fine = f"{key} is not null and {vector} is not null and not exists({vector}, x -> x is null or isnan(x) or abs(cast(x as double)) = double('Infinity'))"
    rows = vectors.where(fine).selectExpr(f"cast({key} as bigint) as id", f"transform({vector}, x -> floor({scale}D * cast(x as double))) as v", f"size({vector}) as dim")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")  # tells repeated rows apart

    drawn = Window.partitionBy("dim").orderBy(F.xxhash64("v", "id"), "row")
    chosen = rows.withColumn("i", F.row_number().over(drawn)).where(F.col("i") <= pivots).select("dim", "v").collect()
    around: dict[int, np.ndarray] = {d: np.array([r["v"] for r in chosen if r["dim"] == d], np.int64).reshape(-1, d) for d in sorted({r["dim"] for r in chosen})}

    def assign(batches):
        """Each vector's nearest pivot and its distance."""
        for batch in batches:
            dims = batch.column(1).to_numpy()
            near, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                v, p = _matrix(batch.column(2).take(pa.array(at))).astype(np.float64), around[int(d)].astype(np.float64)
                square = ((v * v).sum(1)[:, None] - 2 * v @ p.T) + (p * p).sum(1)
                near[at] = square.argmin(1)
                away[at] = np.sqrt(((v - p[near[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(away)], [*batch.schema.names, "split", "away"])

    placed = rows.select("id", "dim", "v", "row").mapInArrow(assign, "id long, dim int, v array<bigint>, row long, split int, away double")
    placed = written(placed, "placed")
    balls = {(r["dim"], r["split"]): r for r in placed.groupBy("dim", "split").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()}
    shards = {at: -(-r["n"] // shard_rows) for at, r in sorted(balls.items())}
    most = max(1, min(32, -(-sum(shards.values()) // shelves)))
    first, spans, begins = 0, {}, []  # begins: each shelf's first shard; all vectors of a shelf have one length
    for d in around:
        start = first
        for at in (at for at in shards if at[0] == d):
            spans[at] = (first, shards[at])
            first += shards[at]
        begins += range(start, first, most)
    tasks = max(1, min(len(begins), -(-sum(r["n"] for r in balls.values()) // shard_rows)))

    def span(i: int):
        """The first shard of a row's split (0), or how many it has (1)."""
        each = F.create_map(*[F.lit(x) for at, s in spans.items() for x in (f"{at[0]}:{at[1]}", s[i])]) if spans else F.lit(None).cast("map<string,int>")
        return each[F.concat_ws(":", "dim", "split")]

    def build(group: pa.Table) -> pa.Table:
        v, shard = _matrix(group["v"]), group["shard"][0].as_py()
        tree = BallTree(_exact(v)[0], group["id"].to_numpy())
        tree.vectors = _narrow(v)
        shelf = pa.array(np.searchsorted(begins, [shard], "right") - 1, pa.int32())
        return pa.table([group["shard"].slice(0, 1), shelf, pa.array([pickle.dumps((shard, tree), 5)], pa.binary())], ["shard", "shelf", "tree"])

    trees = placed.select((span(0) + F.pmod(F.xxhash64("row"), span(1))).cast("int").alias("shard"), "id", "v")
    trees = written(trees.groupBy("shard").applyInArrow(build, "shard int, shelf int, tree binary"), "trees")
    asked = placed.where(F.col("id") % every == 0).groupBy("id", "v", "dim", "split").agg(F.min("row").alias("row"))

    def met(place: str, blocks: DataFrame) -> DataFrame:
        """The trees and blocks of a place in one partition, one after the other, trees first."""
        rows = trees.select(F.col(place).alias("place"), "tree", F.lit(None).cast("binary").alias("block"))
        rows = rows.unionByName(blocks.select("place", F.lit(None).cast("binary").alias("tree"), "block"))
        return rows.repartition(tasks, "place").sortWithinPartitions("place", F.col("tree").isNull())

    def found(batches):
        """Each block of queries with the k best of its place: place, query's id, query, vector, scores, ids."""

        def searched(place, trees, waiting):
            own, query, home, floor, v = (np.concatenate(x) for x in zip(*waiting, strict=True))
            scores, ids = np.full((len(own), k), np.iinfo(np.int64).min), np.full((len(own), k), FREE)
            for shard, tree in trees:
                away = np.flatnonzero(home != shard)
                narrow = tree.vectors
                q, tree.vectors = _exact(v[away], narrow)
                more = tree.search(q, own[away], k, np.maximum(floor[away], scores[away, -1]))
                tree.vectors = narrow
                scores[away], ids[away] = _best(*(np.concatenate([x[away], y], 1) for x, y in zip((scores, ids), more, strict=True)), k)
            return place, own, query, v, scores, ids

        at, trees, waiting = None, [], []
        for batch in batches:
            for place, tree, block in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if waiting and (place != at or sum(len(x[0]) for x in waiting) >= block_rows):
                    yield searched(at, trees, waiting)
                    waiting = []
                if place != at:
                    at, trees = place, []
                if tree.is_valid:
                    trees.append(pickle.loads(tree.as_buffer()))
                else:
                    waiting.append(pickle.loads(block.as_buffer()))
        if waiting:
            yield searched(at, trees, waiting)

    # Home: one shard of the query's own split, by hash, so that tasks are even.
    home = (span(0) + F.pmod(F.xxhash64("row", F.lit("home")), span(1))).cast("int")
    asked = asked.select(home.alias("home"), "id", F.xxhash64("id", "v").alias("query"), "v", "dim")

    def to_home(batches):
        for batch in batches:
            homes, ids, names, dims = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            order = np.argsort(homes, kind="stable")
            places, blocks = [], []
            for at in np.split(order, np.flatnonzero(np.diff(homes[order])) + 1) if len(order) else []:  # rows of one home
                for at in np.split(at, range(block_rows, len(at), block_rows)):
                    v = _matrix(batch.column(3).take(pa.array(at)))
                    none = np.full(len(at), -1, np.int32), np.full(len(at), np.iinfo(np.int64).min + 2)
                    places.append(homes[at[0]]), blocks.append(pickle.dumps((ids[at], names[at], *none, _narrow(v)), 5))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(blocks, pa.binary())], ["place", "block"])

    def at_home(batches):
        for place, own, query, v, scores, ids in found(batches):
            good = ids != FREE
            wide = np.full(len(own), v.shape[1], np.int32)
            columns = [pa.array(own), pa.array(query), pa.array(np.full(len(own), place, np.int32)), pa.array(wide), _lists(v.ravel().astype(np.int64), wide), *(_lists(x[good], good.sum(1)) for x in (scores, ids))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "query", "home", "dim", "v", "scores", "ids"])

    one = met("shard", asked.mapInArrow(to_home, "place int, block binary")).mapInArrow(at_home, "id long, query long, home int, dim int, v array<bigint>, scores array<bigint>, ids array<bigint>")
    one = written(one, "home-shards")

    def to_shelves(batches):
        """Queries to the shelves of the splits whose ball may hold a vector over the query's floor, in place of the query's own."""
        for batch in batches:
            for begin in range(0, batch.num_rows, block_rows):
                part = batch.slice(begin, block_rows)
                ids, names, homes, dims, floors = (part.column(i).to_numpy() for i in (0, 1, 2, 3, 5))
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    v = _matrix(part.column(4).take(pa.array(at)))
                    q = v.astype(np.float64)
                    held = [s for dim, s in balls if dim == d]
                    radius = np.array([balls[int(d), s]["r"] for s in held])
                    bound = q @ around[int(d)][held].astype(np.float64).T + np.sqrt((q * q).sum(1))[:, None] * radius * (1 + 1e-9)
                    open_ = _raised(bound) >= floors[at].astype(np.float64)[:, None]
                    ends = [np.searchsorted(begins, [a, a + n - 1], "right") - 1 for a, n in (spans[int(d), s] for s in held)]
                    places, blocks = [], []
                    for shelf in range(min(a for a, _ in ends), max(b for _, b in ends) + 1):
                        near = open_[:, [a <= shelf <= b for a, b in ends]].any(1)
                        if near.any():
                            to = at[near]
                            places.append(shelf), blocks.append(pickle.dumps((ids[to], names[to], homes[to], floors[to], _narrow(v[near])), 5))
                    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(blocks, pa.binary())], ["place", "block"])

    def on_shelves(batches):
        for _, own, query, _, scores, ids in found(batches):
            good = ids != FREE
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(x, good.sum(1))) for x in (own, query)), pa.array(ids[good]), pa.array(scores[good])], ["query_id", "query", "vec_id", "score"])

    floor = F.when(F.size("scores") >= k, F.array_min("scores")).otherwise(np.iinfo(np.int64).min + 2)
    open_ = one.select("id", "query", "home", "dim", "v", floor.cast("long").alias("floor"))
    two = met("shelf", open_.mapInArrow(to_shelves, "place int, block binary")).mapInArrow(on_shelves, "query_id long, query long, vec_id long, score long")
    one = one.select("id", "query", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(F.col("id").alias("query_id"), "query", "x.ids", "x.scores").toDF("query_id", "query", "vec_id", "score")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return one.unionByName(two).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
