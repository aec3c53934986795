"""Best-fit packing of tokenized documents into sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import added_tokens, id_bytes
from .common import parts, written


def token_pieces(docs: DataFrame, ranks: str, added: dict[str, int], capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece of each document's ids and the closing id 0: doc_id, piece, start, length, ids_crc32.

    Longer documents are cut into pieces of ``capacity``, of which the first may be shorter. Null text counts as empty.
    """

    def cut(batches):
        encode = id_bytes(ranks, added)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = b"".join([*encode(t or ""), b"\0\0\0\0"])
                n = len(ids) // 4
                begin, k = 0, 0
                while begin < n:
                    end = begin + (n % capacity or capacity if begin == 0 else capacity)
                    at.append(i), piece.append(k), start.append(begin), length.append(end - begin)
                    crc.append(zlib.crc32(ids[4 * begin : 4 * end]))
                    begin, k = end, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Pack ``counts`` (length: how many) by best-two-fit; gives (bin as [(length, how many)], how often that bin is made).

    A bin is filled greedily, always by the longest document that fits; then its smallest document is replaced by the two
    unpacked documents that fill its gap, expanded by that document, the most, if they fill it more tightly. While the
    documents of a bin last, the next bin would come out the same, so it is made as often as they last: the work follows
    the number of different lengths, not of documents.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    out = []
    while lengths:
        used: dict[int, int] = {}
        gap, i = capacity, len(lengths)
        while gap > 0 and i > 0:
            i = min(i, bisect_right(lengths, gap))
            if not i:
                break
            n = lengths[i - 1]
            take = min(left[n], gap // n)
            if take:
                used[n] = take
                gap -= take * n
            i -= 1
        if gap > 0:
            smallest = min(used)
            room = gap + smallest
            pair = _best_pair(lengths, left, used, room)
            if pair and sum(pair) > smallest:
                used[smallest] -= 1
                for n in pair:
                    used[n] = used.get(n, 0) + 1
                used = {n: k for n, k in used.items() if k}
        times = min(left[n] // k for n, k in used.items())
        out.append((sorted(used.items(), reverse=True), times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                lengths.pop(bisect_right(lengths, n) - 1)
    return out


def _best_pair(lengths: list[int], left: dict[int, int], used: dict[int, int], room: int) -> tuple[int, int] | None:
    """Two documents out of those not packed whose lengths have the largest sum up to ``room``."""
    free = np.array([n for n in lengths[: bisect_right(lengths, room)] if left[n] > used.get(n, 0)], np.int64)
    if not len(free):
        return None
    partner = np.searchsorted(free, room - free, "right") - 1
    single = np.array([left[n] - used.get(n, 0) < 2 for n in free.tolist()])
    partner = np.where(single & (partner == np.arange(len(free))), partner - 1, partner)
    good = partner >= 0
    if not good.any():
        return None
    both = np.where(good, free + free[partner], -1)
    i = int(both.argmax())
    return int(free[i]), int(free[partner[i]])


def pack_pieces(pieces: DataFrame, capacity: int = 2048, rows_per_part: int = 50_000) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32) into sequences of at most ``capacity`` tokens.

    Only the histogram of lengths, ``capacity`` numbers at most, reaches the driver, which packs it; each piece then finds
    its place by its rank among the pieces of its length. Ranks come from buckets of about ``rows_per_part`` rows, dealt by
    the rows' places in the written table, so neither a length nor a row that a third of all pieces share meets in one task. Which
    of the pieces of one length stands where follows the table's partitions; the sequences' lengths do not. Adds
    sequence_id and offset.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    dealt = in_buckets(pieces, parts(spark, pieces.count(), rows_per_part, 64))
    counts = written(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_two_fit(histogram, capacity)

    # For each length: from which rank on, and then the first sequence, how many a sequence takes, and where they stand.
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    given: dict[int, int] = {}
    for items, times in plan:
        offset = 0
        for length, k in items:
            runs.setdefault(length, []).append((given.get(length, 0), sequence, k, offset))
            given[length] = given.get(length, 0) + k * times
            offset += length * k
        sequence += times
    tables = {length: np.array(rows, np.int64) for length, rows in runs.items()}

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "bucket", before.alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("_row")
    ranked = (
        dealt.withColumn("_at", F.row_number().over(inside))
        .join(starts, ["length", "bucket"])
        .select(*names, (F.col("first") + F.col("_at") - 1).alias("rank"))
    )

    def place(batches):
        for frame in batches:
            rank, length = frame["rank"].to_numpy(), frame["length"].to_numpy()
            where, offset = np.empty(len(frame), np.int64), np.empty(len(frame), np.int64)
            for n in np.unique(length):
                own = length == n
                rows = tables[int(n)]
                r = rank[own]
                row = rows[np.searchsorted(rows[:, 0], r, "right") - 1]
                where[own] = row[:, 1] + (r - row[:, 0]) // row[:, 2]
                offset[own] = row[:, 3] + (r - row[:, 0]) % row[:, 2] * n
            yield pd.DataFrame({**{c: frame[c] for c in names}, "sequence_id": where, "offset": offset})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return ranked.mapInPandas(place, f"{kinds}, sequence_id long, offset long")


def in_buckets(pieces: DataFrame, buckets: int) -> DataFrame:
    """The pieces with ``bucket``, by the hash of each row's place: equal rows are dealt like others."""
    return pieces.withColumn("bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))


def pack_documents(docs: DataFrame, ranks: str | None = None, added: dict[str, int] | None = None, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize and pack documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``ranks`` is a file of BPE ranks and ``added`` the tokens whose text stands for one id (default: the 50k byte-level vocabulary
    and what its JSON file adds). Null or empty text: the closing id alone. Whole texts are encoded; one longer than ``capacity``
    gives pieces. Repeated rows and repeated keys are packed one by one. Other columns are not read. An empty table gives an
    empty result.
    """
    if ranks is None:
        ranks, added = public_tokenizers.path("byte_bpe_50k.tiktoken"), added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack_pieces(token_pieces(docs, ranks, added or {}, capacity, key, text), capacity)
