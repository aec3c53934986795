"""Scoring of whole documents by a gated recurrent language model with a class-factored output."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .blocks import packed, unpacked
from .common import bucketed, crc_mod, written

#: A block's documents: the texts' hashes, how many tokens each has and how often it is learned from, then words and codes.
BLOCK = ("h", "n", "m")


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts, one text after the other, and how many each has.

    A-Z alone change to lower case; white space is U+0009 to U+000D and space.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.values
    full = np.asarray(pc.binary_length(flat)) > 0
    counts = np.diff(np.r_[0, np.cumsum(full)][np.asarray(split.offsets)])
    return flat.filter(pa.array(full)).dictionary_encode(), counts


def shapes_of(words: pa.Array, shapes: int) -> np.ndarray:
    """The classes of words that have none of their own, by their ends."""
    ends = pc.utf8_slice_codeunits(words, -3).dictionary_encode()
    return np.array([zlib.crc32(e.encode()) % shapes for e in ends.dictionary.to_pylist()], np.int64)[np.asarray(ends.indices)]


def dealt(words: pa.Array, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, indices) of distinct words."""
    part = np.fromiter((zlib.crc32(w) % parts for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))
    order = np.argsort(part, kind="stable")
    return [(int(part[i[0]]), i) for i in np.split(order, np.flatnonzero(np.diff(part[order])) + 1)] if len(order) else []


def _documents(payload: bytes) -> tuple[pa.Table, pa.Array, np.ndarray]:
    """A block's documents (see ``BLOCK``), its distinct words, and its tokens as numbers of them; -1 ends a text."""
    table = unpacked(payload)
    whole = table.slice(0, 1)
    documents = pa.table({c: np.asarray(whole[c][0].values) for c in BLOCK})
    return documents, whole["words"][0].values, np.asarray(whole["codes"][0].values)


def _packed_block(group: pa.Table) -> bytes:
    """Texts (h, text, m) as one row of arrays; equal texts are one document."""
    group = group.group_by(["h", "text"]).aggregate([("m", "sum")]).sort_by([("h", "ascending"), ("text", "ascending")])
    words, counts = words_of(group["text"].combine_chunks())
    ends = np.cumsum(counts + 1) - 1
    codes = np.full(int(counts.sum()) + len(counts), -1, np.int32)
    inside = np.ones(len(codes), bool)
    inside[ends] = False
    codes[inside] = np.asarray(words.indices)
    row = {"h": group["h"].to_numpy(), "n": counts + 1, "m": group["m_sum"].to_numpy(), "words": words.dictionary, "codes": codes}
    return packed(pa.table({k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for k, v in row.items()}))


def text_blocks(rows: DataFrame, blocks: int, held_bytes: int = 16 << 20) -> DataFrame:
    """block, payload: the distinct texts of each of the blocks, dealt by the hashes of texts, whatever the partitions.

    Rows: h, text, m. A task sends a text once, so one that a third of all rows hold comes once from each task.
    """

    def gather(batches):
        held, size = [], 0

        def flushed():
            one = pa.Table.from_batches(held).group_by(["h", "text"]).aggregate([("m", "sum")])
            block = pa.array(one["h"].to_numpy().view(np.uint64) % np.uint64(blocks), pa.int32())
            return pa.table([block, one["h"], one["text"], one["m_sum"]], ["block", "h", "text", "m"]).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= held_bytes:
                yield from flushed()
                held, size = [], 0
        if held:
            yield from flushed()

    def pack(group: pa.Table) -> pa.Table:
        return pa.table([group["block"].slice(0, 1), pa.array([_packed_block(group)], pa.binary())], ["block", "payload"])

    sent = rows.mapInArrow(gather, "block int, h long, text string, m long")
    return bucketed(sent.groupBy("block").applyInArrow(pack, "block int, payload binary"), "texts", "block", blocks)


def score_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    held: int = 0,
    of: int = 10,
    classes: int = 16,
    width: int = 32,
    shapes: int = 16,
    hidden: int = 16,
    start_one_in: int = 16,
    rows_per_block: int = 4000,
    bytes_per_block: int = 32 << 20,
    rows_per_part: int = 8000,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every whole document.

    Learned from documents whose crc32 of the key as text modulo ``of`` is not ``held``. Texts are dealt to blocks (of about
    ``rows_per_block`` rows or ``bytes_per_block`` bytes, whichever are more blocks) by their hashes and written once, equal texts as one that counts as often as it is learned from. Word counts cover all of them:
    each block sends its distinct words to their parts, which answer with global counts.

    The model: P(word) is P(class | state) * P(word | class, state), both softmaxes of the recurrent network, for the end and
    the ``classes * width - 1`` commonest words, in classes by their ranks. Other words share ``shapes`` classes by their ends;
    in such a class a word has its share by count and, by the Good-Turing estimate, unknown words have one together. The
    network learns from every learning document: one block in ``start_one_in`` gives a start, then every block runs a pass of
    truncated backpropagation from there, and weights are averaged by tokens. Blocks depend on the texts and their number
    alone, so partitions do not change the scores (but for the rounding of sums). States are carried over whole texts.

    Null or empty text: the end alone. Without documents to learn from, counts are 0, base_score is that of unseen tokens
    and the score that of the unlearned network. Repeated rows are scored alike, null keys count as the empty text in the
    fold; other columns take no part; an empty table gives an empty result. Texts are known by 64-bit hashes.
    """
    spark = docs.sparkSession
    shape = gru.Shape(classes, width, shapes, hidden)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (crc_mod(key, of) == held).alias("held")).withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.count("*").alias("n"), F.sum((~F.col("held")).cast("long")).alias("train"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts, count_blocks = max(64, size["n"] // rows_per_part), max(8, size["n"] // rows_per_block, (size["bytes"] or 0) // bytes_per_block)
    ends = size["train"] or 0
    blocks = text_blocks(rows.select("h", "text", (~F.col("held")).cast("long").alias("m")), count_blocks)

    def send(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                documents, words, codes = _documents(payload)
                inside = codes >= 0
                learned = np.bincount(codes[inside], np.repeat(documents["m"].to_numpy(), documents["n"].to_numpy())[inside], len(words)).astype(np.int64)
                found = [(p, packed(pa.table({"w": words.take(pa.array(i)), "c": learned[i]}))) for p, i in dealt(words, parts)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int32()), pa.array([p for p, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], ["block", "part", "payload"])

    def count(group: pa.Table) -> pa.Table:
        """All blocks' words of a part: global counts, back to the blocks; and sums over the part in a row of its own."""
        sent_ = [unpacked(p) for p in group["payload"].to_pylist()]
        coded = pa.concat_arrays([t["w"].combine_chunks() for t in sent_]).dictionary_encode()
        at = np.asarray(coded.indices)
        total = np.bincount(at, np.concatenate([t["c"].to_numpy() for t in sent_])).astype(np.int64)
        cuts = np.cumsum([t.num_rows for t in sent_])[:-1]
        out = [packed(pa.table({"c": total[i]})) for i in np.split(at, cuts)]
        kind = shapes_of(coded.dictionary, shapes)
        sums = np.r_[np.bincount(kind, total, shapes), np.bincount(kind, total == 1, shapes), (total > 0).sum(), total.sum()].astype(np.int64)
        names = coded.dictionary.to_pylist()
        most = shape.known - 1
        edge = max(1, int(np.partition(total, -most)[-most])) if len(total) > most else 1
        best = sorted(np.flatnonzero(total >= edge).tolist(), key=lambda i: (-total[i], names[i]))[:most]
        none = [None] * len(out)
        return pa.table(
            [
                pa.array([*group["block"].to_pylist(), -1], pa.int32()),
                pa.array([*group["part"].to_pylist(), group["part"][0].as_py()], pa.int32()),
                pa.array([*out, b""], pa.binary()),
                pa.array([*none, sums.tolist()], pa.list_(pa.int64())),
                pa.array([*none, [names[i] for i in best]], pa.list_(pa.string())),
                pa.array([*none, [int(total[i]) for i in best]], pa.list_(pa.int64())),
            ],
            ["block", "part", "payload", "sums", "top", "counts"],
        )

    sent = blocks.mapInArrow(send, "block int, part int, payload binary")
    counted = written(sent.groupBy("part").applyInArrow(count, "block int, part int, payload binary, sums array<bigint>, top array<string>, counts array<bigint>"), "word-counts")
    stats = counted.where("block = -1")
    sums = np.zeros(2 * shapes + 2, np.int64)
    for r in stats.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r["i"]] = r["v"]
    top = stats.select(F.explode(F.arrays_zip("top", "counts")).alias("x")).select("x.*").orderBy(F.desc("counts"), "top").limit(shape.known - 1).collect()
    own = pa.array([r["top"] for r in top], pa.string())
    in_shape, once = sums[:shapes].copy(), sums[shapes : 2 * shapes].copy()
    np.subtract.at(in_shape, shapes_of(own, shapes), np.array([r["counts"] for r in top], np.int64))
    np.subtract.at(once, shapes_of(own, shapes), np.array([r["counts"] == 1 for r in top], np.int64))
    distinct, tokens = int(sums[2 * shapes]) + (ends > 0), int(sums[2 * shapes + 1]) + ends
    counts = np.zeros(shape.known + shapes)
    counts[0], counts[1 : 1 + len(top)], counts[shape.known :] = ends, [r["counts"] for r in top], in_shape
    unknown = (once + 0.5) / (in_shape + 1.0)

    def numbers(words: pa.Array) -> np.ndarray:
        """The network's numbers of distinct words; the last is that of the end."""
        at = pc.fill_null(pc.index_in(words, own), -1).to_numpy(zero_copy_only=False)
        return np.r_[np.where(at >= 0, at + 1, shape.known + shapes_of(words, shapes)), gru.END]

    def round_of(blocks_: DataFrame, start: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(start)

        def learn(batches):
            total, got = 0.0, np.zeros(len(start))
            for batch in batches:
                for payload in batch.column(0).to_pylist():
                    documents, words, codes = _documents(payload)
                    m = np.repeat(documents["m"].to_numpy(), documents["n"].to_numpy())
                    if m.any():
                        learned = gru.train(shape, shared.value, numbers(words)[codes[m > 0]], m[m > 0])
                        got += learned.astype(np.float64) * float(m.sum())
                        total += float(m.sum())
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(got)), pa.int32()), pa.array(np.r_[total, got])], ["i", "v"])

        found = {r["i"]: r["v"] for r in blocks_.select("payload").mapInArrow(learn, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        return (np.array([found[i] for i in range(len(start))]) / found[-1]).astype(np.float32) if found else start

    weights = gru.initial(shape, counts)
    weights = round_of(blocks.where(F.col("block") % start_one_in == 0), weights)
    weights = round_of(blocks, weights)
    model = spark.sparkContext.broadcast(weights)
    floor = tokens + 0.1 * (distinct + 1)

    def assemble(key_, left: pa.Table, right: pa.Table) -> pa.Table:
        answers = dict(zip(right["part"].to_pylist(), right["payload"].to_pylist(), strict=True))
        out = []
        for payload in left["payload"].to_pylist():
            documents, words, codes = _documents(payload)
            places, got = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for part, i in dealt(words, parts):
                places.append(i), got.append(unpacked(answers[part])["c"].to_numpy())
            c = np.empty(len(words) + 1, np.int64)
            c[np.concatenate(places)], c[-1] = np.concatenate(got), ends
            kinds = numbers(words)
            base = np.log10((c + 0.1) / floor)
            inside = np.zeros(len(c))
            shaped = kinds >= shape.known
            g = kinds[shaped] - shape.known
            with np.errstate(divide="ignore"):
                inside[shaped] = np.log10(np.where(c[shaped] > 0, (1 - unknown[g]) * c[shaped] / np.maximum(in_shape[g], 1), unknown[g]))
            n = documents["n"].to_numpy()
            begins = np.cumsum(n) - n
            score = gru.score(shape, model.value, kinds[codes], n) / math.log(10) + np.add.reduceat(inside[codes], begins)
            known = np.add.reduceat((c > 0)[codes].astype(np.int64), begins)
            out.append(pa.table([documents["h"], pa.array(n, pa.int64()), pa.array(known), pa.array(np.add.reduceat(base[codes], begins)), pa.array(score)], names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)

    names = ["h", "n_tokens", "n_known", "base_score", "score"]
    replies = counted.where("block >= 0").select("block", "part", "payload")
    scored = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(assemble, "h long, n_tokens long, n_known long, base_score double, score double")
    found = rows.select("doc_id", "held", "h").join(written(scored, "scores"), "h")
    return found.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
