"""Byte-level BPE encoding and decoding by a global shuffle of distinct words."""

from __future__ import annotations

import hashlib
import string
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import pack_blocks, packed, unpacked
from .chunks import encoding_of, merged, ranks_of
from .common import bucketed

#: A space that does not begin a match of its own: white space or the end comes next.
UNEVEN = r" ([\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]|\z)"


def matcher(pattern: str):
    """A function from a chunk (see ``Chunks``) to the pattern's matches in it."""
    find = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return find

    def matches(chunk: str) -> list[str]:
        # A space and letters are one match, and so is a mark after them; most chunks are such.
        if chunk[0] == " ":
            if chunk[1:].isalpha():
                return [chunk]
            if chunk[-1] in ".,;:!?" and chunk[1:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return find(chunk)

    return matches


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(order, chunks, bounds): the chunks of the texts, text ``order[i]``'s from ``bounds[i]`` to ``bounds[i + 1]``.

    Texts may be cut at each space before a character that is no white space; where white space runs, what belongs together
    is merged. A text without characters has no chunks.
    """
    texts = pc.fill_null(texts, "")
    uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
    even = pc.split_pattern(texts.filter(pa.array(~uneven)), " ")
    starts = np.asarray(even.offsets)
    flat = even.values
    head = np.zeros(len(flat), bool)
    head[starts[:-1]] = True
    chunks = pc.binary_join_element_wise(pc.if_else(pa.array(head), "", " "), flat, "")
    full = np.asarray(pc.binary_length(chunks)) > 0  # a text that begins with a space has an empty head
    lengths = np.diff(np.r_[0, np.cumsum(full)][starts])
    others = []
    for t in texts.filter(pa.array(uneven)).to_pylist():
        first, *rest = t.split(" ")
        others.append(merged(first, rest))
    chunks = pa.concat_arrays([chunks.filter(pa.array(full)), pa.array([c for o in others for c in o], pa.string())])
    bounds = np.r_[0, np.cumsum(np.r_[lengths, [len(o) for o in others]])].astype(np.int64)
    return np.r_[np.flatnonzero(~uneven), np.flatnonzero(uneven)], chunks, bounds


def dealt(distinct: pa.Array, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, indices) of distinct chunks: a word's part, whatever marks follow it."""
    words = pc.utf8_rtrim(distinct, characters=string.punctuation)
    part = np.fromiter((zlib.crc32(w) % parts for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))
    order = np.argsort(part, kind="stable")
    return [(int(part[i[0]]), i) for i in np.split(order, np.flatnonzero(np.diff(part[order])) + 1)] if len(order) else []


def _texts(payload: bytes) -> pa.Array:
    return unpacked(payload).column(1).combine_chunks().cast(pa.string())


def encode_documents(
    docs: DataFrame,
    ranks: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    key: str = "doc_id",
    text: str = "text",
    block_bytes: int = 16 << 20,
    rows_per_part: int = 8000,
    digest: bool = False,
) -> DataFrame:
    """Encode whole texts: doc_id, n_tokens, ids (array of int) and decoded (the bytes that the ids stand for).

    With ``digest``: doc_id, n_tokens, ids_sha256 (hex of the decimal ids joined by commas), decoded_sha256 instead.

    Documents are written once in compressed blocks, in a table bucketed by block. Each block sends its distinct chunks (a
    space, a word and the marks after it) to the word's part. A part cuts its chunks into the pattern's matches, encodes each
    distinct match once, and sends the ids back; the block joins them to its chunks by position and decodes the ids by the
    table of token bytes, whose size is the vocabulary's. Blocks stay where they are: only words and ids are shuffled.

    Null text counts as empty, with no ids. Repeated rows are encoded each; null keys stay null; other columns take no part;
    an empty table gives an empty result. A text longer than ``block_bytes`` is a block of its own.
    """
    ranks = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    n = rows.count()
    parts = max(64, n // rows_per_part)
    blocks = bucketed(pack_blocks(rows, block_bytes), "blocks", "block", max(64, 2 * n // rows_per_part))

    def send(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                distinct = chunks_of(_texts(payload))[1].dictionary_encode().dictionary
                found = [(part, packed(pa.table({"w": distinct.take(pa.array(i))}))) for part, i in dealt(distinct, parts)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.string()), pa.array([p for p, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], ["block", "part", "payload"])

    def encode(group: pa.Table) -> pa.Table:
        """All blocks' chunks of a part: each distinct match is encoded once."""
        matches, encoding, known = matcher(pattern), encoding_of(ranks), ranks_of(ranks)
        sent = [unpacked(p)["w"].combine_chunks() for p in group["payload"].to_pylist()]
        coded = pa.concat_arrays(sent).dictionary_encode()
        chunks = [matches(c) for c in coded.dictionary.to_pylist()]
        ids = {}
        for w in {w for ws in chunks for w in ws}:
            whole = known.get(w.encode())
            ids[w] = encoding.encode_ordinary(w) if whole is None else [whole]
        each = [ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]] for ws in chunks]
        kind = pa.list_(pa.uint16() if max(known.values()) < 1 << 16 else pa.uint32())
        all_, at, out = pa.array(each, kind), coded.indices, []
        begin = 0
        for s in sent:
            out.append(packed(pa.table({"ids": all_.take(at.slice(begin, len(s)))})))
            begin += len(s)
        return group.set_column(2, "payload", pa.array(out, pa.binary()))

    sent = blocks.mapInArrow(send, "block string, part int, payload binary")
    replies = sent.groupBy("part").applyInArrow(encode, "block string, part int, payload binary")

    def assemble(key_, left: pa.Table, right: pa.Table) -> pa.Table:
        known = ranks_of(ranks)
        token_bytes = np.full(max(known.values()) + 1, b"", object)
        for b, i in known.items():
            token_bytes[i] = b
        token_bytes = pa.array(token_bytes, pa.binary())
        token_names = pc.cast(pa.array(np.arange(len(token_bytes))), pa.string())
        answers = dict(zip(right["part"].to_pylist(), right["payload"].to_pylist(), strict=True))
        out = []
        for payload in left["payload"].to_pylist():
            table = unpacked(payload)
            order, chunks, bounds = chunks_of(_texts(payload))
            coded = chunks.dictionary_encode()
            places, got = [np.empty(0, np.int64)], []
            for part, i in dealt(coded.dictionary, parts):
                places.append(i), got.extend(unpacked(answers[part])["ids"].chunks)
            back = np.argsort(np.concatenate(places), kind="stable")
            ids = pa.concat_arrays(got).take(pa.array(back)) if got else pa.array([], pa.list_(pa.uint16()))
            counts = np.asarray(pc.list_value_length(ids)).astype(np.int64)[np.asarray(coded.indices)]
            n_tokens = np.diff(np.r_[0, np.cumsum(counts)][bounds])
            flat = ids.flatten()
            offsets = pa.array(np.r_[0, np.cumsum(np.asarray(pc.list_value_length(ids)))].astype(np.int32), pa.int32())
            decoded = _per_text(pc.binary_join(pa.ListArray.from_arrays(offsets, token_bytes.take(flat)), b""), coded.indices, bounds, b"")
            if digest:
                names = _per_text(pc.binary_join(pa.ListArray.from_arrays(offsets, token_names.take(flat)), ","), coded.indices, bounds, ",")
                sha = lambda a: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in a], pa.string())
                columns = [sha(names), sha(decoded)]
            else:
                every = ids.take(coded.indices).flatten().cast(pa.int32())
                columns = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_tokens)].astype(np.int32), pa.int32()), every), decoded]
            keys = table.column(0).take(pa.array(order)).combine_chunks()
            out.append(pa.table([keys.cast(kind_arrow), pa.array(n_tokens, pa.int64()), *columns], names_))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (kind_arrow, pa.int64(), *types)], names_)

    kind_arrow = to_arrow_type(docs.schema[key].dataType)
    kind = docs.schema[key].dataType.simpleString()
    names_ = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"]
    kinds = ("string", "string") if digest else ("array<int>", "binary")
    types = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.binary())
    schema = f"doc_id {kind}, n_tokens long, {names_[2]} {kinds[0]}, {names_[3]} {kinds[1]}"
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(assemble, schema)


def _per_text(values: pa.Array, codes: pa.Array, bounds: np.ndarray, between: bytes | str) -> pa.Array:
    """Each text's values, in order, joined."""
    large = pa.large_binary() if pa.types.is_binary(values.type) else pa.large_string()
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), values.cast(large).take(codes)), pa.scalar(between, large)).cast(values.type)
