"""Blocks of documents in compressed form: each task cuts its documents into blocks of a few MB."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame


def blocks_of(batches, size: int):
    """(block id, keys and texts) of a task's documents, ``size`` bytes of text in each or one longer document."""
    at, parts, held = 0, [], 0
    task = TaskContext.get()
    name = task.partitionId() if task else 0
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
        begin = 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                parts.append(batch.slice(begin, i - begin))
                yield f"{name}:{at}", pa.Table.from_batches(parts)
                at, parts, held, begin = at + 1, [], 0, i
            held += n
        parts.append(batch.slice(begin))
    if parts and sum(p.num_rows for p in parts):
        yield f"{name}:{at}", pa.Table.from_batches(parts)


def packed(table: pa.Table, level: int = 3) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def pack_blocks(docs: DataFrame, size: int) -> DataFrame:
    """block, payload: the documents (key, text) of each block."""

    def pack(batches):
        for name, table in blocks_of(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([packed(table, 9)], pa.binary())], ["block", "payload"])

    return docs.mapInArrow(pack, "block string, payload binary")
