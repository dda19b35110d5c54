"""Rows packed by key: a stateful operator meets a few rows a key, not each event, and types stay Arrow's.

Spark hands every group to Python by itself and converts each value of it; a blob (an Arrow stream of a key's rows) is one value.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

HELD = 32 << 20  # bytes of rows that a task gathers by key at once
ROWS, BYTES = 128, 8 << 10  # of a blob at most, unless a row is larger: Spark's batches count rows, and a blob is one


def blobs(table: pa.Table) -> Iterator[bytes]:
    """The table's rows in order."""
    for batch in table.combine_chunks().to_batches():
        n = int(max(1, min(ROWS, BYTES * batch.num_rows // max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, n):
            yield _blob(batch.slice(at, n))


def _blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def table(packed: Iterable[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in packed])


def pack(rows: DataFrame, key: str) -> DataFrame:
    """key, rows (blobs). Works on streams too; a watermark's column is inside."""
    kind = rows.schema[key].dataType.simpleString()

    def by_key(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        all_rows = pa.Table.from_batches(held).combine_chunks()
        codes = all_rows[key].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        all_rows, codes = all_rows.take(pa.array(order)), codes[order]
        ends = [*np.flatnonzero(np.diff(codes)) + 1, len(codes)]
        keys, out = [], []
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            for blob in blobs(all_rows.slice(start, end - start)):
                keys.append(start)
                out.append(blob)
        return pa.RecordBatch.from_arrays([all_rows[key].take(pa.array(keys)).combine_chunks(), pa.array(out, pa.binary())], [key, "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= HELD:
                yield by_key(held)
                held, size = [], 0
        if held:
            yield by_key(held)

    return rows.repartition(key).mapInArrow(run, f"`{key}` {kind}, rows binary")


def unpack(packed: DataFrame, schema: str) -> DataFrame:
    """The rows of blobs (rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from table(x.as_py() for x in batch.column("rows")).combine_chunks().to_batches()

    return packed.select("rows").mapInArrow(run, schema)
