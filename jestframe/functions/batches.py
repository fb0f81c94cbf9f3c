"""Arrow batches in pieces, for tasks that make Python objects of their rows.

Spark bounds a batch by rows and by bytes (10,000 and 64 MB); as pandas strings,
with what is made of them, one takes several times that.  In pieces, a task holds
a batch as it came and the objects of a piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], col: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices with about ``limit`` bytes (and a row more
    at most) of the string column ``col``; no slice is empty or goes over a batch's end."""
    limit = limit or PIECE_BYTES
    for batch in batches:
        own = batch.column(col)
        if pa.types.is_string(own.type) or pa.types.is_large_string(own.type):
            sizes = pc.fill_null(pc.binary_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            window = (np.cumsum(sizes) - sizes) // limit
        else:
            window = np.zeros(batch.num_rows, np.int64)
        ends = [*(np.flatnonzero(np.diff(window)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for start, end in zip([0, *ends], ends, strict=False):
            yield batch.slice(start, end - start)


def with_strings(batch: pa.RecordBatch, **columns: list[str | None]) -> pa.RecordBatch:
    """``batch`` and string columns behind its own, which stay as they are."""
    return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.string()) for v in columns.values())], names=[*batch.schema.names, *columns])
