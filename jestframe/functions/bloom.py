"""Bloom filters of keys: a bitmap whose size is a parameter, broadcast to rule
out rows before they are shuffled or joined.  What it lets through is still joined
exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4


def bits_for(keys: int, least: int = 20, most: int = 28) -> int:
    """Bits (a power of two) for so many keys: 16 for each, 2^most (32 MB) at most."""
    return 1 << max(least, min(most, (16 * max(1, keys) - 1).bit_length()))


def hashes(key: str, bits: int) -> list[Column]:
    """Columns _h0, _h1, ... of a key's bit numbers; null for a null key."""
    text = F.col(key).cast("string")
    return [F.when(text.isNotNull(), F.pmod(F.xxhash64(F.lit(s), text), F.lit(bits))).alias(f"_h{s}") for s in range(HASHES)]


def bitmap(rows: DataFrame, key: str, bits: int) -> np.ndarray:
    """The filter of the keys as 64-bit words: combined map-side, a row for each word at most."""
    each = rows.where(F.col(key).isNotNull()).select(F.explode(F.array(*hashes(key, bits))).alias("bit"))
    words = each.groupBy(F.expr("bit div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
    return out


def may_hold(batch: pa.RecordBatch, words: np.ndarray) -> np.ndarray:
    """Whether the filter may hold the key of each row of a batch with ``hashes``."""
    may = np.ones(batch.num_rows, bool)
    for s in range(HASHES):
        column = batch.column(f"_h{s}")
        at = column.fill_null(0).to_numpy()
        may &= (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool) & column.is_valid().to_numpy(zero_copy_only=False)
    return may
