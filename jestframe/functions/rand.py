"""Reproducible random draws as pure column expressions.

A draw is a function of (seed, key, tag) only, so it does not depend on
partitioning, task retries or row order: ``u = first 60 bits of
md5("seed:key:tag")`` as an integer in [0, 2^60).  The same number
is computable in any SQL engine with md5, which lets random operators get a
full value check against an independent engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 79
U_BITS = 60  # 15 hex digits of the md5: positions stay unbiased far beyond 2^32 rows


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.lit(str(x))


def draw(key, tag, seed: int = DEFAULT_SEED) -> Column:
    """Uniform integer in [0, 2^60) for (seed, key, tag); BIGINT.

    Never null (``concat_ws`` skips nulls, md5 always answers); the coalesce
    only tells Catalyst so, which stops it from inferring ``IS NOT NULL``
    filters on joins over draws and evaluating the md5 a second time there."""
    text = F.concat_ws(":", F.lit(str(seed)), _as_col(key).cast("string"), _as_col(tag).cast("string"))
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, U_BITS // 4), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def position(key, tag, n, seed: int = DEFAULT_SEED) -> Column:
    """1-based position in [1, n]: ``draw % n + 1``, declared non-null like
    ``draw`` so that a join on it infers no filter that recomputes the md5."""
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    return F.coalesce(draw(key, tag, seed) % n_col, F.lit(0).cast("bigint")) + 1
