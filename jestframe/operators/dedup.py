"""De-duplication and set operators.

D1 (``drop_all_duplicates``) keeps only rows whose key occurs exactly once.
It is one ``groupBy(key)`` carrying ``count`` and ``min(struct(rest))``:
both combine map-side, so a key that holds a third of the table becomes one
partial row per map task before the shuffle, and a group of one is its own
row, so the result is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _grouping(df: DataFrame, keys: list[str]) -> list[Column]:
    """Group keys led by a 64-bit hash of a string key.

    Grouping on (hash(key), key) gives exactly the groups of ``key`` (the
    hash is a function of it), but the sort-based aggregation that string
    buffers require now compares 8-byte prefixes instead of long texts."""
    strings = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    lead = [F.xxhash64(*[F.col(k) for k in keys]).alias("_h")] if strings & set(keys) else []
    return lead + [F.col(k) for k in keys]


def drop_all_duplicates(df: DataFrame, subset: str | list[str] = "text") -> DataFrame:
    """D1 (pandas ``keep=False``); null keys group together."""
    keys = [subset] if isinstance(subset, str) else list(subset)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        g = df.groupBy(*_grouping(df, keys)).agg(F.count(F.lit(1)).alias("_n"))
        return g.where("_n = 1").select(*keys)
    g = df.groupBy(*_grouping(df, keys)).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*[F.col(c) for c in rest])).alias("_r")
    )
    return g.where(F.col("_n") == 1).select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def drop_all_duplicates_hashed(df: DataFrame, subset: str = "text", hash_fn=F.xxhash64) -> DataFrame:
    """D1 grouped on a 64-bit hash of the key alone, as a cross-check of
    ``drop_all_duplicates`` (which groups on (hash, key) and is the cheaper
    form: it shuffles each key once).  A hash seen once is surely unique; a
    hash seen more than once whose smallest row key equals its largest key is
    a true duplicate; only colliding hashes (vanishingly rare) are regrouped
    on the full key.  Exact.  ``hash_fn`` (Column -> Column) lets tests force
    collisions."""
    rest = [c for c in df.columns if c != subset]
    h = hash_fn(F.col(subset))
    g = df.withColumn("_h", h).groupBy("_h").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.col(subset)).alias("_hi"),
        F.min(F.struct(*[F.col(c) for c in [subset] + rest])).alias("_r"),
    )
    unique = g.where(F.col("_n") == 1).select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])
    collided = g.where((F.col("_n") > 1) & ~F.col(f"_r.{subset}").eqNullSafe(F.col("_hi"))).select("_h")
    again = drop_all_duplicates(
        df.withColumn("_h", h).join(collided, "_h", "left_semi").drop("_h"), subset
    )
    return unique.unionByName(again)


def keep_first(df: DataFrame, subset: str | list[str] = "text", order: str | Column | None = None) -> DataFrame:
    """One row per key, the first in ``order`` (smallest).  Exact and
    combinable map-side via ``min(struct(order, row))``."""
    keys = [subset] if isinstance(subset, str) else list(subset)
    rest = [c for c in df.columns if c not in keys]
    if order is None:
        return df.dropDuplicates(keys)
    o = F.col(order) if isinstance(order, str) else order
    g = df.groupBy(*_grouping(df, keys)).agg(F.min(F.struct(o.alias("_o"), *[F.col(c) for c in rest])).alias("_r"))
    return g.select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def vocabulary_union(a: list[str], b: list[str]) -> Column:
    """D3 + O2: sorted distinct union of two vocabularies, as an array literal."""
    return F.array_sort(F.array_distinct(F.concat(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))))


def union_all(*frames: DataFrame) -> DataFrame:
    """Bag union by column name, missing columns null-filled."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def union_unique(*frames: DataFrame, subset: str = "text") -> DataFrame:
    """A text present twice anywhere (inside or across corpora) is dropped
    from all of them; one shuffle over the union."""
    return drop_all_duplicates(union_all(*frames), subset)
