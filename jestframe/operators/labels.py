"""Label-producing operators: vote resolution (C1), annotation aggregates
(A2-A4, C7, C8), rated items (A7, J2, P6, C4) and the two label views (P4, P5).

Every aggregate here is algebraic (counts, min/max), so Spark combines it
map-side before the shuffle: a hot id or body costs one partial row per map
task, never a whole group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip, half_even


def resolve_votes(df: DataFrame, votes: list[str] | None = None) -> DataFrame:
    """Crowd votes -> score 0..5 without any shuffle.

    is_humor = 0 -> 0 (a null is_humor counts as humour, N4); otherwise the
    first category with more than half of the votes; else the highest category
    with at least a quarter; else 0.  Zero votes -> 0 (N13, documented)."""
    votes = votes or [f"votes_{i}" for i in range(1, 6)]
    v = [F.col(c).cast("bigint") for c in votes]
    # plain column arithmetic and CASE chains: stays in whole-stage codegen
    total = sum(v[1:], v[0])
    majority = F.coalesce(*[F.when(x * 2 > total, F.lit(i)) for i, x in enumerate(v, 1)], F.lit(0))
    quarter = F.coalesce(*[F.when(x * 4 >= total, F.lit(i)) for i, x in reversed(list(enumerate(v, 1)))], F.lit(0))
    score = (
        F.when(F.col("is_humor").eqNullSafe(0), F.lit(0))
        .when(total.isNull() | (total == 0), F.lit(0))
        .when(majority > 0, majority)
        .otherwise(quarter)
    )
    keep = [c for c in df.columns if c not in votes and c != "is_humor"]
    return df.select(*keep, clip(score, 0, 5).cast("int").alias("score"))


def annotation_summary(df: DataFrame, min_annotations: int = 4,
                       id_col: str = "id", text_col: str = "text", value_col: str = "sentiment",
                       order_col: str | None = None) -> DataFrame:
    """A2+A3+A4+J1: counts per (id, rating), then one row per id.

    Both aggregations combine map-side, and no set of rating levels is
    assumed.  Rows without an id are dropped (N12).  Output: id, text, n,
    zero_count, non_zero_count, rating (majority-or-max over the non-zero
    ratings).

    ``text`` is the first non-null text in ``order_col`` order (N11; equal
    orders: the smallest text); without an order column, the smallest text."""
    s = F.col(value_col)
    order = F.col(order_col) if order_col else F.lit(0)
    first = F.min(F.when(F.col(text_col).isNotNull(), F.struct(order.alias("o"), F.col(text_col).alias("t"))))
    levels = (df.where(F.col(id_col).isNotNull()).groupBy(id_col, s.alias("_s"))
              .agg(F.count(F.lit(1)).alias("_n"), first.alias("_first")))
    level, n = F.col("_s"), F.col("_n")
    nonzero = F.when(level != 0, level)
    g = levels.groupBy(id_col).agg(
        F.min("_first")["t"].alias("text"),
        F.sum(n).alias("n"),
        F.coalesce(F.sum(F.when(level == 0, n)), F.lit(0)).alias("zero_count"),
        F.coalesce(F.sum(F.when(~level.eqNullSafe(0), n)), F.lit(0)).alias("non_zero_count"),
        F.max(nonzero).alias("_max"),
        F.max(F.when(level != 0, F.struct(n.alias("c"), level.alias("s")))).alias("_mode"),
    ).where(F.col("n") >= F.lit(min_annotations))
    rating = (
        F.when(F.col("non_zero_count") == 0, F.lit(0))
        .when(F.col("_mode.c") * 2 > F.col("non_zero_count"), F.col("_mode.s"))
        .otherwise(F.col("_max"))
    )
    return g.select(id_col, "text", "n", "zero_count", "non_zero_count", rating.cast("int").alias("rating"))


def detection_from_summary(summary: DataFrame, id_col: str = "id") -> DataFrame:
    """Humour iff zero_count <= non_zero_count (a tie is humour)."""
    return summary.select(
        id_col, "text", (F.col("zero_count") <= F.col("non_zero_count")).cast("int").alias("score")
    )


def classification_from_summary(summary: DataFrame, id_col: str = "id") -> DataFrame:
    """Keep non_zero >= zero, score = rating - 1 (0..4)."""
    return summary.where(F.col("non_zero_count") >= F.col("zero_count")).select(
        id_col, "text", (F.col("rating") - 1).cast("int").alias("score")
    )


def rated_items(df: DataFrame, max_length: int = 512, id_col: str = "id") -> DataFrame:
    """C4: one ``groupBy(body)``.

    A body rated differently anywhere is dropped (A7+J2, conflicts are judged
    on the raw ratings), as are empty bodies and those over ``max_length``
    (P6).  Ratings round half to even (N7); the first item (smallest id) is
    kept (D2).  The length filter runs before the shuffle."""
    body = F.col("body")
    kept = df.where((body != "") & (F.length(body) <= max_length))
    g = kept.groupBy(F.xxhash64("body").alias("_h"), "body").agg(
        F.min(id_col).alias(id_col),
        F.min("rating").alias("_lo"),
        F.max("rating").alias("_hi"),
        F.count_if(F.col("rating").isNull()).alias("_nulls"),
        F.count(F.lit(1)).alias("_n"),
    )
    consistent = (F.col("_lo") == F.col("_hi")) & ((F.col("_nulls") == 0) | (F.col("_n") == 1))
    return g.where(consistent).select(id_col, F.col("body").alias("text"), half_even(F.col("_lo")).alias("score"))


def to_detection(df: DataFrame, score: str = "score") -> DataFrame:
    """Score -> 1 iff score != 0 (a null score counts as non-zero, N4)."""
    return df.withColumn(score, (~F.col(score).eqNullSafe(0)).cast("int"))


def to_classification(df: DataFrame, score: str = "score") -> DataFrame:
    """P5: keep score > 0, shift to 0..4."""
    return df.where(F.col(score) > 0).withColumn(score, (F.col(score) - 1).cast("int"))


def detection_message(detection: Column, rating: Column) -> Column:
    """The cascade's verdict from (detection label, classification label)."""
    return (
        F.when(detection == -1, F.lit("error"))
        .when(detection != 1, F.lit("no_humor"))
        .when(rating.isNull() | (rating == -1), F.lit("humor_unrated"))
        .otherwise(F.concat(F.lit("humor_"), (rating + 1).cast("string")))
    )
