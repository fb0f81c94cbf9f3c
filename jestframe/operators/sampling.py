"""Sampling, splitting and slicing.

All random choices use the keyed draws of ``functions.rand``, so results do
not depend on partitioning or retries.  Ranks are exact without a
single-task window: rows are spread over ``2^bits`` buckets by the high bits
of their (uniform) random key, counts per (group, bucket) give each bucket its
offset, and ``row_number`` runs per (group, bucket).  A class that holds a
third of all rows is therefore split into thousands of window tasks.  Only
single numbers (row counts, smallest and largest class) reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import U_BITS, draw, position

# A class table is broadcast only after its rows were counted, up to this many.
BROADCAST_ROWS = 1 << 16
# Rows of fixed width up to this many are broadcast to the draws of over-sampling.
HASHED_ROWS = 1 << 16
TARGET_BUCKET_ROWS = 1 << 19
DRAW_CHUNK = 1 << 16
# Draws with replacement: expected draws per picked row above which the
# picked rows are replicated (salted), so no join key gets more than about
# this many draws however small a class is next to the largest.
DRAWS_PER_KEY = 1 << 16


def salt_factor(draws_per_row: float, limit: int | None = None) -> int:
    """Copies of each picked row needed to keep ~``DRAWS_PER_KEY`` draws per key."""
    return max(1, math.ceil(draws_per_row / (limit or DRAWS_PER_KEY)))


def _salted(ranked: DataFrame, copies: F.Column) -> DataFrame:
    """Each ranked row once per salt value 0..copies-1 (a no-op for 1)."""
    return ranked.withColumn("_salt", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where a null key matches a null key, as groups
    do (a plain join would drop the rows of a null group)."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in keys]
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in keys])


def _bits_for(n_rows: int, target_rows: int) -> int:
    """Bucket bits: at least 16 buckets, about ``target_rows`` rows each at most
    (the draw is uniform, so no group's bucket holds more)."""
    return max(4, min(U_BITS, math.ceil(math.log2(n_rows / target_rows + 1)) + 4))


def ranged(df: DataFrame, keys: list, blocks: int | None = None) -> DataFrame:
    """Range partitioning on ``keys``: ``blocks`` ranges if given, else the
    shuffle partitions, which AQE may merge when the input is small (an
    explicit count is never coalesced)."""
    return df.repartitionByRange(blocks, *keys) if blocks else df.repartitionByRange(*keys)


def exact_rank_by_order(df: DataFrame, order: str, by: list[str] | None = None, rank_col: str = "rank",
                        blocks: int | None = None) -> DataFrame:
    """1-based rank by an ``order`` column that is unique within ``by``:
    ``row_number() OVER (PARTITION BY by ORDER BY order)``.

    Range partitioning on (by, order) cuts the rows into ``blocks`` (default:
    the shuffle partitions, merged by AQE when small) contiguous ranges, balanced by Spark's sampled
    boundaries as in a global sort.  Each range is sorted and written once
    (``checkpoint``), which fixes every row's position in its range.  Counts
    per (range, group) give each range the number of the group's rows before
    it.  Every task holds one range, whatever the skew of ``by``."""
    by = list(by or [])
    keys = [F.col(c) for c in by] + [F.col(order)]
    x = (ranged(df, keys, blocks).sortWithinPartitions(*keys)
         .withColumn("_pos", F.monotonically_increasing_id()).checkpoint())
    x = x.withColumn("_blk", F.shiftright(F.col("_pos"), 33))
    starts = x.groupBy("_blk", *by).agg(F.count(F.lit(1)).alias("_c"), F.min("_pos").alias("_first"))
    w = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = starts.select("_blk", *by, "_first", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    if not by:
        offsets = F.broadcast(offsets)  # one row per range: at most the shuffle partitions
    joined = join_null_safe(x, offsets, ["_blk", *by])
    rank = F.col("_off") + (F.col("_pos") - F.col("_first")) + 1
    return joined.withColumn(rank_col, rank.cast("bigint")).drop("_pos", "_blk", "_first", "_off")


def with_draw(df: DataFrame, key: str, tag: str, name: str = "_u") -> DataFrame:
    return df.withColumn(name, draw(F.col(key), tag))


class BucketCounts:
    """Row counts per (group, bucket of the random key) and exact ranks from them.

    ``sizes`` (group, n) and ``offsets`` (group, bucket, rows before it) stay
    DataFrames whatever the number of groups; the driver only sees ``total``.
    A null group is a group like any other."""

    def __init__(self, x: DataFrame, u: str, by: list[str], bits: int | None = None, materialise: bool = False,
                 target_rows: int | None = None):
        self.by, self.u = list(by), u
        if materialise:
            # the input holds a shuffle: write it once (shared checkpoint
            # folder) so the count pass and the ranking pass read the same rows
            x = x.checkpoint()
        self.total = x.count()
        self.bits = bits or _bits_for(self.total, target_rows or TARGET_BUCKET_ROWS)
        self.x = x.withColumn("_b", F.shiftright(F.col(u), U_BITS - self.bits))
        counts = self.x.groupBy(*self.by, "_b").agg(F.count(F.lit(1)).alias("_c"))
        w = Window.partitionBy(*self.by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        self.offsets = counts.select(*self.by, "_b", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
        self.sizes = self.x.groupBy(*self.by).agg(F.count(F.lit(1)).alias("n"))

    def ranked(self, tiebreak: str | list[str], rank_col: str = "rank") -> DataFrame:
        """Rank 1..n within each group by (u, tiebreak...), exact; the
        tiebreak columns must make the order total for retries to agree."""
        ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
        joined = join_null_safe(self.x, self.offsets, [*self.by, "_b"])
        rn = F.row_number().over(
            Window.partitionBy(*self.by, "_b").orderBy(F.col(self.u), *[F.col(c) for c in ties]))
        return joined.withColumn(rank_col, (F.col("_off") + rn).cast("bigint")).drop("_b", "_off")


def exact_split(df: DataFrame, key: str, fraction: float, tag: str = "split", names=("train", "valid"),
                held_out: str = "ceil", materialise: bool = False) -> DataFrame:
    """Exactly ceil(f*n) (or floor) rows go to the held-out part.

    Rows are ranked by a keyed draw; the first ``m`` ranks are held out.
    Adds column ``part``."""
    bc = BucketCounts(with_draw(df, key, tag), "_u", [], materialise=materialise)
    n = bc.total
    m = math.ceil(fraction * n) if held_out == "ceil" else math.floor(fraction * n)
    r = bc.ranked(key, rank_col="_rank")
    return r.withColumn("part", F.when(F.col("_rank") <= m, F.lit(names[1])).otherwise(F.lit(names[0]))).drop(
        "_u", "_rank"
    )


def under_sample(df: DataFrame, key: str, label: str = "score", tag: str = "under") -> DataFrame:
    """Every class cut to the size of the smallest (A6), without
    replacement: the first ``min_n`` rows of each class by a keyed draw."""
    bc = BucketCounts(with_draw(df.where(F.col(label).isNotNull()), key, tag), "_u", [label])
    m = bc.sizes.agg(F.min("n")).first()[0]
    if m is None:
        return df.limit(0)
    return bc.ranked(key, rank_col="_rank").where(F.col("_rank") <= m).drop("_u", "_rank")


def over_sample(df: DataFrame, key: str, label: str = "score", tag: str = "over") -> DataFrame:
    """Every class drawn with replacement up to the size of the largest
    (A6; the largest class is bootstrapped too).  Draw i of class c picks the
    row of rank ``draw(c, tag||i) % n_c``; draws are equi-joined to ranked
    rows on (class, rank): no cross product, no per-class collect.

    The classes are a table (class, n, copies): a class drawn far more often
    than it has rows gets salted copies of its rows (``salt_factor``)."""
    bc = BucketCounts(with_draw(df.where(F.col(label).isNotNull()), key, tag + "_rank"), "_u", [label])
    sizes = bc.sizes.checkpoint()
    top, k = sizes.agg(F.max("n"), F.count(F.lit(1))).first()
    if top is None:
        return df.limit(0).withColumn("draw", F.lit(0).cast("bigint"))
    classes = sizes.select(label, F.col("n").alias("_n"), F.greatest(F.lit(1), F.ceil(F.lit(top) / F.col("n") / DRAWS_PER_KEY)).alias("_s"))
    last = F.lit((top - 1) // DRAW_CHUNK).cast("bigint")
    draws = (classes.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).repartition(label, "_chunk")
             .withColumn("draw", F.explode(F.sequence(F.col("_chunk") * DRAW_CHUNK, F.least(F.lit(top), (F.col("_chunk") + 1) * DRAW_CHUNK) - 1))))
    tagged = F.concat(F.lit(tag), F.col("draw").cast("string"))
    draws = draws.select(label, "draw", position(F.col(label), tagged, F.col("_n")).alias("_rank"), (F.col("draw") % F.col("_s")).alias("_salt"))
    copies = classes.select(label, "_s")
    ranked = bc.ranked(key, rank_col="_rank").drop("_u").join(F.broadcast(copies) if k <= BROADCAST_ROWS else copies, label)
    ranked = _salted(ranked, F.col("_s")).drop("_s")
    # the planner can't see how many draws a class table explodes to; the rows are
    # counted, so few of them are hashed next to the draws and many are merged
    few = bc.total <= HASHED_ROWS and not any(t in ("string", "binary") or t.startswith(("array", "map", "struct")) for _, t in ranked.dtypes)
    return draws.join(F.broadcast(ranked) if few else ranked.hint("merge"), [label, "_rank", "_salt"]).drop("_rank", "_salt")


def sample_rows(df: DataFrame, key: str, rows: int | None = None, tag: str = "sample",
                tiebreak: list[str] | None = None, unique_key: bool = False) -> DataFrame:
    """R1 + J3: ``rows`` draws with replacement (default: as many as rows),
    each a uniformly random row, by position in a keyed random order.
    Adds ``draw``.

    With ``unique_key`` (no two rows share ``key``) only keys are ranked and
    drawn, and the other columns join last."""
    keys = df.select(key) if unique_key else df
    bc = BucketCounts(with_draw(keys, key, "pos"), "_u", [])
    n = bc.total
    rows = n if rows is None else rows
    if n == 0 or rows == 0:
        return df.limit(0).withColumn("draw", F.lit(0).cast("bigint"))
    ranked = bc.ranked([key, *(tiebreak or [])], rank_col="_pos").drop("_u")
    spark = df.sparkSession
    draws = spark.range(0, rows, numPartitions=max(1, min(rows // 1_000_000 + 1, 100_000))).select(
        F.col("id").alias("draw")
    )
    draws = draws.withColumn("_pos", position(F.lit(tag), F.col("draw"), n))
    salt = salt_factor(rows / n)
    if salt == 1:
        picked = draws.join(ranked, "_pos").drop("_pos")
    else:
        # many more draws than rows: each row is picked ~rows/n times, so its
        # join key is split over ``salt`` copies
        draws = draws.withColumn("_salt", F.col("draw") % F.lit(salt))
        picked = draws.join(_salted(ranked, F.lit(salt)), ["_pos", "_salt"]).drop("_pos", "_salt")
    return picked.join(df, key) if unique_key and len(df.columns) > 1 else picked


def exact_quantiles(df: DataFrame, cols: str | list[str], qs: tuple[float, ...] | list[float]) -> DataFrame:
    """A5 for any columns: exact linear-interpolation quantiles (SQL
    ``percentile_cont``) as rows (column, q, value), without a value->count
    map (whose size grows with the number of distinct values).

    Values are counted per (column, value) first, which combines map-side, so
    a hot value is one row (``quantiles_of_counts`` does the rest).  Nulls and NaN
    are skipped; a column without values gets null quantiles."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols
    ])))
    values = stacked.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return quantiles_of_counts(values, cols, qs)


def quantiles_of_counts(counts: DataFrame, cols: list[str], qs: tuple[float, ...] | list[float]) -> DataFrame:
    """Quantiles (column, q, value) of counted values (column, value, n).

    The distinct values are range-partitioned on (column, value), each range is
    written once, and running counts within a range plus the counts of the
    ranges before give the ranks that a value covers.  The ranks around each
    q * (n - 1) are read back through a broadcast of 2 * columns * len(qs) targets."""
    spark = counts.sparkSession
    values = counts.select(F.col("column").alias("_col"), F.col("value").alias("_v"), F.col("n").alias("_c"))
    x = (ranged(values, ["_col", "_v"]).sortWithinPartitions("_col", "_v")
         .withColumn("_blk", F.spark_partition_id()).checkpoint())
    before = Window.partitionBy("_col").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = x.groupBy("_col", "_blk").agg(F.sum("_c").alias("_n")).select(
        "_col", "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    upto = Window.partitionBy("_col", "_blk").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = x.withColumn("_last", F.sum("_c").over(upto)).join(blocks, ["_col", "_blk"]).select(
        "_col", "_v", (F.col("_off") + F.col("_last")).alias("_to"), (F.col("_off") + F.col("_last") - F.col("_c")).alias("_from"))
    counts = spark.createDataFrame([(c,) for c in cols], "_col string").join(
        x.groupBy("_col").agg(F.sum("_c").alias("_n")), "_col", "left")
    targets = counts.select("_col", F.inline(F.array(*[
        F.struct(F.lit(float(q)).alias("q"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("_pos")) for q in qs
    ])))
    targets = targets.select("_col", "q", "_pos", (F.floor("_pos") + 1).alias("_lo"), (F.ceil("_pos") + 1).alias("_hi"))
    need = targets.select("_col", "q", "_pos", "_lo", "_hi", F.explode(F.array("_lo", "_hi")).alias("_r"))
    near = F.broadcast(need.withColumnRenamed("_col", "_c2"))  # 2 * columns * len(qs) target rows
    picked = ranked.join(near, (F.col("_col") == F.col("_c2")) & (F.col("_r") > F.col("_from")) & (F.col("_r") <= F.col("_to")))
    ends = picked.groupBy("_col", "q", "_pos").agg(
        F.max(F.when(F.col("_r") == F.col("_lo"), F.col("_v"))).alias("_vlo"),
        F.max(F.when(F.col("_r") == F.col("_hi"), F.col("_v"))).alias("_vhi"),
    )
    value = F.col("_vlo") + (F.col("_pos") - F.floor("_pos")) * (F.col("_vhi") - F.col("_vlo"))
    found = ends.select("_col", "q", value.alias("value"))
    return targets.select("_col", "q").join(found, ["_col", "q"], "left").withColumnRenamed("_col", "column")


def length_slice(df: DataFrame, text: str = "text", q: float = 0.9, side: str = "long") -> DataFrame:
    """Rows whose text length is >= the q-quantile (long) or <= it (short).

    The exact linear-interpolation quantile (N8) runs as a scalar subquery:
    one partial-aggregated pass over lengths, then a filter."""
    n = F.length(F.col(text))
    qv = df.select(F.percentile(F.length(F.col(text)), F.lit(q))).scalar()
    cond = n >= qv if side == "long" else n <= qv
    return df.where(cond)
