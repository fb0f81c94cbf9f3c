"""Evaluation tables: classification report (A8, F17, P9), weighted loss
(A10), best step (A9, K3), running best (W1), curve series (K5, F19),
parameter diff (F16, K6) and the metric / run sinks (S10, S11, F5).

Only small tables move: the report shuffles the confusion matrix (k^2 rows
per group, combined map-side), the loss is one global sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import IGNORE, log_softmax_at
from .sampling import join_null_safe, ranged

_METRICS = ("precision", "recall", "f1-score", "support")


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    by = list(by or [])
    return (
        # a missing prediction is no valid answer (-1); rows without a label have nothing to compare
        df.where(F.col(label).isNotNull()).withColumn(pred, F.coalesce(F.col(pred), F.lit(-1)))
        .groupBy(*by, F.col(label).alias("_l"), F.col(pred).alias("_p"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def class_stats(df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Per (group, class): tp, fp, fn, support, precision, recall, f1-score.

    Classes are the union of labels and predictions (sklearn), so a class
    only ever predicted (e.g. -1 for "no valid answer") has support 0 and
    scores 0, and it lowers the macro average.  Zero division -> 0."""
    by = list(by or [])
    cm = confusion(df, label, pred, by)
    hit = F.col("_l") == F.col("_p")
    miss = F.when(hit, F.lit(0)).otherwise(F.col("_n"))
    cells = cm.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("_l").alias("cls"), F.when(hit, F.col("_n")).otherwise(F.lit(0)).alias("tp"),
                         F.lit(0).cast("bigint").alias("fp"), miss.alias("fn")),
                F.struct(F.col("_p").alias("cls"), F.lit(0).cast("bigint").alias("tp"), miss.alias("fp"),
                         F.lit(0).cast("bigint").alias("fn")),
            )
        ),
    )
    per = cells.groupBy(*by, "cls").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    support = F.col("tp") + F.col("fn")
    return per.select(
        *by, "cls", "tp", "fp", "fn", support.alias("support"),
        F.when(tp + fp == 0, 0.0).otherwise(tp / (tp + fp)).alias("precision"),
        F.when(tp + fn == 0, 0.0).otherwise(tp / (tp + fn)).alias("recall"),
        F.when(2 * tp + fp + fn == 0, 0.0).otherwise(2 * tp / (2 * tp + fp + fn)).alias("f1-score"),
    )


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred",
                          by: list[str] | None = None, prefix: str = "") -> DataFrame:
    """A8 + F17: the flattened report as a long table (by..., metric, value).

    Names: ``{class}_{precision|recall|f1-score|support}``, ``accuracy``,
    ``macro_avg_*``, ``weighted_avg_*`` (blanks already as ``_``)."""
    by = list(by or [])
    st = class_stats(df, label, pred, by)
    per_class = st.select(
        *by,
        F.inline(
            F.array(*[
                F.struct(
                    F.concat(F.lit(prefix), F.col("cls").cast("string"), F.lit("_" + m)).alias("metric"),
                    F.col(f"`{m}`").cast("double").alias("value"),
                )
                for m in _METRICS
            ])
        ),
    )
    s = F.col("support").cast("double")
    tot = F.sum(s)
    agg = st.groupBy(*by).agg(
        (F.sum("tp") / tot).alias("accuracy"),
        tot.alias("n"),
        *[F.avg(F.col(f"`{m}`")).alias(f"macro_{m}") for m in _METRICS[:3]],
        *[(F.sum(F.col(f"`{m}`") * s) / tot).alias(f"weighted_{m}") for m in _METRICS[:3]],
    )
    summary_rows = [F.struct(F.lit(prefix + "accuracy").alias("metric"), F.col("accuracy").alias("value"))]
    for kind in ("macro", "weighted"):
        for m in _METRICS[:3]:
            summary_rows.append(F.struct(F.lit(f"{prefix}{kind}_avg_{m}").alias("metric"), F.col(f"`{kind}_{m}`").alias("value")))
        summary_rows.append(F.struct(F.lit(f"{prefix}{kind}_avg_support").alias("metric"), F.col("n").alias("value")))
    summary = agg.select(*by, F.inline(F.array(*summary_rows)))
    return per_class.unionByName(summary)


def weighted_cross_entropy(df: DataFrame, logits: str = "logits", label: str = "label",
                           weights: list[float] | None = None, k: int | None = None,
                           by: list[str] | None = None) -> DataFrame:
    """A10: sum(w_y * nll) / sum(w_y) with nll = logsumexp(x) - x_y.

    Classes without a given weight get 0.0 (the reference's default); with no
    weights at all every class weighs 1.  Rows whose label is null, the ignore
    label or no position of the logits count nowhere; a weight sum of 0 gives
    a null loss.  One global (or per group) sum."""
    by = list(by or [])
    y = F.col(label)
    counted = y.isNotNull() & (y != IGNORE) & (y >= 0) & (y < F.size(logits))
    nll = F.when(counted, -log_softmax_at(F.col(logits), y))
    if weights is None:
        w = F.lit(1.0)
    else:
        size = k or len(weights)
        full = [float(x) for x in weights] + [0.0] * max(0, size - len(weights))
        w = F.coalesce(F.when(counted, F.try_element_at(F.array(*[F.lit(x) for x in full]), (y + 1).cast("int"))), F.lit(0.0))
    x = df.where(counted).select(*by, w.alias("_w"), nll.alias("_nll"))
    return x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.sum(F.col("_w") * F.col("_nll")), F.sum("_w")).alias("loss"),
    )


def best_rows(df: DataFrame, by: list[str], step: str = "step", metric: str = "macro_f1") -> DataFrame:
    """Per group, the row with the highest metric; the first
    (smallest step) wins a tie.  ``max_by`` over a (metric, -step) struct is
    combinable map-side, so a hot group costs one row per map task."""
    cols = [c for c in df.columns if c not in by]
    best = (
        df.where(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
        .groupBy(*by)
        .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(metric), -F.col(step))).alias("_b"))
    )
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in cols])


def not_nan(col: str, df: DataFrame) -> Column:
    """The column with NaN as null (Spark ranks NaN above every number)."""
    c = F.col(col)
    return F.when(~F.isnan(c), c) if dict(df.dtypes)[col] in ("float", "double") else c


def running_best(df: DataFrame, by: list[str], step: str = "step", metric: str = "macro_f1",
                 blocks: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """``is_best`` = metric strictly above every earlier metric of the
    group (the first evaluation is always best).

    Skew-safe: range partitioning on (group, step) cuts the rows into
    ``blocks`` contiguous ranges (default: the shuffle partitions, merged by
    AQE when small), balanced
    by Spark's sampled boundaries and written once.  Each (range, group) gets
    the max of the group's earlier ranges from a small aggregated table, and
    the ordered window runs per (group, range).  A group with a third of all
    rows is spread over a third of the ranges instead of one task.

    ``start`` (columns ``by`` + ``_start``) is each group's best before these
    rows, e.g. from earlier micro-batches of a stream; a row must beat it too.
    A NaN metric is no metric: it is never best and beats nothing."""
    keys = [F.col(c) for c in by] + [F.col(step)]
    value = not_nan(metric, df)
    x = (ranged(df.withColumn("_m", value), keys, blocks).sortWithinPartitions(*keys)
         .withColumn("_blk", F.spark_partition_id()).checkpoint())
    bmax = x.groupBy(*by, "_blk").agg(F.max("_m").alias("_bm"))
    w1 = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    prior = bmax.select(*by, "_blk", F.max("_bm").over(w1).alias("_prior"))
    if start is not None:
        prior = join_null_safe(prior, start.select(*by, "_start"), by, "left").select(
            *by, "_blk", F.greatest(F.col("_prior"), F.col("_start").cast(prior.schema["_prior"].dataType))
            .alias("_prior"))
    joined = join_null_safe(x, prior, [*by, "_blk"])
    w2 = Window.partitionBy(*by, "_blk").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.greatest(F.col("_prior"), F.max("_m").over(w2))
    m = F.col("_m")
    is_best = m.isNotNull() & (prev.isNull() | (m > prev))
    return joined.withColumn("is_best", is_best).drop("_blk", "_prior", "_m")


def curve_series(logs: DataFrame, by: list[str], step: str = "step", series: list[str] | None = None,
                 metric: str = "macro_f1") -> DataFrame:
    """K5: the long (by, step, series, value, is_best_step) table behind the
    training plots; the best step per group comes from ``best_rows``."""
    series = series or [c for c in logs.columns if c not in by and c != step]
    long = logs.unpivot([*by, step], series, "series", "value")
    best = best_rows(logs.select(*by, step, metric), by, step, metric).select(*by, F.col(step).alias("_best"))
    return join_null_safe(long, best, by, "left").select(
        *by, step, "series", F.col("value").cast("double").alias("value"),
        F.coalesce(F.col(step) == F.col("_best"), F.lit(False)).alias("is_best_step"),
    )


def parameter_diff(params: Column, defaults: dict[str, str], prefix: str = "trainer_") -> Column:
    """F16: entries of a MAP<STRING,STRING> that differ from the defaults
    (null-safe), keys prefixed.  Keys absent from the defaults always differ."""
    d = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))])
    kept = F.map_filter(params, lambda k, v: ~F.map_contains_key(d, k) | ~v.eqNullSafe(F.try_element_at(d, k)))
    return F.transform_keys(kept, lambda k, v: F.concat(F.lit(prefix), k))


def metrics_sink(long: DataFrame, metric: str = "metric") -> DataFrame:
    """S10 + F4 (suffix test, replace): keep metrics named ``*accuracy|*f1-score|*loss|*precision|*recall``
    and drop an ``eval_`` prefix."""
    m = F.col(metric)
    return long.where(m.rlike("(accuracy|f1-score|loss|precision|recall)$")).withColumn(
        metric, F.regexp_replace(m, "eval_", "")
    )


def run_name(model_type: Column, classes: Column, started: Column) -> Column:
    """S11 + F5: ``{type}_{classification|detection}_{HH:mm:ss-dd/MM/yyyy}``."""
    output = F.when(classes == 5, F.lit("classification")).otherwise(F.lit("detection"))
    return F.concat_ws("_", model_type, output, F.date_format(started, "HH:mm:ss-dd/MM/yyyy"))
