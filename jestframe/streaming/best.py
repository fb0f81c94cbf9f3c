"""Online best-checkpoint tracking (W1 / K3 as a stream).

The reference keeps the best evaluation of a training run inside the
trainer's log callback: each new evaluation is compared with the best so far
(strict ``>``) and becomes the new best when it is higher.  Here evaluation
logs arrive as a stream (files dropped by training jobs, a message bus, ...)
and each micro-batch runs the batch ``running_best`` seeded with every run's best so
far; every evaluation row leaves with its ``is_best`` flag, so the output equals
the batch flags when each run's logs arrive in step order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.streaming import DataStreamWriter

from ..operators.metrics import best_rows, not_nan, running_best


def current_best(stream: DataFrame, by: str = "model", step: str = "step", metric: str = "macro_f1") -> DataFrame:
    """Streaming aggregate of the best (metric, first step) per run, for an
    ``update`` / ``complete`` sink; combinable map-side like ``best_rows``."""
    value = not_nan(metric, stream)
    return stream.withColumn(metric, value).where(F.col(metric).isNotNull()).groupBy(by).agg(
        F.max_by(F.col(step), F.struct(F.col(metric), -F.col(step))).alias("best_step"),
        F.max(metric).alias("best_" + metric),
    )


def track_best_batches(stream: DataFrame, out: str, state: str, by: str = "model", step: str = "step",
                       metric: str = "macro_f1") -> DataStreamWriter:
    """Flags of a stream of logs (by, step, metric, is_best): each micro-batch
    runs the batch ``running_best`` (range-partitioned, so a run holding a third
    of a batch is spread over many tasks), seeded with every run's best so far.

    The best so far is a small table (one row per run) in the shared folder
    ``state``, one version per batch id (``v=<id>``).  Batch ``i`` reads the
    latest version below ``i`` and overwrites ``out/batch_id=<i>`` and
    ``state/v=<i>``, so a replayed batch writes the same rows again.  Add
    ``checkpointLocation`` and a trigger to the returned writer and start it.
    Flags equal the batch ones when each run's logs arrive in step order."""

    def read_prior(spark, batch_id: int) -> DataFrame | None:
        # batch ids are consecutive: the previous version is read directly;
        # only when it is missing (first batch) are the versions listed
        try:
            return spark.read.parquet(f"{state}/v={batch_id - 1}").select(by, step, metric)
        except AnalysisException:
            pass
        try:
            versions = spark.read.parquet(state).where(F.col("v") < batch_id)
        except AnalysisException:  # no state written yet
            return None
        last = versions.agg(F.max("v")).first()[0]
        return None if last is None else versions.where(F.col("v") == last).select(by, step, metric)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(by, step, F.col(metric).cast("double").alias(metric))
        prior = read_prior(spark, batch_id)
        start = prior.select(by, F.col(metric).alias("_start")) if prior is not None else None
        flagged = running_best(rows, [by], step, metric, start=start).select(by, step, metric, "is_best")
        path = f"{out}/batch_id={batch_id}"
        flagged.write.mode("overwrite").parquet(path)
        # new best per run: the earlier best, else the first maximum of this
        # batch; read from the flags just written (the is_best rows only)
        news = spark.read.parquet(path).where("is_best").select(by, step, metric)
        candidates = news if prior is None else prior.unionByName(news)
        best_rows(candidates, [by], step, metric).write.mode("overwrite").parquet(f"{state}/v={batch_id}")

    return stream.writeStream.foreachBatch(process)
