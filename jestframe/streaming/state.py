"""Online best-checkpoint tracking with keyed state (W1, K3 as a stream).

The best metric of each run is a value in the state store, which the engine
checkpoints with the stream's offsets: a restarted query goes on from it, and
there are no tables of our own to version.  ``best_so_far`` reads the same state
as a table, while the query runs or after it.

A micro-batch hands each run's rows to the processor as a stream of frames; those of
one run and micro-batch are sorted by step there, so bound a micro-batch by the
source's options (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).  Where one run
may hold most of a large micro-batch, ``best.track_best_batches`` spreads its rows
over many tasks instead.  Flags equal the batch ones (``metrics.running_best``) when
each run's logs arrive in step order from one micro-batch to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BEST = T.StructType([T.StructField("best", T.DoubleType()), T.StructField("step", T.LongType())])


class RunningBest(StatefulProcessor):
    """Flags rows whose metric is strictly above all earlier ones of their run."""

    def __init__(self, by: str, step: str, metric: str):
        self.by, self.step, self.metric = by, step, metric

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", BEST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows), ignore_index=True).sort_values(self.step, kind="stable", ignore_index=True)
        value = frame[self.metric].astype("float64")  # a null or NaN metric is no metric
        before = value.cummax().ffill().shift()
        if self.best.exists():
            before = before.fillna(self.best.get()[0]).clip(lower=self.best.get()[0])
        flags = value.notna() & (before.isna() | (value > before))
        if flags.any():
            last = flags[flags].index[-1]
            self.best.update((float(value[last]), int(frame[self.step][last])))
        yield frame.assign(is_best=flags)

    def close(self) -> None:
        pass


def track_best(stream: DataFrame, by: str = "model", step: str = "step", metric: str = "macro_f1") -> DataFrame:
    """The stream's (by, step, metric) rows with ``is_best``, for an append sink.
    Runs without a name are left out, as a state needs a key."""
    ensure_state_store(stream.sparkSession)
    rows = stream.where(F.col(by).isNotNull()).select(by, F.col(step).cast("long").alias(step), F.col(metric).cast("double").alias(metric))
    schema = T.StructType([*rows.schema.fields, T.StructField("is_best", T.BooleanType())])
    return rows.groupBy(by).transformWithStateInPandas(RunningBest(by, step, metric), schema, "Append", "None")


def ensure_state_store(spark: SparkSession) -> None:
    """Value states need the RocksDB state store; another provider that the
    session names itself is left as it is."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(key):
        spark.conf.set(key, ROCKSDB)


def best_so_far(spark: SparkSession, checkpoint: str, by: str = "model") -> DataFrame:
    """by, best, best_step of every run, from the state of the stream that
    writes to ``checkpoint`` (its last finished micro-batch)."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "best").load()
    return state.select(F.col(f"key.{by}").alias(by), F.col("value.best").alias("best"), F.col("value.step").alias("best_step"))
