"""W1 with keyed state: flags equal the batch ones through a restart."""

import os

from pyspark.sql import functions as F

from jestframe.operators.metrics import best_rows, running_best
from jestframe.session import scratch_path
from jestframe.sources import fixtures as X
from jestframe.streaming.state import best_so_far, track_best

from conftest import SF_SMALL


def run(spark, src, schema, out, ckpt):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    track_best(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination(300)


def test_flags_equal_the_batch_ones_through_a_restart(spark):
    logs = X.x_log(spark, SF_SMALL).withColumn("macro_f1", F.when(F.col("step") % 11 == 0, float("nan")).when(F.col("step") % 13 != 0, F.col("macro_f1").cast("double")))
    q1, q2 = logs.approxQuantile("step", [1 / 3, 2 / 3], 0.0)
    src, out, ckpt = (scratch_path(spark, n) for n in ("state_src", "state_out", "state_ckpt"))
    parts = (F.col("step") < q1, (F.col("step") >= q1) & (F.col("step") < q2), F.col("step") >= q2)
    for i in range(2):
        logs.where(parts[i]).coalesce(1).write.parquet(os.path.join(src, f"part={i}"))
    run(spark, src, logs.schema, out, ckpt)
    logs.where(parts[2]).coalesce(1).write.parquet(os.path.join(src, "part=2"))
    run(spark, src, logs.schema, out, ckpt)  # another query, from the checkpoint
    got = spark.read.parquet(out).select("model", "step", "is_best")
    want = running_best(logs, ["model"], "step", "macro_f1").select("model", "step", "is_best")
    assert got.count() == logs.count() and got.exceptAll(want).count() == 0
    state = {r.model: (r.best, r.best_step) for r in best_so_far(spark, ckpt).collect()}
    best = {r.model: (r.macro_f1, r.step) for r in best_rows(logs, ["model"], "step", "macro_f1").collect()}
    assert state == best and len(best) > 5


def test_edges(spark):
    rows = [("a", 3, 0.7), ("a", 1, 0.5), ("a", 2, 0.7), ("n", 1, None), ("n", 2, float("-inf")), ("n", 3, -1.0), (None, 1, 0.5), ("a", 4, float("nan"))]
    logs = spark.createDataFrame(rows, "model string, step long, macro_f1 double")
    src, out, ckpt = (scratch_path(spark, n) for n in ("state_src", "state_out", "state_ckpt"))
    logs.coalesce(1).write.parquet(src)
    run(spark, src, logs.schema, out, ckpt)
    got = sorted((r.model, r.step, r.is_best) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1, True), ("a", 2, True), ("a", 3, False), ("a", 4, False), ("n", 1, False), ("n", 2, True), ("n", 3, True)]
