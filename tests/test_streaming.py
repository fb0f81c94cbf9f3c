import os

from pyspark.sql import functions as F

from jestframe.operators.metrics import running_best
from jestframe.session import scratch_path
from jestframe.sources import fixtures as X
from jestframe.streaming.best import current_best

from conftest import SF_SMALL


def test_current_best_aggregate(spark):
    logs = X.x_log(spark, SF_SMALL)
    src = scratch_path(spark, "stream_src2")
    logs.write.parquet(src)
    stream = spark.readStream.schema(logs.schema).parquet(src)
    q = (current_best(stream).writeStream.outputMode("complete").format("memory").queryName("best_now")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    from jestframe.operators.metrics import best_rows

    want = best_rows(logs, ["model"], "step", "macro_f1").select("model", F.col("step").alias("best_step"))
    got = spark.table("best_now").select("model", "best_step")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_batch_tracker_matches_batch_running_best(spark):
    """foreachBatch form: range-partitioned running best per micro-batch,
    seeded from a versioned state table; equal to the batch flags."""
    from jestframe.streaming.best import track_best_batches

    logs = X.x_log(spark, SF_SMALL)
    q1, q2 = logs.approxQuantile("step", [1 / 3, 2 / 3], 0.0)
    src = scratch_path(spark, "stream_src3")
    for i, part in enumerate((F.col("step") < q1, (F.col("step") >= q1) & (F.col("step") < q2), F.col("step") >= q2)):
        logs.where(part).coalesce(1).write.parquet(os.path.join(src, f"part={i}"))
    stream = (spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out, state, ckpt = (scratch_path(spark, n) for n in ("bb_out", "bb_state", "bb_ckpt"))
    q = (track_best_batches(stream, out, state).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.read.parquet(out).select("model", "step", "is_best")
    want = running_best(logs, ["model"], "step", "macro_f1").select("model", "step", "is_best")
    assert got.count() == want.count() == logs.count()
    assert got.exceptAll(want).count() == 0
    assert spark.read.parquet(state).select("v").distinct().count() == 3
