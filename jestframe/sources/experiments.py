"""K6: the experiment parameter table (a dimension table) and the trainer
arguments that differ from the defaults (F16), per (model, task)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import parameter_diff

# model, task, max steps, batch size per device, class weights, threshold.
EXPERIMENTS = [
    ("bloom", "classification", 6500, 5, [1.0, 1.3, 1.2, 1.75, 4.0], None),
    ("canine", "classification", 1500, 30, [1.0, 1.0, 1.0, 1.5, 3.0], None),
    ("dccuchile", "classification", 1500, 30, None, None),
    ("distilbert", "classification", 1500, 30, None, None),
    ("distilgpt2", "classification", 3000, 15, None, None),
    ("lxyuan", "classification", 1500, 30, None, None),
    ("textdetox", "classification", 2000, 30, [0.7, 1.0, 1.0, 1.0, 1.0], None),
    ("bloom", "detection", 10000, 5, None, None),
    ("canine", "detection", 3000, 30, [1.3, 1.0], None),
    ("dccuchile", "detection", 3000, 30, [1.05, 1.0], 0.65),
    ("distilbert", "detection", 3000, 30, [1.1, 1.0], None),
    ("distilgpt2", "detection", 8000, 15, [1.2, 1.0], None),
    ("lxyuan", "detection", 3000, 30, [1.1, 1.0], None),
    ("textdetox", "detection", 3000, 30, [1.1, 1.0], None),
]

# Trainer defaults the arguments are compared with (a trainer's own defaults).
TRAINER_DEFAULTS = {"max_steps": "-1", "per_device_train_batch_size": "8"}

SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("task", T.StringType(), False),
    T.StructField("max_steps", T.IntegerType(), False),
    T.StructField("batch_size", T.IntegerType(), False),
    T.StructField("class_weights", T.ArrayType(T.DoubleType()), True),
    T.StructField("threshold", T.DoubleType(), True),
])


def experiments_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXPERIMENTS, SCHEMA)


def changed_arguments(experiments: DataFrame, prefix: str = "trainer_") -> DataFrame:
    """(model, task, param, value): trainer arguments that differ from the
    defaults, keys prefixed, values as text (the parameters a run logs)."""
    args = F.create_map(
        F.lit("max_steps"), F.col("max_steps").cast("string"),
        F.lit("per_device_train_batch_size"), F.col("batch_size").cast("string"),
    )
    return experiments.select(
        "model", "task", F.explode(parameter_diff(args, TRAINER_DEFAULTS, prefix)).alias("param", "value")
    )
