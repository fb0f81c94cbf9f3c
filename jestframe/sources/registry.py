"""The model registry of the inference app, as a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The app's model table (name, decoder, file name, load tuned
# weights, detection threshold), in the app's order.
MODEL_REGISTRY = [
    ("Bloom", True, "bloom", False, None),
    ("Bloom con LoRA", True, "bloom", True, None),
    ("Canine-c", False, "canine", True, None),
    ("DCCUChile", False, "dccuchile", True, 0.65),
    ("DeepSeek-Qwen", True, "deepseek-qwen", False, 0.35),
    ("DistilBert", False, "distilbert", True, None),
    ("DistilGPT2", True, "distilgpt2", False, None),
    ("DistilGPT2 con ajuste fino", True, "distilgpt2", True, None),
    ("Gemini 2.0 Flash", True, "gemini", False, None),
    ("LXYuan", False, "lxyuan", True, None),
    ("TextDetox", False, "textdetox", True, None),
]

SCHEMA = T.StructType([
    T.StructField("idx", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("decoder", T.BooleanType(), False),
    T.StructField("file_name", T.StringType(), False),
    T.StructField("load_tuned", T.BooleanType(), False),
    T.StructField("threshold", T.DoubleType(), True),
])


def registry_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(MODEL_REGISTRY)], SCHEMA)


def registry_sql() -> str:
    """The same table as a DuckDB VALUES list."""
    def lit(v):
        if v is None:
            return "CAST(NULL AS DOUBLE)"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v} AS DOUBLE)"

    rows = ", ".join(f"({i}, " + ", ".join(lit(v) for v in row) + ")" for i, row in enumerate(MODEL_REGISTRY))
    return f"SELECT * FROM (VALUES {rows}) AS r(idx, name, decoder, file_name, load_tuned, threshold)"
