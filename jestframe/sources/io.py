"""Sources and sinks.

Readers take explicit schemas (never ``inferSchema``); CSV options follow
the reference's pandas round trip: quoted multi-line fields, doubled quotes,
outer blanks kept (SURVEY N1, N2).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- schemas of the corpus tables (FIXTURES part 1) -------------------------
LABELLED = T.StructType([T.StructField("text", T.StringType()), T.StructField("score", T.IntegerType())])
UNLABELLED = T.StructType([T.StructField("text", T.StringType())])
VOTES = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("is_humor", T.IntegerType())]
    + [T.StructField(f"votes_{i}", T.IntegerType()) for i in range(1, 6)]
)
ANNOTATIONS = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("text", T.StringType()),
     T.StructField("sentiment", T.IntegerType())]
)
RATED = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("body", T.StringType()),
     T.StructField("rating", T.DoubleType())]
)
TRAIN_LOG = T.StructType(
    [T.StructField("step", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("train_loss", "loss", "accuracy", "macro_f1", "weighted_f1")]
)

CSV_READ = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}
CSV_WRITE = {
    "header": "true", "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}

ARRAY_BYTES = 16 << 20  # of a JSON array file, which one task reads whole

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# Row keys of the driver tables, used to spread a scan that arrives in too
# few splits (hash partitioning on a key is deterministic under retries).
TABLE_KEYS = {
    "documents": "doc_id", "labels": "doc_id", "conversations": "conv_id", "benchmark": "item_id",
    "embeddings": "vec_id", "events": "event_id", "pages": "page_id", "lineitem": "l_orderkey",
    "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables (see ``spread``)."""
    return spread(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")), TABLE_KEYS.get(name))


def spread(df: DataFrame, key: str | None) -> DataFrame:
    """Hash-repartition a scan on ``key`` when it has fewer partitions than
    there are task slots; only where ``spark.jestframe.spread=true`` asks for it
    (a laptop reading small files).

    Per-row work here is CPU-heavy (keyed md5 draws, whole-text token
    arrays), and a file written as one row group is read by one task however
    many cores wait.  Planning the scan to count its splits runs no job."""
    spark = df.sparkSession
    if key is None or spark.conf.get("spark.jestframe.spread", "false") != "true":
        return df
    slots = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, key)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, na_tokens: list[str] | None = None) -> DataFrame:
    """S1.  ``na_tokens`` turns pandas' NA strings into nulls (N3, off by default)."""
    df = spark.read.schema(schema).options(**CSV_READ).csv(path)
    if na_tokens:
        for f in schema.fields:
            if isinstance(f.dataType, T.StringType):
                df = df.withColumn(f.name, F.when(F.col(f.name).isin(na_tokens), None).otherwise(F.col(f.name)))
    return df


def _ordered(df: DataFrame, order_by: list[str] | None) -> DataFrame:
    """O1: key order is applied at the sink only (a range-partitioned sort
    whose part files are in key order), never inside a job."""
    return df.orderBy(*order_by) if order_by else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", order_by: list[str] | None = None) -> None:
    """Header, no index, blanks and quotes preserved."""
    _ordered(df, order_by).write.mode(mode).options(**CSV_WRITE).csv(path)


def write_json_arrays(df: DataFrame, path: str, array_bytes: int = ARRAY_BYTES) -> None:
    """S3 sink: files of one JSON array each.  Such a file is read by one task,
    so every task cuts its rows, as they stream, into arrays of ``array_bytes``
    or, at most, one row more: the number of files grows with the input."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in batch.column("value").to_pylist():
                rows.append(row)
                size += len(row.encode())
                if size >= array_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(rows) + "]"], pa.string())], names=["value"])
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(rows) + "]"], pa.string())], names=["value"])

    (df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(arrays, "value string")
     .write.mode("overwrite").option("maxRecordsPerFile", 1).text(path))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = RATED) -> DataFrame:
    """S3: a file holding one JSON array of objects; each element is a row."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = RATED) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_json(df: DataFrame, path: str) -> None:
    """Add records to an existing JSON data set (one object per line)."""
    df.write.mode("append").json(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", order_by: list[str] | None = None) -> None:
    _ordered(df, order_by).write.mode(mode).parquet(path)


def from_prompts(spark: SparkSession, prompts: list[str], score: int = 0) -> DataFrame:
    """A literal list of prompts (e.g. the sanity prompts, I5) as a
    (text, score) table with a constant score.  For driver-side literals
    only; data of any size comes in as a DataFrame with a ``text`` column."""
    return spark.createDataFrame([(p,) for p in prompts], UNLABELLED).withColumn("score", F.lit(score).cast("int"))


# --- S9: training logs ----------------------------------------------------------
LOG_NAME = r"^(.+)_(classification|detection)\.csv$"


def write_train_logs(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """S9 sink: one CSV data set per (model, task) under ``root``
    (``model=<m>/task=<t>/``), written in one pass by every task."""
    df.write.mode(mode).partitionBy("model", "task").options(**CSV_WRITE).csv(root)


def read_train_logs(spark: SparkSession, root: str) -> DataFrame:
    """S9 scan of logs written by ``write_train_logs``: model and task come
    from the partition folders, so a filter on them prunes whole folders."""
    schema = T.StructType(TRAIN_LOG.fields + [T.StructField("model", T.StringType()),
                                              T.StructField("task", T.StringType())])
    return spark.read.schema(schema).options(**CSV_READ).csv(root)


def read_named_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """S9 scan of loose ``{model}_{task}.csv`` files (the reference's layout):
    every file matching ``pattern`` in one read, with model and task taken
    from the file name (``_metadata.file_name``) instead of a driver loop."""
    df = spark.read.schema(TRAIN_LOG).options(**CSV_READ).csv(pattern)
    name = F.col("_metadata.file_name")
    return df.select(
        *TRAIN_LOG.fieldNames(),
        F.regexp_extract(name, LOG_NAME, 1).alias("model"),
        F.regexp_extract(name, LOG_NAME, 2).alias("task"),
    )


# --- S2: dataset registry ------------------------------------------------------
class Registry:
    """Dataset name -> (path, schema, format).  ``load`` accepts a name or a path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self.entries: dict[str, tuple[str, T.StructType, str]] = {}

    def register(self, name: str, relative: str, schema: T.StructType = LABELLED, fmt: str | None = None) -> None:
        """``fmt``: csv, json (files of one array each) or parquet; by the path's
        ending without it."""
        self.entries[name] = (os.path.join(self.root, relative), schema, fmt or self._ending(relative))

    @staticmethod
    def _ending(path: str) -> str:
        path = path.rstrip("/")
        return next((fmt for fmt in ("parquet", "json") if path.endswith("." + fmt)), "csv")

    def path(self, name: str) -> str:
        return self.entries[name][0]

    def load(self, name_or_path: str, schema: T.StructType | None = None) -> DataFrame:
        """A registered data set in its format, with its schema; or a path, read by
        its ending with ``schema``."""
        path, own, fmt = self.entries.get(name_or_path) or (name_or_path, schema or LABELLED, self._ending(name_or_path))
        if fmt == "parquet":
            return self.spark.read.parquet(path)
        return read_json_array(self.spark, path, own) if fmt == "json" else read_csv(self.spark, path, own)
