"""Uniqueness across corpora that grow (U2, C9, C10): what is written is not
shuffled again.

A corpus is a table in folders by batch, each cut into ``buckets`` by the sha256 of
the text, with one row for each distinct text of a batch: its digest, the number
of its rows and the smallest of them.  A new batch is combined map-side, shuffled
once to the buckets and written.  All questions across batches are then asked
bucket by bucket, over scans that already are where they have to be:

* ``unique``: an aggregate by digest without an exchange;
* ``added`` and ``withdrawn``: what a batch adds to the unique texts and what it
  takes away from them, a merge join of the batch's folder with the digests
  and counts of the others (their texts aren't read), without an exchange.

Writing a batch again replaces its folder, so a repeated job leaves one copy.
Null texts are one text (as in D1); digests stand for texts, which is exact as
far as sha256 is.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class GrowingCorpus:
    """The corpus written below ``path`` (new or existing), with rows of ``schema``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "text", buckets: int = BUCKETS):
        self.spark, self.key, self.schema, self.buckets = spark, key, schema, buckets
        self.name = f"corpus_{os.urandom(8).hex()}"  # the catalogue's entry; the data is its path
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, n BIGINT, row {schema.simpleString()}, batch STRING) USING parquet "
                  f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        spark.catalog.recoverPartitions(self.name)  # the batches of an existing corpus

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def write(self, batch: str, rows: DataFrame) -> None:
        """Write ``rows`` as batch ``batch``, in place of what it held."""
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        digest = F.unhex(F.coalesce(F.sha2(F.col(self.key).cast("string"), 256), F.lit("")))
        own = (rows.select(digest.alias("digest"), F.struct(*fields).alias("row")).groupBy("digest")
               .agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")))
        # the buckets' own hash: one file for each bucket
        own = own.repartition(self.buckets, "digest")
        name = batch.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{name}') SELECT digest, n, row FROM {{own}}", own=own)
        self.spark.catalog.refreshTable(self.name)

    def counts(self, but: str | None = None) -> DataFrame:
        """digest, n over all batches (without ``but``); reads no texts."""
        t = self.table() if but is None else self.table().where(F.col("batch") != but)
        return t.groupBy("digest").agg(F.sum("n").alias("n"))

    def unique(self) -> DataFrame:
        """The rows whose text occurs once in all batches together."""
        once = self.table().groupBy("digest").agg(F.sum("n").alias("n"), F.min("row").alias("row")).where("n = 1")
        return once.select("row.*")

    def added(self, batch: str) -> DataFrame:
        """The rows of ``batch`` whose text occurs in no other batch and once in it."""
        own = self.table().where((F.col("batch") == batch) & (F.col("n") == 1))
        return own.join(self.counts(but=batch).hint("merge"), "digest", "left_anti").select("row.*")

    def withdrawn(self, batch: str) -> DataFrame:
        """The rows that were unique without ``batch`` and are not with it."""
        own = self.table().where(F.col("batch") == batch).select("digest")
        before = (self.table().where(F.col("batch") != batch).groupBy("digest").agg(F.sum("n").alias("n"), F.min("row").alias("row")).where("n = 1"))
        return before.join(own.hint("merge"), "digest", "left_semi").select("row.*")
