"""Operator 11: sharding by a two-pass external shuffle.

1. Scatter: each row goes to one of ``buckets`` buckets by a seeded hash of all its
   columns.  The number of buckets follows the bytes of the texts, so that a
   bucket fits in a task's memory (``bucket_bytes``; with very much data, a larger
   value keeps the number of buckets in bounds).  Rows equal in all columns would meet
   in one bucket; those that repeat more often than a bucket may bear are scattered
   by the input partition as well, which a repeated task numbers the same way.
2. Each bucket is put in an order that doesn't depend on how its rows arrived,
   shuffled by Fisher-Yates with a generator seeded by (seed, bucket), and written.

The buckets one after another are a random order of all rows.  Counts per bucket
give each row its position in it, and the shards are consecutive, equally long
stretches of that order: their row counts are at most one apart.

Defined results: null and empty texts are rows like any other; repeated rows and
ids are separate rows; an empty table gives an empty result; with more shards than
rows, the last shards are empty.  All columns are handed through; columns named
shard or slot give way to the operator's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from jestframe.llm.common import written

SEED = 41
BUCKET_BYTES = 16 << 20
ROW_BYTES = 64
STARTS = 1 << 12


def row_hash(df: DataFrame, seed: int) -> Column:
    """Seeded hash of all columns of a row; which of them are null counts."""
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`")
             for f in df.schema.fields]
    return F.xxhash64(F.lit(seed), *parts, F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns]))


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniformly random order of n places: place i swaps with one of those from i on."""
    order = list(range(n))
    for i, j in enumerate((np.arange(n) + (rng.random(n) * (n - np.arange(n))).astype(np.int64)).tolist()):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def scattered(docs: DataFrame, text_col: str, bucket_bytes: int, seed: int) -> DataFrame:
    """bucket, h1, h2 (hashes of the row) and the row, dealt out by bucket."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + ROW_BYTES
    counts = (docs.select(row_hash(docs, seed).alias("h1"), size.alias("size")).groupBy("h1").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))
    counts = written(counts, "row-hashes")
    buckets = max(1, -(-(counts.agg(F.sum("size")).first()[0] or 0) // bucket_bytes))  # one number
    # at most four for each bucket; the bytes of the file tell the planner how few
    hot = written(counts.where((F.col("n") > 1) & (F.col("size") * 4 > bucket_bytes)).select(F.col("h1").alias("hot")), "hot-rows")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_hash(docs, seed).alias("h1"), row_hash(docs, seed + 1).alias("h2"),
                       F.spark_partition_id().alias("part"))
    rows = rows.join(hot, F.col("h1") == F.col("hot"), "left")
    bucket = F.pmod(F.xxhash64(F.lit(seed + 2), "h1", F.when(F.col("hot").isNotNull(), F.col("part"))), F.lit(buckets)).cast("int")
    return rows.select(bucket.alias("bucket"), "h1", "h2", "row").repartitionById(buckets, "bucket")


def shuffled(docs: DataFrame, *, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """bucket, at (place in its bucket's random order) and the row, written in that order."""
    dealt = scattered(docs, text_col, bucket_bytes, seed)

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition is a bucket
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is not None:
            numbers = table.column("bucket").to_numpy()
            for bucket in np.unique(numbers):
                own = table.filter(pa.array(numbers == bucket))
                order = np.lexsort((own.column("h2").to_numpy(), own.column("h1").to_numpy()))
                order = order[fisher_yates(len(order), np.random.default_rng([seed, int(bucket)]))]
                for i in range(0, len(order), 4096):
                    part = own.take(pa.array(order[i:i + 4096]))
                    for batch in part.select(["bucket", "row"]).append_column("at", pa.array(np.arange(i, i + len(part), dtype=np.int64))).combine_chunks().to_batches():
                        yield batch.select(["bucket", "at", "row"])

    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("at", T.LongType()), dealt.schema["row"]])
    return written(dealt.mapInArrow(shuffle, schema), "shuffled")


def starts(counts: DataFrame) -> DataFrame:
    """bucket, n -> bucket, start: rows in the buckets before, summed in two levels."""
    counts = counts.withColumn("many", F.expr(f"bucket div {STARTS}"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    far = counts.groupBy("many").agg(F.sum("n").alias("n")).select("many", F.coalesce(F.sum("n").over(before.orderBy("many")), F.lit(0)).alias("far"))
    near = counts.select("many", "bucket", F.coalesce(F.sum("n").over(before.partitionBy("many").orderBy("bucket")), F.lit(0)).alias("near"))
    return near.join(far, "many").select("bucket", (F.col("far") + F.col("near")).alias("start"))


def sharded(docs: DataFrame, shards: int = 24, *, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """``docs`` with shard (0 to shards - 1) and slot (place in its shard, from 0)."""
    rows = shuffled(docs, text_col=text_col, bucket_bytes=bucket_bytes, seed=seed)
    counts = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket-rows")
    total = counts.agg(F.sum("n")).first()[0] or 0  # one number
    long, rest = total // shards, total % shards  # ``rest`` shards hold a row more
    turn = F.lit(rest * (long + 1))
    at = rows.join(starts(counts), "bucket").withColumn("pos", F.col("start") + F.col("at"))
    first = F.col("pos") < turn
    shard = F.when(first, F.expr(f"pos div {long + 1}")).otherwise(F.lit(rest) + F.expr(f"(pos - {rest * (long + 1)}) div {max(1, long)}"))
    slot = F.when(first, F.col("pos") % (long + 1)).otherwise((F.col("pos") - turn) % max(1, long))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return at.select(*kept, shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str) -> None:
    """Write ``sharded`` rows as Parquet, a folder for each shard; each file's rows ascend by slot."""
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
