"""Data sets with a commit manifest (S7, O1): appends that may be repeated, and
files kept in key order.

A data set is a folder with data files below ``data/`` and one small JSON file for
each commit below ``commits/``.  A commit names the files it adds, with their rows
and key range, and is written last, whole or not at all: readers follow the commits
and see no file of a write that was cut off.  Batches have names, and a batch that is
committed already is not written again, so a repeated job appends once.

``append(..., key=...)`` also leaves out rows whose key the data set holds.  A
Bloom filter of all keys so far (BLOOM_BITS bits, beside each commit) clears most new
rows at once; only those that may be present are joined with the old keys, so the
answer is exact and what is new doesn't cross the network for it.

``order_by`` writes range-partitioned, sorted files, whose key ranges are in the
commit.  ``scan`` opens only the files that a range of keys needs, and ``in_order``
reads those one after another: rows in key order without a sort.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bloom import bitmap, hashes, may_hold
from ..operators.dedup import union_all
from ..session import scratch_path

BLOOM_BITS = 1 << 23  # 1 MiB; about 1 % of new keys are compared at 900,000 keys


class CommittedData:
    """Rows of ``schema`` below ``path``, in the format ``json`` or ``parquet``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json"):
        self.spark, self.path, self.schema, self.fmt = spark, path.rstrip("/"), schema, fmt
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def commits(self) -> list[dict]:
        """All commits, oldest first."""
        folder = self._path("commits")
        if not self._files.exists(folder):
            return []
        names = sorted(f.getPath().getName() for f in self._files.listStatus(folder))
        found = [n for n in names if n.endswith(".json")]
        return [json.loads(self._read(f"commits/{n}")) for n in found]

    def _read(self, name: str) -> str:
        stream = self._files.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commit(self, commit: dict, number: int) -> None:
        """Write beside, then rename: a name that exists already is left as it is."""
        beside, place = f"commits/.{number:08d}-{os.urandom(6).hex()}", f"commits/{number:08d}.json"
        stream = self._files.create(self._path(beside), False)
        stream.write(bytearray(json.dumps(commit).encode()))
        stream.close()
        if self._files.exists(self._path(place)) or not self._files.rename(self._path(beside), self._path(place)):
            raise RuntimeError(f"another append has committed {place}; run this one again")

    def _frame(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).format(self.fmt).load([f"{self.path}/{f}" for f in files])

    def read(self) -> DataFrame:
        """All committed rows."""
        return self._frame([f["name"] for c in self.commits() for f in c["files"]])

    def append(self, batch: str, rows: DataFrame, key: str | None = None, order_by: str | None = None) -> bool:
        """Append ``rows`` as batch ``batch``; False if it is committed already.

        With ``key``, rows whose key is present stay out, and of rows that share
        a new key the smallest stays; null keys are not compared.  With
        ``order_by`` (numbers or strings), the batch's files hold consecutive
        ranges of that column."""
        commits = self.commits()
        if any(c["batch"] == batch for c in commits):
            return False
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        if key is not None:
            rows = self._new_rows(rows, key, commits)
        folder = f"data/{len(commits):08d}-{os.urandom(6).hex()}"
        ordered = rows.repartitionByRange(order_by).sortWithinPartitions(order_by) if order_by else rows
        ordered.write.format(self.fmt).save(f"{self.path}/{folder}")
        stored = self._frame([folder])
        commit = {"batch": batch, "files": self._file_table(stored, folder, order_by), "order_by": order_by, "key": key, "bloom": None}
        if key is not None and all(c["key"] == key for c in commits):
            bits = bitmap(stored, key, BLOOM_BITS)
            if commits:
                bits |= self._bloom(commits[-1]["bloom"])
            commit["bloom"] = f"{folder}-keys"
            self.spark.createDataFrame([(bits.tobytes(),)], "bits binary").write.parquet(f"{self.path}/{commit['bloom']}")
        self._commit(commit, len(commits))
        return True

    def _file_table(self, stored: DataFrame, folder: str, order_by: str | None) -> list[dict]:
        """name, rows, key range and null keys of each file: a row for each file."""
        low, high, nulls = (F.min(order_by), F.max(order_by), F.count_if(F.col(order_by).isNull())) if order_by else (F.max(F.lit(None).cast("int")),) * 2 + (F.max(F.lit(0)),)
        found = (stored.groupBy(F.col("_metadata.file_name").alias("_f"))
                 .agg(F.count(F.lit(1)).alias("rows"), low.alias("low"), high.alias("high"), nulls.alias("nulls")).collect())
        # part numbers follow the ranges
        return [{"name": f"{folder}/{r._f}", "rows": r.rows, "low": r.low, "high": r.high, "nulls": r.nulls} for r in sorted(found, key=lambda r: r._f)]

    def _bloom(self, name: str) -> np.ndarray:
        return np.frombuffer(self.spark.read.parquet(f"{self.path}/{name}").first().bits, np.uint64).copy()

    def _new_rows(self, rows: DataFrame, key: str, commits: list[dict]) -> DataFrame:
        keyed = rows.where(F.col(key).isNotNull())
        first = keyed.groupBy(key).agg(F.min(F.struct(*[f.name for f in self.schema])).alias("r")).select("r.*")
        rows = first.unionByName(rows.where(F.col(key).isNull()))
        if not commits:
            return rows
        present = self.read().select(F.col(key).alias("_k")).where(F.col("_k").isNotNull())
        if commits[-1]["bloom"] is None:  # some commit has no keys: all rows are compared
            return rows.join(present, F.col(key) == F.col("_k"), "left_anti")
        path = scratch_path(self.spark, "marked")
        marked(rows, key, self._bloom(commits[-1]["bloom"])).write.parquet(path)
        both = self.spark.read.parquet(path)
        return (both.where(~F.col("_may")).unionByName(both.where("_may").join(present, F.col(key) == F.col("_k"), "left_anti"))
                .select(*[f.name for f in self.schema]))

    def _needed(self, low=None, high=None) -> list[dict]:
        """The files that may hold keys from ``low`` to ``high``, in key order."""
        commits = self.commits()
        columns = {c["order_by"] for c in commits}
        if len(columns) != 1 or None in columns:
            raise ValueError("the commits have no common order")
        files = [f for c in commits for f in c["files"]]
        everything = low is None and high is None
        kept = [f for f in files if everything or f["low"] is not None and (low is None or f["high"] >= low) and (high is None or f["low"] <= high)]
        # a file of nulls only, then by lowest key; nulls come first in a range
        return sorted((f for f in kept if f["low"] is None), key=lambda f: f["name"]) + sorted((f for f in kept if f["low"] is not None), key=lambda f: (f["low"], f["high"], f["nulls"] == 0))

    def scan(self, low=None, high=None) -> DataFrame:
        """The rows with keys from ``low`` to ``high`` (both included, None: no
        bound), from the files whose ranges meet them."""
        frame = self._frame([f["name"] for f in self._needed(low, high)])
        return frame.where(self._between(low, high))

    def _between(self, low, high) -> Column:
        column, cond = F.col(self.commits()[0]["order_by"]) if self.commits() else None, F.lit(True)
        if low is not None:
            cond = cond & (column >= F.lit(low))
        return cond if high is None else cond & (column <= F.lit(high))

    def in_order(self, low=None, high=None) -> DataFrame:
        """As ``scan``, with the rows in key order (nulls first): one scan for each
        file, one after another.  Files of batches whose ranges overlap have no
        such order; write their rows as one batch of another data set."""
        files = self._needed(low, high)
        for a, b in zip(files, files[1:], strict=False):
            if b["nulls"] and a["low"] is not None or a["high"] is not None and b["low"] is not None and b["low"] < a["high"]:
                raise ValueError("files overlap; write them as one batch")
        if not files:
            return self._frame([])
        return union_all(*[self._frame([f["name"]]).where(self._between(low, high)) for f in files])


def marked(rows: DataFrame, key: str, bits: np.ndarray) -> DataFrame:
    """``rows`` with ``_may``: whether the filter may hold the row's key."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)  # BLOOM_BITS / 8 bytes
    n = len(rows.columns)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(may_hold(batch, shared.value))], names=[*batch.schema.names[:n], "_may"])

    return rows.select("*", *hashes(key, len(bits) * 64)).mapInArrow(mark, T.StructType([*rows.schema.fields, T.StructField("_may", T.BooleanType())]))
