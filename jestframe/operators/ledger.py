"""Request ledger (I2, I3): a remote answer is paid for once.

Prompts are reduced to distinct keys (sha256 of the prompt), keys that the ledger
answers already are taken out by an anti-join, and only the rest is sent.  While a
task sends, it writes every frame of answers it gets into the ledger's folder, under
a name of its own: what a task was told before it died stays.  A repeated task
reads the answers of its earlier attempts first, and a later call finds them in
the ledger, so at most the frame under way is asked again.

The folder is shared (``spark.checkpoint.dir`` or another URI); executors write to
it through pyarrow's file systems (file, hdfs, s3, gs).  Answers that are final
(``ok`` and refusals) are never asked again; ``error``, ``missing`` and ``invalid``
ones are asked by the next call.  Speculative copies of a task would ask twice;
leave ``spark.speculation`` off (the default) for a paid endpoint.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import pieces
from ..session import scratch_path

ANSWER = "key string, prompt string, response string, status string, call string"
#: Statuses that a later call asks again.
OPEN = ("error", "missing", "invalid")
FRAME_ROWS = 64

Frames = Iterator[pd.DataFrame]


class Ledger:
    """Answers of one scorer below ``path`` (a folder that all executors share).

    ``scorer``: its name with all that an answer depends on besides the prompt
    (model, temperature).  ``frame_rows``: prompts handed to it at a time, and
    answers written at a time."""

    def __init__(self, spark: SparkSession, path: str, scorer: str, frame_rows: int = FRAME_ROWS):
        self.spark, self.scorer, self.frame_rows = spark, scorer, frame_rows
        path = path if "://" in path else "file://" + os.path.abspath(path) if not path.startswith("file:") else "file://" + path.removeprefix("file:")
        self.uri = f"{path.rstrip('/')}/scorer={scorer}"

    def _files(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri)

    def answers(self) -> DataFrame:
        """key, response, status, call: one row a key, a final answer before an
        open one, then the earliest call."""
        files, root = self._files()
        if files.get_file_info(root).type == pafs.FileType.NotFound:
            return self.spark.createDataFrame([], "key string, response string, status string, call string")
        rows = self.spark.read.schema(ANSWER).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(self.uri)
        first = F.struct(F.col("status").isin(*OPEN).alias("open"), "call")
        best = rows.groupBy("key").agg(F.min_by(F.struct("response", "status", "call"), first).alias("a"))
        return best.select("key", "a.response", "a.status", "a.call")

    def ask(self, df: DataFrame, prompt_col: str, ask: Callable[[Frames], Frames], parallelism: int | None = None) -> DataFrame:
        """``df`` with ``response`` and ``status`` of its prompts; a null prompt
        is not sent and counts as refused.

        ``ask`` gets frames (key, prompt) and returns each with both columns."""
        keyed = df.withColumn("_key", F.sha2(F.col(prompt_col), 256))
        wanted = keyed.where(F.col("_key").isNotNull()).groupBy(F.col("_key").alias("key")).agg(F.first(prompt_col).alias("prompt"))
        final = self.answers().where(~F.col("status").isin(*OPEN)).select("key")
        # fixed before anything is sent: a repeated task gets the same prompts
        path = scratch_path(self.spark, "prompts")
        wanted.join(final, "key", "left_anti").write.parquet(path)
        self._send(self.spark.read.schema("key string, prompt string").parquet(path), ask, parallelism)
        known = self.answers().select(F.col("key").alias("_key"), "response", "status")
        out = keyed.join(known, "_key", "left")
        status = F.when(F.col("_key").isNull(), F.lit("refused")).otherwise(F.coalesce("status", F.lit("missing")))
        return out.select(*df.columns, "response", status.alias("status"))

    def _send(self, prompts: DataFrame, ask: Callable[[Frames], Frames], parallelism: int | None) -> int:
        """Send all prompts; the number of requests of the attempts that ended well."""
        uri, rows = self.uri, self.frame_rows
        calls = pafs.FileSystem.from_uri(uri)
        calls[0].create_dir(calls[1])
        call = f"{len(calls[0].get_file_info(pafs.FileSelector(calls[1]))):06d}-{os.urandom(4).hex()}"

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, root = pafs.FileSystem.from_uri(uri)
            own = f"{root}/{call}/{TaskContext.get().partitionId()}"
            files.create_dir(own)
            # answers of this task's earlier attempts
            done: set[str] = set()
            for info in files.get_file_info(pafs.FileSelector(own)):
                if info.extension == "parquet":
                    told = pq.read_table(info.path, columns=["key", "status"], filesystem=files).to_pydict()
                    done |= {k for k, s in zip(told["key"], told["status"], strict=True) if s not in OPEN}

            def open_ones() -> Frames:
                for batch in pieces(batches, "prompt"):
                    frame = batch.to_pandas()
                    left = frame[~frame["key"].isin(done)]
                    for i in range(0, len(left), rows):
                        yield left.iloc[i:i + rows].reset_index(drop=True)

            sent = 0
            for told in ask(open_ones()):
                table = pa.table({c: pa.array(told[c].tolist(), pa.string()) for c in ("key", "prompt", "response", "status")} | {"call": pa.array([call] * len(told), pa.string())})
                name = f"{own}/{os.urandom(8).hex()}"
                pq.write_table(table, f"{name}.tmp", filesystem=files)
                files.move(f"{name}.tmp", f"{name}.parquet")  # whole or not at all
                sent += len(told)
            yield pa.RecordBatch.from_arrays([pa.array([sent], pa.int64())], names=["sent"])

        spread = prompts.repartition(parallelism, "key") if parallelism else prompts
        return spread.mapInArrow(send, "sent long").agg(F.sum("sent")).first()[0] or 0
