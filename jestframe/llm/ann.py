"""Operator 8: nearest neighbours by cosine with cross-polytope hashing.

Vectors are scaled to length 1, padded to a power of two and turned by TABLES
pseudo-random rotations (three rounds of random signs and a fast Hadamard
transform each); in each table a vector's bucket is its nearest signed axis.
A query probes its ``probes`` best (table, axis) pairs, those with the largest
coordinate over all tables.  ``probes`` is fitted: the true neighbours of a
bounded, keyed sample of queries are found against all rows, and the smallest
number of probes that would have found SAMPLE_RECALL of them is used.  Every row
is indexed.  Queries that found fewer rows than they may (``k``, or all candidates
if those are fewer) search again with WIDER times as many probes, and those still short
search all axes of one table, which hold every row.

Buckets are split into parts of about PART_ROWS rows (from counts per bucket:
TABLES x axes rows), so a hot bucket becomes many groups; each group ranks its
rows for its queries and passes on at most ``k`` rows a query.  Candidates found
in several tables count once.  The score is the cosine in double precision on
the original vectors, summed the same way for every pair, so equal vectors tie;
ties go to the smaller id.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, take no part; rows that repeat an id count
once (the smallest vector); vectors only meet vectors of their own length; a
query without candidates has no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jestframe.llm.common import written

TABLES = 8
ROUNDS = 3
PART_ROWS = 2048
SAMPLE_QUERIES = 200
SAMPLE_RECALL = 0.97
WIDER = 8
EVERY = 1 << 62  # probes: all axes of a table


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long)."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(len(x), -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Rows of ``x`` scaled, padded and turned by the table's rotation."""
    n = 1 << max(0, int(x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), n))
    top = np.abs(x).max(axis=1, keepdims=True)
    out[:, :x.shape[1]] = x / top
    out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    signs = np.random.default_rng([37, table, n]).choice([-1.0, 1.0], size=(ROUNDS, n))
    for s in signs:
        out = hadamard(out * s)
    return out


def axis_scores(x: np.ndarray) -> np.ndarray:
    """(rows, TABLES, axes): coordinates along every signed axis."""
    return np.stack([np.concatenate([y, -y], axis=1) for y in (rotated(x, t) for t in range(TABLES))], axis=1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: nothing
    overflows, and no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) if len(x) else x


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each row pair, in an order of operations that only depends on the pair."""
    dot, qq, xx = ((a * b).sum(axis=1) for a, b in ((q, x), (q, q), (x, x)))
    return dot / (np.sqrt(qq) * np.sqrt(xx))


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k nearest rows, its own id left out."""
    out = []
    q, x = scaled(q), scaled(x)
    qn = q / np.sqrt((q * q).sum(axis=1, keepdims=True))
    xn = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    for i in range(0, len(q), 256):
        rough = qn[i:i + 256] @ xn.T
        rough[q_ids[i:i + 256, None] == ids[None, :]] = -np.inf
        kth = np.partition(rough, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)] if len(ids) else None
        for j, row in enumerate(rough):
            at = np.flatnonzero((row >= kth[j] - 1e-9) & (row > -np.inf))  # rounding aside, all that may be among the k
            s = cosines(np.broadcast_to(q[i + j], (len(at), q.shape[1])), x[at])
            best = np.lexsort((ids[at], -s))[:k]
            out.append((np.full(len(best), q_ids[i + j]), ids[at][best], s[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v, dim of the rows that take part; one row for each id."""
    v = F.col(vec_col) if dict(vectors.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .where(finite & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False))))
            .groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long vectors as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fitted_probes(rows: DataFrame, is_query: Column, k: int) -> dict[int, int]:
    """Probes to use for each vector length, from at most SAMPLE_QUERIES queries each."""
    own = Window.partitionBy("dim").orderBy("draw")
    queries = rows.where(is_query).select("vec_id", "v", "dim", F.xxhash64(F.lit(3), "vec_id").alias("draw"))
    counts = {r["dim"]: r["n"] for r in queries.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for dim, n in counts.items():
        share = F.when(F.col("dim") == dim, F.lit(min(1.0, SAMPLE_QUERIES / n))).otherwise(share)
    sample = queries.where(F.pmod("draw", F.lit(1_000_003)) < share * 1_000_003).collect()
    by_dim = {d: (np.array([r["vec_id"] for r in sample if r["dim"] == d], np.int64), np.array([r["v"] for r in sample if r["dim"] == d], np.float64)) for d in {r["dim"] for r in sample}}
    shared = rows.sparkSession.sparkContext.broadcast(by_dim)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, vs = batch.column("vec_id").to_numpy(), batch.column("dim").to_numpy(), batch.column("v")
            for d in np.unique(dims):
                if d in shared.value:
                    at = np.flatnonzero(dims == d)
                    x = matrix(vs.take(pa.array(at)))
                    q, i, s = nearest(*shared.value[d], ids[at], x, k)
                    place = {v: n for n, v in zip(range(len(at)), ids[at], strict=True)}
                    own = x[np.array([place[v] for v in i], np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), d), pa.int32()), pa.array(q), pa.array(i), pa.array(s), pa.array(list(own), pa.list_(pa.float64()))],
                                                     names=["dim", "query_id", "vec_id", "score", "v"])

    found = rows.select("vec_id", "dim", "v").mapInArrow(search, "dim int, query_id long, vec_id long, score double, v array<double>")
    place = Window.partitionBy("dim", "query_id").orderBy(F.desc("score"), "vec_id")
    true = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("dim", "query_id", "v").collect()
    probes = {}
    for d, (ids, q) in by_dim.items():
        own = [r for r in true if r["dim"] == d]
        axes = 2 << max(0, int(d - 1).bit_length())
        probes[d] = TABLES * axes
        if own:
            scores = axis_scores(q)
            order = np.empty((len(q), TABLES * axes), np.int64)  # when each (table, axis) is probed
            np.put_along_axis(order, np.argsort(-scores.reshape(len(q), -1), axis=1, kind="stable"), np.arange(TABLES * axes)[None, :], axis=1)
            place_of = {v: n for n, v in enumerate(ids)}
            buckets = axis_scores(np.array([r["v"] for r in own])).argmax(axis=2) + np.arange(TABLES) * axes
            first = np.sort([order[place_of[r["query_id"]], b].min() + 1 for r, b in zip(own, buckets, strict=True)])
            probes[d] = int(first[min(len(first) - 1, int(np.ceil(SAMPLE_RECALL * len(first))) - 1)])
    return probes


def with_buckets(rows: DataFrame, probes) -> DataFrame:
    """vec_id, dim, v, bucket: a row's own bucket in each table or, with
    ``probes`` (broadcast), the buckets that it probes as a query: so many, or all
    axes of the first table if that is no more."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                for i in range(0, own.num_rows, 1024):
                    part = own.slice(i, 1024)
                    scores = axis_scores(matrix(part.column("v")))
                    flat, axes = scores.reshape(len(scores), -1), scores.shape[2]
                    if probes is None:
                        at = scores.argmax(axis=2) + np.arange(TABLES) * axes
                    else:
                        n = probes.value[int(d)]
                        at = np.argsort(-flat, axis=1, kind="stable")[:, :n] if n < axes else np.tile(np.arange(axes), (len(flat), 1))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * at.shape[1], pa.int32()), pa.array(at.ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("dim"), part.column("v"), lists], names=["vec_id", "dim", "v", "at"])

    kind = dict(rows.dtypes)["v"]
    return (rows.select("vec_id", "dim", "v").mapInArrow(assign, f"vec_id long, dim int, v {kind}, at array<int>")
            .select("vec_id", "dim", "v", F.explode("at").alias("bucket")))


def nearest_neighbours(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows found for the rows
    that ``is_query`` (an expression over vec_id) selects."""
    rows = written(usable(vectors, id_col, vec_col), "vectors")
    fitted = fitted_probes(rows, is_query, k)
    index = written(with_buckets(rows, None), "index")
    left, out = rows.where(is_query), None
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    for probes in (fitted, {d: WIDER * n for d, n in fitted.items()}, dict.fromkeys(fitted, EVERY)):
        found = written(search(index, left, rows.sparkSession.sparkContext.broadcast(probes), k, part_rows), "found")
        counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
        short = (left.join(sizes, "dim").join(counts, F.col("vec_id") == F.col("query_id"), "left")
                 .where(F.coalesce("found", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("vec_id", "v", "dim"))
        if probes is not fitted:  # the rows of these queries take the place of the former ones
            out = out.join(left.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(found)
        else:
            out = found
        left = written(short, "short")
        if left.isEmpty():
            break
    return out


def search(index: DataFrame, queries: DataFrame, probes, k: int, part_rows: int) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest indexed rows in the probed buckets."""
    asked = written(with_buckets(queries, probes).withColumnRenamed("vec_id", "query_id"), "probes")

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias(name))

    # TABLES x axes rows at most for each vector length: the planner broadcasts them if they are few
    plan = written(parts(index, "parts").join(parts(asked, "q_parts"), ["dim", "bucket"]), "parts")
    here = (index.join(plan, ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
            .withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1))).select("dim", "bucket", "part", "q_part", "vec_id", "v"))
    there = (asked.join(plan, ["dim", "bucket"]).withColumn("q_part", F.pmod(F.xxhash64("query_id"), F.col("q_parts")).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("dim", "bucket", "part", "q_part", "query_id", "v"))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            q, i, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            q, i, s = nearest(right.column("query_id").to_numpy(), matrix(right.column("v")), left.column("vec_id").to_numpy(), matrix(left.column("v")), k)
        return pa.table({"query_id": q, "vec_id": i, "score": s})

    group = ["dim", "bucket", "part", "q_part"]
    found = here.groupBy(*group).cogroup(there.groupBy(*group)).applyInArrow(rank, "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.dense_rank().over(place)).where(F.col("rank") <= k).distinct().select("query_id", "rank", "vec_id", "score")
