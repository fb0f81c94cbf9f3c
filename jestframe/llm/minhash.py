"""Operator 6: near-duplicate documents by MinHash with sequential Bayesian
verification.

A document's set holds its distinct ``shingle``-word shingles (A-Z lowered,
words are runs of bytes other than space, tab, LF, VT, FF, CR); with fewer
words the whole sequence is its one shingle; without words it is empty and
linked with nothing.  Documents with equal sets are one class, whose smallest
id represents it.  Two classes are linked if their Jaccard similarity is at
least ``threshold``; a component is what links connect.

1. Signatures of BANDS x ROWS minima per class; classes that agree in a band
   share a bucket (a pair at the threshold shares none with probability
   (1 - 0.8^5)^32 = 3e-6).
2. First, each bucket's smallest id meets its other members.  Then each bucket
   whose members do not lie in one component yet is compared in blocks: parts of
   at most about PART_ROWS members, every part of the members outside the
   bucket's largest component against every part.  A task gets one block and
   passes on links only, at most as many as it has members, so no bucket is
   expanded into pairs; a bucket of near copies takes one pair per member.
3. A pair's signatures are compared in batches; after each batch it is dropped
   if the posterior probability (uniform prior) that its similarity reaches the
   threshold is below ``miss``.
4. Survivors are verified on their full sets, which are made where the texts lie.
   (A pair whose members were just linked through others needs no test.)

Shingles are 64-bit hashes.  Defined results: a row with a null id is its own
document with a null component and kept; rows that repeat an id share its
component; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jestframe.functions.bloom import bitmap, bits_for, hashes, may_hold
from jestframe.llm.common import written

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BATCH = 32  # signature positions compared at once
MISS = 1e-6
PART_ROWS = 512
PART_BYTES = 1 << 24  # of shingle sets
MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: odd multiplier (2^64 over the golden ratio)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = mixed(out * MIX + hashes[k:len(hashes) - width + 1 + k])
    return np.unique(out + np.uint64(width))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(71)
    return (rng.integers(1 << 32, size=HASHES, dtype=np.uint32) | np.uint32(1))[:, None], rng.integers(1 << 32, size=HASHES, dtype=np.uint32)[:, None]


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, out = (hashes >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(out, (low[None, i:i + 1024] * a + b).min(axis=1), out=out)
    return out


def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """For each number of compared positions n the smallest number of matches m
    at which P(similarity >= threshold | m of n) is at least ``miss``."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            density = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(density - density.max())
            if density[grid >= threshold].sum() >= miss * density.sum():
                out[n] = m
                break
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, n_shingles, set hash (h1, h2), signature and band keys per row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations()
        salt = np.arange(BANDS, dtype=np.uint64) * MIX
        for batch in batches:
            sizes, h1, h2, sigs, bands = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingle_set(text, shingle)
                digest = np.frombuffer(xxhash.xxh128_digest(own.tobytes()), np.int64)
                sig = signature(own, a, b)
                key = salt.copy()
                for k in range(ROWS):
                    key = mixed(key * MIX + sig.reshape(BANDS, ROWS)[:, k])
                sizes.append(len(own))
                h1.append(digest[0])
                h2.append(digest[1])
                sigs.append((sig & np.uint32(0xFFFF)).astype(np.uint16).tobytes())
                bands.append(key.view(np.int64))
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * BANDS, pa.int32()), flat)],
                names=["doc_id", "n_shingles", "h1", "h2", "sig", "bands"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(compute, "doc_id long, n_shingles long, h1 long, h2 long, sig binary, bands array<long>"))


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest reachable node) for the nodes of ``edges`` (a, b).

    Labels fall to the smallest neighbour's and jump to their label's label
    until nothing changes; hot nodes are aggregated map-side."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("seen")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen")))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"))
        top = step.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        step = written(step.join(top, "comp").select("node", "old", F.least("comp", "top").alias("comp")), "labels")
        labels = step.select("node", "comp")
        if step.where("comp <> old").isEmpty():
            return labels


def still_possible(x: np.ndarray, y: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the paired signatures that no batch rules out, and their matches."""
    alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for n, m in least.items():
        matches[alive] += (x[alive, n - BATCH:n] == y[alive, n - BATCH:n]).sum(axis=1)
        alive = alive[matches[alive] >= m]
    return alive, matches[alive]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def as_signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def pruned(pairs: DataFrame, sigs: DataFrame, least: dict[int, int]) -> DataFrame:
    """Pairs (a, b) that no batch of signature positions rules out."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive, _ = still_possible(as_signatures(batch.column("sig_a")), as_signatures(batch.column("sig_b")), least)
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return (pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
            .select("a", "b", "sig_a", "sig_b").mapInArrow(compare, "a long, b long"))


def full_sets(texts: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """rep, shingles (its whole set as bytes) of the given representatives.

    A Bloom filter of the representatives goes to the texts, so only the sets of
    those (and about 0.3 % of the others) meet the exact join."""
    wanted = written(reps.distinct(), "wanted")
    bits = bits_for(wanted.count())
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(wanted, "rep", bits))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(may_hold(batch, shared.value)))
            yield pa.RecordBatch.from_arrays([own.column("rep"), pa.array([shingle_set(t, shingle).tobytes() for t in own.column("text").to_pylist()], pa.binary())], names=["rep", "shingles"])

    found = texts.select("rep", "text", *hashes("rep", bits)).mapInArrow(sets, "rep long, shingles binary")
    return written(found.join(wanted, "rep", "left_semi"), "sets")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sets]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = full_sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("rep")), shingle)
    return (pairs.join(own.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a").join(own.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b")
            .select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long"))


def links_in_block(sigs: np.ndarray, sets: list[np.ndarray], comps: list[int], left: np.ndarray, right: np.ndarray, least: dict[int, int], percent: int) -> list[tuple[int, int]]:
    """Links between ``left`` and ``right`` rows that join different components."""
    parent = {c: c for c in comps}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out, label = [], np.array(comps)
    for i in left:
        others = right[label[right] != label[i]]
        alive, matches = still_possible(np.broadcast_to(sigs[i], (len(others), HASHES)), sigs[others], least)
        for j in others[alive[np.argsort(-matches, kind="stable")]]:
            if root(comps[i]) != root(comps[j]) and linked(sets[i], sets[j], percent):
                parent[root(comps[i])] = root(comps[j])
                out.append((i, j))
    return out


def links_of_buckets(members: DataFrame, sigs: DataFrame, texts: DataFrame, shingle: int, percent: int, least: dict[int, int], part_rows: int) -> DataFrame:
    """Links (a, b) that join the components of each bucket's members (bucket,
    rep, comp), found block by block."""
    sets = full_sets(texts, members.select("rep"), shingle)
    rows = members.join(sets, "rep").join(sigs, "rep")
    of_comp = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("shingles")).alias("bytes"))
    most = F.struct("n", "comp")
    plan = of_comp.groupBy("bucket").agg(F.max_by("comp", most).alias("main"), F.max("n").alias("main_n"), F.max_by("bytes", most).alias("main_bytes"), F.sum("n").alias("all_n"), F.sum("bytes").alias("all_bytes"))

    def parts(n: Column, size: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / part_rows), F.ceil(size / PART_BYTES)).cast("int")

    plan = plan.select("bucket", "main", parts(F.col("main_n"), F.col("main_bytes")).alias("main_parts"),
                       parts(F.col("all_n") - F.col("main_n"), F.col("all_bytes") - F.col("main_bytes")).alias("rest_parts"))
    rows = rows.join(plan, "bucket").withColumn("rest", F.col("comp") != F.col("main"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.when(F.col("rest"), F.col("rest_parts")).otherwise(F.col("main_parts"))).cast("int"))
    each_rest, each_main = F.sequence(F.lit(0), F.col("rest_parts") - 1), F.sequence(F.lit(0), F.col("main_parts") - 1)
    among = F.transform(each_rest, lambda q: F.struct(F.lit(False).alias("to_main"), F.least("part", q).alias("lo"), F.greatest("part", q).alias("hi")))
    outward = F.transform(each_main, lambda q: F.struct(F.lit(True).alias("to_main"), F.col("part").alias("lo"), q.alias("hi")))
    inward = F.transform(each_rest, lambda q: F.struct(F.lit(True).alias("to_main"), q.alias("lo"), F.col("part").alias("hi")))
    blocks = rows.withColumn("block", F.explode(F.when(F.col("rest"), F.concat(among, outward)).otherwise(inward)))
    blocks = blocks.select("bucket", "block.to_main", "block.lo", "block.hi", "rep", "comp", "rest", "part", "sig", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        own, rest, part = as_signatures(table.column("sig")), np.array(table.column("rest").to_pylist(), bool), table.column("part").to_numpy()
        to_main, lo, hi = (table.column(c)[0].as_py() for c in ("to_main", "lo", "hi"))
        left, right = (rest, ~rest) if to_main else (part == lo, part == hi)
        reps = table.column("rep").to_pylist()
        found = links_in_block(own, [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()], table.column("comp").to_pylist(), np.flatnonzero(left), np.flatnonzero(right), least, percent)
        return pa.table({"a": pa.array([reps[i] for i, _ in found], pa.int64()), "b": pa.array([reps[j] for _, j in found], pa.int64())})

    return blocks.groupBy("bucket", "to_main", "lo", "hi").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, miss: float = MISS,
                    part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    rows = written(signatures(docs, id_col, text_col, shingle), "signatures")
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min_by("sig", "doc_id").alias("sig"),
                                                                                         F.min_by("bands", "doc_id").alias("bands"))
    classes = written(classes, "classes")
    of_class = rows.select("doc_id", "n_shingles", "h1", "h2").join(classes.select("h1", "h2", "rep"), ["h1", "h2"], "left")
    of_class = of_class.withColumn("rep", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id")))

    # an id that stands for several classes, or is in several, joins them
    same_id = (of_class.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.countDistinct("rep").alias("n"))
               .where("n > 1").select("doc_id"))
    edges = written(of_class.join(same_id, "doc_id", "left_semi").where("n_shingles > 0 AND rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "edges")

    # class representatives may repeat only where ids do: then the sets are compared by (rep, set)
    members = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("bucket", "lo")
    members = written(members.join(shared, "bucket").select("bucket", "rep", "lo"), "members")
    # each class has one text: that of a row with the class's smallest id
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).where("rep IS NOT NULL")
    sigs = classes.select("rep", "sig")

    least, percent = least_matches(threshold, miss), round(threshold * 100)
    pairs = members.where("rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct()
    survivors = written(pruned(pairs, sigs, least), "survivors")
    edges = written(edges.unionByName(verified(survivors, texts, shingle, percent)).distinct(), "edges")
    comps = components(edges)

    # buckets whose members lie in several components
    labelled = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("comp", "rep").alias("comp"))
    several = labelled.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("bucket")
    unsettled = written(labelled.join(several, "bucket", "left_semi"), "members")
    new = written(links_of_buckets(unsettled, sigs, texts, shingle, percent, least, part_rows).distinct(), "links")
    if not new.isEmpty():
        comps = components(edges.unionByName(new))
    out = of_class.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("comp", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
