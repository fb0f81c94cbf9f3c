"""Corpus-building jobs (C1-C12) and their runners.

Each job is a function of DataFrames returning a DataFrame (or a dict of
named DataFrames for side outputs), so jobs compose lazily and Catalyst
plans a whole chain at once.  ``run_job`` writes one output; ``run_family``
writes a base table, reads it back (cutting lineage exactly like the
reference re-reads its own file) and writes the classification and
detection views.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, generate, labels, profile, sampling
from ..operators.increment import BUCKETS, GrowingCorpus
from ..sources import io


# ---- C1-C4: raw corpora -> labelled or plain text ----------------------------------

def job_votes(votes: DataFrame) -> DataFrame:
    """C1 (HAHATrain): crowd votes -> (text, score 0..5)."""
    return labels.resolve_votes(votes).select("text", "score")


def job_test_text(raw: DataFrame) -> DataFrame:
    """C2 (HAHATest): keep the text column."""
    return raw.select("text")


def job_jokes(raw: DataFrame, order: str | None = None) -> DataFrame:
    """C3 (SpanishJokes): first row per text, text only."""
    return dedup.keep_first(raw.select(*(["text"] + ([order] if order else []))), "text", order).select("text")


def job_rated(items: DataFrame) -> DataFrame:
    """C4 (StupidStuff): conflicted / empty / long bodies dropped, half-even score."""
    return labels.rated_items(items).select("text", "score")


# ---- C5, C6, C9, C10: unions made unique across corpora ------------------------------

def job_base_train(votes_labelled: DataFrame, generated: DataFrame) -> DataFrame:
    """Votes U generated jokes; every text seen twice is dropped."""
    return dedup.union_unique(votes_labelled.select("text", "score"), generated.select("text", "score"))


def job_test_pool(jokes: DataFrame, test_text: DataFrame) -> DataFrame:
    """Jokes U unlabelled test text, unique."""
    return dedup.union_unique(jokes.select("text"), test_text.select("text"))


def job_train(base: DataFrame, repetition_train: DataFrame, exclusive_train: DataFrame) -> DataFrame:
    """Base U repetition rows U contradiction rows, unique."""
    return dedup.union_unique(*(d.select("text", "score") for d in (base, repetition_train, exclusive_train)))


def job_train_multilingual(train: DataFrame, rated: DataFrame) -> DataFrame:
    """Train U rated items, unique."""
    return dedup.union_unique(train.select("text", "score"), rated.select("text", "score"))


def train_families(base: DataFrame, repetition_train: DataFrame, exclusive_train: DataFrame,
                   rated: DataFrame) -> DataFrame:
    """C9 + C10 in one shuffle: (family, text, score) for ``train`` and
    ``train_multilingual``.

    With ``na`` = copies of a text among base/repetition/exclusive rows and
    ``nb`` = copies among rated items, a text is in train iff na = 1, and in
    the multilingual set (train U rated, made unique) iff [na = 1] + nb = 1.
    Both follow from one ``groupBy(text)`` over all four sources, so the train
    set is neither written nor recomputed to build the second family."""
    side_a = dedup.union_all(*(d.select("text", "score") for d in (base, repetition_train, exclusive_train)))
    both = side_a.withColumn("_b", F.lit(False)).unionByName(rated.select("text", "score").withColumn("_b", F.lit(True)))
    g = both.groupBy(F.xxhash64("text").alias("_h"), "text").agg(
        F.count_if(~F.col("_b")).alias("na"),
        F.count_if(F.col("_b")).alias("nb"),
        F.min(F.when(~F.col("_b"), F.col("score"))).alias("sa"),
        F.min(F.when(F.col("_b"), F.col("score"))).alias("sb"),
    )
    in_train = F.col("na") == 1
    multi_score = F.when(in_train, F.col("sa")).otherwise(F.col("sb"))
    in_multi = (in_train.cast("int") + F.col("nb")) == 1
    rows = F.filter(
        F.array(
            F.struct(F.lit("train").alias("family"), F.col("sa").alias("score"), in_train.alias("keep")),
            F.struct(F.lit("train_multilingual").alias("family"), multi_score.alias("score"), in_multi.alias("keep")),
        ),
        lambda r: r["keep"],
    )
    return g.select("text", F.inline(rows)).select("family", "text", "score")


def grow_families(spark: SparkSession, path: str, base: DataFrame, repetition_train: DataFrame, exclusive_train: DataFrame,
                  rated: DataFrame, buckets: int = BUCKETS) -> dict[str, GrowingCorpus]:
    """C9 + C10 as corpora that grow: ``train`` from the base, repetition and
    contradiction rows, then ``train_multilingual`` from the written train set
    and the rated items.  Each source is shuffled once, when it is written; the
    written ones are read where they lie.  Run again with one source changed,
    ``write`` that source's batch and ask ``added`` and ``withdrawn``."""
    train = GrowingCorpus(spark, os.path.join(path, "train"), io.LABELLED, buckets=buckets)
    for name, rows in (("base", base), ("repetition", repetition_train), ("exclusive", exclusive_train)):
        train.write(name, rows)
    multilingual = GrowingCorpus(spark, os.path.join(path, "train_multilingual"), io.LABELLED, buckets=buckets)
    multilingual.write("train", train.unique())
    multilingual.write("rated", rated)
    return {"train": train, "train_multilingual": multilingual}


def view_counts(families: DataFrame) -> DataFrame:
    """Rows per (family, view, score) for the base, classification (P5) and
    detection (P4) views, from one pass over the family rows."""
    s = F.col("score")
    views = F.filter(
        F.array(
            F.struct(F.lit("base").alias("view"), s.alias("score"), F.lit(True).alias("keep")),
            F.struct(F.lit("classification").alias("view"), (s - 1).alias("score"), (s > 0).alias("keep")),
            F.struct(F.lit("detection").alias("view"), (~s.eqNullSafe(0)).cast("int").alias("score"),
                     F.lit(True).alias("keep")),
        ),
        lambda r: F.coalesce(r["keep"], F.lit(False)),
    )
    return families.select("family", F.inline(views)).groupBy("family", "view", "score").agg(
        F.count(F.lit(1)).alias("n")
    )


# ---- C7, C8: human annotations -> labels -------------------------------------------

def job_annotations(annotations: DataFrame, min_annotations: int = 4,
                    order_col: str | None = None) -> dict[str, DataFrame]:
    """C7 + C8 from one shared aggregate: {"classification", "detection"}."""
    summary = labels.annotation_summary(annotations, min_annotations, order_col=order_col)
    return {
        "classification": labels.classification_from_summary(summary).select("text", "score"),
        "detection": labels.detection_from_summary(summary).select("text", "score"),
    }


# ---- C11, C12: evaluation suites ------------------------------------------------------

def job_length_slices(test_detection: DataFrame) -> dict[str, DataFrame]:
    """C11: texts at or above the 90th length percentile, at or below the 10th."""
    return {
        "long_lengths": sampling.length_slice(test_detection, "text", 0.9, "long"),
        "short_lengths": sampling.length_slice(test_detection, "text", 0.1, "short"),
    }


def job_exclusive(base_train: DataFrame, test_detection: DataFrame, exclusive_humor: list[str],
                  exclusive_non_humor: list[str], rows: int) -> dict[str, DataFrame]:
    """Contradiction rows; side output ``train_exclusive`` from the
    base train set, main output ``test_exclusive`` from the test set (S6)."""
    def gen(df: DataFrame, tag: str) -> DataFrame:
        # no business key in these corpora: a hash of the row, with the row
        # itself as tiebreak, gives a total order that every retry repeats
        keyed = df.select(F.xxhash64("text", "score").alias("id"), "text", "score")
        return generate.contradiction_rows(keyed, exclusive_humor, exclusive_non_humor, rows=rows, tag=tag,
                                           tiebreak=["text", "score"]).select("text", "score")

    return {"train_exclusive": gen(base_train, "exclusive_train"), "test_exclusive": gen(test_detection, "exclusive_test")}


def job_repetition(spark: SparkSession, repetition_tokens: list[str], exclusive_humor: list[str],
                   rows: int) -> dict[str, DataFrame]:
    """``2 * rows`` repetition texts, unique, split in halves."""
    seeds = spark.range(rows).select(F.col("id").alias("seed"))
    out = generate.repetition_rows(seeds, repetition_tokens, exclusive_humor, key="seed")
    return {
        "test_repetition": out.where(F.col("part") == "test").select("text", "score"),
        "train_repetition": out.where(F.col("part") == "train").select("text", "score"),
    }


# ---- runners -------------------------------------------------------------------------

def run_job(result: DataFrame | dict[str, DataFrame], out: str, fmt: str = "parquet",
            report: str | None = None) -> dict[str, str]:
    """Write one output (or every named output under ``out``); with
    ``report``, the profile (A11) of each parquet output goes under that folder."""
    items = result.items() if isinstance(result, dict) else [("", result)]
    paths = {}
    for name, df in items:
        path = os.path.join(out, name) if name else out
        if fmt == "csv":
            io.write_csv(df, path)
        else:
            io.write_table(df, path)
        if report:
            written = df if fmt == "csv" else df.sparkSession.read.parquet(path)
            io.write_table(profile.profile(written), os.path.join(report, name) if name else report)
        paths[name or "out"] = path
    return paths


def run_family(spark: SparkSession, base: DataFrame, out: str, fmt: str = "parquet") -> dict[str, str]:
    """Write the base table, read it back, write both label views from
    the written copy (no recomputation of the base plan)."""
    base_path = os.path.join(out, "base")
    run_job(base, base_path, fmt)
    written = spark.read.parquet(base_path) if fmt == "parquet" else io.read_csv(spark, base_path, io.LABELLED)
    paths = {"base": base_path}
    for name, view in (("classification", labels.to_classification(written)),
                       ("detection", labels.to_detection(written))):
        paths[name] = run_job(view, os.path.join(out, name), fmt)["out"]
    return paths
