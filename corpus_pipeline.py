"""The corpus pipeline: stages from raw documents to a mixed corpus.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written
as Parquet and reread as the next one's docs.  All but the last return the
columns of documents, for every row that the stage keeps.

Defined results: rows that repeat an id are judged each, and the near-dedup stage
leaves one of them; an empty table gives an empty result; of the documents only the
five named columns are read, so columns with other names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jestframe.llm import decontaminate, langid, line_dedup, minhash, mixing
from jestframe.llm.common import crc_mod, read_table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letters, null, empty) go."""
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    return langid.predict(docs, model, keep=docs.columns).where("lang_pred <> 'und'").select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; a document goes when all its lines
    that held words went.  ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    out = out.where("n_dropped = 0 OR text RLIKE '\\\\S'")
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies stays;
    of rows that repeat an id, one (the smallest in all columns)."""
    # written, so that the planner knows how few they are and leaves the texts where they lie
    gone = written(minhash.near_duplicates(docs, shingle=5).where("NOT kept").select("doc_id").distinct(), "copies")
    again = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated-ids")
    one = F.min(F.struct(*[c for c in docs.columns if c != "doc_id"]))
    left = docs.join(gone, "doc_id", "left_anti")
    first = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(one.alias("r")).select("doc_id", "r.*").select(*docs.columns)
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    found = decontaminate.contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    return found.where(F.size("matches") == 0).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row per slot and document piece that the mix takes."""
    return (mixing.mix(docs).where("words > 0")
            .select("shard", "slot", "block_no", "doc_id", "source", "first_word", "words", "size", "source_size", "target", "text"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: Language models, near duplicates and decontamination are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
