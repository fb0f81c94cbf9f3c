"""Stand-in inputs over the driver's tables (FIXTURES part 2).

The reference's raw corpora are not in its snapshot, so each of its input
shapes is derived from a driver table by a deterministic rule.  Every builder
reads the tables, so the work grows with them.  ``SQL`` holds the same
definitions for DuckDB (used by the oracle queries).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import gather
from ..functions.rand import draw
from .io import TRAIN_LOG, table

# Our own vocabularies (not taken from the reference, whose
# vocabularies are arguments without values).
EXCLUSIVE_HUMOR = ["jaja", "jeje", "lol"]
EXCLUSIVE_NON_HUMOR = ["report", "table", "index"]
REPETITION_TOKENS = ["jaja", "meh", "ok"]
# Our own sanity prompts (I5): a joke, plain prose, laughter, noise, an
# English line and an empty-ish line.
SANITY_PROMPTS = [
    "¿Por qué el libro de matemáticas estaba triste? Porque tenía muchos problemas.",
    "El informe trimestral se entrega el lunes.",
    "jajajaja",
    "asdf qwer zxcv",
    "Why did the chicken cross the road?",
    "...",
]
CLASS_TOKENS = [6, 7, 8, 9, 10]
END_TOKEN = 9
MAX_LENGTH = 512


def u_sql(key: str, tag: str) -> str:
    """R0 draw in DuckDB SQL."""
    return f"CAST('0x' || substr(md5(concat_ws(':', '79', CAST({key} AS VARCHAR), {tag})), 1, 15) AS BIGINT)"


def x_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        "text",
        (draw(F.col("doc_id"), "0") % 2).cast("int").alias("is_humor"),
        *[(draw(F.col("doc_id"), str(i)) % 4).cast("int").alias(f"votes_{i}") for i in range(1, 6)],
    )


def x_annot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations: some without an id, texts that differ within an id (in the
    order ``ord``; equal orders have equal texts), ratings 0..7."""
    li = table(spark, sf_dir, "lineitem")
    line, part = F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")
    return li.select(
        F.when(F.col("l_partkey") % 97 != 0, F.col("l_orderkey")).alias("id"),
        F.concat(F.lit("line "), line, F.lit(" part "), part).alias("text"),
        (F.floor("l_quantity").cast("int") % 8).alias("sentiment"),
        (F.col("l_linenumber") * F.lit(1_000_000_000_000) + F.col("l_partkey")).alias("ord"),
    )


def x_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated items: the whole text is the body, so exact copies of a text are
    the same item; copies whose length is a multiple of 3 agree on the
    rating, the others usually conflict."""
    d = table(spark, sf_dir, "documents")
    n = F.length("text")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("body"),
        (F.when(n % 3 == 0, n % 11).otherwise(F.col("doc_id") % 11).cast("double") / 2).alias("rating"),
    )


def x_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    score = F.when(F.col("quality") == 0, F.lit(0)).otherwise(
        1 + F.least(draw(F.col("doc_id"), "9") % 5, draw(F.col("doc_id"), "10") % 5)
    )
    # never null (a null quality takes the second branch); the coalesce only
    # says so, so filters on a non-null score are dropped, not pushed into the
    # scan where they would evaluate both draws again
    score = F.coalesce(score.cast("int"), F.lit(0))
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("id"), "text", score.alias("score"))


def x_log(spark: SparkSession, sf_dir: str, with_loss: bool = False) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    cols = [
        F.col("user_id").alias("model"),
        F.col("event_id").alias("step"),
        F.floor("value").cast("bigint").alias("macro_f1"),
    ]
    if with_loss:
        cols.append(F.col("value").alias("loss"))
    return ev.select(*cols)


def x_train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training logs of 7 models and 2 tasks, every metric from the events."""
    ev = table(spark, sf_dir, "events")
    v = F.col("value")
    return ev.select(
        F.col("event_id").cast("int").alias("step"), *[(v / n).alias(c) for n, c in enumerate(TRAIN_LOG.fieldNames()[1:], 1)],
        F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model"),
        F.when(F.col("user_id") % 2 == 0, F.lit("classification")).otherwise(F.lit("detection")).alias("task"),
    )


def x_resp(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def x_logits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        (F.col("label") % k).cast("int").alias("label"),
        F.transform(gather(F.col("embedding"), list(range(k))), lambda x: x.cast("double")).alias("logits"),
    )


def x_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids = word lengths of every blank-separated word of the whole text;
    labels = the same, -100 where the length is 5 or less; score for P10."""
    d = table(spark, sf_dir, "documents")
    # tokens get their own projection: the labels read them, and an inlined
    # split of the whole text would run twice per row
    t = d.select("doc_id", F.transform(F.split(F.col("text"), " "), lambda w: F.length(w).cast("int")).alias("tokens"))
    return t.select(
        F.col("doc_id").alias("id"),
        "tokens",
        F.transform("tokens", lambda x: F.when(x <= 5, F.lit(-100)).otherwise(x)).alias("labels"),
        F.when(F.col("doc_id") % 6 == 5, F.lit(None).cast("int"))
        .otherwise((F.col("doc_id") % 5).cast("int"))
        .alias("score"),
    )


# DuckDB definitions of the same stand-ins (names used as CTEs in the oracle).
SQL = {
    "x_votes": "SELECT doc_id AS id, text, CAST({u0} % 2 AS INTEGER) AS is_humor, {votes} FROM documents".format(
        u0=u_sql("doc_id", "'0'"),
        votes=", ".join(f"CAST({u_sql('doc_id', repr(str(i)))} % 4 AS INTEGER) AS votes_{i}" for i in range(1, 6)),
    ),
    "x_annot": "SELECT CASE WHEN l_partkey % 97 <> 0 THEN l_orderkey END AS id, "
    "concat('line ', CAST(l_linenumber AS VARCHAR), ' part ', CAST(l_partkey AS VARCHAR)) AS text, "
    "CAST(floor(l_quantity) AS INTEGER) % 8 AS sentiment, "
    "CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey AS ord FROM lineitem",
    "x_rated": "SELECT doc_id AS id, text AS body, "
    "CAST(CASE WHEN length(text) % 3 = 0 THEN length(text) % 11 ELSE doc_id % 11 END AS DOUBLE) / 2 AS rating "
    "FROM documents",
    "x_scored": "SELECT d.doc_id AS id, d.text, CAST(CASE WHEN l.quality = 0 THEN 0 ELSE 1 + least({a} % 5, {b} % 5) "
    "END AS INTEGER) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id".format(
        a=u_sql("d.doc_id", "'9'"), b=u_sql("d.doc_id", "'10'")
    ),
    "x_log": "SELECT user_id AS model, event_id AS step, CAST(floor(value) AS BIGINT) AS macro_f1, value AS loss "
    "FROM events",
    "x_resp": "SELECT conv_id * 1000 + turn AS id, text FROM conversations",
    "x_logits2": "SELECT vec_id AS id, CAST(label % 2 AS INTEGER) AS label, "
    "list_transform(embedding[1:2], lambda x: CAST(x AS DOUBLE)) AS logits FROM embeddings",
    "x_logits5": "SELECT vec_id AS id, CAST(label % 5 AS INTEGER) AS label, "
    "list_transform(embedding[1:5], lambda x: CAST(x AS DOUBLE)) AS logits FROM embeddings",
    "x_tokens": "SELECT doc_id AS id, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INTEGER)) "
    "AS tokens, list_transform(string_split(text, ' '), lambda w: CAST(CASE WHEN length(w) <= 5 THEN -100 "
    "ELSE length(w) END AS INTEGER)) AS labels, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE CAST(doc_id % 5 AS INTEGER) "
    "END AS score FROM documents",
}


def with_ctes(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
