"""Operator 3: mixing sources to target weights (DataFrame functions only).

The words of each source's documents are packed, in a keyed order, end to end
into blocks of ``BLOCK`` words.  A source's quota of slots is drawn over the
output shards: each slot goes to a keyed uniform shard, so the source counts of
a shard are multinomial by target weight, conditioned on the quotas.  A
source's k-th slot takes block ``perm(k mod blocks)``, an affine permutation of
the block numbers keyed by source and pass; slots and blocks are joined by
(source, block number).

Quotas: source ranks follow the code points of the names, null last; weights
repeat 3, 1, 2; together they get 150% of all words.  A target stops at twice
its source's size and the excess is shared again by weight until none is
above.  A source's last slot takes only the words its target still lacks, so
the words taken are the target rounded to whole words, and as no target is
above two passes no document is taken more than twice.

Defined results: null and empty texts have size 0 and take nothing; a source
of size 0 has target 0; repeated rows and repeated ids are separate rows; an
empty table gives an empty result.  Only the three named columns are read.

Blocks and slots are worked out on slim rows (ids, sizes, a hash of the text).  With
texts, the pieces of a row are brought together and meet its text once; the text
crosses the network once, as it is, and is cut into its pieces after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jestframe.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256
SHARD_SLOTS = 4096
BUCKET_ROWS = 1 << 10
CHUNK = 1 << 12
SEED = 23
WEIGHTS = (3, 1, 2)
# Primes; a step that doesn't divide the number of blocks permutes them.
STEPS = (100000007, 100000037, 100000039, 100000049)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key: null and the empty name stay apart."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def fill_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> with target: water filling in closed form.

    Ordered by size/weight, the first j sources are capped and the rest share
    what is left by weight; j is the smallest count at which no further source
    lies above its cap.  The windows run over one row per source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    k = len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % k + 1).cast("int")))
    ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.select(
        "*",
        # what a unit of weight gets if exactly the sources before this one are capped
        ((share * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
         / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))).alias("level"))
    holds = F.col("level") * F.col("weight") <= most * F.col("source_size")
    final = level.withColumn("final_level", F.min_by(F.when(holds, F.col("level")), F.when(holds, F.struct(F.col("source_size") / F.col("weight"), F.coalesce("source", F.lit("")))))
                             .over(Window.partitionBy(F.lit(1))))
    target = F.least(most * F.col("source_size"), F.coalesce(F.col("final_level") * F.col("weight"), most * F.col("source_size")))
    return final.select("source", "source_size", target.cast("double").alias("target"))


def drawn_from(*parts: Column | str) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


def quotas(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per source: number of blocks, slots, and what the last slot takes.

    ``at_`` is the short (last) block's place in the final, partial pass."""
    last = (F.col("source_size") - 1) % block + 1
    q = (sources.where("source_size > 0").withColumn("key", source_key(F.col("source")))
         .withColumn("goal", F.round("target").cast("long"))
         .withColumn("blocks", F.expr(f"(source_size + {block} - 1) div {block}"))
         .withColumn("short", block - last)
         .withColumn("passes", F.expr("goal div source_size"))
         .withColumn("rest", F.col("goal") % F.col("source_size"))
         .withColumn("at_", F.pmod(drawn_from("key", "passes"), F.col("blocks"))))
    plain = F.expr(f"(rest + {block} - 1) div {block}")
    with_short = F.expr(f"(rest + short + {block} - 1) div {block}")
    q = q.withColumn("partial", F.when(F.col("at_") < plain, with_short).otherwise(plain))
    full = (F.col("partial") - 1) * block - F.when(F.col("at_") < F.col("partial") - 1, F.col("short")).otherwise(0)
    return (q.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("partial"))
            .withColumn("last_take", F.when(F.col("partial") > 0, F.col("rest") - full).otherwise(block))
            .select("key", "blocks", "slots", "last_take"))


def draw_slots(quota: DataFrame, shards: Column, block: int = BLOCK) -> DataFrame:
    """All slots: key, slot, shard, block_no, take (words the slot may take)."""
    slots = (quota.where("slots > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {CHUNK}"))))
             .repartition("key", "chunk")
             .withColumn("slot", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK) - 1)))
             .withColumn("pass", F.expr("slot div blocks")))
    step = F.element_at(F.array(*map(F.lit, STEPS)), (F.pmod(drawn_from(F.lit("step"), "key", "pass"), F.lit(len(STEPS))) + 1).cast("int"))
    step = F.when(F.col("blocks") % step == 0, step + 2).otherwise(step)
    moved = F.col("slot") % F.col("blocks") - F.pmod(drawn_from("key", "pass"), F.col("blocks"))
    return slots.select(
        "key", "slot", F.pmod(drawn_from(F.lit("shard"), "key", "slot"), shards).alias("shard"),
        F.pmod(moved * step + F.col("blocks") - 1, F.col("blocks")).alias("block_no"),
        F.when(F.col("slot") == F.col("slots") - 1, F.col("last_take")).otherwise(block).alias("take"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One slim row per row of ``docs``: key, source, size, keyed order and text hash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), source_key(F.col(source_col)).alias("key"),
                       word_count(F.col(text_col)).alias("size"), drawn_from(F.col(id_col)).alias("order"), F.xxhash64(text_col).alias("text_hash"))


def pack(rows: DataFrame, n_rows: int, block: int = BLOCK) -> DataFrame:
    """Where each row's words lie when a source's rows follow one another: a row
    per (row, block) piece; rows without words keep one row without a block.

    Offsets are prefix sums in two levels (keyed buckets of about BUCKET_ROWS
    rows, then the rows of a bucket), so a source with most rows spreads over
    many tasks.  Equal rows are numbered apart."""
    rows = rows.withColumn("bucket", F.pmod("order", F.lit(max(1, n_rows // BUCKET_ROWS))))
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
              .select("key", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base")))
    inside = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "size", "text_hash")
    placed = (rows.withColumn("row_no", F.row_number().over(inside))
              .withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .join(starts, ["key", "bucket"])
              .withColumn("start", F.col("base") + F.col("upto") - F.col("size")))
    spans = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    pieces = (placed.withColumn("block_no", F.explode_outer(spans))
              .withColumn("from", F.greatest(F.col("start"), F.col("block_no") * block))
              .withColumn("first_word", F.col("from") - F.col("start"))
              .withColumn("at", F.col("from") % block)
              .withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * block) - F.col("from")))
    return pieces.select("key", "bucket", "row_no", "doc_id", "source", "size", "text_hash", "block_no", "first_word", "at", "words")


def texts_by_hash(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text_id, text_hash, text: one row for each id and text of ``docs`` with words.
    Only texts of rows that repeat both are grouped."""
    again = written(rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_hash")), "repeated")
    texts = docs.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).withColumn("text_hash", F.xxhash64("text"))
    same = F.col("text_id").eqNullSafe(F.col("again_id")) & (F.col("text_hash") == F.col("again_hash"))
    return (texts.join(again, same, "left_anti").select("text_id", "text_hash", "text")
            .unionByName(texts.join(again, same, "left_semi").groupBy("text_id", "text_hash").agg(F.min("text").alias("text"))))


def with_texts(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """``mixed`` with the text of each row's words.

    A row's pieces meet its text together; the text is cut into words once, bound
    as a lambda's argument, which the optimizer can't move into the pieces."""
    row = ["key", "bucket", "row_no", "doc_id", "source", "size", "source_size", "target", "text_hash"]
    own = ["shard", "slot", "block_no", "first_word", "words"]
    rows = mixed.groupBy(*row).agg(F.collect_list(F.struct(*own)).alias("pieces"))
    rows = rows.join(texts.withColumnRenamed("text_hash", "of_hash"), F.col("doc_id").eqNullSafe(F.col("text_id")) & (F.col("text_hash") == F.col("of_hash")), "left")

    def cut(words: Column) -> Column:
        return F.transform("pieces", lambda p: F.struct(*[p[c].alias(c) for c in own], F.coalesce(F.array_join(F.slice(words, p["first_word"].cast("int") + 1, p["words"].cast("int")), " "), F.lit("")).alias("text")))

    pieces = F.get(F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), cut), F.lit(0))
    return rows.select(*row, F.explode(pieces).alias("p")).select(*row, "p.*")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
        share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, with_text: bool = True) -> DataFrame:
    """The mix: a row per slot and piece of its block with shard, slot, doc_id,
    source, size, source_size, target, first_word, words (taken) and, unless
    ``with_text`` is off, the text of those words.  Pieces that no slot takes
    stay as rows with words 0 and no slot."""
    rows = written(sized(docs, id_col, text_col, source_col), "mix-rows")
    sources = written(fill_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), weights, share, most), "mix-sources")
    quota = quotas(sources, block)
    # two numbers of the whole input: rows, and slots for the number of shards
    n_rows, n_slots = rows.count(), quota.agg(F.sum("slots")).first()[0] or 0
    slots = draw_slots(quota, F.lit(max(1, -(-n_slots // shard_slots))), block)
    taken = F.greatest(F.lit(0), F.least(F.col("at") + F.col("words"), F.col("take")) - F.col("at"))
    # the planner can't see how many rows the slots explode to, and would broadcast them
    mixed = (pack(rows, n_rows, block).join(slots.hint("merge"), ["key", "block_no"], "left")
             .withColumn("words", F.when(F.col("slot").isNull(), F.lit(0)).otherwise(taken).cast("long"))
             .join(sources.select(source_key(F.col("source")).alias("key"), "source_size", "target"), "key"))
    out = ["shard", "slot", "key", "bucket", "row_no", "doc_id", "source", "size", "source_size", "target", "block_no", "first_word", "words"]
    if with_text:
        mixed = with_texts(mixed, texts_by_hash(docs, rows, id_col, text_col))
        out.append("text")
    return mixed.select(*out)


def per_document(mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of the input."""
    return (mixed.groupBy("key", "bucket", "row_no").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"),
                                                          F.first("target").alias("target"), F.sum("words").alias("taken"))
            .select("doc_id", "size", "source_size", "target", "taken"))
