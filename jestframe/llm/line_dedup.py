"""Operator 5: line dedup by a deletion-neighbourhood join (DataFrame functions
only).

The lines of all documents are compared as sequences of lower-cased words (runs
of characters other than white space) with an edit distance in words: a word
inserted, deleted or replaced is one edit.  A line goes if an earlier line (by
document id, then position) equals it, or, for lines of ``near_words`` words or
more, lies within one edit of it.  Lines of fewer than ``least_words`` words
always stay.

1. Equal lines are one class with its first occurrence.
2. Two lines within one edit agree on their first or their last half, so only
   classes that share a half with another class go on; no link is lost.
3. Deletion neighbourhood: such a class emits, for each word i outside a half that
   it shares, a hashed key of the line without word i, and for each gap i there a
   key of the line as it is; a key
   is the hash of (hash of the words before i, hash of those after).  Equal
   deletion keys at the same i are lines that differ in that word; a deletion
   key equal to a gap key is a line with one word more.  Equal keys meet in one
   aggregation that keeps the earliest line of each kind, so a key shared by
   many lines makes no pairs.
4. Each candidate's edit distance to that earliest line is verified on the words.

Defined results: null and empty texts have no lines that count and stay as they
are; a document whose lines all go becomes an empty text; a null id comes last;
rows that repeat an id are ordered by a hash of their text, and rows that repeat
id and text are one document (each keeps the same lines); an empty table gives
an empty result; the other columns are handed through, except that n_lines and
n_dropped are the operator's.  A line's neighbourhood costs its words times
CHUNK (the size of the pieces that prefix hashes are chained in), with no limit
on its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jestframe.llm.common import bound, free_name, others, written

LEAST_WORDS = 3
NEAR_WORDS = 8
CHUNK = 256


def plain(raw: Column) -> Column:
    """A line's lower-cased words, joined by single blanks."""
    odd = F.contains(raw, F.lit("  "))
    for c in "\t\x0B\f\r":
        odd = odd | F.contains(raw, F.lit(c))
    low = F.lower(raw)
    return F.btrim(F.when(odd, F.regexp_replace(low, r"\s{2,}|[\t\x0B\f\r]", " ")).otherwise(low))


def row_place(id_col: str, text_col: str) -> Column:
    """A row's place: document id (null last), then a hash of its text."""
    return F.struct(F.col(id_col).isNull().alias("last"), F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("doc"), F.xxhash64(text_col).alias("row"))


def lines_of(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """place (row place and position), line (plain), n words and class hash of
    every line that counts."""
    # lines are made plain before they are exploded: a filter on what follows can't repeat it
    lines = F.transform(F.split(F.col(text_col), "\n"), plain)
    rows = docs.select(row_place(id_col, text_col).alias("r"), F.posexplode(lines).alias("pos", "line"))
    n = F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1
    return (rows.select(F.struct("r.last", "r.doc", "r.row", "pos").alias("place"), "line", n.alias("n")).where((F.col("line") != "") & (F.col("n") >= least_words))
            .select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))


def halves() -> Column:
    """Keys of the first and last halves that a line within one edit may share:
    of floor((n-1)/2) up to floor(n/2) words each, n the longer line's size."""
    def keys(h: str) -> list[Column]:
        return [F.expr(f"xxhash64(0, {h}, substring_index(line, ' ', {h}))"), F.expr(f"xxhash64(1, {h}, substring_index(line, ' ', -({h})))")]

    low, high = "CAST((n - 1) div 2 AS INT)", "CAST(n div 2 AS INT)"
    return F.when(F.col("n") % 2 == 0, F.array(*keys(low), *keys(high))).otherwise(F.array(*keys(low)))


def chained(values: Column) -> Column:
    """Hashes of all prefixes of ``values``, the empty one first."""
    start = F.array(F.lit(7).cast("long"))
    return F.aggregate(values, start, lambda acc, v: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), v))))


def prefixes(words: Column) -> Column:
    """As ``chained``, in chunks: a prefix is hashed from the chunks before it and
    its part of its own chunk, so the cost doesn't grow with the square."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / CHUNK).cast("int")), lambda c: chained(F.slice(words, c * CHUNK + 1, F.lit(CHUNK))))

    def joined(inner: Column) -> Column:
        def all_of(before: Column) -> Column:
            # a chunk's last prefix is the next one's first
            own = F.transform(inner, lambda a, c: F.transform(F.slice(a, F.lit(1), F.when(c + 1 < F.size(inner), F.size(a) - 1).otherwise(F.size(a))), lambda h: F.xxhash64(F.get(before, c), h)))
            return F.flatten(own)

        return bound(chained(F.transform(inner, lambda a: F.element_at(a, -1))), all_of)

    return bound(chunks, joined)


def neighbourhood(words: Column, before: Column, after: Column, start: Column, stop: Column) -> Column:
    """(key, deleted, at) for the places from ``start`` to ``stop``: the line
    without a word, and with a gap.

    before[i]: hash of the first i words; after[j]: hash of the last j words."""
    n = F.size(words)
    without = F.transform(F.sequence(start, stop - 1), lambda i: F.struct(F.xxhash64(before[i], after[n - 1 - i], n - 1).alias("key"), F.lit(True).alias("deleted"), i.alias("at")))
    gaps = F.transform(F.sequence(start, stop), lambda i: F.struct(F.xxhash64(before[i], after[n - i], n).alias("key"), F.lit(False).alias("deleted"), i.alias("at")))
    return F.concat(without, gaps)


def within_one_edit(a: Column, b: Column, at: Column) -> Column:
    """Equal after taking word ``at`` (0-based) from the longer line, or from both."""
    def without(w: Column) -> Column:
        return F.concat(F.slice(w, F.lit(1), at), F.slice(w, at + 2, F.size(w)))

    return (F.when(F.size(a) == F.size(b), without(a) == without(b)).when(F.size(a) == F.size(b) + 1, without(a) == b)
            .when(F.size(b) == F.size(a) + 1, without(b) == a).otherwise(False))


def near_classes(classes: DataFrame, docs: DataFrame, near_words: int, id_col: str, text_col: str) -> DataFrame:
    """h1, h2 of the classes that an earlier line lies within one edit of."""
    keys = classes.where(F.size("halves") > 0).select("h1", "h2", "first", "words_n", F.posexplode("halves").alias("k", "half"))
    shared = keys.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    # what a line shares with another is not where they differ: first halves have even k
    size = F.when(F.col("k") < 2, F.floor((F.col("words_n") - 1) / 2)).otherwise(F.floor(F.col("words_n") / 2)).cast("int")
    ends = (keys.join(shared, "half", "left_semi").groupBy("h1", "h2", "first", "words_n")
            .agg(F.min(F.when(F.col("k") % 2 == 0, size)).alias("head"), F.min(F.when(F.col("k") % 2 == 1, size)).alias("tail")))
    some = written(ends.select("h1", "h2", "first", F.when(F.col("tail").isNull(), F.col("head")).otherwise(F.lit(0)).alias("start"),
                               F.when(F.col("head").isNull(), F.col("words_n") - F.col("tail")).otherwise(F.col("words_n")).cast("int").alias("stop")), "sharing")
    # the words of these classes only, from the document of their first occurrence
    places = (some.select("h1", "h2", "start", "stop", F.struct("first.last", "first.doc", "first.row").alias("at_row"), "first.pos")
              .groupBy("at_row").agg(F.collect_list(F.struct("pos", "h1", "h2", "start", "stop")).alias("at")))
    texts = docs.select(row_place(id_col, text_col).alias("own_row"), F.col(text_col).alias("own_text"))
    own = (texts.join(places, F.col("own_row") == F.col("at_row")).select("at_row", F.split("own_text", "\n").alias("lines"), "at")
           .select("at_row", F.explode(F.transform("at", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["start"].alias("start"), x["stop"].alias("stop"),
                                                                            x["pos"].alias("pos"), plain(F.get(F.col("lines"), x["pos"])).alias("line")))).alias("x"))
           .select("x.h1", "x.h2", "x.start", "x.stop", F.struct("at_row.*", "x.pos").alias("first"), "x.line"))
    some = written(own.dropDuplicates(["h1", "h2"]), "sharing")
    some = some.withColumn("words", F.split("line", " "))
    arranged = some.repartition("h1").withColumn("before", prefixes(F.col("words"))).withColumn("after", prefixes(F.reverse("words")))
    emitted = (arranged.select("h1", "h2", "first", F.explode(neighbourhood(*map(F.col, ("words", "before", "after", "start", "stop")))).alias("v"))
               .select("h1", "h2", "first", "v.*"))
    emitted = written(emitted, "variants")  # read twice: for the earliest line of each key, and to meet it
    # of equal (key, at), deletions differ in that word; a deletion and a gap differ by it
    earliest = emitted.groupBy("key", "at").agg(F.min(F.when(F.col("deleted"), F.struct("first", "h1", "h2"))).alias("del"),
                                                F.min(F.when(~F.col("deleted"), F.struct("first", "h1", "h2"))).alias("gap"))
    earliest = earliest.withColumn("best", F.least("del", "gap"))
    found = (emitted.join(earliest.where("del IS NOT NULL"), ["key", "at"])
             .withColumn("other", F.when(F.col("deleted"), F.col("best")).otherwise(F.col("del")))
             .where(F.col("other.first") < F.col("first"))
             .select("h1", "h2", "at", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2")))
    found = written(found, "candidates")
    texts = some.select("h1", "h2", "words")
    checked = (found.join(texts, ["h1", "h2"]).join(texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("words").alias("other")), ["o1", "o2"])
               .where(within_one_edit(F.col("words"), F.col("other"), F.col("at"))).where(F.greatest(F.size("words"), F.size("other")) >= near_words))
    return checked.select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame, near_words: int = NEAR_WORDS, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """place of every line that goes: last, doc, row, pos."""
    lines = lines_of(docs, id_col, text_col, least_words)
    own = F.when(F.col("n") >= near_words - 1, halves())
    placed = written(lines.select("place", "h1", "h2", F.col("n").alias("words_n"), own.alias("halves")), "placed")
    classes = written(placed.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), F.first("words_n").alias("words_n"), F.first("halves", ignorenulls=True).alias("halves")), "classes")
    near = near_classes(classes, docs, near_words, id_col, text_col).withColumn("near", F.lit(True))
    judged = classes.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left").where("n > 1 OR near")
    return (placed.select("place", "h1", "h2").join(judged, ["h1", "h2"])
            .where(F.coalesce(F.col("near"), F.lit(False)) | (F.col("place") > F.col("first"))).select("place.*"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", near_words: int = NEAR_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with ``text_col`` less the lines that go, and n_lines, n_dropped."""
    at, drop = free_name(docs, "gone_at"), free_name(docs, "gone")
    gone = dropped_lines(docs, near_words, least_words, id_col, text_col).groupBy(F.struct("last", "doc", "row").alias(at)).agg(F.collect_set("pos").alias(drop))
    lines = F.split(F.col(text_col), "\n")
    kept = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(drop), i)), "\n"))
    return docs.join(gone, row_place(id_col, text_col) == F.col(at), "left").select(
        *[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in others(docs.columns, ["n_lines", "n_dropped"])],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"))
