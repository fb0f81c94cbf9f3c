"""Operator 13: spelling variant grouping by permuterm rotations.

Two words are near if they differ by one inserted, deleted or replaced code
point.  Of each word, marked with the terminator ``$``, all rotations are taken.
A rotation ends with the character before the cut, so words that differ only in
the character at one place have rotations with the same prefix and another last
character (a replacement), and the word without that character has the prefix
itself as a rotation (an insertion or deletion).  So each rotation is sorted under
the prefix that skips its last character, and, whole, as the prefix of longer ones.
Every prefix range is scanned once: each of its words gets the number of its
neighbours there and the most frequent of them.

A range holds one word at most for each character (and the word without one), as
prefix and character name the word: its size is bounded by the alphabet, however
frequent a word is.  No pairs are written.  Two words meet in one range only: of a
run of equal characters, only the first counts as inserted or deleted.

Rotations of words over LONG code points are kept as hashes (positions and
polynomial hashes of the parts before and after the skipped character, 124 bits),
computed from running sums, so a word of any length costs its length and not its
square.

A word's form is its most frequent near word (ties: smallest in code-point order),
if ``ratio`` times as frequent; its root is found by following forms to the end.
Counts grow by ``ratio`` along a chain, so chains are short, and pointer doubling
ends after log2 of their greatest length.

Defined results: null and empty texts hold no words; a null id leaves runs as they
are under ``edited``; repeated rows count again; words with no near word have n_near 0
and are their own root; an empty table gives an empty result.  Only the two named
columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jestframe.llm.common import written
from jestframe.operators.sampling import exact_rank_by_order

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
LONG = 64
MARK = "$"
# Two primes below 2^31 and a base for the hashes of long words.
PRIMES = (2147483647, 2147483629)
BASE = 1_000_003
#: What a row is in its range: the whole rotation, a skipped character, or one that repeats the character before it.
WHOLE, SKIPPED, REPEATED = 0, 1, 3


def lowered(run: Column) -> Column:
    """Only A-Z in lower case."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
               edited: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """word, n of the maximal letter runs of all texts, lower-cased and passed
    through ``edited`` (of run and id; it may only shorten a run)."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    words = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).select("id", lowered(F.col("run")).alias("run"))
    words = words.select((edited(F.col("run"), F.col("id")) if edited else F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def short_rotations(words: DataFrame) -> DataFrame:
    """key, id, n, kind of words up to LONG code points."""
    w, size = F.col("word"), F.length("word")
    def part(start: Column, n: Column | None = None) -> Column:
        return F.substr(w, start, size if n is None else n)

    def rotation(i: Column) -> Column:
        return F.concat(part(i + 1), F.lit(MARK), part(F.lit(1), i))

    # the rotation cut after character i (from 1) ends with it; its range's prefix skips it
    skipped = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(
        F.concat(part(i + 1), F.lit(MARK), part(F.lit(1), i - 1)).alias("key"),
        F.when((i > 1) & (part(i, F.lit(1)) == part(i - 1, F.lit(1))), F.lit(REPEATED)).otherwise(F.lit(SKIPPED)).alias("kind")))
    whole = F.when(size < LONG, F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(rotation(i).alias("key"), F.lit(WHOLE).alias("kind"))))
    both = F.concat(skipped, F.coalesce(whole, F.slice(skipped, 1, 0)))
    return words.where(size <= LONG).select("id", "n", F.explode(both).alias("r")).select(F.col("r.key").cast("binary").alias("key"), "id", "n", "r.kind")


def powers(n: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(BASE, len(out), prime)) % np.uint64(prime)])
    return out[:n]


def part_hashes(points: np.ndarray) -> list[np.ndarray]:
    """Hashes of all prefixes and of all suffixes (by first character, the empty one last)."""
    out, zero = [], np.zeros(1, np.uint64)
    for prime in PRIMES:
        p = np.uint64(prime)
        pw = powers(len(points), prime)
        out.append(np.concatenate([zero, np.cumsum((points + np.uint64(1)) * pw % p) % p]))
        out.append(np.concatenate([zero, np.cumsum((points[::-1] + np.uint64(1)) * pw % p) % p])[::-1])
    return out


def long_rotations(words: DataFrame) -> DataFrame:
    """As short_rotations, hashed: words over LONG code points, and those of LONG
    as the shorter neighbours of longer ones."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, number, n in zip(batch.column("word").to_pylist(), batch.column("id").to_pylist(), batch.column("n").to_pylist(), strict=True):
                points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
                size, sums = len(points), part_hashes(points)
                at = np.arange(size + 1, dtype=np.uint64)
                whole = np.column_stack([at, np.full(size + 1, size, np.uint64), *sums])
                keys, kinds = [whole], [np.full(size + 1, WHOLE)]
                if size > LONG:
                    keys.append(np.column_stack([at[:-1], np.full(size, size - 1, np.uint64), *[h[:-1] if k % 2 == 0 else h[1:] for k, h in enumerate(sums)]]))
                    kinds.append(np.where(np.concatenate([[False], points[1:] == points[:-1]]), REPEATED, SKIPPED))
                for key, kind in zip(keys, kinds, strict=True):
                    for i in range(0, len(key), 65_536):
                        part = np.ascontiguousarray(key[i:i + 65_536])
                        raw = pa.Array.from_buffers(pa.binary(part.shape[1] * 8), len(part), [None, pa.py_buffer(part.tobytes())]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([raw, pa.array(np.full(len(part), number, np.int64)), pa.array(np.full(len(part), n, np.int64)),
                                                          pa.array(kind[i:i + 65_536].astype(np.int32))], names=["key", "id", "n", "kind"])

    return words.where(F.length("word") >= LONG).select("word", "id", "n").mapInArrow(emit, "key binary, id long, n long, kind int")


def neighbours(words: DataFrame) -> DataFrame:
    """word, n, id (its rank in code-point order) -> id, n_near, form (id of the
    most frequent near word), form_n; words with near words only."""
    ranges = (short_rotations(words).unionByName(long_rotations(words)).groupBy("key")
              .agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "id", "kind"))).alias("m")).where(F.size("m") > 1))

    def near(x: Column) -> Column:
        others = F.filter("m", lambda y: (y["id"] != x["id"]) & (x["kind"] + y["kind"] != WHOLE + REPEATED))
        return F.struct(x["id"].alias("id"), F.size(others).alias("n_near"), F.struct(F.get(others, F.lit(0))["less"].alias("less"), F.get(others, F.lit(0))["id"].alias("id")).alias("first"))

    found = ranges.select(F.explode(F.transform("m", near)).alias("x")).select("x.*").where("n_near > 0")
    return (found.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("first").alias("first"))
            .select("id", "n_near", F.col("first.id").alias("form"), (-F.col("first.less")).alias("form_n")))


def roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """id, form -> id, root: forms followed to the last, by pointer doubling."""
    links = forms.select("id", F.col("form").alias("to"))
    longest = max(1, math.ceil(math.log(max(most, 2), ratio))) if ratio > 1 else most
    for _ in range(math.ceil(math.log2(longest + 1))):
        after = links.select(F.col("id").alias("to"), F.col("to").alias("next"))
        links = written(links.join(after, "to", "left").select("id", F.coalesce("next", "to").alias("to")), "roots")
    return links.select("id", F.col("to").alias("root"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n (one row a word) -> word, form, root, n, n_near, form_n."""
    ranked = written(exact_rank_by_order(written(words.select("word", "n"), "words"), "word", rank_col="id"), "vocabulary")
    near = written(neighbours(ranked), "near")
    most = ranked.agg(F.max("n")).first()[0] or 0  # one number
    linked = ranked.select("id", "n").join(near, "id")
    own = written(linked.where(F.col("form_n") >= ratio * F.col("n")).select("id", "form", "form_n"), "forms")
    names = ranked.select("id", "word")
    spelled = (own.join(roots(own, most, ratio), "id").join(names.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form")
               .join(names.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
               .select("id", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "form_n"))
    return (ranked.join(near.select("id", "n_near"), "id", "left").join(spelled, "id", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
