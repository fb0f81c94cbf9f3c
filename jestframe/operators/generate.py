"""Synthetic test rows.

Every random choice is a keyed draw (``functions.rand``): the i-th generated
row and its j-th token get their own key, so the rows are the same on any
cluster shape and after any retry.  Generation is row-local (no shuffle);
the only shuffle is the final drop-all-duplicates.

Token arrays are projected into their own column before ``random_join``
reads them.  ``random_join`` refers to its tokens three times, and Catalyst
does not share common subexpressions across higher-order functions, so an
inlined array of keyed draws (or a split of a whole text) would be computed
three times per row.  CollapseProject keeps the separate projection because
merging it would duplicate a costly expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rand import draw
from ..functions.text import choices, random_count, random_join
from .dedup import drop_all_duplicates, vocabulary_union
from .sampling import exact_split, sample_rows


def contradiction_rows(original: DataFrame, exclusive_humor: list[str], exclusive_non_humor: list[str],
                       rows: int | None = None, key: str = "id", score: str = "score", text: str = "text",
                       tag: str = "exclusive", tiebreak: list[str] | None = None, unique_key: bool = False) -> DataFrame:
    """``rows`` random rows (with replacement) of ``original``, each text
    followed by 1..3 phrases of the *opposite* class (score 0 -> humour
    phrases, otherwise non-humour phrases), randomly joined; score kept; then
    every text that occurs twice is dropped.  ``rows`` defaults to the size of
    ``original``.  Output: draw, id, text, score."""
    sampled = sample_rows(original.select(key, text, score), key, rows=rows, tag=tag, tiebreak=tiebreak,
                          unique_key=unique_key)
    g = F.concat(F.lit(tag + ":"), F.col("draw").cast("string"))
    is_zero = F.col(score).eqNullSafe(0)
    hi = F.when(is_zero, F.lit(min(3, len(exclusive_humor)))).otherwise(F.lit(min(3, len(exclusive_non_humor))))
    k = random_count_col(g, "k", hi)
    humor = choices(exclusive_humor, k, g) if exclusive_humor else F.array().cast("array<string>")
    other = choices(exclusive_non_humor, k, g) if exclusive_non_humor else F.array().cast("array<string>")
    phrases = F.when(is_zero, humor).otherwise(other)
    tokens = F.concat(F.array(F.col(text)), phrases)
    staged = sampled.select("draw", F.col(key).alias("id"), F.col(score).alias("score"), tokens.alias("_tok"))
    out = staged.select("draw", "id", random_join(F.col("_tok"), g).alias("text"), "score")
    return drop_all_duplicates(out, "text")


def random_count_col(key, tag: str, hi) -> F.Column:
    """randint(1, hi) with a per-row upper bound; 0 when hi is 0 (empty list)."""
    return F.when(hi <= 0, F.lit(0)).otherwise((F.lit(1) + draw(key, tag) % hi).cast("int"))


def repetition_rows(seeds: DataFrame, repetition_tokens: list[str], exclusive_humor: list[str],
                    key: str = "doc_id", per_seed: int = 2, max_tokens: int = 50,
                    tag: str = "repetition") -> DataFrame:
    """``per_seed`` texts per seed row, each 1..50 tokens drawn from the
    sorted union of both vocabularies (D3), randomly joined, score 0; drop all
    duplicates; split in halves: the first floor(n/2) rows by a keyed draw
    are ``test``, the rest ``train`` (R6).  Output: gen, text, score, part."""
    vocab = sorted(set(exclusive_humor) | set(repetition_tokens))
    gen = seeds.select(
        F.explode(F.array(*[F.col(key) * per_seed + j for j in range(per_seed)])).alias("gen")
    )
    g = F.concat(F.lit(tag + ":"), F.col("gen").cast("string"))
    k = random_count(g, "k", 1, max_tokens)
    staged = gen.select("gen", choices(vocab, k, g).alias("_tok"))
    out = staged.select("gen", random_join(F.col("_tok"), g).alias("text"), F.lit(0).alias("score"))
    unique = drop_all_duplicates(out, "text")
    return exact_split(unique, "gen", 0.5, tag=tag + "_split", names=("train", "test"), held_out="floor",
                       materialise=True)


def token_shuffle_join(df: DataFrame, vocabulary: list[str], key: str = "doc_id", text: str = "text",
                       tag: str = "join") -> DataFrame:
    """R2 + R3 over whole texts: the words of each text followed by 1..3
    vocabulary phrases, then randomly joined with blanks / newlines."""
    g = F.concat(F.lit(tag + ":"), F.col(key).cast("string"))
    k = random_count(g, "k", 1, min(3, len(vocabulary)))
    tokens = F.concat(F.split(F.col(text), " "), choices(vocabulary, k, g))
    staged = df.select(F.col(key), tokens.alias("_tok"))
    return staged.select(F.col(key), random_join(F.col("_tok"), g).alias("text"))


__all__ = ["contradiction_rows", "repetition_rows", "token_shuffle_join", "vocabulary_union"]
