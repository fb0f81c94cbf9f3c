"""String column functions (F1-F6, F3, R2, R3).  Column -> Column, no UDFs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rand import DEFAULT_SEED, U_BITS

# Python's str.strip() removes every whitespace character at both ends
# (newlines included); plain TRIM only removes blanks.
_STRIP_RE = r"^\s+|\s+$"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, _STRIP_RE, "")


def text_length(col: Column) -> Column:
    """Length in code points, like Python ``len``."""
    return F.length(col)


def half_even(col: Column) -> Column:
    """Python ``round(x)``: half to even, integer result."""
    return F.floor(F.bround(col, 0)).cast("int")


def clip(col: Column, lo, hi) -> Column:
    """Clip to [lo, hi]."""
    return F.least(F.greatest(col, F.lit(lo)), F.lit(hi))


def random_join(tokens: Column, key: Column, p_newline: float = 0.1, seed: int = DEFAULT_SEED,
                tag: str = "s") -> Column:
    """F2 + R3: each token followed by a newline with probability p, else a blank;
    concatenated, then stripped.

    The draw for token j (1-based) is the ((j-1) % 4)-th 32-bit word of
    md5("seed:key:tag||((j-1) // 4 + 1)"): one md5 serves four tokens.  The
    separators are built as their own array and zipped with the tokens, so
    each hash is computed once per row (a lambda that referred to a shared
    expression would re-evaluate it per element).  ``tokens`` is read three
    times: pass a column reference, not a costly expression (see
    ``operators.generate``)."""
    t = math.ceil(p_newline * (1 << 32))
    n = F.size(tokens)
    blocks = F.greatest(((n + 3) / 4).cast("int"), F.lit(1))
    hexes = F.transform(
        F.sequence(F.lit(1), blocks),
        lambda b: F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.concat(F.lit(tag), b.cast("string")))),
    )
    words = F.flatten(F.transform(hexes, lambda h: F.array(
        *[F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)])))
    seps = F.transform(F.slice(words, 1, n), lambda u: F.when(u < F.lit(t), F.lit("\n")).otherwise(F.lit(" ")))
    return strip(F.array_join(F.zip_with(tokens, seps, lambda a, b: F.concat(a, b)), ""))


def _draw_indexed(key: Column, tag: str, i: Column, seed: int) -> Column:
    """Draw for the element at 0-based index i; the tag carries i + 1."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.concat(F.lit(tag), (i + 1).cast("string")))
    return F.conv(F.substring(F.md5(text), 1, U_BITS // 4), 16, 10).cast("bigint")


def choices(vocabulary: list[str], k: Column, key: Column, seed: int = DEFAULT_SEED,
            tag: str = "t") -> Column:
    """R2: ``random.choices(vocabulary, k=k)`` as an array column; element i is
    vocabulary[draw(key, tag||i) % len]."""
    vocab = F.array(*[F.lit(v) for v in vocabulary])
    size = len(vocabulary)
    return F.transform(
        F.sequence(F.lit(1), k.cast("int")),
        lambda i: F.element_at(vocab, (_draw_indexed(key, tag, i - 1, seed) % F.lit(size) + 1).cast("int")),
    )


def random_count(key: Column, tag: str, lo: int, hi: int, seed: int = DEFAULT_SEED) -> Column:
    """``random.randint(lo, hi)`` keyed by (key, tag)."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(tag))
    u = F.conv(F.substring(F.md5(text), 1, U_BITS // 4), 16, 10).cast("bigint")
    return (F.lit(lo) + u % F.lit(hi - lo + 1)).cast("int")


def apply_template(template: str, col: Column, placeholder: str = "{input}") -> Column:
    """prompt text around a column; the template holds one placeholder."""
    pre, _, post = template.partition(placeholder)
    return F.concat(F.lit(pre), col, F.lit(post))


__all__ = [
    "strip", "text_length", "half_even", "clip", "random_join", "choices",
    "random_count", "apply_template",
]
