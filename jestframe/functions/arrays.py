"""Array column functions for logits, labels and token sequences.

F7 softmax, F8 first arg-max, F9 threshold label, F10 gather, F11 last valid
position, F12 mask-all-but-last, F13 keep-last-n, F14 append label token,
F15 shift, F18 wide columns, J5 class lookup, J6 answer lookup.  All are
higher-order SQL functions, evaluated in the JVM next to the data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


def softmax(logits: Column) -> Column:
    """F7, stable form: exp(x - max) / sum(exp(x - max)).

    Meant for class arrays (k <= 8): max and sum sit inside the lambda and
    are re-evaluated per element, which is negligible at that width."""
    m = F.array_max(logits)
    ex = F.transform(logits, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def log_softmax_at(logits: Column, index0: Column) -> Column:
    """log p[index] = x[index] - logsumexp(x) (index 0-based)."""
    m = F.array_max(logits)
    lse = F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - m)), F.lit(0.0), lambda a, x: a + x)) + m
    return F.try_element_at(logits, (index0 + 1).cast("int")) - lse


def argmax_first(values: Column) -> Column:
    """F8: 0-based index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def label_from_logits(logits: Column, threshold: float | None = None) -> Column:
    """arg-max, or, with a threshold, 1 iff softmax(x)[1] > threshold."""
    if threshold is None:
        return argmax_first(logits)
    return (F.element_at(softmax(logits), 2) > F.lit(float(threshold))).cast("int")


def gather(values: Column, indices: list[int] | Column) -> Column:
    """values at 0-based indices, e.g. logits restricted to class tokens."""
    idx = indices if isinstance(indices, Column) else F.array(*[F.lit(int(i)) for i in indices])
    return F.transform(idx, lambda i: F.try_element_at(values, (i + 1).cast("int")))


def last_valid(labels: Column, ignore: int = IGNORE) -> Column:
    """0-based position of the last label that is not ``ignore``; 0 if none."""
    return F.coalesce(
        F.array_max(F.transform(labels, lambda x, i: F.when(x != F.lit(ignore), i).otherwise(F.lit(0)))), F.lit(0)
    )


def gather_last(values: Column, labels: Column, shift: int = 1, ignore: int = IGNORE) -> Column:
    """element at (last valid position - shift).  A negative position wraps
    to the end of the array like numpy indexing does."""
    pos = last_valid(labels, ignore) - F.lit(shift)
    return F.try_element_at(values, F.when(pos < 0, pos).otherwise(pos + 1).cast("int"))


def mask_all_but_last(labels: Column, ignore: int = IGNORE) -> Column:
    """keep only the last valid label, every other position -> ignore.

    Built as ignore* ++ [label] ++ ignore* so the last position is computed
    once per row; a lambda referring to it would be re-evaluated for every
    element (Catalyst inlines it), which is quadratic on long sequences."""
    last = last_valid(labels, ignore)
    n = F.size(labels)
    fill = F.lit(ignore)
    built = F.concat(
        F.array_repeat(fill, last),
        F.array(F.try_element_at(labels, (last + 1).cast("int"))),
        F.array_repeat(fill, F.greatest(n - last - 1, F.lit(0))),
    )
    return F.when(n <= 0, labels).otherwise(built)


def keep_last(values: Column, n: int) -> Column:
    """left truncation to the last n elements."""
    return F.slice(values, F.greatest(F.size(values) - F.lit(n) + 1, F.lit(1)), n)


def append_label(ids: Column, label_token: Column, end_token: int, max_length: int) -> Column:
    """put the label token at the end of a token sequence.

    * label is the end token: drop a trailing end token, otherwise unchanged;
    * sequence ends with the end token: replace it by the label;
    * else append, and drop the first element if that overflows max_length.
    """
    end = F.lit(end_token)
    n = F.size(ids)
    ends_with_end = F.try_element_at(ids, F.lit(-1)) == end
    without_last = F.slice(ids, 1, F.greatest(n - 1, F.lit(0)))
    appended = F.concat(ids, F.array(label_token))
    trimmed = F.when(F.size(appended) > F.lit(max_length), F.slice(appended, 2, max_length)).otherwise(appended)
    return (
        F.when(label_token == end, F.when(ends_with_end, without_last).otherwise(ids))
        .when(ends_with_end, F.concat(without_last, F.array(label_token)))
        .otherwise(trimmed)
    )


def append_mask(mask: Column, ids: Column, label_token: Column, end_token: int, max_length: int) -> Column:
    """F14 for the attention mask: parallel to ``append_label(ids, ...)``; the
    label's position is attended (1)."""
    end, one = F.lit(end_token), F.array(F.lit(1))
    ends_with_end = F.coalesce(F.try_element_at(ids, F.lit(-1)) == end, F.lit(False))
    without_last = F.slice(mask, 1, F.greatest(F.size(mask) - 1, F.lit(0)))
    appended = F.concat(mask, one)
    trimmed = F.when(F.size(appended) > F.lit(max_length), F.slice(appended, 2, max_length)).otherwise(appended)
    return (
        F.when(label_token == end, F.when(ends_with_end, without_last).otherwise(mask))
        .when(ends_with_end, F.concat(without_last, one))
        .otherwise(trimmed)
    )


def shift_left(labels: Column, ignore: int = IGNORE) -> Column:
    """labels[1:] + [ignore]."""
    return F.concat(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), F.array(F.lit(ignore)))


def class_lookup(token: Column, class_tokens: list[int], default: int = IGNORE) -> Column:
    """Token id -> class index (position in ``class_tokens``), else default."""
    m = F.create_map(*[x for i, t in enumerate(class_tokens) for x in (F.lit(int(t)), F.lit(i))])
    return F.coalesce(F.try_element_at(m, token), F.lit(default))


def answer_index(answer: Column, classes: list[str]) -> Column:
    """``classes.index(answer)`` or -1 when absent (or null)."""
    arr = F.array(*[F.lit(c) for c in classes])
    return (F.coalesce(F.array_position(arr, answer), F.lit(0)) - 1).cast("int")


def score_to_token(score: Column, class_tokens: list[int], end_token: int) -> Column:
    """P10: score -> class token; a null score -> the end token."""
    arr = F.array(*[F.lit(int(t)) for t in class_tokens])
    return F.coalesce(F.try_element_at(arr, (score + 1).cast("int")), F.lit(end_token))


def wide(probs: Column, k: int, prefix: str = "score_") -> list[Column]:
    """array -> columns score_0..score_{k-1}."""
    return [F.element_at(probs, i + 1).alias(f"{prefix}{i}") for i in range(k)]
