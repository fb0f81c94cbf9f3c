from pyspark.sql import functions as F

from jestframe.functions import arrays as A
from jestframe.functions.text import random_join, strip


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_argmax_and_threshold(spark):
    assert _one(spark, A.argmax_first(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    # p1 exactly at the threshold -> 0 (strict >)
    assert _one(spark, A.label_from_logits(F.array(F.lit(0.0), F.lit(0.0)), 0.5)) == 0
    assert _one(spark, A.label_from_logits(F.array(F.lit(0.0), F.lit(1.0)), 0.5)) == 1
    s = _one(spark, A.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))
    assert abs(sum(s) - 1.0) < 1e-12


def test_pack(spark):
    cases = [([1, 2, 9], 9, [1, 2]), ([1, 2], 9, [1, 2]), ([1, 2, 9], 5, [1, 2, 5]), ([1, 2], 5, [1, 2, 5]),
             ([1, 2, 3], 5, [2, 3, 5])]
    for ids, lab, want in cases:
        col = A.append_label(F.array(*[F.lit(i) for i in ids]), F.lit(lab), 9, 3)
        assert _one(spark, col) == want
    assert _one(spark, A.keep_last(F.array(*[F.lit(i) for i in range(10)]), 3)) == [7, 8, 9]


def test_mask_gather_shift(spark):
    labels = F.array(*[F.lit(x) for x in (-100, 5, 7, -100)])
    assert _one(spark, A.mask_all_but_last(labels)) == [-100, -100, 7, -100]
    values = F.array(*[F.lit(x) for x in ("a", "b", "c", "d")])
    assert _one(spark, A.gather_last(values, labels, shift=1)) == "b"
    assert _one(spark, A.shift_left(labels)) == [5, 7, -100, -100]
    none_valid = F.array(F.lit(-100), F.lit(-100))
    assert _one(spark, A.gather_last(F.array(F.lit("x"), F.lit("y")), none_valid, shift=1)) == "y"  # wraps


def test_lookups(spark):
    assert _one(spark, A.class_lookup(F.lit(8), [6, 7, 8])) == 2
    assert _one(spark, A.class_lookup(F.lit(99), [6, 7, 8])) == -100
    assert _one(spark, A.answer_index(F.lit("1"), ["0", "1"])) == 1
    assert _one(spark, A.answer_index(F.lit("x"), ["0", "1"])) == -1
    assert _one(spark, A.answer_index(F.lit(None).cast("string"), ["0", "1"])) == -1
    assert _one(spark, A.score_to_token(F.lit(None).cast("int"), [6, 7], 9)) == 9


def test_strip_and_join(spark):
    assert _one(spark, strip(F.lit(" \n a b \t\n"))) == "a b"
    out = _one(spark, random_join(F.array(F.lit("x"), F.lit("y")), F.lit("k")))
    assert out.replace("\n", " ") == "x y"
