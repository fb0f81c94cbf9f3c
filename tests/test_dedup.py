from pyspark.sql import functions as F

from jestframe.operators import dedup
from jestframe.sources import io

from conftest import SF_MID


def test_drop_all_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id long, text string")
    assert [r.id for r in dedup.drop_all_duplicates(df).collect()] == [3]
    one_null = spark.createDataFrame([(1, None), (2, "b")], "id long, text string")
    assert sorted(r.id for r in dedup.drop_all_duplicates(one_null).collect()) == [1, 2]


def test_hashed_equals_simple(spark):
    docs = io.table(spark, SF_MID, "documents")
    a = dedup.drop_all_duplicates(docs).select("doc_id")
    b = dedup.drop_all_duplicates_hashed(docs).select("doc_id")
    assert a.count() == b.count() == a.intersect(b).count()


def test_idempotent(spark):
    docs = io.table(spark, SF_MID, "documents")
    once = dedup.drop_all_duplicates(docs)
    twice = dedup.drop_all_duplicates(once)
    assert once.count() == twice.count()


def test_keep_first_and_union(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id long, text string")
    assert sorted((r.id, r.text) for r in dedup.keep_first(df, "text", "id").collect()) == [(1, "a"), (2, "b")]
    x = spark.createDataFrame([("a", 1), ("b", 1)], "text string, score int")
    y = spark.createDataFrame([("b",), ("c",)], "text string")
    out = sorted((r.text, r.score) for r in dedup.union_unique(x, y).collect())
    assert out == [("a", 1), ("c", None)]


def test_vocabulary_union(spark):
    row = spark.range(1).select(dedup.vocabulary_union(["ok", "jaja"], ["jaja", "meh"]).alias("v")).first()
    assert row.v == ["jaja", "meh", "ok"]


def test_hashed_collision_path(spark):
    """Every text in one hash group (and in two groups): the collision branch
    regroups by the full text and still equals the plain D1."""
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, None), (6, None), (7, "d"), (8, "c")]
    df = spark.createDataFrame(rows, "id long, text string")
    want = sorted(r.id for r in dedup.drop_all_duplicates(df).collect())
    assert want == [3, 7]
    for fn in (lambda c: F.lit(1).cast("bigint"), lambda c: F.length(c).cast("bigint") % 2):
        got = sorted(r.id for r in dedup.drop_all_duplicates_hashed(df, hash_fn=fn).collect())
        assert got == want
