"""U2 over growing corpora: equal to the union made unique, without shuffling what is written."""

import random

import pytest
from pyspark.sql import functions as F

from jestframe.operators import dedup
from jestframe.operators.increment import GrowingCorpus
from jestframe.sources import io


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def batches(spark):
    rng = random.Random(2)
    rows = [[(rng.choice([None, "", "é", *(f"t{i}" for i in range(60))]), rng.randint(0, 5)) for _ in range(40)] for _ in range(4)]
    rows[2] += [("hot", 1)] * 500
    return [spark.createDataFrame(r, io.LABELLED) for r in rows]


def test_equals_the_union_made_unique(spark, batches, tmp_path):
    corpus = GrowingCorpus(spark, f"file://{tmp_path}/c", io.LABELLED, buckets=4)
    assert corpus.unique().count() == 0
    before = []
    for k, batch in enumerate(batches):
        corpus.write(f"b{k}", batch)
        now = rows_of(dedup.union_unique(*batches[:k + 1]))
        assert rows_of(corpus.unique()) == now
        assert rows_of(corpus.added(f"b{k}")) == sorted(set(now) - set(before), key=repr)
        assert rows_of(corpus.withdrawn(f"b{k}")) == sorted(set(before) - set(now), key=repr)
        before = now
    # a batch written again replaces itself; another takes its place
    corpus.write("b1", batches[1])
    assert rows_of(corpus.unique()) == before
    corpus.write("b1", batches[0])
    assert rows_of(corpus.unique()) == rows_of(dedup.union_unique(batches[0], batches[0], batches[2], batches[3]))
    corpus.write("b1", batches[1].limit(0))
    assert rows_of(corpus.counts(but="b3")) == rows_of(GrowingCorpus(spark, f"file://{tmp_path}/c", io.LABELLED, buckets=4).counts(but="b3"))  # reopened


def test_nothing_written_is_shuffled(spark, batches, tmp_path):
    corpus = GrowingCorpus(spark, f"file://{tmp_path}/c", io.LABELLED, buckets=4)
    for k, batch in enumerate(batches):
        corpus.write(f"b{k}", batch)
    for df in (corpus.unique(), corpus.added("b2"), corpus.withdrawn("b2"), corpus.counts()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    plan = corpus.added("b2")._jdf.queryExecution().executedPlan().toString()
    other = next(p for p in plan.split("FileScan") if "NOT (batch" in p)
    assert "ReadSchema: struct<digest:binary>" in other  # no texts of other batches


def test_files_follow_the_buckets(spark, batches, tmp_path):
    corpus = GrowingCorpus(spark, f"file://{tmp_path}/c", io.LABELLED, buckets=4)
    corpus.write("x", batches[2].withColumn("score", F.col("score").cast("long")).withColumn("extra", F.lit(1)))
    assert len(list((tmp_path / "c" / "batch=x").glob("*.parquet"))) <= 4
