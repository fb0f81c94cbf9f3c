from pyspark.sql import Window
from pyspark.sql import functions as F

from jestframe.functions.rand import draw, position
from jestframe.operators import sampling
from jestframe.sources import fixtures as X

from conftest import SF_MID


def test_draw_matches_known_value(spark):
    assert spark.range(1).select(draw(F.lit(1), "").alias("u")).first().u is not None
    import hashlib

    got = spark.range(3).select(draw(F.col("id"), "t").alias("u")).collect()
    assert [r.u for r in got] == [int(hashlib.md5(f"79:{i}:t".encode()).hexdigest()[:15], 16) for i in range(3)]


def test_positions_reach_beyond_32_bits(spark):
    n = 1 << 33
    top = spark.range(20_000).select(position(F.lit("s"), F.col("id"), n).alias("p")).agg(F.max("p"), F.min("p")).first()
    assert top[0] > (1 << 32) * 1.99 and 1 <= top[1] < n // 1000


def test_many_classes_resample(spark):
    """Class sizes never reach the driver, so labels may be as many as rows."""
    df = spark.range(1_100_000).select("id", F.floor(F.col("id") / 1.00001).alias("score"))
    classes = df.select("score").distinct().count()
    assert classes > 1_000_000
    assert sampling.under_sample(df, "id").count() == classes
    top = df.groupBy("score").count().agg(F.max("count")).first()[0]
    small = df.where("id < 3000")
    assert sampling.over_sample(small, "id").count() == small.select("score").distinct().count() * small.groupBy("score").count().agg(F.max("count")).first()[0]
    assert top >= 1


def test_exact_split_sizes(spark):
    for n, f, how, held in ((5, 0.2, "ceil", 1), (7, 0.5, "floor", 3), (7, 0.5, "ceil", 4)):
        df = spark.range(n)
        out = sampling.exact_split(df, "id", f, held_out=how).groupBy("part").count().collect()
        sizes = {r.part: r["count"] for r in out}
        assert sizes.get("valid", 0) == held and sizes["train"] == n - held


def test_exact_rank_equals_row_number(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 3).withColumn("u", draw(F.col("id"), "r"))
    ranked = sampling.BucketCounts(df, "u", ["g"], bits=6).ranked("id")
    ref = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("u", "id")))
    assert ranked.select("id", "rank").exceptAll(ref.select("id", "rank")).count() == 0
    by_order = sampling.exact_rank_by_order(df, "id", by=["g"], blocks=16)
    ref2 = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    assert by_order.select("id", "rank").exceptAll(ref2.select("id", "rank")).count() == 0


def test_under_over_sample_balanced(spark):
    scored = X.x_scored(spark, SF_MID).select("id", "score")
    under = sampling.under_sample(scored, "id").groupBy("score").count().collect()
    assert len({r["count"] for r in under}) == 1
    over = sampling.over_sample(scored, "id").groupBy("score").count().collect()
    assert len({r["count"] for r in over}) == 1
    top = scored.groupBy("score").count().agg(F.max("count")).first()[0]
    assert over[0]["count"] == top


def test_partition_count_invariance(spark):
    scored = X.x_scored(spark, SF_MID).select("id", "score")
    results = []
    for parts in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        results.append(sorted(r.id for r in sampling.under_sample(scored, "id").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_length_slices(spark):
    df = spark.createDataFrame([("a",), ("bb",), ("ccc",), ("d" * 10,)], "text string")
    assert [r.text for r in sampling.length_slice(df, q=0.1, side="short").collect()] == ["a"]
    assert [r.text for r in sampling.length_slice(df, q=0.9, side="long").collect()] == ["d" * 10]


def test_salted_draws_pick_the_same_rows(spark, monkeypatch):
    """Salting hot picked rows (R1, R8) changes the plan, never the result."""
    scored = X.x_scored(spark, SF_MID).select("id", "score")
    docs = spark.range(40).select(F.col("id").alias("doc_id"))

    def run():
        over = sorted(tuple(r) for r in sampling.over_sample(scored, "id").select("score", "draw", "id").collect())
        rows = sorted(tuple(r) for r in sampling.sample_rows(docs, "doc_id", rows=3000).select("draw", "doc_id")
                      .collect())
        return over, rows

    plain = run()
    monkeypatch.setattr(sampling, "DRAWS_PER_KEY", 2)
    assert sampling.salt_factor(3000 / 40) == 38
    salted = run()
    assert "_salt" in sampling.sample_rows(docs, "doc_id", rows=3000).drop("draw")._jdf.queryExecution() \
        .analyzed().toString()
    assert plain == salted
    assert len(plain[1]) == 3000


def test_bucket_counts_follow_the_rows(spark):
    """More rows than the target give more bits; ranks stay exact, also for a null group."""
    group = F.when(F.col("id") % 3 < 2, (F.col("id") % 3).cast("int"))
    df = spark.range(6000).withColumn("g", group).withColumn("u", draw(F.col("id"), "bc"))
    coarse = sampling.BucketCounts(df, "u", ["g"], bits=2)
    fine = sampling.BucketCounts(df, "u", ["g"], target_rows=50)
    assert coarse.bits == 2 and fine.bits > 6
    assert {(r.g, r.n) for r in fine.sizes.collect()} == {(0, 2000), (1, 2000), (None, 2000)}
    ref = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("u", "id")))
    for bc in (coarse, fine):
        got = bc.ranked("id").select("id", "rank")
        assert got.exceptAll(ref.select("id", "rank")).count() == 0 and got.count() == 6000


def test_key_only_draws_pick_the_same_rows(spark):
    scored = X.x_scored(spark, SF_MID)
    whole = sampling.sample_rows(scored, "id", rows=500).select("draw", "id", "text")
    keyed = sampling.sample_rows(scored, "id", rows=500, unique_key=True).select("draw", "id", "text")
    assert whole.exceptAll(keyed).count() == 0 and keyed.count() == 500


def test_exact_quantiles_match_linear_interpolation(spark):
    import math

    import numpy as np

    qs = (0.1, 0.25, 0.5, 0.75, 0.9)
    cases = [[5.0, 1.0, 3.0, 3.0, 3.0, 10.0, 2.0], [7.0], list(map(float, range(100)))]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
        got = {r.q: r.value for r in sampling.exact_quantiles(df, "x", qs).collect()}
        for q in qs:
            assert math.isclose(got[q], float(np.quantile(values, q)), rel_tol=1e-12, abs_tol=1e-12)
    empty = spark.createDataFrame([(None,)], "x double")
    assert all(r.value is None for r in sampling.exact_quantiles(empty, "x", qs).collect())
