import math
import random

from pyspark.sql import functions as F

from jestframe.operators import profile as P
from jestframe.plans import queries as Q

from conftest import SF_SMALL

SCHEMA = "a long, b double, t string, flag boolean"


def table(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(50)]), rng.choice([None, float("nan"), 0.5, -0.0, 0.0, 1e12]), rng.choice([None, "", "é", "abc", "x" * 5000]), rng.choice([None, True])) for _ in range(900)]
    return spark.createDataFrame(rows, SCHEMA), rows


def as_dict(df):
    return {(r.column, r.stat): r.value for r in df.collect()}


def test_no_row_is_expanded(spark):
    """No Expand for distinct counts, and no text in the shuffled table of values."""
    df, _ = table(spark)
    for frame in (Q.t35_profile(spark, SF_SMALL), P.profile(df), P.value_counts(df)):
        assert "Expand" not in frame._jdf.queryExecution().executedPlan().toString()
    assert dict(P.value_counts(df).dtypes) == {"column": "string", "h1": "bigint", "h2": "bigint", "value": "double", "n": "bigint"}


def test_exact_numbers(spark):
    df, rows = table(spark)
    got = as_dict(P.profile(df))
    plain = [(a, None if b is None or math.isnan(b) else b, t, f) for a, b, t, f in rows]
    for k, c in enumerate(df.columns):
        own = [r[k] for r in plain if r[k] is not None]
        assert got[(c, "count")] == len(own) and got[(c, "distinct")] == len(set(own)) and got[(c, "any_missing")] == 1.0
    assert got[("*", "duplicate_rows")] == len(plain) - len(set(plain))
    empty = as_dict(P.profile(df.limit(0)))
    assert empty[("*", "rows")] == empty[("a", "distinct")] == empty[("*", "duplicate_rows")] == 0 and empty[("a", "p50")] is None


def test_merged_equals_rebuilt(spark, tmp_path):
    df, _ = table(spark)
    path = f"{tmp_path}/sketches"
    for b in range(5):
        P.sketches(df.where(F.coalesce(F.col("a"), F.lit(0)) % 5 == b), f"b{b}").write.mode("append").parquet(path)
    P.sketches(df.limit(0), "none").write.mode("append").parquet(path)
    P.sketches(df.where(F.coalesce(F.col("a"), F.lit(0)) % 5 == 2), "b2").write.mode("append").parquet(path)  # a batch appended twice counts once
    merged, once, exact = as_dict(P.merged_profile(spark.read.parquet(path))), as_dict(P.merged_profile(P.sketches(df, "all"))), as_dict(P.profile(df))
    assert set(merged) == set(once) == set(exact)
    for key, want in exact.items():
        if key[1][0] == "p" and key[1][1:].isdigit():
            continue
        bound = 0.035 * max(want, 900) if key[1] in ("distinct", "duplicate_rows") else 1e-9 * max(1, abs(want))
        assert abs(merged[key] - want) <= bound and abs(once[key] - want) <= bound, key
    below = df.where(F.col("a") < merged[("a", "p50")]).count() / df.where("a IS NOT NULL").count()
    assert abs(below - 0.5) < 0.06
