import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from jestframe.llm import queries, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, bucket int, `at` int, h1 int"


def corpus(spark, parts=6):
    rows = [(i, f"text {i} " * (i % 40), "en", f"s{i % 4}", i, "x", i, 1, 2) for i in range(700)]
    rows += [(7, "a copy " * 30, None, "hot", 1, None, None, None, None)] * 400  # a third of all rows are equal
    rows += [(None, None, None, None, None, None, None, None, None)] * 3 + [(8, "", "", "", 0, "", 0, 0, 0), (9, "long " * 60_000, "en", "s", 1, "", 0, 0, 0), (10, "é", "en", "s", 1, "", 0, 0, 0)]
    return spark.createDataFrame(rows, DOCS).repartition(parts, "doc_id", "n_chars"), rows


def test_fisher_yates():
    """Every place is as likely for every row."""
    counts = np.zeros((4, 4))
    seen = Counter()
    for seed in range(4800):
        order = sharding.fisher_yates(4, np.random.default_rng(seed))
        seen[tuple(order)] += 1
        counts[np.arange(4), order] += 1
    assert len(seen) == 24 and min(seen.values()) > 130 and max(seen.values()) < 280
    assert abs(counts - 1200).max() < 150
    assert list(sharding.fisher_yates(0, np.random.default_rng(1))) == [] and list(sharding.fisher_yates(1, np.random.default_rng(1))) == [0]


def test_whole_and_even(spark):
    docs, rows = corpus(spark)
    out = sharding.sharded(docs, 24, bucket_bytes=20_000)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "bucket", "at", "h1", "shard", "slot"]
    got = out.collect()
    key = lambda r: repr(tuple(r)[:5])
    assert sorted(map(key, got)) == sorted(map(key, rows))  # no row lost or doubled
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_buckets_are_small_and_shuffled(spark):
    docs, _ = corpus(spark, parts=60)
    docs = docs.where("doc_id IS NULL OR doc_id <> 9").withColumn("doc_id", F.col("doc_id")).repartition(60)
    out = sharding.shuffled(docs, bucket_bytes=8_000).cache()
    per = {r.bucket: r["count"] for r in out.groupBy("bucket").count().collect()}
    assert len(per) > 20
    most = max(out.groupBy("bucket").agg(F.sum(F.octet_length("row.text") + 64).alias("b")).select("b").collect())[0]
    assert most < 5 * 8_000  # the copies are spread over buckets too
    # ids of a shard are no run of neighbours
    rows = [r.row.doc_id for r in out.where("row.text LIKE 'text%'").orderBy("bucket", "at").select("row").collect()]
    ups = sum(a < b for a, b in zip(rows, rows[1:], strict=False))
    assert 0.4 < ups / len(rows) < 0.6
    # the order doesn't depend on how rows arrive
    own = docs.where("text LIKE 'text%'")
    a = sharding.shuffled(own, bucket_bytes=8_000).select("bucket", "at", "row.doc_id")
    b = sharding.shuffled(own.coalesce(2), bucket_bytes=8_000).select("bucket", "at", "row.doc_id")
    assert a.exceptAll(b).count() == 0


def test_files(spark, tmp_path):
    docs, rows = corpus(spark)
    sharding.write_shards(sharding.sharded(docs, 5, bucket_bytes=50_000), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(rows) and sorted(r.shard for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3, 4]


def test_query(spark, tmp_path):
    docs, rows = corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_sharding(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = out.collect()
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    assert sorted((repr(r.doc_id), r.size, repr(r.text_crc32)) for r in got) == sorted((repr(r[0]), len((r[1] or "").encode()) + 8, repr(crc(r[1]))) for r in rows)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    again = queries.op11_sharding(spark, str(tmp_path))
    assert out.exceptAll(again).count() == 0


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(i, "t", "en", "s", 1, "", 0, 0, 0) for i in range(3)], DOCS)
    assert sorted((r.shard, r.slot) for r in sharding.sharded(few, 24).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.sharded(few.limit(0), 24).count() == 0


def test_map_columns(spark):
    rows = spark.createDataFrame([(i, "t", {"a": i}) for i in range(9)], "doc_id long, text string, m map<string,int>")
    assert sharding.sharded(rows, 2).select("doc_id", "m").count() == 9
