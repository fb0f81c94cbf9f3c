"""Appends that may be repeated, cut-off writes, files in key order."""

import json

import pytest
from pyspark.sql import functions as F

from jestframe.sources import commits
from jestframe.sources.commits import CommittedData
from jestframe.sources.io import RATED


def items(spark, *ids):
    return spark.createDataFrame([(i, f"body {i}", 1.0) for i in ids], RATED)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_two_runs_equal_one(spark, tmp_path, fmt):
    data = CommittedData(spark, f"file://{tmp_path}/d", RATED, fmt)
    assert data.read().count() == 0
    for _ in range(2):
        assert data.append("a", items(spark, 1, 2, None, None), key="id") is (_ == 0)
        assert data.append("b", items(spark, 2, 3, 3, None), key="id") is (_ == 0)
    assert sorted((r.id or 0) for r in data.read().collect()) == [0, 0, 0, 1, 2, 3]
    assert len(data.commits()) == 2 and CommittedData(spark, f"file://{tmp_path}/d", RATED, fmt).read().count() == 6


def test_a_write_cut_off_is_not_seen(spark, tmp_path, monkeypatch):
    data = CommittedData(spark, f"file://{tmp_path}/d", RATED)
    data.append("a", items(spark, 1, 2))
    monkeypatch.setattr(CommittedData, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        data.append("b", items(spark, 3))
    monkeypatch.undo()
    assert rows_of(data.read()) == rows_of(items(spark, 1, 2))  # the old rows, although files of b exist
    assert data.append("b", items(spark, 3)) and rows_of(data.read()) == rows_of(items(spark, 1, 2, 3))


def test_two_writers(spark, tmp_path, monkeypatch):
    data, other = (CommittedData(spark, f"file://{tmp_path}/d", RATED) for _ in range(2))
    real = CommittedData._commit

    def late(self, commit, number):
        monkeypatch.setattr(CommittedData, "_commit", real)
        other.append("other", items(spark, 9))
        return real(self, commit, number)

    monkeypatch.setattr(CommittedData, "_commit", late)
    with pytest.raises(RuntimeError):
        data.append("mine", items(spark, 1))
    assert data.append("mine", items(spark, 1)) and rows_of(data.read()) == rows_of(items(spark, 1, 9))


def test_present_keys_with_and_without_a_filter(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "BLOOM_BITS", 256)  # nearly every key may be present: the join decides
    data = CommittedData(spark, f"file://{tmp_path}/d", RATED)
    data.append("a", items(spark, *range(0, 400, 2)), key="id")
    data.append("b", items(spark, *range(400)), key="id")
    assert sorted(r.id for r in data.read().collect()) == list(range(400))
    monkeypatch.undo()
    data = CommittedData(spark, f"file://{tmp_path}/e", RATED)
    data.append("a", items(spark, 1, 2))  # no keys noted
    data.append("b", items(spark, 2, 3), key="id")
    data.append("c", items(spark, 3, 4), key="id")
    assert sorted(r.id for r in data.read().collect()) == [1, 2, 3, 4]


def test_the_filter_clears_new_keys(spark):
    bits = commits.bitmap(items(spark, *range(2000)), "id", commits.BLOOM_BITS)
    marked = commits.marked(items(spark, *range(1000, 12000), None), "id", bits)
    got = {r._may: r["count"] for r in marked.where("id >= 2000").groupBy("_may").count().collect()}
    assert got.get(True, 0) < 10 and marked.where("id < 2000 AND NOT _may").count() == 0 and marked.where("id IS NULL AND _may").count() == 0


def test_files_in_key_order(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = items(spark, None, *range(1000))
        data = CommittedData(spark, f"file://{tmp_path}/d", RATED, "parquet")
        data.append("a", rows, order_by="id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = data.commits()[0]["files"]
    assert len(files) > 3 and sum(f["rows"] for f in files) == 1001
    plan = data.in_order()._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
    assert [r.id for r in data.in_order().collect()] == [None, *range(1000)]
    assert [r.id for r in data.in_order(200, 300).collect()] == list(range(200, 301))
    assert sorted(r.id for r in data.scan(low=900).collect()) == list(range(900, 1000))
    assert len(data.scan(200, 300).inputFiles()) < len(files) and data.scan(5000).count() == 0
    data.append("b", items(spark, *range(500, 510)), order_by="id")
    with pytest.raises(ValueError):
        data.in_order()
    assert data.scan(500, 509).count() == 20


def test_strings_and_empty(spark, tmp_path):
    data = CommittedData(spark, f"file://{tmp_path}/d", RATED)
    data.append("none", items(spark, 1).limit(0), order_by="body")
    data.append("some", items(spark, 3, 1, 2), order_by="body")
    assert [r.body for r in data.in_order().collect()] == ["body 1", "body 2", "body 3"] and json.dumps(data.commits())
    assert data.scan("body 2", "body 2").count() == 1
