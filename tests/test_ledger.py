"""Each distinct prompt is sent once over repeats, reruns and killed tasks."""

import os
import subprocess
import sys
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jestframe.operators import infer
from jestframe.operators.ledger import Ledger

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def counting(folder, fail_on=None):
    """A scorer that notes every prompt it gets; it raises once at a prompt."""
    folder = str(folder)

    def score(batches):
        for batch in batches:
            for p in batch:
                if p == fail_on and not os.path.exists(f"{folder}/failed"):
                    open(f"{folder}/failed", "w").close()
                    raise RuntimeError("gone")
                with open(f"{folder}/seen-{os.getpid()}", "a") as f:
                    f.write(p + "\n")
            yield batch.map(lambda p: None if p.endswith("7") else p[-1])
    return score


def seen(folder):
    return Counter(line for name in os.listdir(folder) if name.startswith("seen") for line in open(f"{folder}/{name}").read().splitlines())


@pytest.fixture
def notes(tmp_path):
    (tmp_path / "notes").mkdir()
    return tmp_path / "notes"


def test_each_prompt_once(spark, tmp_path, notes):
    df = spark.range(600, numPartitions=4).select("id", F.when(F.col("id") < 200, F.lit("hot 1")).when(F.col("id") == 599, None).otherwise(F.concat(F.lit("p"), (F.col("id") % 90).cast("string"))).alias("text"))
    ledger = Ledger(spark, f"{tmp_path}/ledger", "stub", frame_rows=8)
    first = infer.label_with(df.where("id < 300"), counting(notes), ["1", "2"], ledger=ledger, parallelism=3).collect()
    assert len(first) == 300
    out = {r.id: r for r in infer.label_with(df, counting(notes), ["1", "2"], ledger=ledger, parallelism=5).collect()}
    assert len(out) == 600 and max(seen(notes).values()) == 1 and len(seen(notes)) == 91
    plain = {r.id: r for r in infer.label_with(df.where("text IS NOT NULL"), counting(tmp_path), ["1", "2"]).collect()}
    assert all((out[i].response, out[i].status, out[i].labels) == (r.response, r.status, r.labels) for i, r in plain.items())
    assert (out[599].response, out[599].status, out[599].labels) == (None, "refused", -1)
    # another scorer has answers of its own
    infer.label_with(df.where("id = 0"), counting(notes), ["1"], ledger=Ledger(spark, f"{tmp_path}/ledger", "other")).collect()
    assert seen(notes)["hot 1"] == 2


def test_failed_requests_are_asked_again(spark, tmp_path, notes):
    df = spark.range(40, numPartitions=1).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("text"))
    ledger = Ledger(spark, f"{tmp_path}/ledger", "stub", frame_rows=5)
    one = infer.label_with(df, counting(notes, fail_on="p20"), ["1"], ledger=ledger).collect()
    assert {r.status for r in one} == {"ok", "refused", "error"} and 1 <= sum(r.status == "error" for r in one) <= 5
    two = infer.label_with(df, counting(notes, fail_on="p20"), ["1"], ledger=ledger).collect()
    assert {r.status for r in two} == {"ok", "refused"} and len(two) == 40
    ok_first = {r.text for r in one if r.status != "error"}
    assert all(seen(notes)[t] == 1 for t in ok_first)


KILLED = """
import os, sys
sys.path[:0] = [{root!r}, {root!r} + "/tests"]
from pyspark.sql import SparkSession, functions as F
from jestframe.operators import infer
from jestframe.operators.ledger import Ledger
folder = {folder!r}

def score(batches):
    for batch in batches:
        for p in batch:
            if p == "p33" and not os.path.exists(folder + "/killed"):
                open(folder + "/killed", "w").close()
                os._exit(9)  # the worker dies in the middle of a task
        for p in batch:
            with open(folder + "/seen-" + str(os.getpid()), "a") as f:
                f.write(p + chr(10))
        yield batch.map(lambda p: p[-1])

spark = (SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", folder + "/shared").getOrCreate())
df = spark.range(60, numPartitions=2).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("text"))
out = infer.label_with(df, score, ["1"], ledger=Ledger(spark, folder + "/ledger", "stub", frame_rows=4), parallelism=1).collect()
print("ROWS", len(out), sorted({{r.status for r in out}}))
"""


def test_a_killed_and_repeated_task(notes):
    """The task dies after part of its answers; its second attempt asks only the rest."""
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(KILLED.format(root=ROOT, folder=str(notes)))], capture_output=True, text=True, timeout=240)
    assert "ROWS 60 ['ok']" in run.stdout, run.stderr[-2000:]
    assert os.path.exists(f"{notes}/killed") and len(seen(notes)) == 60 and set(seen(notes).values()) == {1}


def test_batched_rewrites(spark, tmp_path, notes):
    df = spark.range(200).selectExpr("id", "CONCAT('b', id) AS body", "CAST(1 AS DOUBLE) AS rating")
    folder = str(notes)

    def sender(prompt):
        with open(f"{folder}/seen-{os.getpid()}", "a") as f:
            f.write(prompt + "\n")
        return infer.translate_stub(prompt)

    ledger = Ledger(spark, f"{tmp_path}/ledger", "rewriter", frame_rows=1)
    want = sorted(map(tuple, infer.rewrite_in_batches(df, infer.translate_stub).collect()))
    for _ in range(2):
        assert sorted(map(tuple, infer.rewrite_in_batches(df, sender, ledger=ledger).collect())) == want
    assert set(seen(notes).values()) == {1}


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "id long, text string")
    assert infer.label_with(df, infer.md5_scorer, ["1"], ledger=Ledger(spark, f"{tmp_path}/ledger", "s")).count() == 0
