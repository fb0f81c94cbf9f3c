import os

from pyspark.sql import functions as F

from jestframe.plans import jobs
from jestframe.session import scratch_path
from jestframe.sources import fixtures as X
from jestframe.sources import io

from conftest import SF_SMALL


def test_corpus_chain_end_to_end(spark):
    """Raw corpora (written as the reference's CSV / JSON shapes) -> every job."""
    root = scratch_path(spark, "corpus")
    votes = X.x_votes(spark, SF_SMALL).drop("id")
    io.write_csv(votes, os.path.join(root, "raw/haha_train"))
    rated = X.x_rated(spark, SF_SMALL)
    rated.write.json(os.path.join(root, "raw/rated"))
    annot = X.x_annot(spark, SF_SMALL)

    votes_in = io.read_csv(spark, os.path.join(root, "raw/haha_train"), io.VOTES)
    labelled = jobs.job_votes(votes_in)
    assert labelled.count() == votes.count()
    rated_in = io.read_json_lines(spark, os.path.join(root, "raw/rated"))
    stupid = jobs.job_rated(rated_in)
    base = jobs.job_base_train(labelled, stupid.limit(0))
    views = jobs.job_annotations(annot)
    suites = jobs.job_length_slices(views["detection"])
    exc = jobs.job_exclusive(base, views["detection"], X.EXCLUSIVE_HUMOR, X.EXCLUSIVE_NON_HUMOR, rows=50)
    rep = jobs.job_repetition(spark, X.REPETITION_TOKENS, X.EXCLUSIVE_HUMOR, rows=40)
    train = jobs.job_train(base, rep["train_repetition"], exc["train_exclusive"])
    multi = jobs.job_train_multilingual(train, stupid)
    paths = jobs.run_family(spark, multi, os.path.join(root, "train_multilingual"))
    cls = spark.read.parquet(paths["classification"])
    det = spark.read.parquet(paths["detection"])
    assert cls.where("score < 0 OR score > 4").count() == 0
    assert set(r.score for r in det.select("score").distinct().collect()) <= {0, 1}
    assert det.count() == spark.read.parquet(paths["base"]).count()
    # every text of the multilingual set is unique
    assert multi.groupBy("text").count().where("count > 1").count() == 0
    assert suites["long_lengths"].count() > 0 and rep["test_repetition"].count() > 0
    jobs.run_job(exc, os.path.join(root, "exclusive"), fmt="csv")
    back = io.read_csv(spark, os.path.join(root, "exclusive/test_exclusive"), io.LABELLED)
    assert back.count() == exc["test_exclusive"].count()
