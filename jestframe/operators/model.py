"""Fit and apply a text classifier with ``pyspark.ml``.

The reference fine-tunes transformers on one GPU; that is not a Spark job.
What carries over is the workflow: a labelled table, optional class weights
and resampling, a held-out split or a fixed test set, a probability table
and a report.  The model is a distributed ``Pipeline`` of tokenizer,
hashed term frequencies, IDF and logistic regression.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import wide
from .dedup import union_all
from .metrics import best_rows, classification_report
from .sampling import over_sample, under_sample


def _regression(num_classes: int, threshold: float | None, weighted: bool, max_iter: int) -> LogisticRegression:
    lr = LogisticRegression(featuresCol="features", labelCol="score", maxIter=max_iter,
                            family="binomial" if num_classes == 2 else "multinomial")
    if weighted:
        lr.setWeightCol("weight")
    if threshold is not None and num_classes == 2:
        lr.setThreshold(threshold)
    return lr


def _feature_stages(num_features: int) -> list:
    return [
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[^\p{L}\p{M}\p{N}_]+", minTokenLength=1),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="features", minDocFreq=1),
    ]


def text_classifier(num_classes: int = 2, num_features: int = 1 << 18, threshold: float | None = None,
                    weighted: bool = False, max_iter: int = 20) -> Pipeline:
    return Pipeline(stages=_feature_stages(num_features) + [_regression(num_classes, threshold, weighted, max_iter)])


def with_class_weights(df: DataFrame, weights: list[float] | None, label: str = "score") -> DataFrame:
    """Weight column from a per-class list; missing classes weigh 0.0 (as in
    the reference)."""
    if not weights:
        return df.withColumn("weight", F.lit(1.0))
    arr = F.array(*[F.lit(float(w)) for w in weights])
    return df.withColumn("weight", F.coalesce(F.try_element_at(arr, (F.col(label) + 1).cast("int")), F.lit(0.0)))


def training_rows(df: DataFrame, class_weights: list[float] | None = None, sample: str | None = None,
                  key: str = "id", label: str = "score") -> DataFrame:
    """The rows that a fit sees, with their ``weight``: rows without a text
    dropped, then classes balanced (``sample``: ``under``, ``over`` or none)."""
    rows = df.where(F.col("text").isNotNull())
    if sample:
        keys = rows.select(key, label)
        drawn = under_sample(keys, key, label) if sample == "under" else over_sample(keys, key, label)
        rows = drawn.drop(label).join(rows, key)  # the texts join last
    return with_class_weights(rows, class_weights, label)


def fit(df: DataFrame, num_classes: int = 2, class_weights: list[float] | None = None,
        threshold: float | None = None, sample: str | None = None, key: str = "id") -> PipelineModel:
    """K1: rows balanced if asked (``training_rows``), then feature stages fitted once and their output written once (shared
    checkpoint folder), then the regression fitted on it -- the same model
    as ``text_classifier(...).fit``, without tokenising the texts twice."""
    data = training_rows(df, class_weights, sample, key).withColumn("score", F.col("score").cast("double"))
    if sample:
        data = data.checkpoint()
    features = Pipeline(stages=_feature_stages(1 << 18)).fit(data)
    train_x = features.transform(data).select("features", "score", "weight").checkpoint()
    lr = _regression(num_classes, threshold, class_weights is not None, 20).fit(train_x)
    return PipelineModel(stages=list(features.stages) + [lr])


def predict(model: PipelineModel, df: DataFrame, num_classes: int = 2) -> DataFrame:
    """Probability columns score_i and integer ``labels``."""
    out = model.transform(df.where(F.col("text").isNotNull()))
    probs = vector_to_array(F.col("probability"))
    keep = [c for c in df.columns]
    return out.select(*keep, *wide(probs, num_classes), F.col("prediction").cast("int").alias("labels"))


# Report metrics kept in the candidate log (S9 column names).
_LOG_METRICS = {"accuracy": "accuracy", "macro_avg_f1-score": "macro_f1", "weighted_avg_f1-score": "weighted_f1"}


def fit_best(train: DataFrame, valid: DataFrame, num_classes: int = 2, class_weights: list[float] | None = None,
             steps: tuple[int, ...] = (5, 10, 20), metric: str = "macro_f1", threshold: float | None = None,
             num_features: int = 1 << 18) -> tuple[PipelineModel, DataFrame]:
    """K2 + K3: keep the best of several training lengths, judged on ``valid``.

    The reference evaluates every N steps and keeps the first best
    checkpoint by macro F1, weighted F1 or accuracy.  Here a candidate is
    the regression after ``s`` iterations.  The feature stages are fitted
    once, and their output is written once to the shared checkpoint folder;
    every candidate is fitted on it and scored on ``valid``.  Returns the
    best model (features + regression) and the log ``(step, accuracy,
    macro_f1, weighted_f1, is_best)``; the first best step wins (A9)."""
    weighted = class_weights is not None
    prepared = with_class_weights(train.where(F.col("text").isNotNull()), class_weights).withColumn(
        "score", F.col("score").cast("double"))
    features = Pipeline(stages=_feature_stages(num_features)).fit(prepared)
    train_x = features.transform(prepared).select("features", "score", "weight").checkpoint()
    valid_x = features.transform(valid.where(F.col("text").isNotNull())).select("features", "score").checkpoint()
    models, reports = {}, []
    for s in steps:  # a short list of parameter values; each fit is a distributed job
        lr = _regression(num_classes, threshold, weighted, s).fit(train_x)
        models[s] = lr
        scored = lr.transform(valid_x).select(F.col("score").cast("int").alias("score"),
                                              F.col("prediction").cast("int").alias("labels"))
        reports.append(classification_report(scored, "score", "labels").withColumn("step", F.lit(s)))
    long = union_all(*reports).where(F.col("metric").isin(list(_LOG_METRICS)))
    log = long.groupBy("step").pivot("metric", list(_LOG_METRICS)).agg(F.first("value"))
    log = log.select("step", *[F.col(f"`{k}`").alias(v) for k, v in _LOG_METRICS.items()])
    best = best_rows(log, [], "step", metric)
    best_step = best.select("step").first()[0]  # one value: which candidate to return
    model = PipelineModel(stages=list(features.stages) + [models[best_step]])
    return model, log.withColumn("is_best", F.col("step") == F.lit(best_step))
