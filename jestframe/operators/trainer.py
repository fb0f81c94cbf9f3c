"""K3: one training run, judged every N steps, first best kept.

A softmax regression is trained by mini-batch steps.  The features are written
once, in folders by batch, so a step reads its own batch only.  In a step every
task adds up the gradient of its rows (numpy over Arrow batches); the partial
gradients are summed by feature in one small shuffle, and the sum, at most one
row for each feature, updates the run's state: weights and momentum, of
``num_features`` x classes numbers each, a size set by parameters and not by the
data.  Every ``eval_steps`` steps the current weights are judged on the validation
rows, and a row of metrics joins the log; the first best weights stay.  However
many evaluations there are, the rows are trained on once per epoch.

With ``state_path`` the state is written at each evaluation, and a run that is
started again with the same path goes on from the last one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import wide
from ..session import scratch_path
from .model import _feature_stages, training_rows, with_class_weights
from .sampling import BucketCounts, with_draw

LOG = "step int, train_loss double, loss double, accuracy double, macro_f1 double, weighted_f1 double"
STATE = "step int, weights binary, momentum binary, best_step int, best binary, log array<struct<step:int,train_loss:double,loss:double,accuracy:double,macro_f1:double,weighted_f1:double>>"
EXAMPLE = ["at", "x", "score", "weight"]


@dataclass
class Run:
    """The weights kept (features + intercept x classes), the step they are from,
    and the log (step, train_loss, loss, accuracy, macro_f1, weighted_f1, is_best)."""

    weights: np.ndarray
    best_step: int
    log: DataFrame


def dense_features(values: Column) -> list[Column]:
    """Columns ``at`` and ``x`` of a feature array."""
    return [F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: i.cast("int")).alias("at"), values.cast("array<double>").alias("x")]


def sparse_features(df: DataFrame, vector: str = "features") -> DataFrame:
    """``df`` with the non-zero entries of an ML vector column as ``at`` and ``x``."""
    rest = [c for c in df.columns if c != vector]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a vector arrives as struct<type, size, indices, values>; dense ones have no indices
            v = batch.column(vector)
            if isinstance(v, pa.ExtensionArray):
                v = v.storage
            at, x = v.field("indices"), v.field("values")
            if at.null_count:
                at = pa.array([range(len(xs)) if a is None else a for a, xs in zip(at.to_pylist(), x.to_pylist(), strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), at, x], names=[*rest, "at", "x"])

    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(parts, schema)


def written_batches(rows: DataFrame, key: str, batches: int, tag: str = "batches") -> tuple[str, int]:
    """Rows in a keyed random order cut into ``batches`` of (but for the last) equal
    size, written in a folder each: path and number of batches."""
    counts = BucketCounts(with_draw(rows.select(key, *EXAMPLE), key, tag), "_u", [], materialise=True)
    per = max(1, -(-counts.total // batches))
    ranked = counts.ranked(key, rank_col="rank").select(*EXAMPLE, F.expr(f"CAST((rank - 1) div {per} AS INT)").alias("batch"))
    path = scratch_path(rows.sparkSession, "batches")
    ranked.write.partitionBy("batch").parquet(path)
    return path, -(-counts.total // per)


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and row numbers of all entries of a batch."""
    at, x = batch.column("at"), batch.column("x")
    rows = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
    return at.flatten().to_numpy().astype(np.int64), x.flatten().to_numpy(zero_copy_only=False), rows


def _margins(batch: pa.RecordBatch, w: np.ndarray) -> np.ndarray:
    at, x, rows = _matrix(batch)
    z = np.tile(w[-1], (batch.num_rows, 1))  # the intercept
    for c in range(w.shape[1]):
        z[:, c] += np.bincount(rows, x * w[at, c], batch.num_rows)
    return z


def _log_softmax(z: np.ndarray) -> np.ndarray:
    top = z - z.max(axis=1, keepdims=True)
    return top - np.log(np.exp(top).sum(axis=1, keepdims=True))


def gradient(rows: DataFrame, w: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Sum of the weighted gradients, losses and weights of ``rows`` at ``w``."""
    n, k = w.shape
    shared = rows.sparkSession.sparkContext.broadcast(w)  # its size is set by parameters

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, total, sums = shared.value, None, np.zeros(2)
        for batch in batches:
            if not batch.num_rows:
                continue
            total = np.zeros((n, k)) if total is None else total
            at, x, own = _matrix(batch)
            y, weight = batch.column("score").to_numpy().astype(np.int64), batch.column("weight").to_numpy()
            logp = _log_softmax(_margins(batch, weights))
            off = np.exp(logp)
            off[np.arange(len(y)), y] -= 1.0
            off *= weight[:, None]
            for c in range(k):
                total[:, c] += np.bincount(at, x * off[own, c], n)
            total[-1] += off.sum(axis=0)
            sums += (-(weight * logp[np.arange(len(y)), y]).sum(), weight.sum())
        if total is not None:
            hit = np.flatnonzero(total.any(axis=1))
            values = np.vstack([total[hit], np.concatenate([sums, np.zeros(k - 2)])])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), *(pa.array(np.ascontiguousarray(values[:, c])) for c in range(k))], names=["at", *(f"g{c}" for c in range(k))])

    parts = rows.mapInArrow(partial, "at long, " + ", ".join(f"g{c} double" for c in range(k)))
    found = parts.groupBy("at").agg(*[F.sum(f"g{c}").alias(f"g{c}") for c in range(k)]).toArrow()  # one row for each feature at most
    at, values = found.column("at").to_numpy(), np.column_stack([found.column(f"g{c}").to_numpy() for c in range(k)])
    out = np.zeros((n, k))
    out[at[at >= 0]] = values[at >= 0]
    loss, weight = values[at == -1][0, :2] if (at == -1).any() else (0.0, 0.0)
    shared.unpersist()
    return out, float(loss), float(weight)


def predicted(p: np.ndarray, threshold: float | None) -> np.ndarray:
    """The first most likely class or, of two classes, the second if above ``threshold``."""
    return (p[:, 1] > threshold).astype(np.int32) if threshold is not None and p.shape[1] == 2 else p.argmax(axis=1).astype(np.int32)


def scored(rows: DataFrame, w: np.ndarray, threshold: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns with probabilities ``p`` and integer ``labels``."""
    shared = rows.sparkSession.sparkContext.broadcast(w)
    keep = rows.columns if keep is None else keep
    fields = [rows.schema[c] for c in keep]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.exp(_log_softmax(_margins(batch, shared.value)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists, pa.array(predicted(p, threshold))], names=[*keep, "p", "labels"])

    schema = T.StructType([*fields, T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("labels", T.IntegerType())])
    return rows.mapInArrow(score, schema)


def judged(valid: DataFrame, w: np.ndarray, threshold: float | None = None) -> dict[str, float]:
    """loss, accuracy, macro_f1, weighted_f1 of ``w`` on the validation rows, in one
    pass that leaves confusion counts and two sums (classes squared rows a task)."""
    k, shared = w.shape[1], valid.sparkSession.sparkContext.broadcast(w)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((k * k, 3))
        for batch in batches:
            logp = _log_softmax(_margins(batch, shared.value))
            y, weight = batch.column("score").to_numpy().astype(np.int64), batch.column("weight").to_numpy()
            cell = y * k + predicted(np.exp(logp), threshold)
            for c, v in enumerate((np.ones(len(y)), -logp[np.arange(len(y)), y] * weight, weight)):
                cells[:, c] += np.bincount(cell, v, k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), *(pa.array(np.ascontiguousarray(cells[:, c])) for c in range(3))], names=["cell", "n", "nll", "weight"])

    found = valid.mapInArrow(count, "cell long, n double, nll double, weight double").groupBy("cell").agg(F.sum("n"), F.sum("nll"), F.sum("weight")).collect()
    n, nll, weight = np.zeros((k, k)), 0.0, 0.0
    for cell, rows, loss, own in found:
        n[cell // k, cell % k] = rows
        nll, weight = nll + loss, weight + own
    shared.unpersist()
    total, support, given = n.sum(), n.sum(axis=1), n.sum(axis=0)
    seen = (support + given) > 0  # classes that are a label or a prediction
    f1 = 2 * n.diagonal()[seen] / (support + given)[seen]
    return {"loss": float(nll / weight) if weight else None, "accuracy": float(n.trace() / total) if total else None,
            "macro_f1": float(f1.mean()) if total else None, "weighted_f1": float((f1 * support[seen]).sum() / total) if total else None}


def _saved(spark: SparkSession, path: str | None, shape: tuple[int, int]) -> dict | None:
    """The state of the last evaluation that was written below ``path``."""
    if path is None:
        return None
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(jpath):
        return None
    done = [f.getPath() for f in files.listStatus(jpath) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    if not done:
        return None
    row = spark.read.schema(STATE).parquet(max(done, key=lambda f: int(f.getName().rpartition("=")[2])).toString()).first()
    back = {c: np.frombuffer(row[c]).reshape(shape).copy() for c in ("weights", "momentum", "best")}
    return row.asDict() | back | {"log": [r.asDict() for r in row.log]}


def run(train: DataFrame, valid: DataFrame, num_features: int, num_classes: int, *, key: str = "id", steps: int | None = None, epochs: int = 2,
        batches: int = 8, eval_steps: int = 4, learning_rate: float = 0.5, momentum: float = 0.9, metric: str = "macro_f1",
        threshold: float | None = None, state_path: str | None = None) -> Run:
    """Train on ``train`` (key, at, x, score, weight) in mini-batches, ``steps`` of
    them (default: ``epochs`` times the batches), and keep the first best of the
    evaluations on ``valid`` by ``metric`` (macro_f1, weighted_f1 or accuracy).

    The rate falls in proportion to the steps left.  A step's gradient is the
    weighted mean over its batch, a batch without weight changes nothing, and
    ``train_loss`` is the mean loss of the steps since the last evaluation.  The
    last step is always judged.  Without training rows nothing is trained, and
    the log has the evaluation of step 0."""
    spark = train.sparkSession
    path, n_batches = written_batches(train, key, batches)
    rows = spark.read.parquet(path) if n_batches else None
    judge = valid.select(*EXAMPLE).checkpoint()
    steps = (epochs * n_batches if steps is None else steps) if n_batches else 0
    shape = (num_features + 1, num_classes)
    state = _saved(spark, state_path, shape) or {"step": 0, "weights": np.zeros(shape), "momentum": np.zeros(shape), "best_step": 0, "best": np.zeros(shape), "log": []}
    losses = []
    for step in range(state["step"] + 1, steps + 1) if steps else [0]:
        if steps:
            batch = rows.where(F.col("batch") == (step - 1) % n_batches).select(*EXAMPLE)
            g, loss, weight = gradient(batch, state["weights"])
            if weight:
                state["momentum"] = momentum * state["momentum"] + g / weight
                state["weights"] = state["weights"] - learning_rate * (1 - (step - 1) / steps) * state["momentum"]
                losses.append(loss / weight)
        if step % eval_steps and step < steps:
            continue
        seen = {"step": step, "train_loss": float(np.mean(losses)) if losses else None} | judged(judge, state["weights"], threshold)
        losses = []
        former = max((r[metric] for r in state["log"] if r[metric] is not None), default=None)
        if not state["log"] or (seen[metric] is not None and (former is None or seen[metric] > former)):
            state["best"], state["best_step"] = state["weights"], step
        state |= {"step": step, "log": [*state["log"], seen]}
        if state_path is not None:
            values = [state[f.name].tobytes() if f.name in ("weights", "momentum", "best") else state[f.name] for f in spark.createDataFrame([], STATE).schema]
            spark.createDataFrame([tuple(values)], STATE).write.mode("overwrite").parquet(f"{state_path}/step={step}")
    log = spark.createDataFrame([tuple(r[c] for c in ("step", "train_loss", "loss", "accuracy", "macro_f1", "weighted_f1")) for r in state["log"]], LOG)
    return Run(state["best"], state["best_step"], log.withColumn("is_best", F.col("step") == state["best_step"]))


def text_features(stages: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of the rows with a text, with ``at`` and ``x``."""
    return sparse_features(stages.transform(df.where(F.col("text").isNotNull())).select(*keep, "features"))


@dataclass
class TextModel:
    """Fitted feature stages and the kept weights of a run."""

    stages: PipelineModel
    run: Run
    threshold: float | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """The columns of ``df`` with probabilities score_i and ``labels``, of its rows with a text."""
        out = scored(text_features(self.stages, df, df.columns), self.run.weights, self.threshold, df.columns)
        return out.select(*df.columns, *wide(F.col("p"), self.run.weights.shape[1]), "labels")


def fit_run(train: DataFrame, valid: DataFrame, num_classes: int = 2, class_weights: list[float] | None = None, sample: str | None = None,
            threshold: float | None = None, key: str = "id", num_features: int = 1 << 18, **options) -> TextModel:
    """K1 + K2 + K3 for texts (id, text, score): rows balanced if asked, hashed term
    frequencies and IDF fitted once on the training rows, one run (``run``,
    which takes ``options``) on the written features."""
    rows = training_rows(train, class_weights, sample, key).checkpoint()
    stages = Pipeline(stages=_feature_stages(num_features)).fit(rows)
    if "draw" in rows.columns:  # over-sampled rows repeat ids
        rows = rows.withColumn(key, F.concat_ws(":", F.col(key).cast("string"), F.col("draw").cast("string")))
    judge = with_class_weights(valid, class_weights)
    out = run(text_features(stages, rows, [key, "score", "weight"]), text_features(stages, judge, [key, "score", "weight"]), num_features, num_classes,
              key=key, threshold=threshold, **options)
    return TextModel(stages, out, threshold)
