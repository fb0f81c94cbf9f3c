"""K3: the run equals a restated one in NumPy, whatever the number of evaluations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from jestframe.functions.rand import draw
from jestframe.operators import trainer

N, D, K = 230, 6, 3


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(N + 60):
        y = int(rng.integers(K))
        x = rng.normal(size=D) + 1.5 * np.eye(D)[y]
        rows.append((i, [float(v) if abs(v) > 0.3 else 0.0 for v in x], y, [1.0, 0.5, 2.0][y]))
    df = spark.createDataFrame(rows, "id long, v array<double>, score int, weight double").select("id", *trainer.dense_features(F.col("v")), "score", "weight", "v")
    order = [r.id for r in df.where(F.col("id") < N).select("id", draw(F.col("id"), "batches").alias("u")).orderBy("u", "id").collect()]
    return df, rows, order


def restated(rows, order, steps, batches, eval_steps, lr, momentum, metric="macro_f1"):
    per = -(-len(order) // batches)
    groups = [order[i:i + per] for i in range(0, len(order), per)]
    w, m = np.zeros((D + 1, K)), np.zeros((D + 1, K))
    log, losses, best = [], [], None

    def probabilities(x, w):
        z = x @ w[:-1] + w[-1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    test = rows[N:]
    for t in range(1, steps + 1):
        own = [rows[i] for i in groups[(t - 1) % len(groups)]]
        x, y, c = (np.array([r[k] for r in own]) for k in (1, 2, 3))
        p = probabilities(x, w)
        losses.append(-(c * np.log(p[np.arange(len(y)), y])).sum() / c.sum())
        off = (p - np.eye(K)[y]) * c[:, None] / c.sum()
        m = momentum * m + np.vstack([x.T @ off, off.sum(axis=0)])
        w = w - lr * (1 - (t - 1) / steps) * m
        if t % eval_steps and t < steps:
            continue
        x, y, c = (np.array([r[k] for r in test]) for k in (1, 2, 3))
        p = probabilities(x, w)
        guess = p.argmax(axis=1)
        f1 = [2 * ((y == k) & (guess == k)).sum() / max(1, (y == k).sum() + (guess == k).sum()) for k in range(K)]
        row = {"step": t, "train_loss": np.mean(losses), "loss": -(c * np.log(p[np.arange(len(y)), y])).sum() / c.sum(), "accuracy": (y == guess).mean(),
               "macro_f1": np.mean(f1), "weighted_f1": sum(f * (y == k).mean() for k, f in enumerate(f1))}
        losses = []
        log.append(row)
        if best is None or row[metric] > best[0]:
            best = (row[metric], t, w.copy())
    return log, best


@pytest.mark.parametrize(("steps", "eval_steps", "metric"), [(10, 3, "macro_f1"), (10, 1, "accuracy"), (7, 20, "weighted_f1")])
def test_run_equals_numpy(tables, steps, eval_steps, metric):
    df, rows, order = tables
    out = trainer.run(df.where(F.col("id") < N), df.where(F.col("id") >= N), D, K, steps=steps, batches=4, eval_steps=eval_steps, learning_rate=0.8, momentum=0.5, metric=metric)
    want, best = restated(rows, order, steps, 4, eval_steps, 0.8, 0.5, metric)
    got = [r.asDict() for r in out.log.orderBy("step").collect()]
    assert [r["step"] for r in got] == [r["step"] for r in want]
    for a, b in zip(got, want, strict=True):
        assert all(abs(a[c] - b[c]) < 1e-9 for c in b)
    assert out.best_step == best[1] and [r["step"] for r in got if r["is_best"]] == [best[1]]
    assert np.allclose(out.weights, best[2], atol=1e-9)


def test_training_work_does_not_grow_with_evaluations(tables, monkeypatch):
    df, *_ = tables
    calls = []
    real = trainer.gradient
    monkeypatch.setattr(trainer, "gradient", lambda rows, w: calls.append(1) or real(rows, w))
    logs = [trainer.run(df.where(F.col("id") < N), df.where(F.col("id") >= N), D, K, steps=4, batches=4, eval_steps=e).log.count() for e in (1, 4)]
    assert logs == [4, 1] and len(calls) == 8


def test_a_step_reads_only_its_batch(tables, spark):
    df, *_ = tables
    path, n = trainer.written_batches(df.where(F.col("id") < N), "id", 4)
    plan = spark.read.parquet(path).where("batch = 2")._jdf.queryExecution().executedPlan().toString()
    assert n == 4 and "PartitionFilters: [isnotnull(batch" in plan
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("batch").count().collect()]
    assert sum(sizes) == N and max(sizes) - min(sizes) <= 4


def test_a_stopped_run_goes_on(tables, tmp_path, monkeypatch):
    df, *_ = tables
    args = (df.where(F.col("id") < N), df.where(F.col("id") >= N), D, K)
    options = dict(steps=8, batches=4, eval_steps=2, learning_rate=0.8)
    whole = trainer.run(*args, **options)
    path, real, calls = f"file://{tmp_path}/state", trainer.gradient, []

    def dies(rows, w):
        calls.append(1)
        if len(calls) == 6:
            raise RuntimeError("lost")
        return real(rows, w)

    monkeypatch.setattr(trainer, "gradient", dies)
    with pytest.raises(RuntimeError):
        trainer.run(*args, state_path=path, **options)
    again = trainer.run(*args, state_path=path, **options)
    assert len(calls) == 6 + 4  # steps 5 to 8 only
    assert again.best_step == whole.best_step and np.allclose(again.weights, whole.weights)
    for a, b in zip(again.log.orderBy("step").collect(), whole.log.orderBy("step").collect(), strict=True):
        assert all(a[c] == b[c] or abs(a[c] - b[c]) < 1e-12 for c in a.asDict())


def test_edges(tables, spark):
    df, *_ = tables
    none = trainer.run(df.limit(0), df.where(F.col("id") >= N), D, K)
    row = none.log.first()
    assert (row.step, row.train_loss, none.best_step) == (0, None, 0) and not none.weights.any()
    blind = trainer.run(df.where(F.col("id") < N), df.limit(0), D, K, steps=2, batches=2, eval_steps=1)
    assert blind.log.count() == 2 and blind.best_step == 1 and blind.log.first().macro_f1 is None
    weightless = trainer.run(df.where(F.col("id") < N).withColumn("weight", F.lit(0.0)), df.where(F.col("id") >= N), D, K, steps=2, batches=2)
    assert not weightless.weights.any()


def test_texts(spark):
    words = {0: "señor año niño informe", 1: "jaja más qué risa"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation((words[i % 2] + " común").split())), i % 2) for i in range(200)] + [(900, None, 1)]
    df = spark.createDataFrame(rows, "id long, text string, score int")
    model = trainer.fit_run(df.where("id % 5 <> 0"), df.where("id % 5 = 0"), 2, class_weights=[1.05, 1.0], sample="over", threshold=0.5, num_features=1 << 12, batches=3, eval_steps=2)
    out = model.predict(df).collect()
    assert len(out) == 200 and all(r.labels == r.score for r in out) and all(abs(r.score_0 + r.score_1 - 1) < 1e-9 for r in out)


def test_words_with_accents_stay_whole(spark):
    from jestframe.operators.model import _feature_stages

    df = spark.createDataFrame([("más niño qué? Año_2 l'été ΑΒΓ 日本 ñ",)], "text string")
    assert _feature_stages(16)[0].transform(df).first().tokens == ["más", "niño", "qué", "año_2", "l", "été", "αβγ", "日本", "ñ"]
