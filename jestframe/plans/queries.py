"""The registered queries: one function per key, each
``(spark, sf_dir) -> DataFrame`` over the driver's tables.

P1-P3 (projection, constant columns, comparison filters) are plain
``select`` / ``lit`` / ``where`` throughout, so Catalyst prunes and pushes
them into the scans.

Output conventions shared with the DuckDB oracle (``plans.oracle``):
integers BIGINT, fractions DOUBLE rounded to 6 digits, arrays rendered as
blank-joined text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.text import apply_template
from ..operators import dedup, generate, infer, labels, metrics, profile, sampling
from ..session import ensure_checkpoint_dir, scratch_path
from ..sources import fixtures as X
from ..sources import io
from ..sources.registry import MODEL_REGISTRY, registry_frame

# Prompt templates of the reference's bloom experiment
# (classification rating question, detection yes/no question).
CLASSIFICATION_TEMPLATE = """{input}
How funny is this text?
1) Slightly
2) Mildly
3) Moderately
4) Very
5) Incredibly
The text is """
DETECTION_TEMPLATE = """{input}
Detect if the text is funny 1 or not 0.
Is the text funny? The text is """

# Templates of the chat experiments; the strict form adds STRICT.
STRICT = " Do not answer anything else."
CHAT_CLASSIFICATION_TEMPLATE = """{input}
========================================
- Question:
How funny is this text?{strict}
1) Slightly
2) Mildly
3) Moderately
4) Very
5) Incredibly
The answer is """
FEW_SHOT_DETECTION_TEMPLATE = """Detect if the following text is funny 1 or not 0 following the provided examples.{strict}

Text: Un piano me caería excelente en estos momentos.
Score: 1

Text: Ni Jesús te ama.
Score: 0

Text: Jajajajajajajaj Idiota.
Score: 0

Text: —¿Qué es eso que traes en tu bolsa?
—Un AK-47.
—No, al lado del AK-47.
—Unos Chettos bolita.
—¡No puedes entrar al Cine con comida!
Score: 1

Text: {input}
Score: """
# Fixed value: the prompt around a batch of jokes to translate.
TRANSLATION_TEMPLATE = """Traduce estos chistes al español, para cada objeto del array traduce el texto en la llave body, las demás llaves déjalas intactas.
Procura usar un lenguaje que resulte familiar en el contexto latinoamericano.

```json
{jokes_batch}
```
"""
PROMPTS = {
    "classification_prompt": CLASSIFICATION_TEMPLATE,
    "detection_prompt": DETECTION_TEMPLATE,
    "chat_classification_prompt": CHAT_CLASSIFICATION_TEMPLATE.replace("{strict}", ""),
    "chat_detection_prompt": FEW_SHOT_DETECTION_TEMPLATE.replace("{strict}", ""),
    "strict_classification_prompt": CHAT_CLASSIFICATION_TEMPLATE.replace("{strict}", STRICT),
    "strict_detection_prompt": FEW_SHOT_DETECTION_TEMPLATE.replace("{strict}", STRICT),
}

DETECTION_THRESHOLD = 0.65
DETECTION_WEIGHTS = [1.05, 1.0]
CLASSIFICATION_WEIGHTS = [1.0, 1.3, 1.2, 1.75, 4.0]


def _r(c) -> F.Column:
    return F.round(c, 6)


def _big(c) -> F.Column:
    return c.cast("bigint")


def _ints_text(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


# ---- labels ---------------------------------------------------------------------

def t01_vote_resolution(spark: SparkSession, d: str) -> DataFrame:
    out = labels.resolve_votes(X.x_votes(spark, d))
    return out.select("id", "text", _big(F.col("score")).alias("score"))


def _annotations(spark, d):
    return labels.annotation_summary(X.x_annot(spark, d), order_col="ord")


def t02_annotation_detection(spark: SparkSession, d: str) -> DataFrame:
    out = labels.detection_from_summary(_annotations(spark, d))
    return out.select("id", "text", _big(F.col("score")).alias("score"))


def t03_annotation_classification(spark: SparkSession, d: str) -> DataFrame:
    out = labels.classification_from_summary(_annotations(spark, d))
    return out.select("id", "text", _big(F.col("score")).alias("score"))


def t04_rated_items(spark: SparkSession, d: str) -> DataFrame:
    out = labels.rated_items(X.x_rated(spark, d))
    return out.select("id", "text", _big(F.col("score")).alias("score"))


# ---- de-duplication -----------------------------------------------------------------

def t05_drop_all_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.drop_all_duplicates(io.table(spark, d, "documents"), "text")


def t06_keep_first(spark: SparkSession, d: str) -> DataFrame:
    docs = io.table(spark, d, "documents").select("doc_id", "text")
    return dedup.keep_first(docs, "text", order="doc_id")


def _corpora(spark, d):
    return (
        io.table(spark, d, "documents").select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("id"), "text"),
        io.table(spark, d, "conversations").select(
            F.lit("conversations").alias("corpus"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
        ),
        io.table(spark, d, "benchmark").select(F.lit("benchmark").alias("corpus"), F.col("item_id").alias("id"), "text"),
    )


def t07_union_unique(spark: SparkSession, d: str) -> DataFrame:
    return dedup.union_unique(*_corpora(spark, d))


def _slice(spark, d, q, side):
    docs = io.table(spark, d, "documents").select("doc_id", "text")
    out = sampling.length_slice(docs, "text", q, side)
    return out.select("doc_id", "text", _big(F.length("text")).alias("n_len"))


def t08_long_slice(spark: SparkSession, d: str) -> DataFrame:
    return _slice(spark, d, 0.9, "long")


def t09_short_slice(spark: SparkSession, d: str) -> DataFrame:
    return _slice(spark, d, 0.1, "short")


def t10_transform_detection(spark: SparkSession, d: str) -> DataFrame:
    out = labels.to_detection(X.x_scored(spark, d))
    return out.select("id", "text", _big(F.col("score")).alias("score"))


def t11_transform_classification(spark: SparkSession, d: str) -> DataFrame:
    out = labels.to_classification(X.x_scored(spark, d))
    return out.select("id", "text", _big(F.col("score")).alias("score"))


# ---- generators, sampling -------------------------------------------------------

def t13_sample_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = io.table(spark, d, "documents").select("doc_id")
    out = sampling.sample_rows(docs, "doc_id", tag="sample")
    return out.select(_big(F.col("draw")).alias("draw"), "doc_id")


def t14_random_join(spark: SparkSession, d: str) -> DataFrame:
    docs = io.table(spark, d, "documents")
    return generate.token_shuffle_join(docs, X.EXCLUSIVE_HUMOR, key="doc_id", tag="join")


def _scored_once(spark, d):
    """The documents-labels join written once, for queries that read it several times."""
    return X.x_scored(spark, d).checkpoint()


def _contradictions(scored):
    return generate.contradiction_rows(scored, X.EXCLUSIVE_HUMOR, X.EXCLUSIVE_NON_HUMOR, tag="exclusive",
                                       unique_key=True)


def t15_contradiction_rows(spark: SparkSession, d: str) -> DataFrame:
    out = _contradictions(_scored_once(spark, d))
    return out.select(_big(F.col("draw")).alias("draw"), "id", "text", _big(F.col("score")).alias("score"))


def _repetitions(spark, d):
    docs = io.table(spark, d, "documents").select("doc_id")
    return generate.repetition_rows(docs, X.REPETITION_TOKENS, X.EXCLUSIVE_HUMOR, key="doc_id", tag="repetition")


def t16_repetition_rows(spark: SparkSession, d: str) -> DataFrame:
    out = _repetitions(spark, d)
    return out.select(_big(F.col("gen")).alias("gen"), "text", _big(F.col("score")).alias("score"), "part")


def t17_exact_split(spark: SparkSession, d: str) -> DataFrame:
    out = sampling.exact_split(X.x_scored(spark, d).select("id", "score"), "id", 0.2, tag="split")
    return out.select("id", _big(F.col("score")).alias("score"), "part")


def t18_under_sample(spark: SparkSession, d: str) -> DataFrame:
    out = sampling.under_sample(X.x_scored(spark, d).select("id", "score"), "id", "score", tag="under")
    return out.select("id", _big(F.col("score")).alias("score"))


def t19_over_sample(spark: SparkSession, d: str) -> DataFrame:
    out = sampling.over_sample(X.x_scored(spark, d).select("id", "score"), "id", "score", tag="over")
    return out.select(_big(F.col("score")).alias("score"), _big(F.col("draw")).alias("draw"), "id")


def _family_sources(spark, d):
    """base, repetition (train half), contradiction and rated rows (text, score)."""
    scored = _scored_once(spark, d)
    rep = _repetitions(spark, d).where(F.col("part") == "train")
    return [x.select("text", "score") for x in (scored, rep, _contradictions(scored), labels.rated_items(X.x_rated(spark, d)))]


def t12_train_family(spark: SparkSession, d: str) -> DataFrame:
    """C9 + C10 (+ S5 views): train = base U repetition (train half) U
    contradiction rows, unique; multilingual = train U rated items, unique;
    rows per score of each family's base, classification and detection view.
    Both families come from one shuffle (``jobs.train_families``)."""
    from . import jobs

    counts = jobs.view_counts(jobs.train_families(*_family_sources(spark, d)))
    return counts.select("family", "view", _big(F.col("score")).alias("score"), "n")


# ---- logits, reports ------------------------------------------------------------

def t20_softmax_argmax(spark: SparkSession, d: str) -> DataFrame:
    out = infer.score_logits(X.x_logits(spark, d, 5), "logits", 5)
    return out.select(_big(F.col("id")).alias("id"), _big(F.col("label")).alias("label"),
                      *[_r(F.col(f"score_{i}")).alias(f"score_{i}") for i in range(5)],
                      _big(F.col("labels")).alias("labels"))


def t21_threshold_label(spark: SparkSession, d: str) -> DataFrame:
    out = infer.score_logits(X.x_logits(spark, d, 2), "logits", 2, threshold=DETECTION_THRESHOLD)
    return out.select(_big(F.col("id")).alias("id"), _big(F.col("label")).alias("label"),
                      *[_r(F.col(f"score_{i}")).alias(f"score_{i}") for i in range(2)],
                      _big(F.col("labels")).alias("labels"))


def _x_pred(spark, d):
    lg = X.x_logits(spark, d, 2)
    return lg.select(
        "id", "label", (F.col("id") % 5).alias("suite"),
        F.when(F.col("id") % 17 == 0, F.lit(-1)).otherwise(A.argmax_first(F.col("logits"))).alias("pred"),
    )


def t22_classification_report(spark: SparkSession, d: str) -> DataFrame:
    rep = metrics.classification_report(_x_pred(spark, d), "label", "pred")
    return rep.select("metric", _r(F.col("value")).alias("value"))


def t23_suite_report(spark: SparkSession, d: str) -> DataFrame:
    rep = metrics.classification_report(_x_pred(spark, d), "label", "pred", by=["suite"])
    return rep.select(_big(F.col("suite")).alias("suite"), "metric", _r(F.col("value")).alias("value"))


def t24_weighted_cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    det = metrics.weighted_cross_entropy(X.x_logits(spark, d, 2), weights=DETECTION_WEIGHTS, k=2)
    cls = metrics.weighted_cross_entropy(X.x_logits(spark, d, 5), weights=CLASSIFICATION_WEIGHTS, k=5)
    return det.select(F.lit("detection").alias("task"), _big(F.col("n")).alias("n"), _r(F.col("loss")).alias("loss")).unionByName(
        cls.select(F.lit("classification").alias("task"), _big(F.col("n")).alias("n"), _r(F.col("loss")).alias("loss"))
    )


def t25_best_step(spark: SparkSession, d: str) -> DataFrame:
    best = metrics.best_rows(X.x_log(spark, d), ["model"], "step", "macro_f1")
    return best.select("model", F.col("step").alias("best_step"), F.col("macro_f1").alias("best_macro_f1"))


def t26_running_best(spark: SparkSession, d: str) -> DataFrame:
    return metrics.running_best(X.x_log(spark, d), ["model"], "step", "macro_f1").select(
        "model", "step", "macro_f1", "is_best"
    )


def t27_curve_series(spark: SparkSession, d: str) -> DataFrame:
    logs = X.x_log(spark, d, with_loss=True).withColumn("macro_f1", F.col("macro_f1").cast("double"))
    out = metrics.curve_series(logs, ["model"], "step", ["macro_f1", "loss"], "macro_f1")
    return out.select("model", "step", "series", _r(F.col("value")).alias("value"), "is_best_step")


# ---- prompts, scorers, cascade --------------------------------------------------

def t28_prompts(spark: SparkSession, d: str) -> DataFrame:
    docs = io.table(spark, d, "documents")
    return docs.select("doc_id", *[apply_template(t, F.col("text")).alias(name) for name, t in PROMPTS.items()])


def t29_llm_labels(spark: SparkSession, d: str) -> DataFrame:
    out = infer.label_with(X.x_resp(spark, d), infer.md5_scorer, ["0", "1"])
    return out.select("id", "response", "status", _big(F.col("labels")).alias("labels"))


def t30_batched_rewrite(spark: SparkSession, d: str) -> DataFrame:
    out = infer.rewrite_in_batches(X.x_rated(spark, d), infer.translate_stub, 32, "id", template=TRANSLATION_TEMPLATE)
    return out.select("id", "body", "rating", "status")


def t43_faulty_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """I3 with a rewriter that raises, cuts its answers short and leaves items out."""
    out = infer.rewrite_in_batches(X.x_rated(spark, d), infer.faulty_stub, 32, "id")
    return out.select("id", "body", "rating", "status")


def t44_cascade_scorers(spark: SparkSession, d: str) -> DataFrame:
    """I4 with scorers: only rows that the detector finds reach the rater."""
    rows = X.x_resp(spark, d)
    detector = infer.keyword_scorer(["th"])
    out = infer.cascade_with(rows, detector, infer.md5_scorer)
    return out.select("id", _big(F.col("detection")).alias("detection"), _big(F.col("rating")).alias("rating"), "message")


def t31_cascade(spark: SparkSession, d: str) -> DataFrame:
    e = io.table(spark, d, "embeddings")
    lg = e.select(
        F.col("vec_id").alias("id"),
        F.transform(A.gather(F.col("embedding"), [0, 1]), lambda x: x.cast("double")).alias("det"),
        F.transform(A.gather(F.col("embedding"), [0, 1, 2, 3, 4]), lambda x: x.cast("double")).alias("rate"),
    )
    out = infer.cascade(lg, "det", "rate")
    return out.select("id", _big(F.col("detection")).alias("detection"), _big(F.col("rating")).alias("rating"),
                      "message", _r(F.col("humor")).alias("humor"), _r(F.col("no_humor")).alias("no_humor"))


# ---- token arrays -----------------------------------------------------------------

def t32_pack_examples(spark: SparkSession, d: str) -> DataFrame:
    t = X.x_tokens(spark, d)
    ids = A.keep_last(F.col("tokens"), X.MAX_LENGTH)
    label_tok = A.score_to_token(F.col("score"), X.CLASS_TOKENS, X.END_TOKEN)
    packed = A.append_label(ids, label_tok, X.END_TOKEN, X.MAX_LENGTH)
    # every third position of the stand-in is padding, so the mask shows which position went
    mask = A.keep_last(F.transform("tokens", lambda x, i: F.when(i % 3 == 0, F.lit(0)).otherwise(F.lit(1))), X.MAX_LENGTH)
    out = t.select("id", packed.alias("input_ids"), A.append_mask(mask, ids, label_tok, X.END_TOKEN, X.MAX_LENGTH).alias("mask"))
    return out.select("id", _big(F.size("input_ids")).alias("n_tokens"), _ints_text(F.col("input_ids")).alias("input_ids"),
                      _ints_text(F.col("mask")).alias("attention_mask"))


def t33_mask_last_label(spark: SparkSession, d: str) -> DataFrame:
    t = X.x_tokens(spark, d)
    return t.select(
        "id",
        _big(A.last_valid(F.col("labels"))).alias("last_pos"),
        _ints_text(A.mask_all_but_last(F.col("labels"))).alias("masked"),
        _ints_text(A.shift_left(F.col("labels"))).alias("shifted"),
    )


def t34_last_valid_gather(spark: SparkSession, d: str) -> DataFrame:
    t = X.x_tokens(spark, d)
    label_tok = A.gather_last(F.col("labels"), F.col("labels"), shift=0)
    pred_tok = A.gather_last(F.col("tokens"), F.col("labels"), shift=1)
    return t.select(
        "id",
        _big(A.last_valid(F.col("labels"))).alias("last_pos"),
        _big(A.class_lookup(label_tok, X.CLASS_TOKENS)).alias("label_class"),
        _big(pred_tok).alias("pred_token"),
        _big(A.class_lookup(pred_tok, X.CLASS_TOKENS)).alias("pred_class"),
    )


# ---- profile, parameters, sinks ----------------------------------------------------

def t35_profile(spark: SparkSession, d: str) -> DataFrame:
    out = profile.profile(io.table(spark, d, "documents"), exact_distinct=True)
    return out.select("column", "stat", _r(F.col("value")).alias("value"))


def t45_top_values(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent values of several columns (a top-k report)."""
    out = profile.top_values(io.table(spark, d, "documents"), ["lang", "source", "n_chars"], 5)
    return out.select("column", "value", "n", _big(F.col("rank")).alias("rank"))


# Defaults the parameter maps are compared with (our own values).
PARAM_DEFAULTS = {"optim": "view", "per_device_train_batch_size": "50"}


def t36_param_diff(spark: SparkSession, d: str) -> DataFrame:
    ev = io.table(spark, d, "events")
    params = F.create_map(
        F.lit("optim"), F.col("event_type"),
        F.lit("per_device_train_batch_size"), F.get_json_object("props", "$.k"),
    )
    diff = metrics.parameter_diff(params, PARAM_DEFAULTS, "trainer_")
    return ev.select("event_id", F.explode(diff).alias("param", "value"))


def t37_metrics_sink(spark: SparkSession, d: str) -> DataFrame:
    ev = io.table(spark, d, "events")
    runs = ev.groupBy(F.col("user_id").alias("model")).agg(
        F.min("ts").alias("started"),
        F.avg("value").alias("eval_loss"),
        F.max(F.floor("value")).cast("double").alias("eval_macro_avg_f1-score"),
        (F.count_if(F.col("value") > 10) / F.count(F.lit(1))).alias("eval_accuracy"),
        F.count(F.lit(1)).cast("double").alias("eval_runtime"),
    )
    long = runs.unpivot(["model", "started"], ["eval_loss", "`eval_macro_avg_f1-score`", "eval_accuracy", "eval_runtime"],
                        "metric", "value")
    kept = metrics.metrics_sink(long)
    return kept.select(
        F.concat(F.lit("test_model"), F.col("model").cast("string")).alias("experiment"),
        metrics.run_name(F.lit("encoder"), F.lit(2), F.col("started")).alias("run_name"),
        "metric",
        _r(F.col("value")).alias("value"),
    )


def t38_fit_predict(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import model as M

    docs = io.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    lab = io.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("score"))
    # the split feeds the IDF fit, the regression fit and the prediction:
    # written once to the shared checkpoint folder instead of recomputed
    data = sampling.exact_split(docs.join(lab, "id"), "id", 0.2, tag="fit").checkpoint()
    train = data.where(F.col("part") == "train").drop("part")
    valid = data.where(F.col("part") == "valid").drop("part")
    fitted = M.fit(train, 2, class_weights=DETECTION_WEIGHTS)
    pred = M.predict(fitted, valid, 2)
    rep = metrics.classification_report(pred, "score", "labels")
    return rep.select("metric", _r(F.col("value")).alias("value"))


def t39_registry_join(spark: SparkSession, d: str) -> DataFrame:
    ev = io.table(spark, d, "events").select("event_id", "user_id", "value")
    reg = F.broadcast(registry_frame(spark))  # fixed 11 rows
    j = ev.join(reg, (ev.user_id % F.lit(len(MODEL_REGISTRY))) == reg.idx)
    p = (F.col("value") / F.lit(500.0))
    scored = j.select("event_id", "name", "decoder", "file_name", "load_tuned", "threshold",
                      p.alias("score_1"), (F.lit(1.0) - p).alias("score_0"))
    score_cols = [c for c in scored.columns if c.startswith("score_")]  # P12
    label = (F.col("score_1") > F.coalesce(F.col("threshold"), F.lit(0.5))).cast("bigint")
    return scored.select("event_id", "name", "decoder", "file_name", "load_tuned", "threshold",
                         *[_r(F.col(c)).alias(c) for c in sorted(score_cols)], label.alias("labels"))


def t42_evaluation_suites(spark: SparkSession, d: str) -> DataFrame:
    """K4 + I2 + A8: the reference's five test suites built from the driver
    tables (detection test set, contradiction rows, long and short slices,
    test half of the repetition rows), scored in one pass by a keyword
    scorer through the scorer hook, reported per suite."""
    scored = _scored_once(spark, d)
    test = labels.to_detection(scored).select("text", "score")
    rows = infer.suites(
        test=test,
        exclusive=labels.to_detection(_contradictions(scored)).select("text", "score"),
        long_lengths=sampling.length_slice(test, "text", 0.9, "long"),
        short_lengths=sampling.length_slice(test, "text", 0.1, "short"),
        repetition=_repetitions(spark, d).where(F.col("part") == "test").select("text", "score"),
    )
    rep = infer.evaluate(rows, infer.keyword_scorer(X.EXCLUSIVE_HUMOR), ["0", "1"])
    return rep.select("suite", "metric", _r(F.col("value")).alias("value"))


def t40_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = io.table(spark, d, "documents")
    path = scratch_path(spark, "csv_roundtrip")
    io.write_csv(docs, path)
    return io.read_csv(spark, path, docs.schema)


def t41_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rated = X.x_rated(spark, d)
    path = scratch_path(spark, "json_roundtrip")
    io.append_json(rated.where(F.col("rating") < 2.5), path)
    io.append_json(rated.where(~(F.col("rating") < 2.5)), path)  # S7: a second append to the same data set
    return io.read_json_lines(spark, path, io.RATED)


def t46_train_family_files(spark: SparkSession, d: str) -> DataFrame:
    """S5 + S6 + S4: the base table and its two views written and read back."""
    from . import jobs

    path = scratch_path(spark, "family")
    paths = jobs.run_family(spark, X.x_scored(spark, d).select("text", "score"), path)
    views = [spark.read.parquet(p).select(F.lit(name).alias("view"), "text", _big(F.col("score")).alias("score"))
             for name, p in paths.items()]
    return dedup.union_all(*views)


def t47_json_arrays(spark: SparkSession, d: str) -> DataFrame:
    """S3 + S2: files of one JSON array each, found through the dataset registry."""
    path = scratch_path(spark, "arrays")
    rated = X.x_rated(spark, d)
    io.write_json_arrays(rated, path)
    registry = io.Registry(spark, path)
    registry.register("rated", "", io.RATED, "json")
    return registry.load("rated").select("id", "body", "rating")


def t48_training_logs(spark: SparkSession, d: str) -> DataFrame:
    """S9 + O1 + A9: logs written per (model, task), read back, best step each."""
    logs = X.x_train_log(spark, d)
    path = scratch_path(spark, "logs")
    io.write_train_logs(logs, path)
    best = metrics.best_rows(io.read_train_logs(spark, path), ["model", "task"], "step", "macro_f1")
    return best.select("model", "task", _big(F.col("step")).alias("best_step"), _r(F.col("macro_f1")).alias("best_macro_f1"))


def t49_missing_gate(spark: SparkSession, d: str) -> DataFrame:
    """P11 + C2: whether any value of the text-only rows or the scores is missing."""
    from . import jobs

    texts = jobs.job_test_text(X.x_resp(spark, d)).withColumn("score", F.length("text").cast("double"))
    # every 13th length is a NaN
    value = F.when(F.col("score") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("score"))
    return texts.select("text", value.alias("value")).groupBy(F.substring("text", 1, 1).alias("head")).agg(
        infer.any_missing("value").alias("missing"), _big(F.count(F.lit(1))).alias("n"))


def t50_changed_arguments(spark: SparkSession, d: str) -> DataFrame:
    """K6 + F16: the arguments that each logged run changed, by its experiment."""
    from ..sources.experiments import changed_arguments, experiments_frame

    exp = changed_arguments(experiments_frame(spark))  # fixed 28 rows
    runs = io.table(spark, d, "events").select("event_id", F.col("user_id").alias("run"))
    named = exp.select("model", "task", "param", "value", (F.dense_rank().over(Window.orderBy("model", "task")) - 1).alias("idx"))
    return runs.join(F.broadcast(named), F.col("run") % 14 == F.col("idx")).select("event_id", "model", "task", "param", "value")


def t51_fixed_test_set(spark: SparkSession, d: str) -> DataFrame:
    """K2 + K1: sizes, supports and class weights of a fit judged on a fixed test set.

    The fit itself has no SQL form; what it is given has: training rows by
    class after under-sampling, their weights, and the test set's classes, as
    the report of the fitted model counts them."""
    from ..operators import model as M

    scored = labels.to_detection(X.x_scored(spark, d)).checkpoint()
    test = scored.where(F.col("id") % 5 == 0)
    train = scored.where(F.col("id") % 5 != 0)
    used = M.training_rows(train, DETECTION_WEIGHTS, sample="under")
    pred = M.predict(M.fit(train, 2, class_weights=DETECTION_WEIGHTS, sample="under"), test, 2)
    rep = metrics.classification_report(pred, "score", "labels")
    support = rep.where("metric IN ('0_support', '1_support')").select(
        F.concat(F.lit("test_"), F.col("metric")).alias("name"), "value")
    sums = pred.select(F.lit("probabilities_sum_to_1").alias("name"),
                       F.when(F.abs(F.col("score_0") + F.col("score_1") - 1) < 1e-9, 1.0).otherwise(0.0).alias("value"))
    sums = sums.groupBy("name").agg(F.min("value").alias("value"))
    classes = used.groupBy("score").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("weight").alias("w"))
    given = classes.select(F.inline(F.array(
        F.struct(F.concat(F.lit("train_rows_"), F.col("score").cast("int").cast("string")).alias("name"), F.col("n").alias("value")),
        F.struct(F.concat(F.lit("train_weight_"), F.col("score").cast("int").cast("string")).alias("name"), F.col("w").alias("value")))))
    return dedup.union_all(support, sums, given).select("name", _r(F.col("value")).alias("value"))


TRAINING_RUN = {"batches": 8, "epochs": 2, "eval_steps": 4, "learning_rate": 0.5, "momentum": 0.9}


def t52_training_run(spark: SparkSession, d: str) -> DataFrame:
    """K3: the log of one training run over the embeddings (a class each), judged
    every 4 steps on the fifth of the vectors that is not trained on."""
    from ..operators import trainer

    e = io.table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), *trainer.dense_features(F.col("embedding")), F.col("label").cast("int").alias("score"),
                    (1 + F.col("label") % 2).cast("double").alias("weight")).checkpoint()
    dims, classes = rows.agg(F.max(F.size("at")), F.max("score") + 1).first()
    out = trainer.run(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0"), dims, classes, **TRAINING_RUN)
    return out.log.select(_big(F.col("step")).alias("step"), *[_r(F.col(c)).alias(c) for c in ("train_loss", "loss", "accuracy", "macro_f1", "weighted_f1")], "is_best")


def t53_request_ledger(spark: SparkSession, d: str) -> DataFrame:
    """I2 with a ledger: two runs over the same prompts; ``call`` says in which of
    them (0 or 1) a row's prompt was sent."""
    from ..operators.ledger import Ledger

    rows = X.x_resp(spark, d)
    ledger = Ledger(spark, scratch_path(spark, "ledger"), "md5")
    infer.label_with(rows.where("id % 2 = 0"), infer.md5_scorer, ["0", "1"], ledger=ledger)
    out = infer.label_with(rows, infer.md5_scorer, ["0", "1"], ledger=ledger)
    calls = ledger.answers().select("key", _big(F.split_part("call", F.lit("-"), F.lit(1))).alias("call"))
    return (out.join(calls, F.sha2("text", 256) == F.col("key"), "left")
            .select("id", "response", "status", _big(F.col("labels")).alias("labels"), "call"))


def t54_growing_families(spark: SparkSession, d: str) -> DataFrame:
    """C9 + C10 + U2 as ``t12``, from corpora that grow batch by batch."""
    from . import jobs

    grown = jobs.grow_families(spark, scratch_path(spark, "families"), *_family_sources(spark, d), buckets=8)
    rows = [c.unique().withColumn("family", F.lit(name)) for name, c in grown.items()]
    counts = jobs.view_counts(dedup.union_all(*rows).select("family", "text", "score"))
    return counts.select("family", "view", _big(F.col("score")).alias("score"), "n")


def t55_merged_profile(spark: SparkSession, d: str) -> DataFrame:
    """A11 from the sketches of eight batches, appended one by one: the exact numbers,
    and for each estimate whether it lies within its stated error."""
    docs = io.table(spark, d, "documents")
    path = scratch_path(spark, "sketches")
    for b in range(8):  # a number of batches, not of rows
        profile.sketches(docs.where(F.col("doc_id") % 8 == b), f"b{b}").write.mode("append").parquet(path)
    merged = profile.merged_profile(spark.read.parquet(path))
    exact = profile.profile(docs).withColumnRenamed("value", "exact")
    joined = merged.join(exact, ["column", "stat"])
    rows = docs.count()
    off = F.abs(F.col("value") - F.col("exact"))
    # four standard errors; duplicates are rows less distinct rows, so they carry the error of those
    near = F.when(F.col("stat") == "duplicate_rows", off <= 0.035 * rows).otherwise(off <= 0.035 * F.col("exact"))
    value = F.when(F.col("stat").isin("distinct", "duplicate_rows"), near.cast("double")).otherwise(F.col("value"))
    exactly = joined.where(~F.col("stat").rlike("^p[0-9]")).select("column", "stat", _r(value).alias("value"))
    # a quartile's estimate must have a rank near its own
    quarters = merged.where("stat RLIKE '^p[0-9]'").withColumn("q", F.substring("stat", 2, 2).cast("double") / 100)
    numbers = docs.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in ("doc_id", "n_chars")])))
    ranks = numbers.join(F.broadcast(quarters), "column").groupBy("column", "stat", "q").agg(  # six rows
        F.avg((F.col("v") < F.col("value")).cast("double")).alias("below"), F.avg((F.col("v") <= F.col("value")).cast("double")).alias("upto"))
    within = (F.col("below") <= F.col("q") + 0.035) & (F.col("upto") >= F.col("q") - 0.035)
    return exactly.unionByName(ranks.select("column", "stat", within.cast("double").alias("value")))


def t56_stream_best(spark: SparkSession, d: str) -> DataFrame:
    """W1 with keyed state over a file stream that is stopped and started again."""
    from ..streaming.state import track_best

    logs = X.x_log(spark, d)
    half = logs.agg(F.avg("step")).first()[0] or 0
    src, out, ckpt = (scratch_path(spark, name) for name in ("logs_in", "flags", "offsets"))
    for part in ("step <= {half}", "step > {half}"):
        logs.where(part.format(half=half)).write.mode("append").parquet(src)
        stream = spark.readStream.schema(logs.schema).parquet(src)
        query = track_best(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
        query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("model", "step", _big(F.col("macro_f1")).alias("macro_f1"), "is_best")


def t57_committed_appends(spark: SparkSession, d: str) -> DataFrame:
    """Appends that are repeated and overlap leave each item once."""
    from ..sources.commits import CommittedData

    rated = X.x_rated(spark, d)
    data = CommittedData(spark, scratch_path(spark, "items"), io.RATED)
    data.append("low", rated.where(F.col("rating") < 2.5), key="id")
    data.append("low", rated.where(F.col("rating") < 2.5), key="id")  # repeated: nothing happens
    data.append("all", rated.withColumn("rating", F.col("rating") + 100), key="id")  # only the missing ids
    return data.read().select("id", "body", "rating")


def t58_ordered_files(spark: SparkSession, d: str) -> DataFrame:
    """O1: files in key order; for each row of a range of keys, whether it follows
    the row before it."""
    from ..sources.commits import CommittedData

    docs = io.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    data = CommittedData(spark, scratch_path(spark, "ordered"), docs.schema, "parquet")
    data.append("all", docs, order_by="doc_id")
    low, high = docs.agg(F.percentile("doc_id", 0.25).cast("bigint"), F.percentile("doc_id", 0.75).cast("bigint")).first()
    rows = data.in_order(low, high).withColumn("place", F.monotonically_increasing_id())
    # places grow by 1 in a partition and jump between them: a row follows the one before it in its
    # partition, and a partition's first row follows the last one of the partition before
    part = F.shiftright("place", 33)
    rows = rows.withColumn("part", part).withColumn("before", F.lag("doc_id").over(Window.partitionBy("part").orderBy("place")))
    ends = rows.groupBy("part").agg(F.max_by("doc_id", "place").alias("last"))  # a row for each file
    ends = ends.select(F.col("part"), F.lag("last").over(Window.orderBy("part")).alias("end"))
    follows = F.coalesce(F.coalesce("before", "end") < F.col("doc_id"), F.lit(True))
    return rows.join(F.broadcast(ends), "part").select("doc_id", "lang", "n_chars", follows.alias("in_order"))


def t59_registry_load(spark: SparkSession, d: str) -> DataFrame:
    """The same labelled rows, written in each format and loaded by name."""
    path = scratch_path(spark, "registry")
    registry = io.Registry(spark, path)
    rows = X.x_scored(spark, d).select("text", "score").checkpoint()
    for name, write in (("train.csv", io.write_csv), ("train.json", io.write_json_arrays), ("train.parquet", io.write_table)):
        registry.register(name.replace(".", "_"), name)
        write(rows, registry.path(name.replace(".", "_")))
    loaded = [registry.load(f"train_{fmt}").select(F.lit(fmt).alias("format"), "text", "score") for fmt in ("csv", "json", "parquet")]
    return dedup.union_all(*loaded).select("format", "text", _big(F.col("score")).alias("score"))


def t60_routed_models(spark: SparkSession, d: str) -> DataFrame:
    """I4 + S12 + J7: each row scored by the model of its task."""
    rows = X.x_resp(spark, d)
    routes = {"classes": infer.Route(infer.md5_scorer, 2, classes=("a", "b", "c")), "words": infer.Route(infer.keyword_scorer(["th"]), 1),
              "detector": infer.Route(infer.probability_scorer, 3, threshold=DETECTION_THRESHOLD)}
    task = F.element_at(F.array(*map(F.lit, ("classes", "words", "detector", "none"))), (F.col("id") % 4 + 1).cast("int"))
    out = infer.route(rows, task, routes)
    return out.select("id", "model", "response", "status", *[_r(F.col(c)).alias(c) for c in ("score_0", "score_1")], _big(F.col("labels")).alias("labels"))


def t61_class_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """F19 + P12: the probabilities of five classes as one row each."""
    scored = infer.score_logits(X.x_logits(spark, d, 5), "logits", 5)
    out = infer.class_probabilities(scored, "id")
    return out.select(_big(F.col("id")).alias("id"), _big(F.col("class")).alias("class"), _r(F.col("p")).alias("p"))


QUERIES = {
    name: fn for name, fn in sorted(globals().items())
    if name[:1] == "t" and name[1:3].isdigit() and callable(fn)
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return t07_union_unique(spark, d)


__all__ = ["QUERIES", "flagship"]
