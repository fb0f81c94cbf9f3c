"""Inference and labelling.

A *scorer* is any function ``Iterator[pandas.Series[str]] -> Iterator[
pandas.Series[str]]`` (one answer per prompt, same order).  It runs inside
``mapInArrow``: Arrow batches in, Arrow batches out, one client per
partition, width = number of partitions.  Prompts become Python strings a few
MB at a time (``functions.batches``); the other columns pass through as they
are.  Everything after the answer (label
lookup, probabilities, reports) is ordinary column code in the JVM.

Scorers may be remote and costly, so their output is materialised once
(``checkpoint`` into the shared checkpoint folder) before anything reads it
twice; a failed request is a ``status``, never a dropped row.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import answer_index, label_from_logits, softmax, wide
from ..functions.batches import pieces, with_strings
from ..functions.text import apply_template
from .dedup import union_all
from .labels import detection_message
from .ledger import Ledger
from .metrics import classification_report
from .sampling import exact_rank_by_order

Scorer = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def md5_scorer(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Offline stand-in for a remote model: answers the first hex digit of
    md5(prompt).  Deterministic, so results can be checked exactly."""
    for batch in prompts:
        yield batch.map(lambda s: None if s is None else hashlib.md5(s.encode("utf-8")).hexdigest()[:1])


def keyword_scorer(words: list[str]) -> Scorer:
    """Offline rule scorer: answers '1' when the prompt contains any of
    ``words``, else '0' (vectorised per Arrow batch)."""
    pattern = "|".join(re.escape(w) for w in words)

    def score(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in prompts:
            hit = batch.str.contains(pattern, regex=True)
            yield hit.map(lambda h: None if pd.isna(h) else ("1" if h else "0"))

    return score


def _apply_scorer(df: DataFrame, prompt_col: str, scorer: Scorer, out_col: str) -> DataFrame:
    """Every row once, with the scorer's answer and a ``status``: ``ok``,
    ``refused`` (a null answer), ``missing`` (the scorer answered fewer prompts
    than it got) or ``error`` (it raised).

    One scorer call per partition sees the partition's Arrow batches as a
    stream of prompt series (long batches in pieces) and answers each in order.
    When it ends or raises early, the series it took without an answer keep their
    rows, and a new call gets the ones after them."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType()), T.StructField("status", T.StringType())])
    return df.mapInArrow(lambda batches: answered_batches(batches, prompt_col, scorer, out_col), schema)


def answered_batches(batches: Iterator[pa.RecordBatch], prompt_col: str, scorer: Scorer, out_col: str) -> Iterator[pa.RecordBatch]:
    """The batches of a partition, in pieces, with ``out_col`` and ``status`` (see ``_apply_scorer``)."""
    def series(batch: pa.RecordBatch) -> pd.Series:
        return batch.column(prompt_col).to_pandas().rename(prompt_col)

    for batch, found, status in _answered(pieces(batches, prompt_col), series, scorer):
        yield with_strings(batch, **{out_col: found, "status": status})


def answered_frames(frames: Iterator[pd.DataFrame], prompt_col: str, scorer: Scorer, out_col: str) -> Iterator[pd.DataFrame]:
    """The frames of a partition with ``out_col`` and ``status`` (see ``_apply_scorer``)."""
    for frame, found, status in _answered(frames, lambda f: f[prompt_col], scorer):
        yield frame.assign(**{out_col: pd.Series(found, index=frame.index, dtype=object), "status": status})


def _answered(parts: Iterator, prompts_of: Callable, scorer: Scorer) -> Iterator[tuple]:
    """Each part (a frame or batch) with the answers and statuses of its rows."""
    def answered(part, answers: list, rest: str) -> tuple:
        answers = list(answers)[:len(part)]
        short = len(part) - len(answers)
        found = [None if a is None or pd.isna(a) else str(a) for a in answers]
        return part, found + [None] * short, ["refused" if a is None else "ok" for a in found] + [rest] * short

    parts, ended = iter(parts), False
    while not ended:
        pending: list = []
        taken = 0

        def prompts() -> Iterator[pd.Series]:
            nonlocal ended, taken
            for part in parts:
                taken += 1
                pending.append(part)
                yield prompts_of(part)
            ended = True

        failed = "missing"
        try:
            for answers in scorer(prompts()):
                if pending:
                    yield answered(pending.pop(0), answers, "missing")
        except Exception:  # noqa: BLE001 - a failing client is a status of its rows
            failed = "error"
        if not taken and not ended:  # a scorer that takes nothing would never end
            for part in parts:
                yield answered(part, [], failed)
            ended = True
        for part in pending:
            yield answered(part, [], failed)


def label_with(df: DataFrame, scorer: Scorer, classes: list[str], text: str = "text",
               template: str | None = None, parallelism: int | None = None, materialise: bool = True,
               ledger: Ledger | None = None) -> DataFrame:
    """I2 + J6: one answer and ``status`` per row; ``labels`` = index of the
    answer in ``classes`` or -1; probabilities are unknown (null ``score_i``).
    ``parallelism``: number of scorer calls at a time (the partitions as they
    are without it).  With a ``ledger`` each distinct prompt is sent once, however
    often it occurs, a task is repeated or the labelling is run again."""
    x = df.withColumn("_prompt", apply_template(template, F.col(text)) if template else F.col(text))
    if ledger is not None:
        scored = ledger.ask(x, "_prompt", lambda frames: answered_frames(frames, "prompt", scorer, "response"), parallelism).drop("_prompt")
        materialise = False  # the answers are in the ledger
    else:
        if parallelism:
            x = x.repartition(parallelism)
        scored = _apply_scorer(x, "_prompt", scorer, "response").drop("_prompt")
    if materialise:
        scored = scored.checkpoint()
    return scored.select(
        *df.columns, "response", "status",
        *[F.lit(None).cast("double").alias(f"score_{i}") for i in range(len(classes))],
        answer_index(F.col("response"), classes).alias("labels"),
    )


def suites(**frames: DataFrame) -> DataFrame:
    """K4: named evaluation suites (test, exclusive, long_lengths, ...) as
    one (suite, text, score) table, so they are scored in a single pass."""
    return union_all(*[df.select(F.lit(name).alias("suite"), "text", "score") for name, df in frames.items()])


def evaluate(suite_rows: DataFrame, scorer: Scorer, classes: list[str], text: str = "text",
             template: str | None = None, label: str = "score", by: str = "suite") -> DataFrame:
    """K4: one scorer pass over every suite (I2), then the classification
    report (A8) grouped by suite: the reference runs one evaluation per
    suite; here the suites share a scan, a scorer call and one shuffle of
    the (suite, label, prediction) counts."""
    scored = label_with(suite_rows, scorer, classes, text=text, template=template)
    return classification_report(scored, label, "labels", by=[by])


def score_logits(df: DataFrame, logits: str = "logits", k: int = 2, threshold: float | None = None) -> DataFrame:
    """Logits -> softmax columns score_0..score_{k-1} and ``labels``."""
    p = softmax(F.col(logits))
    return df.select(
        *[c for c in df.columns if c != logits],
        *wide(p, k),
        label_from_logits(F.col(logits), threshold).alias("labels"),
    )


def cascade(df: DataFrame, detect_logits: str, rate_logits: str, threshold: float | None = None,
            key: str = "id") -> DataFrame:
    """I4 + P8 + F19 (two-class view): detection first; only rows detected as
    humour (label 1) get a rating; -1 stays an error.  In one pass, with the
    rating null for the other rows, so no join is needed."""
    det = label_from_logits(F.col(detect_logits), threshold)
    p = softmax(F.col(detect_logits))
    rating = F.when(det == 1, label_from_logits(F.col(rate_logits)))
    return df.select(
        key,
        det.alias("detection"),
        rating.alias("rating"),
        detection_message(det, rating).alias("message"),
        F.element_at(p, 2).alias("humor"),
        F.element_at(p, 1).alias("no_humor"),
    )


def cascade_with(df: DataFrame, detector: Scorer, rater: Scorer, key: str = "id", text: str = "text",
                 detect_template: str | None = None, rate_template: str | None = None,
                 rate_classes: tuple[str, ...] = ("1", "2", "3", "4", "5")) -> DataFrame:
    """I4 + P8 with scorers (remote models): every row is sent to the
    detector; only rows detected as humour (label 1) are sent to the rater, so
    the others cost no request; -1 (no valid answer) stays an error.  Both
    answers are written once (``label_with``); the ratings are left-joined
    back on ``key``.  Output: key, detection, rating, message."""
    det = label_with(df.select(key, text), detector, ["0", "1"], text=text, template=detect_template)
    hits = det.where(F.col("labels") == 1).select(key, text)
    rated = label_with(hits, rater, list(rate_classes), text=text, template=rate_template).select(
        key, F.col("labels").alias("_rating"))
    out = det.select(key, F.col("labels").alias("detection")).join(rated, key, "left")
    return out.select(key, "detection", F.col("_rating").alias("rating"),
                      detection_message(F.col("detection"), F.col("_rating")).alias("message"))


@dataclass(frozen=True)
class Route:
    """A model of the registry: its scorer, how many tasks may call it at a time,
    and how its answers are read: as the probability of class 1 (``threshold``)
    or as the name of one of ``classes``."""

    scorer: Scorer
    width: int = 1
    threshold: float | None = None
    classes: tuple[str, ...] = ("0", "1")
    template: str | None = None


def route(df: DataFrame, model: F.Column, routes: dict[str, Route], key: str = "id", text: str = "text") -> DataFrame:
    """I4 + S12 + J7: every row scored by the model that ``model`` names, in one scan
    and one shuffle: each model has ``width`` partitions of its own, so a task
    calls one model, a busy model doesn't hold up the others, and a model's
    requests at a time are bounded by its width.

    Adds model, response, status, score_0, score_1 (with a threshold) and labels.
    Rows without a registered model are kept, with status ``unrouted`` and -1."""
    names = sorted(routes)  # the registry's models
    first = {n: 1 + sum(routes[m].width for m in names[:i]) for i, n in enumerate(names)}
    name = F.col("model")
    prompt, part, label, p1 = F.col(text), F.lit(0), F.lit(-1), F.lit(None).cast("double")
    for n in names:
        r, own = routes[n], name == n
        if r.template:
            prompt = F.when(own, apply_template(r.template, F.col(text))).otherwise(prompt)
        part = F.when(own, F.lit(first[n]) + F.pmod(F.xxhash64(key, text), F.lit(r.width)).cast("int")).otherwise(part)
        if r.threshold is None:
            label = F.when(own, answer_index(F.col("response"), list(r.classes))).otherwise(label)
        else:
            given = F.col("response").try_cast("double")
            p1 = F.when(own, given).otherwise(p1)
            label = F.when(own, F.when(given > r.threshold, F.lit(1)).when(given.isNotNull(), F.lit(0)).otherwise(F.lit(-1))).otherwise(label)
    x = df.withColumn("model", model).withColumn("_prompt", prompt)
    x = x.repartitionById(1 + sum(r.width for r in routes.values()), part.cast("int"))
    schema = T.StructType(x.schema.fields + [T.StructField("response", T.StringType()), T.StructField("status", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        whole = itertools.chain([head], batches)
        own = routes.get(head.column("model")[0].as_py()) if head.num_rows else None  # a partition holds one model's rows
        del head
        if own is None:
            for batch in whole:
                yield with_strings(batch, response=[None] * batch.num_rows, status=["unrouted"] * batch.num_rows)
        else:
            yield from answered_batches(whole, "_prompt", own.scorer, "response")

    scored = x.mapInArrow(run, schema).drop("_prompt").checkpoint()
    return scored.withColumn("score_1", p1).withColumn("score_0", 1 - F.col("score_1")).withColumn("labels", label)


def probability_scorer(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Offline stand-in for a detector that answers with the probability of class 1:
    the first byte of md5(prompt) over 255."""
    for batch in prompts:
        yield batch.map(lambda s: None if s is None else repr(int(hashlib.md5(s.encode("utf-8")).hexdigest()[:2], 16) / 255.0))


def any_missing(col: str) -> F.Column:
    """True when any value is null or NaN (an aggregate)."""
    c = F.col(col)
    return F.bool_or(c.isNull() | F.isnan(c))


def class_probabilities(df: DataFrame, key: str = "id", prefix: str = "score_") -> DataFrame:
    """F19 + P12 + F4 (split and cast): unpivot the ``score_*`` columns to
    (class = i + 1, p)."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    long = df.unpivot([key], cols, "_name", "p")
    return long.select(key, (F.split_part(F.col("_name"), F.lit("_"), F.lit(2)).cast("int") + 1).alias("class"), "p")


# ---- I3: batched rewriting with a per-item fallback ---------------------------

ITEM = "array<struct<body:string,id:bigint,rating:double>>"


def rewrite_in_batches(df: DataFrame, batch_scorer: Callable[[str], tuple[str | None, str]],
                       batch_size: int = 32, order: str = "id", parallelism: int = 10,
                       template: str | None = None, ledger: Ledger | None = None) -> DataFrame:
    """I3 + W3 + F20: items are packed into batches of ``batch_size`` in
    ``order`` (exact ranks, no single-task window), each batch sent as one
    JSON payload, ``parallelism`` senders at a time.

    Each item leaves exactly once with a status.  Items of a batch that was
    refused, failed, or whose answer is no JSON, and items that a good answer
    leaves out, are retried one by one; then ``ok``, the refusal's reason,
    ``error`` (the sender raised) or ``invalid`` (no answer for the item).
    Answers for unknown ids are ignored; of several for an id the first counts.

    ``batch_scorer(prompt) -> (response_json | None, finish_reason)``; the
    prompt is the payload, or ``template`` with its ``{jokes_batch}`` replaced.
    With a ``ledger`` a payload that was answered before is not sent again."""
    def ask(calls: DataFrame, *key: str) -> DataFrame:
        prompt = apply_template(template, F.col("payload"), "{jokes_batch}") if template else F.col("payload")
        if ledger is not None:
            asked = ledger.ask(calls.withColumn("_prompt", prompt), "_prompt", lambda frames: _json_frames(frames, "prompt", batch_scorer, "status"), parallelism)
            return asked.drop("_prompt").withColumnRenamed("status", "finish").checkpoint()
        # requests are tiny, so a width by bytes would leave one sender
        sent = calls.withColumn("prompt", prompt).repartition(parallelism, *key)
        return _call_json(sent, "prompt", batch_scorer).drop("prompt").checkpoint()  # each request once

    ranked = exact_rank_by_order(df, order, rank_col="_rank")
    batched = ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / batch_size))
    payloads = batched.groupBy("batch").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("body", "id", "rating")),
                               lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)))
        .alias("payload")
    )
    first = ask(payloads, "batch")
    answers = _with_answers(first)
    good = (F.col("finish") == "ok") & F.col("answer").isNotNull()
    accepted = answers.where(good).select(F.col("it.id").alias("id"), F.col("answer.body").alias("body"),
                                          F.col("answer.rating").alias("rating"), F.lit("ok").alias("status"))
    # the items to retry are read back from their (written) payload: no
    # second ranking pass and no join over all items
    singles = answers.where(~good).select(F.to_json(F.array(F.col("it"))).alias("payload"))
    second = ask(singles)
    status = F.when(F.col("finish") != "ok", F.col("finish")).when(F.col("answer").isNull(), F.lit("invalid")).otherwise(F.lit("ok"))
    retried = _with_answers(second).withColumn("status", status)
    ok = F.col("status") == "ok"
    return accepted.unionByName(retried.select(
        F.col("it.id").alias("id"), F.when(ok, F.col("answer.body")).alias("body"),
        F.when(ok, F.col("answer.rating")).alias("rating"), "status"))


def _with_answers(calls: DataFrame) -> DataFrame:
    """A row per item of each payload with the first answer for its id (or null)."""
    given = F.coalesce(F.from_json("response", ITEM), F.array().cast(ITEM))
    read = calls.select("finish", F.from_json("payload", ITEM).alias("items"), given.alias("given"))
    return read.select("finish", "given", F.explode("items").alias("it")).select(
        "finish", "it", F.try_element_at(F.filter("given", lambda g: g["id"].eqNullSafe(F.col("it.id"))), F.lit(1)).alias("answer"))


def _asked(batch_scorer, payload: str) -> tuple[str | None, str]:
    try:
        response, finish = batch_scorer(payload)
        return response, finish or "error"
    except Exception:  # noqa: BLE001 - a failing request is a status
        return None, "error"


def _json_batches(batches: Iterator[pa.RecordBatch], col: str, batch_scorer, finish_col: str) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, col):
        res = [_asked(batch_scorer, p) for p in batch.column(col).to_pylist()]
        yield with_strings(batch, **{"response": [r[0] for r in res], finish_col: [r[1] for r in res]})


def _json_frames(frames: Iterator[pd.DataFrame], col: str, batch_scorer, finish_col: str) -> Iterator[pd.DataFrame]:
    for frame in frames:
        res = [_asked(batch_scorer, p) for p in frame[col]]
        yield frame.assign(**{"response": pd.Series([r[0] for r in res], index=frame.index, dtype=object), finish_col: [r[1] for r in res]})


def _call_json(df: DataFrame, col: str, batch_scorer) -> DataFrame:
    schema = T.StructType(
        df.schema.fields + [T.StructField("response", T.StringType()), T.StructField("finish", T.StringType())]
    )
    return df.mapInArrow(lambda batches: _json_batches(batches, col, batch_scorer, "finish"), schema)


def faulty_stub(payload: str) -> tuple[str | None, str]:
    """Offline stand-in for an unreliable rewriter, by the md5 of each body:
    raises if one starts with '0', cuts its JSON short if one starts with '1',
    leaves out bodies that start with '2', and adds an item nobody sent."""
    items = _items_of(payload)
    marks = [hashlib.md5((it.get("body") or "").encode("utf-8")).hexdigest()[0] for it in items]
    if "0" in marks:
        raise RuntimeError("no connection")
    out = [{"body": "[es] " + (it.get("body") or ""), "id": it["id"], "rating": it["rating"]}
           for it, mark in zip(items, marks, strict=True) if mark != "2"]
    text = json.dumps([*out, {"body": "x", "id": -1, "rating": 0.0}], ensure_ascii=False)
    return (text[:len(text) // 2] if "1" in marks else text), "ok"


def _items_of(prompt: str) -> list[dict]:
    return json.loads(prompt[prompt.index("["):prompt.rindex("]") + 1])


def translate_stub(payload: str) -> tuple[str | None, str]:
    """Offline stand-in for the remote rewriter: refuses (``recitation``) any
    payload holding a body whose md5 starts with '0'; otherwise returns each
    item with ``[es] `` put before its body."""
    items = _items_of(payload)
    if any(hashlib.md5((it.get("body") or "").encode("utf-8")).hexdigest()[0] == "0" for it in items):
        return None, "recitation"
    out = [{"body": "[es] " + (it.get("body") or ""), "id": it["id"], "rating": it["rating"]} for it in items]
    return json.dumps(out, ensure_ascii=False), "ok"
