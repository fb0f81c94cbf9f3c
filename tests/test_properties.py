"""Property tests: random inputs, checked against plain-Python statements of
the rules (SURVEY §1.1, §2).  Each example is one Spark job over many cases."""

from collections import Counter

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jestframe.functions import arrays as A
from jestframe.operators import dedup, labels, metrics

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.sampled_from(["a", "b", "c", "d", " a"])), min_size=1, max_size=30))
def test_drop_all_duplicates_matches_pandas(spark, texts):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "id long, text string")
    got = sorted(r.id for r in dedup.drop_all_duplicates(df).collect())
    want = sorted(pd.DataFrame(rows, columns=["id", "text"]).drop_duplicates("text", keep=False)["id"])
    assert got == want


def _vote_rule(is_humor, votes):
    if is_humor == 0:
        return 0
    total = sum(votes)
    if total == 0:
        return 0
    for i, v in enumerate(votes, 1):
        if v / total > 0.5:
            return i
    for i in range(5, 0, -1):
        if votes[i - 1] / total >= 0.25:
            return i
    return 0


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([0, 1, None]), st.lists(st.integers(0, 4), min_size=5, max_size=5)),
                min_size=1, max_size=40))
def test_vote_resolution_rule(spark, cases):
    rows = [(i, f"t{i}", h, *v) for i, (h, v) in enumerate(cases)]
    df = spark.createDataFrame(
        rows, "id long, text string, is_humor int, votes_1 int, votes_2 int, votes_3 int, votes_4 int, votes_5 int")
    got = {r.id: r.score for r in labels.resolve_votes(df).collect()}
    assert got == {i: _vote_rule(h, v) for i, (h, v) in enumerate(cases)}


def _annotation_rule(values):
    zero = sum(1 for v in values if v == 0)
    non_zero = [v for v in values if v != 0]  # None counts as non-zero
    detection = int(zero <= len(non_zero))
    ratings = [v for v in non_zero if v is not None]
    if not non_zero:
        rating = 0
    else:
        counts = Counter(ratings)
        top = max(counts.values()) if counts else 0
        rating = [k for k, c in counts.items() if c == top][0] if top / len(non_zero) > 0.5 else max(ratings)
    cls = rating - 1 if len(non_zero) >= zero else None
    return detection, cls


@SETTINGS
@given(st.lists(st.lists(st.sampled_from([0, 1, 2, 3, 4, 5]), min_size=1, max_size=8), min_size=1, max_size=25))
def test_annotation_rules(spark, groups):
    rows = [(g, f"g{g}", v) for g, vals in enumerate(groups) for v in vals]
    df = spark.createDataFrame(rows, "id long, text string, sentiment int")
    summary = labels.annotation_summary(df)
    det = {r.id: r.score for r in labels.detection_from_summary(summary).collect()}
    cls = {r.id: r.score for r in labels.classification_from_summary(summary).collect()}
    want_det, want_cls = {}, {}
    for g, vals in enumerate(groups):
        if len(vals) < 4:
            continue
        d, c = _annotation_rule(vals)
        want_det[g] = d
        if c is not None:
            want_cls[g] = c
    assert det == want_det and cls == want_cls


def _report(pairs):
    classes = sorted({l for l, _ in pairs} | {p for _, p in pairs})
    out, n = {}, len(pairs)
    precs, recs, f1s, sups = [], [], [], []
    for c in classes:
        tp = sum(1 for l, p in pairs if l == c and p == c)
        fp = sum(1 for l, p in pairs if l != c and p == c)
        fn = sum(1 for l, p in pairs if l == c and p != c)
        prec = tp / (tp + fp) if tp + fp else 0.0
        rec = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        out.update({f"{c}_precision": prec, f"{c}_recall": rec, f"{c}_f1-score": f1, f"{c}_support": tp + fn})
        precs.append(prec), recs.append(rec), f1s.append(f1), sups.append(tp + fn)
    out["accuracy"] = sum(1 for l, p in pairs if l == p) / n
    for name, vals in (("precision", precs), ("recall", recs), ("f1-score", f1s)):
        out[f"macro_avg_{name}"] = sum(vals) / len(vals)
        out[f"weighted_avg_{name}"] = sum(v * s for v, s in zip(vals, sups)) / sum(sups)
    out["macro_avg_support"] = out["weighted_avg_support"] = n
    return out


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-1, 2)), min_size=1, max_size=60))
def test_classification_report_definition(spark, pairs):
    df = spark.createDataFrame(pairs, "label int, pred int")
    got = {r.metric: r.value for r in metrics.classification_report(df).collect()}
    want = _report(pairs)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert abs(got[k] - v) < 1e-9, k


def _pack(ids, label, end, max_len):
    ids = list(ids)
    if label == end:
        return ids[:-1] if ids and ids[-1] == end else ids
    if ids and ids[-1] == end:
        return ids[:-1] + [label]
    ids = ids + [label]
    return ids[1:] if len(ids) > max_len else ids


@SETTINGS
@given(st.lists(st.tuples(st.lists(st.integers(1, 9), min_size=1, max_size=6), st.sampled_from([5, 9])),
                min_size=1, max_size=30))
def test_pack_and_mask_rules(spark, cases):
    df = spark.createDataFrame([(i, ids, lab) for i, (ids, lab) in enumerate(cases)], "i int, ids array<int>, lab int")
    out = df.select("i", A.append_label(A.keep_last(F.col("ids"), 4), F.col("lab"), 9, 4).alias("p"),
                    A.mask_all_but_last(F.transform("ids", lambda x: F.when(x <= 4, F.lit(-100)).otherwise(x))).alias("m"))
    got = {r.i: (r.p, r.m) for r in out.collect()}
    for i, (ids, lab) in enumerate(cases):
        labels_ = [-100 if x <= 4 else x for x in ids]
        valid = [j for j, x in enumerate(labels_) if x != -100]
        last = valid[-1] if valid else 0
        mask = [x if j == last else -100 for j, x in enumerate(labels_)]
        assert got[i] == (_pack(ids[-4:], lab, 9, 4), mask)


def test_fit_best_keeps_first_best_step(spark):
    """K3: candidates by training length, the first best by macro F1 wins."""
    from jestframe.operators import model as M
    from jestframe.operators.sampling import exact_split
    from jestframe.sources import io
    from conftest import SF_MID

    docs = io.table(spark, SF_MID, "documents").select(F.col("doc_id").alias("id"), "text")
    lab = io.table(spark, SF_MID, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("score"))
    data = exact_split(docs.join(lab, "id"), "id", 0.2, tag="k3").checkpoint()
    train = data.where("part = 'train'").drop("part")
    valid = data.where("part = 'valid'").drop("part")
    model, log = M.fit_best(train, valid, 2, class_weights=[1.05, 1.0], steps=(2, 5, 10), num_features=1 << 12)
    rows = sorted(log.collect(), key=lambda r: r.step)
    assert [r.step for r in rows] == [2, 5, 10]
    top = max(r.macro_f1 for r in rows)
    first = min(r.step for r in rows if r.macro_f1 == top)
    assert [r.step for r in rows if r.is_best] == [first]
    assert model.stages[-1].getMaxIter() == first
    pred = M.predict(model, valid, 2)
    assert pred.count() == valid.count()
    # The sanity prompts through the chosen model
    from jestframe.sources.fixtures import SANITY_PROMPTS
    sanity = M.predict(model, io.from_prompts(spark, SANITY_PROMPTS), 2).collect()
    assert len(sanity) == 6 and all(r.labels in (0, 1) and abs(r.score_0 + r.score_1 - 1) < 1e-9 for r in sanity)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([0, 1, None]), st.one_of(st.none(), st.integers(0, 3))),
                min_size=1, max_size=60))
def test_running_best_rule(spark, cases):
    """W1 against the callback rule: per run in step order, a row is best iff
    its metric is strictly above every earlier metric of the run."""
    rows = [(run, step, m) for step, (run, m) in enumerate(cases)]
    df = spark.createDataFrame(rows, "run int, step long, m int")
    got = {(r.run, r.step): r.is_best for r in metrics.running_best(df, ["run"], "step", "m", blocks=3).collect()}
    want, best = {}, {}
    for run, step, m in rows:
        ok = m is not None and (best.get(run) is None or m > best[run])
        if ok:
            best[run] = m
        want[(run, step)] = ok
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["", "a", "ab", "abc", "abcd", "b"]), st.sampled_from([0.5, 1.5, 2.5, 3.0])),
                min_size=1, max_size=40))
def test_rated_items_rule(spark, items):
    """C4 against the loop rule: a body whose rating ever changes is dropped,
    as are empty and over-long bodies; the first item of a body is kept and
    its rating rounded half to even."""
    rows = [(i, body, rating) for i, (body, rating) in enumerate(items)]
    df = spark.createDataFrame(rows, "id long, body string, rating double")
    got = sorted(tuple(r) for r in labels.rated_items(df, max_length=3).select("id", "text", "score").collect())
    last, removed = {}, {""}
    for _, body, rating in rows:
        if body in last and last[body] != rating:
            removed.add(body)
        last[body] = rating
    want, seen = [], set()
    for i, body, rating in rows:
        if body not in removed and len(body) <= 3 and body not in seen:
            seen.add(body)
            want.append((i, body, round(rating)))
    assert got == sorted(want)
