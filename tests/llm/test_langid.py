import math

import numpy as np
from pyspark.sql import functions as F

from jestframe.llm import langid
from jestframe.llm.common import crc_mod, read_table

from conftest import SF_MID

DOCS = "doc_id long, text string, lang string, score string"


def bits_by_rule(train, text, order=langid.ORDER):
    """Code length by escapes of method C, byte by byte."""
    seen = {}
    for t in train:
        b = t.lower().encode()
        for i in range(len(b)):
            ctx = bytes([0] * max(0, order - i)) + b[max(0, i - order):i]
            for k in range(order + 1):
                c = seen.setdefault(ctx[order - k:], {})
                c[b[i]] = c.get(b[i], 0) + 1
    total, b = 0.0, text.lower().encode()
    for i in range(len(b)):
        ctx = bytes([0] * max(0, order - i)) + b[max(0, i - order):i]
        for k in range(order, -1, -1):
            c = seen.get(ctx[order - k:])
            if c:
                n, d = sum(c.values()), len(c)
                if b[i] in c:
                    total -= math.log2(c[b[i]] / (n + d))
                    break
                total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_are_exact(spark):
    train = {"aa": ["the cat sat on the mat", "the bat"], "bb": ["der hund und die katze", "ein Hund"]}
    rows = [(i, t, lang, "") for lang, ts in train.items() for i, t in enumerate(ts)]
    model = langid.fit(spark.createDataFrame(rows, DOCS), F.lit(True))
    texts = ["the hat", "Der Kater", "x", "über the zzz", "the cat sat on the mat" * 40]
    got = model.lengths([langid.lower_bytes(t) for t in texts])
    want = np.array([[bits_by_rule(train[lang], t) for lang in model.langs] for t in texts])
    assert np.allclose(got, want)


def test_long_texts_in_parts(spark, monkeypatch):
    model = langid.fit(spark.createDataFrame([(1, "the cat sat on the mat", "en", ""), (2, "der Hund und die Katze", "de", "")], DOCS), F.lit(True))
    texts = [langid.lower_bytes(t) for t in ("the cat and the hound " * 40, "x", "die Katze" * 30, "", "mat")]
    whole = model.lengths(texts)
    for chunk in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert np.allclose(model.lengths(texts), whole)


def test_held_out_accuracy(spark):
    docs = read_table(spark, SF_MID, "documents")
    out = langid.predict(docs, langid.fit(docs, crc_mod("doc_id", 4) != 2), keep=["doc_id", "lang"]).where(crc_mod("doc_id", 4) == 2)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_a_language_of_long_texts_only_is_learned(spark):
    rows = [(i, "the cat sat on the mat and the dog sat by it " * 8000, "en", "") for i in range(3)] + [(9, "der Hund und die Katze sitzen auf der Matte", "de", "")]
    model = langid.fit(spark.createDataFrame(rows, DOCS), F.lit(True), sample_bytes=300_000)
    assert model.langs == ["de", "en"]
    held = spark.createDataFrame([(20, "the dog sat on the mat", None, "x", 1.0, "y"), (21, "ein Hund", None, "x", 1.0, "y")], "doc_id long, text string, lang string, score string, bits double, text_ string")
    out = langid.predict(held, model, keep=["doc_id", "score", "bits", "text_"])
    assert out.columns == ["doc_id", "text_", "lang_pred", "score", "bits"]  # the operator's names win
    assert sorted((r.doc_id, r.text_, r.lang_pred) for r in out.collect()) == [(20, "y", "en"), (21, "y", "de")] and dict(out.dtypes)["score"] == "double"


def test_edge_cases(spark):
    rows = [(1, "hello there friend", "en", "clash"), (2, "guten tag mein freund", "de", ""), (3, None, "en", ""), (4, "", "de", ""), (5, "12 -- 7", "en", ""), (None, "hello", None, ""), (1, "hello there", "en", "")]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs, F.lit(True))
    out = {(r.doc_id, r.lang_pred) for r in langid.predict(docs, model, keep=["doc_id"]).collect()}
    assert out == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en")}
    none = langid.predict(docs, langid.fit(docs, F.lit(False)), keep=["doc_id"]).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)} and len(none) == len(rows)
    assert langid.predict(docs.limit(0), model, keep=["doc_id"]).count() == 0 and langid.fit(docs.limit(0), F.lit(True)) is None
