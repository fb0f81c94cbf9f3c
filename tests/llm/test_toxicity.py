import random

import numpy as np
from pyspark.sql import functions as F

from jestframe.llm import toxicity as T
from jestframe.llm.common import crc_mod, read_table

from conftest import SF_MID

DOCS = "doc_id long, text string, score string, y_ int, half_ int, id_ int, text_ string"
LABELS = "doc_id long, toxic int, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j - 1] + (x != y), row[j] + 1, out[j - 1] + 1))
        row = out
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(6)
    terms = ["idiot", "scum", "worthless", "disgusting", "abc"]
    lexicon = T.Lexicon({t + "$": 1.0 + i for i, t in enumerate(terms)})
    for _ in range(1500):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at + rng.choice([0, 1])] = rng.choice([[], ["x"], ["t"]])
        word = "".join(w)
        best = 0.0
        for i, t in enumerate(terms):
            bound = min(len(word) >= 5, len(t) >= 5)
            if (d := distance(word, t)) <= bound:
                best = max(best, (1.0 + i) * (1 - 0.2 * d))
        assert abs((lexicon.search(word) or (0.0,))[0] - best) < 1e-9, word
        assert lexicon.possible(word) or not best


def test_two_edits_from_ten_letters():
    rng = random.Random(7)
    terms = ["idiot", "worthless", "disgusting", "contemptible"]
    lexicon, twice = T.Lexicon({t + "$": 1.0 + i for i, t in enumerate(terms)}), 0
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at + rng.choice([0, 1])] = rng.choice([[], ["x"], ["t"]])
        word = "".join(w)
        best = 0.0
        for i, t in enumerate(terms):
            bound = min((len(word) >= 5) + (len(word) >= 10), (len(t) >= 5) + (len(t) >= 10))
            if (d := distance(word, t)) <= bound:
                best = max(best, (1.0 + i) * (1 - 0.2 * d))
                twice += d == 2
        assert abs(lexicon.find(word)[0] - best) < 1e-9, word
    assert twice > 100 and lexicon.find("disgutsing") == (3.0 * 0.6, True)


def test_rare_entries_stay_whatever_the_sample():
    assert set(T.distinct_entries({"scum$": 4.0, "vile$": 4.0}, {"scum$": 3, "vile$": 2}, 100_000)) == {"scum$"}


def test_slips_in_a_beginning():
    support = {"idiot$": 50, "idiots$": 25, "idiotic$": 25, "idio": 100, "idiot": 50}
    odds = dict.fromkeys(support, 4.0)
    lexicon = T.Lexicon(T.distinct_entries(odds, support, 400) | T.spelled(odds, support))
    assert all(lexicon.find(w) == (4.0 * 0.8, True) for w in ("idjot", "ediot", "iidiot", "idjots", "ediotic"))
    assert all(lexicon.find(w) == (4.0, False) for w in ("idiot", "idiots", "idiocy")) and lexicon.find("pilot") == (0.0, False)


def test_beginnings_by_edit_distance():
    rng = random.Random(9)
    starts = ["vequ", "lowei", "gorkfa"]
    lexicon, edited = T.Lexicon({s: 1.0 + i for i, s in enumerate(starts)}), 0
    for _ in range(2000):
        w = list(rng.choice(starts) + rng.choice(["", "x", "xing", "tableness"]))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w) + 1)
            w[at:at + rng.choice([0, 1])] = rng.choice([[], ["x"], ["t"]])
        word = "".join(w)
        best = 0.0
        for i, s in enumerate(starts):
            d = min((distance(word[:k], s) for k in range(len(word))), default=9)  # letters are left after the beginning
            if d <= min(len(word) >= 5, len(s) >= 5):
                best = max(best, (1.0 + i) * (1 - 0.2 * d))
                edited += d == 1
        assert abs(lexicon.find(word)[0] - best) < 1e-9, word
    assert edited > 100


def test_quotation_scores_lower():
    lexicon = T.Lexicon({"idiot$": 4.0, "vequ": 3.0})
    score = lambda t: T.features(t, lexicon)[0]
    assert score("you are an idiot") > score("an idiot there") > score('he quoted the word "idiot" here')
    assert score("an id1ot there") > 0 and score("an idiott there") > 0 and score("an vequxyz there") > 0 and score("an vequ there") == score("nothing") == 0


def test_entries_that_mean_the_same():
    support = {"idiot$": 90, "idio": 90, "scum$": 50, "vequ": 80, "vequa": 30, "vequab$": 10, "vequto$": 9, "rare$": 1, "lowe": 60, "lowei": 60, "loweis": 20}
    kept = T.distinct_entries(dict.fromkeys(support, 4.0), support, 400)
    assert set(kept) == {"idiot$", "scum$", "vequ", "lowei"}


def test_held_out_quality(spark):
    docs, labels = read_table(spark, SF_MID, "documents"), read_table(spark, SF_MID, "labels")
    model = T.fit(docs, labels, crc_mod("doc_id", 5) != 0)
    out = T.score(docs, model, keep=["doc_id"]).join(labels, "doc_id")
    r = out.agg(F.sum(F.col("toxic") * F.col("predicted")).alias("tp"), F.sum("toxic").alias("p"), F.sum("predicted").alias("pp")).first()
    assert r.tp >= 0.6 * r.p and r.tp >= 0.9 * r.pp


def test_edge_cases(spark):
    rows = [(i, "plain words of text " + ("you vile gorkface" if i % 4 == 0 else "and more"), "clash") for i in range(400)]
    rows += [(900, None, ""), (901, "", ""), (902, "word " * 30_000 + "gorkface", ""), (None, "gorkface", ""), (0, "gorkface you", ""), (903, "what a gorkfase", "")]
    labels = [(i, int(i % 4 == 0), "") for i in range(400)] + [(1, None, ""), (None, 1, ""), (4, 0, ""), (5000, 1, "")]
    rows = [(*r, 1, 2, 3, "t") for r in rows]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    model = T.fit(docs, marks, F.lit(True))
    out = T.score(docs, model, keep=["doc_id"]).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    predicted = {}
    for r in out:
        predicted.setdefault(r.doc_id, []).append(r.predicted)
    assert predicted[0] == [1, 1] and predicted[8] == [1] and predicted[1] == [0] and predicted[900] == predicted[901] == [0] and predicted[903] == [1]
    wide = T.score(docs, model, keep=docs.columns)
    assert wide.columns == ["doc_id", "text", "y_", "half_", "id_", "text_", "score", "predicted"] and wide.where("text_ = 't' AND y_ = 1").count() == len(rows)
    none = T.score(docs, T.fit(docs, marks.limit(0), F.lit(True)), keep=["doc_id"]).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert T.score(docs.limit(0), model, keep=["doc_id"]).count() == 0


def test_regression_learns_a_line():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    w = T.regression(x, (x[:, 0] > 0.3).astype(float))
    assert ((x @ w[:2] + w[2] > 0) == (x[:, 0] > 0.3)).mean() > 0.95
