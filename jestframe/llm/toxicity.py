"""Operator 10: toxicity from a lexicon with misspellings and context windows.

The lexicon is learned from labelled rows: whole words, and word beginnings of
4 to 6 letters (so inflected forms of a term are one entry), that occur mostly
in toxic documents; each has a log-odds weight.  The entries form a trie, which
is intersected with the Levenshtein automaton of each distinct document word:
one edit is allowed for entries of 5 letters or more and two from 10 letters, at
a discount, except for words that non-toxic sample documents use, and look-alike
signs (0 1 3 4 5 7 @ $) are read as letters first.  The automaton only runs for
words that share a shortened form with an entry, as all words within its edits do.
An edit may also lie within a beginning of 5 letters or more, and the whole words
that a beginning stands for stay entries, so their misspellings are found.  An occurrence is scored by its window of WINDOW words on either side: quotation (quotation marks
around it, words of reporting) lowers it, direct address raises it.  A logistic
regression on the document's features (sum, maximum, number and density of these
scores, the quoted share, misspellings) gives the score.

At most FIT_ROWS labelled rows (a keyed sample; half for the lexicon, half for
the regression) are learned from; the driver sees counts of at most LEXICON
terms and the sampled rows' features only.  All texts are scored whole.

Defined results: null and empty texts have no occurrences and get the score of
a text without any; without labelled rows of both kinds the lexicon is empty and
every score 0; several labels of a document count as toxic if one is; a null id
is not held out.  Repeated rows are each scored; an empty table gives an empty
result; kept columns called score or predicted give way to the operator's.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jestframe.llm.common import free_name, others, sampled, written

FIT_ROWS = 20_000
LEXICON = 5_000
LEAST_DOCS = 3  # toxic sample documents that an entry occurs in
LEAST_ODDS = 3.0  # natural log
WINDOW = 6
CACHE = 1 << 19  # looked-up words that a worker keeps
FEATURES = 7
TOKEN = re.compile(r"[^\W_]+(?:[@$*'’][^\W_]+)*|[\"“”«»„‟]")
# Signs read as letters, words of reporting, words of direct address.
LOOKALIKE = str.maketrans("013457@$", "oieastas")
REPORTING = {"quote", "quoted", "quotes", "quoting", "said", "says", "called", "wrote", "reported", "cited", "alleged", "citation", "cité", "zitat", "sagte", "dijo"}
ADDRESS = {"you", "your", "you're", "youre", "yourself", "dich", "dein", "toi", "vous", "usted", "eres"}
Model = tuple[dict[str, float], frozenset[str], np.ndarray | None]
QUOTES = set("\"“”«»„‟")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def entries_of(word: str) -> list[str]:
    """Lexicon entries a word counts for: the whole word (marked) and beginnings."""
    return [word + "$", *(word[:k] for k in (4, 5, 6) if len(word) > k)]


def allowed(letters: int) -> int:
    """Edits that a word or an entry of so many letters may have."""
    return (letters >= 5) + (letters >= 10)


def shortened(word: str, most: int) -> set[str]:
    """The word without up to ``most`` of its letters.  Words within as many edits of each other share one."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1:] for w in last for i in range(len(w))}
        out = out | last
    return out


def trie_of(weights: dict[str, float]) -> dict:
    trie: dict = {}
    for entry, weight in weights.items():
        node = trie
        for ch in entry.removesuffix("$"):
            node = node.setdefault("next", {}).setdefault(ch, {})
        node["whole" if entry.endswith("$") else "start"] = weight
    return trie


def by_form(words: set[str], k: int) -> dict[str, set[str]]:
    """The words that may have ``k`` edits, by their shortened forms."""
    out: dict[str, set[str]] = {}
    for word in words:
        for form in shortened(word, k) if allowed(len(word)) >= k else ():
            out.setdefault(form, set()).add(word)
    return out


class Lexicon:
    """Trie of entries; ``find`` runs a word's Levenshtein automaton over it."""

    def __init__(self, weights: dict[str, float], clean: frozenset[str] = frozenset()):
        self.weights, self.trie = weights, trie_of(weights)
        self.clean = clean  # words that are no misspellings
        self.whole, self.starts = {e[:-1] for e in weights if e.endswith("$")}, {e for e in weights if not e.endswith("$")}
        self.longest = max(map(len, self.whole), default=0)
        self.short, self.short_starts = {k: by_form(self.whole, k) for k in (1, 2)}, by_form(self.starts, 1)
        # disjoint pieces of the entries, one of which so many edits leave as it is
        self.halves = {(len(e), at, piece) for e in self.whole for h in [len(e) // 2] for at, piece in ((0, e[:h]), (1, e[h:]))}
        self.thirds = {(len(e), at, piece) for e in self.whole if allowed(len(e)) > 1 for a, b in [(len(e) // 3, 2 * len(e) // 3)] for at, piece in ((0, e[:a]), (1, e[a:b]), (2, e[b:]))}
        self.start_pieces = {(len(e), at, piece) for e in self.starts if allowed(len(e)) for at, piece in ((0, e[:3]), (1, e[3:]))}
        self.start_sizes = sorted({k for e in self.starts if allowed(len(e)) for k in (len(e) - 1, len(e), len(e) + 1)})
        self.cache: dict[str, tuple[float, bool]] = {}
        self.start_cache: dict[str, tuple[str, ...]] = {}

    def find(self, word: str) -> tuple[float, bool]:
        """(weight of the best entry, whether it took an edit); weight 0: none."""
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            plain = word.translate(LOOKALIKE)
            found = self.search(word, 2, trie_of(own)) if (own := self.near(word)) else None
            if found is None and plain != word and (own := self.near(plain)):
                found = self.search(plain, 2, trie_of(own))
            found = found or (0.0, False)
            if found[1] and word in self.clean:
                found = (0.0, False)
            self.cache[word] = found
        return found

    def pieced(self, word: str, k: int) -> bool:
        """Whether a piece of a whole word that ``k`` edits may lead to is in its place (two edits move the middle one by up to 2)."""
        n = len(word)
        if k == 1:
            return any((m, 0, word[:m // 2]) in self.halves or (m, 1, word[n - m + m // 2:]) in self.halves for m in (n - 1, n, n + 1))
        for m in range(n - 2, n + 3):
            a, b = m // 3, 2 * m // 3
            if (m, 0, word[:a]) in self.thirds or (m, 2, word[n - m + b:]) in self.thirds:
                return True
            if any((m, 1, word[a + d:b + d]) in self.thirds for d in (-2, -1, 0, 1, 2)):
                return True
        return False

    def near(self, word: str) -> dict[str, float]:
        """The entries that share a shortened form with the word: all within its bound, and few others."""
        n, out = len(word), {e for e in (word + "$", *(word[:k] for k in (4, 5, 6) if len(word) > k)) if e in self.weights}
        for k in range(1, allowed(n) + 1):
            if n <= self.longest + k and self.pieced(word, k):
                out.update(e + "$" for form in shortened(word, k) for e in self.short[k].get(form, ()))
        if self.start_pieces and allowed(n) and any((m, 0, word[:3]) in self.start_pieces or any((m, 1, word[i:i + m - 3]) in self.start_pieces for i in (2, 3, 4)) for m in (5, 6)):
            for k in self.start_sizes:
                if n > k:
                    out.update(self.starts_near(word[:k]))
        return {e: self.weights[e] for e in out}

    def starts_near(self, start: str) -> tuple[str, ...]:
        """The beginnings that share a shortened form with a word's (many words have it in common)."""
        found = self.start_cache.get(start)
        if found is None:
            if len(self.start_cache) >= CACHE:
                self.start_cache.clear()
            found = self.start_cache[start] = tuple({e for form in shortened(start, 1) for e in self.short_starts.get(form, ())})
        return found

    def possible(self, word: str) -> bool:
        return bool(self.near(word))

    def search(self, word: str, edits: int = 1, trie: dict | None = None) -> tuple[float, bool] | None:
        """The best entry (of ``trie``, else of all) within ``edits`` and the bounds of word and entry."""
        n, bound = len(word), min(edits, allowed(len(word)))
        best: tuple[float, bool] | None = None
        # automaton states along the trie: letters of the word read, edits so far, depth of the entry
        stack, seen = [(self.trie if trie is None else trie, 0, 0, 0)], set()
        while stack:
            node, i, edits, depth = stack.pop()
            if (state := (id(node), i, edits)) in seen:
                continue
            seen.add(state)
            whole, start, after = node.get("whole"), node.get("start"), node.get("next", {})
            if whole is not None and edits + n - i <= min(bound, allowed(depth)):
                rated = (whole * (1 - 0.2 * (edits + n - i)), edits + n > i)
                best = rated if best is None or (rated[0], not rated[1]) > (best[0], not best[1]) else best
            if start is not None and edits <= allowed(depth) and n > i:
                rated = (start * (1 - 0.2 * edits), edits > 0)
                best = rated if best is None or (rated[0], not rated[1]) > (best[0], not best[1]) else best
            if i < n and word[i] in after:
                stack.append((after[word[i]], i + 1, edits, depth + 1))
            if edits < bound:
                if i < n:
                    stack.append((node, i + 1, edits + 1, depth))
                for ch, child in after.items():
                    stack.append((child, i, edits + 1, depth + 1))
                    if i < n and ch != word[i]:
                        stack.append((child, i + 1, edits + 1, depth + 1))
        return best


_BUILT: dict[str, Lexicon] = {}


def built_once(token: str, weights: dict[str, float], clean: frozenset[str]) -> Lexicon:
    """The lexicon of a model (``token``) in this worker, with the words that its
    earlier tasks have looked up."""
    if token not in _BUILT:
        _BUILT.clear()  # one model at a time
        _BUILT[token] = Lexicon(weights, clean)
    return _BUILT[token]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """What the regression sees of a text's occurrences of lexicon entries."""
    words = tokens(text)
    found = {w: f for w in set(words) if w not in QUOTES and (f := lexicon.find(w))[0]}
    if not found:
        return [0.0] * FEATURES
    scores, quoted, fuzzy = [], 0.0, 0
    inside = False  # between an odd and an even quotation mark
    for i, word in enumerate(words):
        if word in QUOTES:
            inside = not inside
            continue
        if word not in found:
            continue
        weight, edited = found[word]
        window = words[max(0, i - WINDOW):i + WINDOW + 1]
        marked = inside and not QUOTES.isdisjoint(words[i + 1:i + 8 * WINDOW])
        report = not REPORTING.isdisjoint(window)
        score = weight * (0.3 if marked and report else 0.6 if marked or report else 1.0 if ADDRESS.isdisjoint(window) else 1.25)
        scores.append(score)
        quoted += score if marked or report else 0.0
        fuzzy += edited
    total = sum(scores)
    return [math.log1p(total), max(scores, default=0.0), math.log1p(len(scores)), math.log1p(100 * total / max(50, len(words))), float(bool(scores)),
            quoted / total if total else 0.0, math.log1p(fuzzy)]


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression on features
    scaled by their deviation, by Newton steps that are halved until they help."""
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    x = np.hstack([x / scale, np.ones((len(x), 1))])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (penalty * w * w).sum())

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w += size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return np.r_[w[:-1] / scale, w[-1]]


def distinct_entries(odds: dict[str, float], support: dict[str, int], toxic: int) -> dict[str, float]:
    """Of entries that stand for the same occurrences one each: a beginning whose
    words are many, else the whole word.  ``support``: toxic documents that an
    entry occurs in; how many there are in all (``toxic``) has no say."""
    whole, longer = {}, {}  # the best support among a beginning's words, and one letter on
    for term, n in support.items():
        word = term.removesuffix("$")
        for k in range(4, min(len(word), 6) + 1):
            side = whole if term.endswith("$") else longer if k == len(word) - 1 else {}
            side[word[:k]] = max(n, side.get(word[:k], 0))
    keep = {}
    for term, n in support.items():
        word = term.removesuffix("$")
        above = [support.get(word[:k], 0) for k in (4, 5, 6) if k < len(word)]
        if n < LEAST_DOCS:
            continue
        if term.endswith("$"):
            alone = all(m <= 1.5 * n for m in above)
        else:
            alone = whole.get(word, 0) < n / 1.5 and longer.get(word, 0) < 0.9 * n and all(m <= 1.1 * n for m in above)
        if alone:
            keep[term] = odds[term]
    return keep


def spelled(odds: dict[str, float], support: dict[str, int]) -> dict[str, float]:
    """Whole words with edits, also those that a beginning stands for: a slip may
    lie in the beginning itself."""
    return {term: odds[term] for term, n in support.items() if term.endswith("$") and allowed(len(term) - 1) and n >= LEAST_DOCS}


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Lexicon weights, clean words and regression weights from at most about ``fit_rows`` rows."""
    marked = labels.where(learnable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y_"))
    n = marked.count()
    own = marked.where(sampled(F.col(id_col), fit_rows / max(n, 1))).limit(2 * fit_rows)  # the limit only makes the bound certain
    chosen = F.broadcast(own.select(F.col(id_col).alias("id_"), "y_", sampled(F.col(id_col), 0.5, 5).alias("half_")))
    texts = docs.select(F.col(id_col).alias("doc_"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(chosen, F.col("doc_") == F.col("id_")).select("y_", "half_", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for y, text in zip(batch.column("y_").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen[y > 0].update({e for w in set(tokens(text)) for e in entries_of(w)} | {""})
            terms = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[0][t] for t in terms], pa.int64()), pa.array([seen[1][t] for t in terms], pa.int64())], names=["term", "neg", "pos"])

    counts = rows.where("half_").select("y_", "text").mapInArrow(count, "term string, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    counts = written(counts, "lexicon-counts")
    total = counts.where("term = ''").first()
    if total is None or not total["pos"] or not total["neg"]:
        return {}, frozenset(), None
    odds = F.log((F.col("pos") + 0.5) / (total["pos"] + 1.0)) - F.log((F.col("neg") + 0.5) / (total["neg"] + 1.0))
    terms = (counts.where((F.col("term") != "") & (F.col("pos") >= LEAST_DOCS)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
             .where("neg * 20 <= pos").orderBy(F.desc("pos"), "term").limit(LEXICON).collect())
    odds, support = {r["term"]: float(r["odds"]) for r in terms}, {r["term"]: r["pos"] for r in terms}
    weights = distinct_entries(odds, support, total["pos"]) | spelled(odds, support)

    def misread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = Lexicon(weights)
        for batch in batches:
            yield batch.filter(pa.array([built.find(t[:-1])[1] for t in batch.column("term").to_pylist()], pa.bool_()))

    clean = counts.where("neg > 0 AND neg * 20 > pos AND term LIKE '%$'").select("term").mapInArrow(misread, "term string")
    clean = written(clean, "clean-words").collect()
    clean = frozenset(r["term"][:-1] for r in clean)
    sc = docs.sparkSession.sparkContext
    lexicon = sc.broadcast((weights, clean))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = Lexicon(*lexicon.value)
        for batch in batches:
            x = [features(t, built) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y_"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    own = rows.where("NOT half_").select("y_", "text").mapInArrow(describe, "y int, x array<double>").toPandas()
    if own["y"].nunique() < 2:
        return weights, clean, None
    return weights, clean, regression(np.array(own["x"].tolist()), own["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row with score and predicted."""
    shared, token = docs.sparkSession.sparkContext.broadcast(model), os.urandom(8).hex()
    keep = others(keep, ["score", "predicted"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, clean, coefs = shared.value
        built = built_once(token, weights, clean)
        for batch in batches:
            x = np.array([features(t, built) for t in batch.column(len(keep)).to_pylist()]).reshape(-1, FEATURES)
            s = np.zeros(len(x)) if coefs is None else 1 / (1 + np.exp(-np.clip(x @ coefs[:-1] + coefs[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = "".join(f"`{c}` {t}, " for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, F.col(text_col).alias(free_name(docs, "text_"))).mapInArrow(judge, f"{schema}score double, predicted int")
