"""Operator 7: secret scan with random forests (DataFrame functions and
pyspark.ml only).

Candidates are runs of LEAST_CHARS or more letters, digits and + / _ -, with = at
their end, and every value, whatever its length and signs, that is assigned to or
quoted after a credential's word (a quoted value may hold blanks, SPAN words at
most).  Equal values that start in one word, of which one is named by a credential,
are one candidate.  Each gets features: length, character transitions (changes
between lower case, upper case, digits and others, per character), shares of digits
and capitals, distinct characters, dictionary coverage (share of its characters in
the corpus's DICTIONARY_WORDS most frequent words), the path (test, example and lock
files; here the document's source), and the neighbouring words (words of credentials
before it, an assignment or quotation mark, words of placeholders around): the
NEIGHBOURS words on each side, CONTEXT characters at most.  A random forest trained
from labelled findings scores each candidate; those of 0.5 or more are secrets, the
rest false positives.

``labelled`` findings are given by the caller: rows of ``findings`` with a label.  A
corpus without any is labelled in two views, each from what its forest does not see:
the forest of VALUE features learns from findings labelled by their surroundings
(assigned to a credential's name, or no such name near), the forest of SURROUNDINGS
from findings labelled by their value (letters and digits mixed; letters only, digits
only or a placeholder).  The score is the root of the product of both, so a secret
has to look like one and stand where one stands.  Each forest is trained on a keyed
sample of about FIT_ROWS findings of each label.

Defined results: null and empty texts have no candidates; rows that repeat are
scanned each; without labelled findings of both kinds (in both views) score is null
and every candidate stays a secret (nothing is dismissed without a model); an empty
table gives an empty result; other columns are not read.  The work on a text grows in
proportion to its length, also where it is one word.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jestframe.llm.common import bound, written

LEAST_CHARS = 16
FIT_ROWS = 20_000
TREES, DEPTH = 30, 6
NEIGHBOURS, CONTEXT = 3, 200
SPAN = 24
DICTIONARY_WORDS = 2_000
CHUNK = 128

# Words of credentials, of placeholders and of test files.
CREDENTIAL = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credential|auth|bearer)"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|your[_-]|changeme|xxxx|test|fake|todo|redacted)"
TEST_PATH = r"(?i)(test|example|sample|docs?|lock|fixture|demo)"

# Patterns consume a run, or what is before a named value; the value and what follows are looked ahead at.
FOLLOWING = rf"([\s\S]{{0,{CONTEXT}}})"
RUN = rf"([A-Za-z0-9+/_-]{{{LEAST_CHARS},}}={{0,2}})"
NAME = CREDENTIAL + r"[\w.-]{0,64}\\*[\"'`\])]*\s*"  # with its end; two groups within
QUOTED = "(" + NAME + r"(?:[:=,]+>?\s*|(?<=\s))\\*([\"'`]))" + rf"(?=(\S\S*?(?: \S*?){{0,{SPAN - 1}}}?)(\\*\4[\s\S]{{0,{CONTEXT}}}))"
BARE = "(" + NAME + r"[:=]+>?\s*(?:(?:bearer|basic)\s+)?)(?=([^\s\"'`,;]+)" + FOLLOWING + ")"

VALUE = ["n_chars", "transitions", "digits", "capitals", "distinct", "dictionary", "hex", "placeholder"]
SURROUNDINGS = ["in_test_path", "credential_near", "assigned", "quoted", "placeholder_near"]
FEATURES = VALUE + SURROUNDINGS
FOUND = "array<struct<word_no:int,value:string,named:boolean,before:string,after:string>>"


def running_totals(values: Column) -> Column:
    """The sum up to and with each element, by totals of chunks."""
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda s, x: s + x)

    def by_chunk(v: Column) -> Column:
        starts = F.filter(F.transform(v, lambda _, i: i), lambda i: i % CHUNK == 0)
        sums = F.transform(starts, lambda s: total(F.slice(v, s + 1, F.lit(CHUNK))))
        before = bound(sums, lambda c: F.transform(c, lambda _, i: total(F.slice(c, F.lit(1), i))))
        return bound(before, lambda b: F.transform(v, lambda _, i: F.get(b, F.floor(i / CHUNK).cast("int")) + total(F.slice(v, i - i % CHUNK + 1, i % CHUNK + 1))))

    return bound(values, by_chunk)


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def matches(text: Column, pattern: str, *, value: int, after: int, named: bool) -> Column:
    """word_no, value, named, before, after of each match of ``pattern`` in a text
    whose words are parted by one blank."""
    least = 4 if named else LEAST_CHARS  # characters that a match consumes
    back = CONTEXT // least + 1  # so many stretches, each a match and the gap after it, hold CONTEXT characters
    parts = F.struct(F.split(text, pattern).alias("gaps"), *[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(name)
                                                             for name, g in (("taken", 1), ("value", value), ("after", after))])

    def place(p: Column) -> Column:
        stretches = F.transform(p["gaps"], lambda gap, i: F.concat(F.coalesce(F.get(p["taken"], i - 1), F.lit("")), gap))
        at = bound(stretches, lambda s: F.struct(running_totals(F.transform(s, blanks)).alias("words"), F.transform(s, lambda x: F.right(x, F.lit(CONTEXT))).alias("ends")))
        head = (lambda i: F.get(p["taken"], i)) if named else (lambda i: F.lit(""))
        return bound(at, lambda a: F.transform(p["value"], lambda v, i: F.struct(
            (F.get(a["words"], i) + blanks(head(i))).cast("int").alias("word_no"), v.alias("value"), F.lit(named).alias("named"),
            near(F.concat(F.array_join(F.slice(a["ends"], F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back)) + 1), ""), head(i))).alias("before"),
            F.substring_index(F.left(F.get(p["after"], i), F.lit(CONTEXT)), " ", NEIGHBOURS + 1).alias("after"))))

    return bound(parts, place)


def near(before: Column) -> Column:
    return F.substring_index(F.right(before, F.lit(CONTEXT)), " ", -NEIGHBOURS - 1)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, word_no, value, before, after, path: a row per candidate."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.regexp_replace(F.col(text_col), r"\s+", " ").alias("line"))
    line = F.col("line")
    runs = matches(line, RUN + f"(?={FOLLOWING})", value=1, after=2, named=False)
    named = F.concat(matches(line, QUOTED, value=5, after=6, named=True), matches(line, BARE, value=4, after=5, named=True))
    # the cheap searches first: most texts have neither
    found = F.concat(F.when(line.rlike(RUN), runs).otherwise(F.array().cast(FOUND)), F.when(line.rlike(CREDENTIAL), named).otherwise(F.array().cast(FOUND)))

    def once(all_: Column) -> Column:
        def again(f: Column, i: Column) -> Column:
            last = F.get(all_, i - 1)
            return f["named"] & (i > 0) & (last["word_no"] == f["word_no"]) & (last["value"] == f["value"])

        return F.filter(all_, lambda f, i: ~F.coalesce(again(f, i), F.lit(False)))

    at = texts.where("line IS NOT NULL").select("doc_id", "path", F.explode(bound(F.sort_array(found), once)).alias("found"))
    return at.select("doc_id", F.col("found.word_no").cast("long").alias("word_no"), F.coalesce("path", F.lit("")).alias("path"), "found.value", "found.before", "found.after")


def frequent_words(docs: DataFrame, text_col: str = "text", n: int = DICTIONARY_WORDS) -> list[str]:
    """The ``n`` most frequent words of 4 to 12 letters that stand alone in the
    texts and occur 3 times or more, ties by word; ``n`` bounds what the driver gets."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"(?<!\S)\p{L}{4,12}(?!\S)"), F.lit(0))).alias("word"))
    counts = words.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(n).collect()]


def any_of(words: list[str]) -> str:
    """A pattern that matches the longest of ``words``, letter by letter."""
    tails: dict[str, list[str]] = {}
    for word in words:
        if word:
            tails.setdefault(word[0], []).append(word[1:])
    some = "(?:" + "|".join(re.escape(c) + any_of(t) for c, t in sorted(tails.items())) + ")" if tails else ""
    return some + "?" if some and "" in words else some


def with_features(found: DataFrame, dictionary: list[str] | tuple[str, ...] = ()) -> DataFrame:
    value, n = F.col("value"), F.length("value")

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(value, pattern, "")) / n

    flag = {
        "hex": value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "placeholder": value.rlike(PLACEHOLDER),
        "in_test_path": F.col("path").rlike(TEST_PATH), "credential_near": F.col("before").rlike(CREDENTIAL),
        "assigned": F.col("before").rlike(r"[:=]>?\s*[\"'`]?$"), "quoted": F.col("before").rlike("[\"'`]$"),
        "placeholder_near": F.concat_ws(" ", "before", "after").rlike(PLACEHOLDER),
    }
    changes = r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]"
    covered = 1 - F.length(F.regexp_replace(F.lower(value), any_of(list(dictionary)), "")) / F.length(F.lower(value)) if dictionary else F.lit(0.0)
    return found.select(
        "*", n.cast("double").alias("n_chars"), (F.regexp_count(value, F.lit(changes)) / n).alias("transitions"), share("[^0-9]").alias("digits"), share("[^A-Z]").alias("capitals"),
        (F.size(F.array_distinct(F.split(value, ""))) / n).alias("distinct"), covered.alias("dictionary"),
        *[c.cast("double").alias(name) for name, c in flag.items()])


def findings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """All candidates with FEATURES, written: what labels are given for."""
    return written(with_features(candidates(docs, id_col, text_col, path_col), frequent_words(docs, text_col)), "findings")


def labels_by_surroundings() -> Column:
    return (F.when((F.col("credential_near") == 1) & (F.col("assigned") == 1) & (F.col("placeholder_near") == 0) & (F.col("in_test_path") == 0), 1.0)
            .when(F.col("credential_near") == 0, 0.0))


def labels_by_value() -> Column:
    mixed = (F.col("digits") > 0) & (F.col("digits") < 1) & ~F.col("value").rlike(r"(.)\1{5}")
    return F.when((F.col("digits") == 0) | (F.col("digits") == 1) | (F.col("placeholder") == 1), 0.0).when(mixed, 1.0)


def train(labelled: DataFrame, features: list[str] = FEATURES, fit_rows: int = FIT_ROWS) -> RandomForestClassificationModel | None:
    """The forest over a keyed sample of about ``fit_rows`` findings of each label."""
    labelled = labelled.where("label IS NOT NULL")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(counts) != {0.0, 1.0}:
        return None
    share = F.when(F.col("label") == 1.0, min(1.0, fit_rows / counts[1.0])).otherwise(min(1.0, fit_rows / counts[0.0]))
    own = labelled.where(F.pmod(F.xxhash64(F.lit(29), "doc_id", "word_no", "value"), F.lit(1_000_003)) < share * 1_000_003)
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(own).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=31).fit(rows)


def rated(found: DataFrame, model: RandomForestClassificationModel, features: list[str], name: str) -> DataFrame:
    """``found`` with the probability of a secret as column ``name``."""
    out = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(found))
    return out.select(*found.columns, vector_to_array("probability")[1].alias(name))


def scan(docs: DataFrame, labelled: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, word_no, value, path, score and is_secret of every candidate.

    ``labelled``: rows of ``findings`` (FEATURES, doc_id, word_no, value) with label 0.0 or 1.0."""
    found = findings(docs, id_col=id_col, text_col=text_col, path_col=path_col)
    if labelled is None:
        views = [(VALUE, train(found.withColumn("label", labels_by_surroundings()), VALUE)), (SURROUNDINGS, train(found.withColumn("label", labels_by_value()), SURROUNDINGS))]
    else:
        views = [(FEATURES, train(labelled))]
    own = ["doc_id", "word_no", "value", "path"]
    if any(model is None for _, model in views):
        return found.select(*own, F.lit(None).cast("double").alias("score"), F.lit(True).alias("is_secret"))
    out, scores = found, [f"by_{i}" for i in range(len(views))]
    for name, (features, model) in zip(scores, views):
        out = rated(out, model, features, name)
    score = F.sqrt(F.col(scores[0]) * F.col(scores[1])) if len(scores) == 2 else F.col(scores[0])
    return out.select(*own, score.alias("score")).withColumn("is_secret", F.col("score") >= 0.5)
