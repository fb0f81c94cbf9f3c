import hashlib
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from jestframe.llm import secrets

NAMES = ["token", "secret", "password", "passwor", "passwd", "passw", "pwd", "api_key", "api-key", "apikey", "access_key", "access-key", "accesskey",
         "private_key", "private-key", "privatekey", "credential", "auth", "bearer"]
HOLDERS = ["example", "sample", "dummy", "placeholder", "your_", "your-", "changeme", "xxxx", "test", "fake", "todo", "redacted"]
DOCS = "doc_id long, text string, source string, score string"


def corpus(n=300):
    rng, rows = random.Random(4), []
    for i in range(n):
        value = hashlib.sha1(str(i).encode()).hexdigest()
        rows.append((i, f"some words here token = \"{value}\" and more", "src/app.py", "clash"))
        rows.append((1000 + i, "an " + "".join(rng.choice(["tion", "the", "ing", "er", "mo", "la"]) for _ in range(9)) + " word", "src1", ""))
        rows.append((2000 + i, f"number {rng.randrange(10 ** 19):020d} of a card", "src2", ""))
        rows.append((3000 + i, f"api_key = \"your-{value[:24]}\" is an example", "docs/test.md", ""))
    return rows


def test_false_positives_are_removed(spark):
    out = secrets.scan(spark.createDataFrame(corpus(), DOCS)).collect()
    by_kind = [[r for r in out if r.doc_id // 1000 == k] for k in range(4)]
    assert [len(k) for k in by_kind] == [300] * 4
    assert sum(r.is_secret for r in by_kind[0]) >= 297
    assert sum(r.is_secret for k in by_kind[1:] for r in k) <= 9
    assert all(r.value == hashlib.sha1(str(r.doc_id).encode()).hexdigest() for r in by_kind[0])


def test_held_out_findings(spark):
    """Train on labelled findings of some documents, judge the others."""
    found = secrets.with_features(secrets.candidates(spark.createDataFrame(corpus(), DOCS)))
    labelled = found.withColumn("label", (F.col("doc_id") < 1000).cast("double"))
    rows = spark.createDataFrame(corpus(), DOCS)
    out = secrets.scan(rows, labelled.where("doc_id % 2 = 0")).where("doc_id % 2 = 1").collect()
    assert sum((r.doc_id < 1000) == r.is_secret for r in out) >= 0.98 * len(out)


def test_candidates_and_edge_cases(spark):
    texts = [None, "", "short words only", "a=ABCDEF0123456789abcd;b=ZYXWVU9876543210zyxw==", "x " * 3000 + "Q" * 40]
    docs = spark.createDataFrame([(i, t, None, "") for i, t in enumerate(texts)] + [(3, texts[3], "again", "")], DOCS)
    found = secrets.candidates(docs).orderBy("doc_id", "value").collect()
    assert [(r.doc_id, r.value) for r in found] == [(3, "ABCDEF0123456789abcd")] * 2 + [(3, "ZYXWVU9876543210zyxw==")] * 2 + [(4, "Q" * 40)]
    assert found[0].before == "a=" and found[2].before.endswith("b=") and found[4].word_no == 3000
    out = secrets.scan(docs, secrets.with_features(secrets.candidates(docs)).withColumn("label", F.lit(1.0))).collect()
    assert len(out) == 5 and all(r.score is None and r.is_secret for r in out)
    assert secrets.scan(docs.limit(0)).count() == 0


def test_values_of_any_length_after_a_credential(spark):
    texts = ['the password = "Tr0ub4dor&3" here', "pwd: hunter2!x", '{"api_key": "k9$Qz1", "n": 1}', "passwd='a b c' and", 'passwd "x;y" token:ab12cd34', "db_password=p@ss,w=1 secret = s3",
             'a password and a token", he said "no" of it', "pwd: x1 pwd: x1", "k=" + "Q1" * 10 + " token=" + "Z9" * 10, 'set("PASSWORD", "q!")']
    found = secrets.candidates(spark.createDataFrame([(i, t, None, "") for i, t in enumerate(texts)], DOCS)).orderBy("doc_id", "word_no").collect()
    assert [(r.doc_id, r.word_no, r.value) for r in found] == [
        (0, 3, "Tr0ub4dor&3"), (1, 1, "hunter2!x"), (2, 1, "k9$Qz1"), (3, 0, "a b c"), (4, 1, "x;y"), (4, 2, "ab12cd34"), (5, 0, "p@ss"), (5, 3, "s3"),
        (7, 1, "x1"), (7, 3, "x1"), (8, 0, "Q1" * 10), (8, 1, "Z9" * 10), (9, 1, "q!")]
    assert found[0].before == 'the password = "' and found[0].after == '" here' and found[3].before == "passwd='" and found[6].after == ",w=1 secret = s3"
    out = secrets.scan(spark.createDataFrame([*corpus(), (9000, texts[0], "src/app.py", "")], DOCS)).where("doc_id = 9000").collect()
    assert [(r.value, r.is_secret) for r in out] == [("Tr0ub4dor&3", True)]


def test_no_python_on_the_main_path(spark):
    plan = secrets.scan(spark.createDataFrame(corpus(40), DOCS))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def plain_candidates(text):
    """(word_no, value, before, after) by hand: every start is tried, no offsets are carried along."""
    line = re.sub(r"\s+", " ", text, flags=re.A)
    starts = [(m.start(), m[0], False) for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}={0,2}", line)]
    name = re.compile("(?:" + "|".join(NAMES) + ")" + r"[\w.-]{0,64}\\*[\"'`\])]*\s*", re.I | re.A)

    def ends(pattern):  # of the heads, each searched for from the end of the one before
        at = 0
        while (m := pattern.search(line, at)) is not None:
            at = m.end()
            yield m

    quoted = re.compile(name.pattern + r"(?:[:=,]+>?\s*|(?<=\s))\\*([\"'`])(?=\S(.*?)\\*\1)", re.I | re.A)
    for m in ends(quoted):
        value = line[m.end():m.end() + 1 + len(m[2])]
        if value.count(" ") < secrets.SPAN:
            starts.append((m.end(), value, True))
    for m in ends(re.compile(name.pattern + r"[:=]+>?\s*(?:(?:bearer|basic)\s+)?(?=[^\s\"'`,;])", re.I | re.A)):
        starts.append((m.end(), re.match(r"[^\s\"'`,;]+", line[m.end():], re.A)[0], True))
    out, seen = [], set()
    for at, value, named in sorted(starts, key=lambda f: f[2]):
        key = (line[:at].count(" "), value)
        if named and key in seen:
            continue
        seen.add(key)
        before, after = line[max(0, at - 200):at], line[at + len(value):][:200]
        out.append((*key, " ".join(before.split(" ")[-4:]), " ".join(after.split(" ")[:4])))
    return sorted(out)


def plain_features(value, before, after, path, words):
    def kind(c):
        return "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "-"

    n, rest, at = len(value), 0, 0
    while at < n:
        fits = max((len(w) for w in words if value.lower().startswith(w, at)), default=0)
        rest, at = rest + (fits == 0), at + max(fits, 1)
    lower = before.lower()
    return [n, sum(kind(a) != kind(b) for a, b in zip(value, value[1:])) / n, sum(map(str.isdigit, value)) / n, sum(kind(c) == "A" for c in value) / n, len(set(value)) / n, 1 - rest / n,
            all(c in "0123456789abcdef" for c in value) or all(c in "0123456789ABCDEF" for c in value), any(h in value.lower() for h in HOLDERS),
            any(t in path.lower() for t in ("test", "example", "sample", "doc", "lock", "fixture", "demo")), any(n in lower for n in NAMES),
            re.search(r"[:=]>?\s*[\"'`]?$", before) is not None, before[-1:] in ("'", '"', "`") and before != "", any(h in f"{before} {after}".lower() for h in HOLDERS)]


def test_candidates_and_features_equal_brute_force(spark):
    rng = random.Random(12)
    parts = [" ", " ", "\n", "  ", "token", "API_KEY", "pwd", "secret_name", "=", ": ", " = ", "=>", '"', "'", "`", "\\", ",", ";", ")", "bearer ", "word", "example", "a1B2c3D4e5F6g7H8", "0123456789abcdef0",
             "ABCDEFABCDEFABCDEF==", "x y z", "hunter2", "p@ss!", "más", "die", "+/", "testword", "verylongwordsinthetext", "q" * 150]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(400)] + ["word word words text word text text words words", "token=" + "a" * 400 + "1 end", "token='" + "b " * 23 + "c' x", "token='" + "b " * 24 + "c' x"]
    paths = ["src/a.py", "tests/b.py", "package.lock"]
    docs = spark.createDataFrame([(i, t, paths[i % 3], "") for i, t in enumerate(texts)], DOCS)
    words = Counter(w.lower() for t in texts for w in re.split(r"[\s]+", t, flags=re.A) if re.fullmatch(r"[^\W\d_]{4,12}", w))
    dictionary = secrets.frequent_words(docs)
    assert dictionary == [w for w, n in sorted(words.items(), key=lambda e: (-e[1], e[0])) if n >= 3] and len(dictionary) >= 2
    got = {}
    for r in secrets.findings(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    n = 0
    for i, text in enumerate(texts):
        mine = sorted(got.get(i, []), key=lambda r: (r.word_no, r.value, r.before, r.after))
        assert [(r.word_no, r.value, r.before, r.after) for r in mine] == plain_candidates(text), text
        for r in mine:
            wanted = plain_features(r.value, r.before, r.after, r.path, dictionary)
            assert all(abs(r[f] - w) < 1e-9 for f, w in zip(secrets.FEATURES, wanted)), r
            n += 1
    assert n > 500


def test_labels_are_not_read_from_the_features_they_train(spark):
    """Surroundings label for the forest of values, and the other way round."""
    for column, own in ((secrets.labels_by_surroundings(), secrets.VALUE), (secrets.labels_by_value(), secrets.SURROUNDINGS)):
        assert not any(re.search(rf"\b{f}\b", str(column)) for f in own)


def test_time_grows_with_the_length_of_a_text(spark):
    """Many assignments, over words and in one word."""
    def seconds(n, joint):
        text = joint.join(f"token_{i}=value{i}" + "x1" * 8 for i in range(n))
        docs = spark.createDataFrame([(1, text, "src", "")], DOCS)
        start = time.time()
        assert secrets.candidates(docs).count() >= n
        return time.time() - start

    for joint in (" ", ";"):
        seconds(500, joint)
        small, large = seconds(1_000, joint), seconds(16_000, joint)  # the square would be 256 times
        assert large < 16 * max(small, 0.5)
