import random
import re
import zlib
from collections import Counter

from jestframe.llm import queries, spelling

DOCS = "doc_id long, text string, word string, n int, id int, `key` string"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1:]


def brute(counts, ratio=5):
    own, form = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x)) if others else None
        own[w] = (len(others), best)
        if best and counts[best] >= ratio * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, own[w][0], counts[form[w]] if w in form else None))
    return sorted(out)


def words(rng):
    """Words with many neighbours: few letters, runs of equal ones, accents, the mark, long ones."""
    counts = {}
    for _ in range(500):
        w = "".join(rng.choice("aabé") for _ in range(rng.randint(1, 7)))
        counts[w] = rng.choice([1, 1, 2, 5, 30, 200])
    for size in (spelling.LONG - 2, spelling.LONG - 1, spelling.LONG, spelling.LONG + 1, spelling.LONG + 2, 300):
        stem = "".join(rng.choice("abz") for _ in range(size))
        counts[stem] = 1000
        for _ in range(12):
            i = rng.randrange(size)
            counts[rng.choice([stem[:i] + stem[i + 1:], stem[:i] + "é" + stem[i + 1:], stem[:i] + stem[i] + stem[i:], stem[:i] + "𝒳" + stem[i:]])] = rng.randint(1, 900)
    counts |= {"a" * n: 3 + n for n in range(60, 70)} | {"abcdef": 1, "abcdeg": 5, "abcdhg": 25, "abcihg": 125, "abjihg": 625, "akjihg": 625}
    return counts


def test_against_all_pairs(spark):
    counts = words(random.Random(3))
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute(counts)
    two = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), ratio=2)
    assert sorted(map(tuple, two.collect())) == brute(counts, 2)


def test_long_words_cost_their_length(spark):
    rows = [("x" * 400_000, 9), ("x" * 399_999, 50), ("x" * 200_000 + "y" + "x" * 199_999, 5)]
    got = spelling.variants(spark.createDataFrame(rows, "word string, n long")).select("n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == [(5, 2, 50), (9, 2, 50), (50, 2, None)]


def corpus(spark):
    rng = random.Random(5)
    stems = ["Spelling", "variant", "grouping", "naïveté", "Ünicode", "aaaaaa", "ÀÉÎõüÿ", "short"]
    rows = []
    for i in range(300):
        text = [rng.choice(stems) for _ in range(rng.randint(0, 30))]
        text = [w if rng.random() < 0.8 else w[:2] + rng.choice("xyz") + w[3:] for w in text]
        rows.append((i, rng.choice([" ", "\n", "7", "_", "ß-", "€"]).join(text), "w", 1, 2, "k"))
    rows += [(None, "Spelling variant", "w", 1, 2, "k")] * 7 + [(5, None, None, None, None, None), (5, "", "", 0, 0, ""), (6, "grouping " * 30_000, "", 0, 0, "")]
    return spark.createDataFrame(rows, DOCS), rows


def counted(rows):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_query(spark, tmp_path):
    docs, rows = corpus(spark)
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_spelling_variants(spark, str(tmp_path))
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    want = brute(counted(rows))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20 and any(w[1] for w in want)


def test_without_edits_and_empty(spark):
    docs, rows = corpus(spark)
    got = {r.word: r.n for r in spelling.vocabulary(docs, least_letters=1, least_count=1).collect()}
    plain = Counter(re.sub("[A-Z]", lambda m: m[0].lower(), w) for _, t, *_ in rows for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    assert got == plain
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).count() == 0
    assert [tuple(r) for r in spelling.variants(spark.createDataFrame([("single", 4)], "word string, n long")).collect()] == [("single", None, "single", 4, 0, None)]
