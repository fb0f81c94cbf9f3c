import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from jestframe.llm import line_dedup, queries
from jestframe.llm.line_dedup import LEAST_WORDS, NEAR_WORDS

DOCS = "doc_id long, text string, n_lines string"


def within_one(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def by_rule(docs, near_words=NEAR_WORDS, least_words=LEAST_WORDS):
    """Every line against every earlier line."""
    earlier, out = [], {}
    for i, text in sorted(docs.items()):
        kept = []
        for line in (text or "").split("\n"):
            w = line.lower().split()
            gone = len(w) >= least_words and any(w == e or (max(len(w), len(e)) >= near_words and within_one(w, e)) for e in earlier)
            if len(w) >= least_words:
                earlier.append(w)
            if not gone:
                kept.append(line)
        out[i] = None if text is None else "\n".join(kept)
    return out


def test_against_every_pair(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 14))] for _ in range(25)]
    docs = {}
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w[at:at + rng.choice([0, 1])] = [rng.choice(vocab)] * rng.choice([0, 1])
            lines.append(rng.choice(["  ", ""]) + " ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
        docs[i] = "\n".join(lines)
    docs |= {90: None, 91: "", 92: "\n\n", 93: " ".join(["long"] * 3000) + "\n" + " ".join(["long"] * 3000 + ["end"])}
    out = line_dedup.dedup_lines(spark.createDataFrame([(i, t, "clash") for i, t in docs.items()], DOCS)).collect()
    assert {r.doc_id: r.text for r in out} == by_rule(docs)
    assert any(r.n_dropped for r in out)


@pytest.mark.parametrize("near_words, least_words", [(3, 3), (2, 1), (5, 2)])
def test_short_lines_by_parameter(spark, near_words, least_words):
    """Edits in lines of any size, held against every pair."""
    rng = random.Random(near_words)
    docs = {i: "\n".join(" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:30 - 4 * near_words]) for _ in range(rng.choice([1, 2, 3, 3, 4, 5, 6, 7, 9]))) for _ in range(4)) for i in range(60)}
    out = line_dedup.dedup_lines(spark.createDataFrame([(i, t, "clash") for i, t in docs.items()], DOCS), near_words=near_words, least_words=least_words).collect()
    wanted = by_rule(docs, near_words, least_words)
    assert {r.doc_id: r.text for r in out} == wanted and wanted != by_rule(docs, 100, least_words)


def test_edge_cases(spark):
    line = "one two three four five six seven eight"
    rows = [(2, line, "a"), (1, line + "\nother words here", "b"), (None, line, "c"), (3, "new line that is here", "d"), (3, "new line that is here", "e"), (3, "x\n" + line.replace("five", "5"), "f")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, extra string")).collect()
    got = {r.extra: (r.text, r.n_dropped) for r in out}
    assert got == {"b": (rows[1][1], 0), "a": ("", 1), "c": ("", 1), "d": (rows[3][1], 0), "e": (rows[4][1], 0), "f": ("x", 1)}
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_lines_make_no_pairs(spark):
    """Thousands of lines that differ in one word: the earliest stays."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("this line is the same but for word "), F.col("id"), F.lit(" at its end")).alias("text"))
    assert line_dedup.dedup_lines(docs).where("n_dropped = 0").select("doc_id").collect() == [(0,)]


def test_clashing_names(spark):
    """Columns named as the operator's own, inner and outer ones, stay usable."""
    line = "one two three four five six seven eight"
    docs = spark.createDataFrame([(i, line, 1, 2, 3, 4, "c", 5, 6, 7, 8) for i in range(3)], "doc_id long, text string, `row` int, doc int, last int, _gone int, n_lines string, pos int, gone int, gone_at int, h1 int")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "row", "doc", "last", "_gone", "pos", "gone", "gone_at", "h1", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.text, r.gone, r.n_lines, r.n_dropped) for r in out.collect()) == [(0, line, 6, 1, 0), (1, "", 6, 1, 1), (2, "", 6, 1, 1)]


def test_prefix_hashes_agree_with_prefixes(spark):
    """Equal prefixes of any length, across chunk borders, have equal hashes, others not."""
    words = [f"w{i}" for i in range(3 * line_dedup.CHUNK + 5)]
    other = list(words)
    other[2 * line_dedup.CHUNK + 1] = "x"
    rows = spark.createDataFrame([(words,), (other,), (words[:line_dedup.CHUNK],), (words[:1],)], "w array<string>").select(line_dedup.prefixes(F.col("w")).alias("p")).collect()
    a, b, c, d = (r.p for r in rows)
    assert [len(x) for x in (a, b, c, d)] == [len(words) + 1, len(words) + 1, line_dedup.CHUNK + 1, 2]
    at = 2 * line_dedup.CHUNK + 2
    assert a[:at] == b[:at] and not set(a[at:]) & set(b[at:]) and len(set(a)) == len(a)
    assert a[:line_dedup.CHUNK] == c[:-1] and a[:1] == d[:1] and a[1] == d[1]


def test_long_lines_cost_their_length(spark):
    """Ten times the words take far less than a hundred times as long."""
    def took(n):
        text = " ".join(f"w{i % 977}" for i in range(n))
        docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, text.replace("w5 ", "other ", 1))], "doc_id long, text string")
        start = time.perf_counter()
        assert sorted((r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(docs).select("doc_id", "n_dropped").collect()) == [(1, 0), (2, 1), (3, 1)]
        return time.perf_counter() - start

    took(1000)
    short, long = took(10_000), took(200_000)
    assert long < 20 * short + 10


def test_query_equals_its_sql(spark, tmp_path):
    """The registered query, as it is, on a table with extra columns."""
    line = "a line of eight words that comes back often"
    rows = [(i, "\n".join([line if i % 3 else line.replace("eight", f"n{i}"), f"own line number {i} here"] * (i % 4)), "x") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, n_lines string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, text FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(queries.ORACLE_SQL["op5_line_dedup"]).fetchall()
    assert sorted(map(tuple, queries.op5_line_dedup(spark, str(tmp_path)).collect())) == sorted(want)
