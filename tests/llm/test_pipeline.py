import re

from pyspark.sql import functions as F

import corpus_pipeline
from jestframe.llm import decontaminate
from jestframe.llm.common import read_table, written

from conftest import SF_SMALL
from test_line_dedup import by_rule as lines_by_rule
from test_minhash import by_rule as copies_by_rule


def test_stages_against_brute_force(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    bench = [(r.item_id, r.text) for r in read_table(spark, SF_SMALL, "benchmark").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights"]

    def run(name):
        nonlocal docs
        docs = written(stages[name](spark, docs, SF_SMALL), "test")
        return {r.doc_id: r for r in docs.collect()}

    out = run("language ID")
    assert set(out) == {i for i, t in rows.items() if t and any(map(str.isalpha, t))} and docs.columns == corpus_pipeline.COLUMNS
    rows = {i: rows[i] for i in out}
    before, rows = rows, lines_by_rule(rows)
    out = run("line dedup")
    want = {i: t for i, t in rows.items() if t == before[i] or t.split()}
    assert {i: r.text for i, r in out.items()} == want and all(r.n_chars == len(r.text) for r in out.values() if r.text != before[r.doc_id])
    comps = copies_by_rule(sorted(want.items()), 5)
    out = run("MinHash near-dedup")
    assert set(out) == {c for c, _ in comps.values()}
    own = decontaminate.ItemIndex([(k, w) for k, t in bench if (w := decontaminate.words_of(t))], 5)
    joined = {k: " ".join(decontaminate.words_of(t)) for k, t in bench}
    kept = set(out)
    out = run("benchmark decontamination")
    leaks = {i for i in kept if any(j in " ".join(decontaminate.words_of(want[i])) for j in joined.values())}
    assert leaks and not leaks & set(out) and all(own.matches(want[i], 0.8) for i in kept - set(out)) and docs.columns == corpus_pipeline.COLUMNS
    rows = {i: r.text for i, r in out.items()}
    mixed = stages["mixing sources to target weights"](spark, docs, SF_SMALL).collect()
    size = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in rows.items()}
    assert all(r.text.split(" ") == size[r.doc_id][r.first_word:r.first_word + r.words] for r in mixed)
    total = sum(map(len, size.values()))
    assert abs(sum(r.words for r in mixed) - 1.5 * total) <= len({r.source for r in mixed})


def test_run_equals_its_stages_on_odd_rows(spark, tmp_path):
    line = "a sentence of quite a few common words that is repeated"
    rows = [(1, line, None, "a", 1), (2, line, "en", "a", None), (None, "a null id keeps its own text here", "en", None, 3), (3, None, "en", "b", 0), (4, "", "en", "b", 0),
            (5, "12 34", "en", "b", 5), (6, "one two three", "en", "b", 13), (6, "one two three", "en", "b", 13), (7, "wörter " * 5000, "de", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("words").alias("n")).collect()
    assert {r.doc_id for r in out} <= {1, None, 6, 7} and {r.doc_id for r in out} >= {1, 7}
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
