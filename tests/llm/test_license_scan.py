from jestframe.llm import license_scan as L

DOCS = "doc_id long, text string, license string"


def lcs_coverage(template, words):
    """Brute force: most template words in order within any window of the template's size plus the band."""
    best, size = 0, len(template) + L.BAND
    for s in range(len(words)):
        row = [0] * (len(template) + 1)
        for w in words[s:s + size]:
            prev = row[:]
            for j, t in enumerate(template, 1):
                row[j] = prev[j - 1] + 1 if t == w else max(prev[j], row[j - 1])
        best = max(best, row[-1])
    return best


def test_spans_and_coverage(spark):
    mit = L.TEMPLATES["MIT"]
    changed = mit.replace("copies of the Software, and to permit", "copies of this Program and permit").replace("free of charge, ", "")
    texts = [None, "", "no license here at all", "Éa " + mit + " end", "start " + changed, "Licensed under CC BY-NC 4.0. x", "Licensed under the Apache License",
             "Released under the MIT License. And Released under the MIT License."]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "")]
    out = L.scan(spark.createDataFrame(rows, DOCS), keep=["doc_id"]).orderBy("doc_id", "first_word").collect()
    got = [(r.doc_id, r.license) for r in out]
    assert got == [(3, "MIT"), (3, "MIT"), (4, "MIT"), (5, "CC-BY-NC-4.0 notice"), (7, "MIT notice"), (7, "MIT notice")]
    assert out[0].coverage == 1.0 and texts[3][out[0].span_start:out[0].span_end] == mit.rstrip(".")
    words = L.WORD.findall(texts[4].lower())
    template = L.WORD.findall(mit.lower())
    assert abs(out[2].matched_words - lcs_coverage(template, words)) <= 1 and 0.9 < out[2].coverage < 1


def test_every_template_is_found_in_noise(spark):
    noise = " ".join(f"w{i}" for i in range(300))
    rows = [(i, f"{noise} {t} {noise}") for i, t in enumerate(L.TEMPLATES.values())]
    out = L.scan(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).collect()
    names = list(L.TEMPLATES)
    assert {names[r.doc_id] for r in out if r.license == names[r.doc_id] and r.coverage == 1.0} | {"Apache-2.0 notice"} >= set(names)


def test_empty(spark):
    assert L.scan(spark.createDataFrame([], DOCS), keep=["doc_id", "license"]).count() == 0
    assert L.scan(spark.createDataFrame([(1, "MIT License", "")], DOCS), {}, keep=["doc_id"]).count() == 0


def test_cut_texts_report_their_coverage(spark):
    """A part of a licence is a span with its coverage and no complete one."""
    words = L.TEMPLATES["MIT"].split()
    rows = [(p, "so it says: " + " ".join(words[:len(words) * p // 100]) + " and that is all", "") for p in (20, 50, 70, 79, 90)]
    out = L.scan(spark.createDataFrame(rows, DOCS), keep=["doc_id", "license"]).orderBy("doc_id").collect()
    assert [(r.doc_id, r.license, r.complete) for r in out] == [(p, "MIT", p >= 80) for p in (20, 50, 70, 79, 90)]
    assert all(abs(r.coverage - r.doc_id / 100) < 0.03 for r in out)


def test_licences_that_share_most_words(spark):
    names = ["GPL header", "LGPL header", "AGPL header", "BSD-2-Clause", "BSD-3-Clause"]
    rows = [(i, "İİİİ " + L.TEMPLATES[n], "") for i, n in enumerate(names)]
    out = L.scan(spark.createDataFrame(rows, DOCS), keep=["doc_id"]).orderBy("doc_id").collect()
    assert [(r.doc_id, r.license, r.coverage) for r in out] == [(i, n, 1.0) for i, n in enumerate(names)]
    assert all(rows[r.doc_id][1][r.span_start:r.span_end] == L.TEMPLATES[r.license].rstrip(".") for r in out)  # in the text itself
