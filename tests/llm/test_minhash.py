import random

from pyspark.sql import functions as F

from jestframe.llm import minhash

DOCS = "doc_id long, text string, n_shingles string"


def by_rule(docs, shingle, percent=80):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        own = {tuple(w[k:k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(own)
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (find(i), sorted(map(len, sets[i]))) for i in ids}


def test_against_all_pairs(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            base = w if rng.random() < 0.5 else base  # chains of copies of copies
            docs.append((len(docs), " ".join(w).upper() if rng.random() < 0.2 else "  ".join(w)))
    docs += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (3, "repeated id other text"), (906, "Repeated ID other text"), (907, "Éa b c d e"), (908, "éa b c d e")]
    for shingle in (4, 5):
        out = minhash.near_duplicates(spark.createDataFrame([(i, t, "clash") for i, t in docs], DOCS), shingle=shingle).collect()
        want = by_rule(docs, shingle)
        assert len(out) == len(docs)
        for r in out:
            assert r.component_id == want[r.doc_id][0] and r.n_shingles in want[r.doc_id][1] and r.kept == (r.doc_id == r.component_id), r


def test_null_ids_and_empty(spark):
    out = minhash.near_duplicates(spark.createDataFrame([(None, "a b c", ""), (None, "a b c", ""), (1, "a b c", "")], DOCS)).collect()
    assert sorted((str(r.component_id), r.kept) for r in out) == [("1", True), ("None", True), ("None", True)]
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_a_bucket_of_several_components(spark):
    """Documents that share most words share buckets whether they are linked or not; blocks find all links."""
    rng = random.Random(9)
    core = [f"c{i}" for i in range(60)]
    docs = [(i, " ".join(core + [f"t{g}x{k}" for k in range(30)] + [f"n{i}"])) for i, g in enumerate(rng.choices(range(6), k=60))]
    want = by_rule(docs, 2)
    assert len({c for c, _ in want.values()}) == 6
    for part_rows in (7, 512):
        out = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2, part_rows=part_rows).collect()
        assert {r.doc_id: r.component_id for r in out} == {i: c for i, (c, _) in want.items()}


def test_pruning_keeps_what_may_reach_the_threshold():
    least = minhash.least_matches(0.8, 1e-6)
    assert least[32] < 20 and least[160] < 128 * 0.85 and all(m > 0 for m in least.values())


def test_components_of_chains(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 501), (501, 500)], "a long, b long"))
    assert {r.node: r.comp for r in minhash.components(edges).collect()} == {i: 0 for i in range(201)} | {500: 500, 501: 500}
