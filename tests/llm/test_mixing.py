import re

from pyspark.sql import functions as F

from jestframe.llm import mixing

DOCS = "doc_id long, text string, source string, size long"


def targets(sizes):
    """Brute force: share by weight, cap at twice the size, share the rest again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= set(over)


def corpus(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(7 * i % 131)), f"s{i % 5}" if i % 11 else None, 9) for i in range(400)]
    rows += [(500 + i, "x " * 700, "hot", 0) for i in range(60)] + [(1, "a b", "s1", 0)] * 3
    rows += [(600, None, "s1", 0), (601, "", "empty", 0), (None, "null id", "", 0), (602, "very " * 20_000, "s2", 0)]
    return spark.createDataFrame(rows, DOCS), rows


def test_targets_and_taken(spark):
    docs, rows = corpus(spark)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    mixed = mixing.mix(docs, block=32, shard_slots=64, with_text=True).cache()
    out = mixing.per_document(mixed).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.size) for r in out], key=key) == sorted([(i, size(t)) for i, t, _, _ in rows], key=key)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    by_source = {r.source: r for r in mixed.groupBy("source").agg(F.sum("words").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("n")).collect()}
    assert set(by_source) == set(sizes)
    for s, n in sizes.items():
        assert by_source[s].n == n and abs(by_source[s].target - want[s]) < 1e-6 * max(1, n) and abs(by_source[s].taken - want[s]) <= 1
    # texts hold the words taken; a block is filled by its slots; reruns agree
    assert mixed.where(F.when(F.col("words") > 0, F.size(F.split("text", " "))).otherwise(0) != F.col("words")).count() == 0
    again = mixing.mix(docs.repartition(7), block=32, shard_slots=64, with_text=False)
    cols = ["shard", "slot", "key", "doc_id", "block_no", "first_word", "words"]
    assert mixed.select(cols).exceptAll(again.select(cols)).count() == 0


def test_shards_are_multinomial(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 50).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    slots = mixing.mix(docs, block=25, shard_slots=600, with_text=False).where("slot IS NOT NULL").select("key", "shard", "slot").distinct()
    counts = slots.groupBy("shard", "key").count().collect()
    per = {}
    for r in counts:
        per.setdefault(r.shard, {})[r.key] = r["count"]
    total = sum(r["count"] for r in counts)
    assert 6000 <= total <= 6003 and len(per) == -(-total // 600)  # 1.5 * 100,000 words in blocks of 25 words
    for own in per.values():  # weights 3, 1, 2 with s0 capped at twice its size
        assert abs(sum(own.values()) - total / len(per)) < 130 and own["=s0"] > own["=s2"] > own["=s1"] / 2


def test_empty(spark):
    assert mixing.per_document(mixing.mix(spark.createDataFrame([], DOCS))).count() == 0
    out = mixing.per_document(mixing.mix(spark.createDataFrame([(1, None, None, 0)], DOCS))).collect()
    assert [tuple(r) for r in out] == [(1, 0, 0, 0.0, 0)]
