import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from jestframe.llm import merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf int, `key` string, kept int, i string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return h("".join(map(field, (row[0], row[3], row[2], row[4], text))))


def climb(nodes, fanout):
    """Node levels and, for each leaf, its siblings (before, after) level by level."""
    steps = [[] for _ in nodes]
    at, level = list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[i:i + fanout] for i in range(0, len(level), fanout)]
        for k, p in enumerate(at):
            run = runs[p // fanout]
            steps[k].append(("".join(run[:p % fanout]), "".join(run[p % fanout + 1:])))
        at, level = [p // fanout for p in at], [h("".join(r)) for r in runs]
    return level[0], steps


def brute(rows, fanout=3):
    """(doc_id, leaf, subroot, root, steps, row) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout) for s in order}
    root, tops = climb([own[s][0] for s in order], fanout)
    return [(x[3][0], x[2], own[s][0], root, st + top, x[3])
            for s, top in zip(order, tops, strict=True) for x, st in zip(sorted(groups[s], key=lambda x: x[:3]), own[s][1], strict=True)]


def folded(node, steps):
    for a, b in steps:
        node = h(a + node + b)
    return node


def corpus(spark):
    rows = [(i, f"text {i}\nline" * (i % 3), ("en", None)[i % 2], f"s{i % 4}" if i % 3 else "hot", i, 1, "k", 2, "x") for i in range(230)]
    rows += [(9, "again\n", "en", "hot", 1, 1, "k", 2, "x")] * 40 + [(9, "other", "en", "hot", 1, 1, "k", 2, "x"), (None, "no id", "en", "hot", 1, 1, "k", 2, "x")]
    rows += [(500, None, None, None, None, None, None, None, None), (501, "", "", "", 0, 0, "", 0, ""), (502, "é" * 50_000 + "\n", "é", "é", 1, 0, "", 0, ""), (503, "z", "en", "￿", 1, 0, "", 0, "")]
    return spark.createDataFrame(rows, DOCS).repartition(5), rows


@pytest.mark.parametrize(("fanout", "depth"), [(3, 1), (3, 2), (2, 1), (3, 6), (4, 2)])
def test_against_whole_trees(spark, fanout, depth):
    docs, rows = corpus(spark)
    out = merkle.manifest(docs, keep=["doc_id", "n_chars", "leaf", "key"], fanout=fanout, depth=depth)
    assert out.columns == ["doc_id", "n_chars", "key", "leaf", "proof", "subroot", "root"]
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.proof]) for r in out.collect()]
    want = [x[:5] for x in brute(rows, fanout)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(folded(g[1], g[4]) == g[3] for g in got)
    assert out.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 82])
def test_ragged_sizes(spark, n):
    rows = [(i, str(i), "en", "s", 1, 0, "", 0, "") for i in range(n)]
    out = merkle.manifest(spark.createDataFrame(rows, DOCS), depth=1).collect()
    assert sorted((r.doc_id, r.root, [tuple(s) for s in r.proof]) for r in out) == sorted((x[0], x[3], x[4]) for x in brute(rows))


def test_many_groups(spark):
    """More groups than a partition of the tree over them holds."""
    rows = [(i, "t", "en", f"host{i % 40}", 1, 0, "", 0, "") for i in range(100)]
    out = merkle.manifest(spark.createDataFrame(rows, DOCS), depth=2).collect()
    assert sorted((r.doc_id, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in out) == sorted((x[0], x[2], x[3], x[4]) for x in brute(rows))


def test_query(spark, tmp_path):
    docs, rows = corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_merkle_manifest(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = []
    for i, own, sub, root, steps, row in brute(rows):
        changed = i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and row[1] is not None
        end = folded(leaf(row, row[1].replace("\n", "")) if changed else own, steps)
        want.append((i, own, sub, root, h("".join(a + b for a, b in steps)), end, end == root))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert {x[-1] for x in want} == {True, False}


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
