"""Every registered query of the operators, as registered, over one small set of whole
tables with rows of nulls, empty texts and repeats, and extra columns with clashing names."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from jestframe.llm.queries import ORACLE_SQL
from test_secrets import plain_candidates

TABLES = ["documents", "embeddings", "benchmark", "labels"]
EDGES = [{"doc_id": 900_000_001, "text": None, "lang": "en", "source": "src0", "n_chars": 0}, {"doc_id": 900_000_002, "text": "", "lang": None, "source": None, "n_chars": None},
         {"doc_id": 900_000_003, "text": "12 34 !?", "lang": "de", "source": None, "n_chars": 8}, {"doc_id": 900_000_004, "text": "one word more", "lang": None, "source": "", "n_chars": 13}]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    for name in TABLES:
        table = pq.read_table(f"{SF_SMALL}/{name}.parquet")
        if name == "documents":
            table = pa.concat_tables([table, pa.Table.from_pylist(EDGES, schema=table.schema), table.slice(0, 3)])
            for extra in ("score", "size", "word", "row"):
                table = table.append_column(extra, pa.array(["clash"] * table.num_rows))
        pq.write_table(table, folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def docs(tables):
    return pq.read_table(f"{tables}/documents.parquet").to_pylist()


def rows(spark, tables, name, columns):
    df = E.queries()[name](spark, tables)
    assert df.columns[:len(columns)] == columns and len(set(df.columns)) == len(df.columns)
    return df.collect()


def each_once(out, docs):
    assert sorted(r.doc_id for r in out) == sorted(d["doc_id"] for d in docs)


def remainder(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_token_counts(spark, tables, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    library.no_truncation()
    library.no_padding()
    out = rows(spark, tables, "op1_token_counts", ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    each_once(out, docs)
    wanted = {d["doc_id"]: (len((d["text"] or "").encode()), len(library.encode(d["text"] or "", add_special_tokens=False).ids)) for d in docs}
    assert all((r.n_bytes, r.n_tokens, r.over_limit) == (*wanted[r.doc_id], wanted[r.doc_id][1] > 1024) for r in out)


def test_mixing(spark, tables, docs):
    out = rows(spark, tables, "op3_mixing", ["doc_id", "size", "source_size", "target", "taken"])
    each_once(out, docs)
    source, size = {d["doc_id"]: d["source"] for d in docs}, {d["doc_id"]: len(words(d["text"])) for d in docs}
    taken, target, whole = collections.Counter(), {}, collections.Counter()
    for d in docs:
        whole[d["source"]] += size[d["doc_id"]]
    for r in out:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] and r.source_size == whole[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 and target[s] <= 2 * whole[s] + 1e-6 for s in target)


def test_language_id(spark, tables, docs):
    out = rows(spark, tables, "op4_language_id", ["doc_id", "held_out", "lang_pred", "score"])
    each_once(out, docs)
    by_id = {d["doc_id"]: d for d in docs}
    for r in out:
        letters = any(c.isalpha() for c in by_id[r.doc_id]["text"] or "")
        assert r.held_out == (remainder(r.doc_id, 4) == 2) and (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    judged = [r for r in out if r.held_out and r.lang_pred != "und" and by_id[r.doc_id]["lang"]]
    assert sum(r.lang_pred == by_id[r.doc_id]["lang"] for r in judged) >= 0.9 * len(judged)


def test_near_duplicates(spark, tables, docs):
    out = rows(spark, tables, "op6_near_duplicates", ["doc_id", "n_shingles", "component_id", "kept"])
    sets = {}
    for d in docs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or ""))
        sets[d["doc_id"]] = {tuple(w[i:i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()
    ids, top = sorted(sets), {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out} == {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def test_secret_scan(spark, tables, docs):
    out = rows(spark, tables, "op7_secret_scan", ["doc_id", "word_no", "n_chars", "fingerprint", "score", "is_secret"])
    wanted = sorted((d["doc_id"], at, len(value), hashlib.sha256(value.encode()).hexdigest()) for d in docs for at, value, _, _ in plain_candidates(d["text"] or ""))
    assert sorted((r.doc_id, r.word_no, r.n_chars, r.fingerprint) for r in out) == wanted and wanted
    assert all(r.score is None or r.is_secret == (r.score >= 0.5) for r in out)


def test_nearest_neighbours(spark, tables):
    out = rows(spark, tables, "op8_nearest_neighbours", ["query_id", "rank", "vec_id", "score"])
    table = pq.read_table(f"{tables}/embeddings.parquet").to_pylist()
    unit = {r["vec_id"]: np.array(r["embedding"], float) / np.linalg.norm(np.array(r["embedding"], float)) for r in table}
    found = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r["rank"], r.vec_id))
        assert abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-9
    assert set(found) == {i for i in unit if i % 50 == 0} and all([k for k, _ in f] == [1, 2, 3, 4, 5] for f in found.values())
    best = {q: set(sorted((i for i in unit if i != q), key=lambda i: (-(unit[q] @ unit[i]), i))[:5]) for q in found}
    assert sum(len(best[q] & {v for _, v in f}) for q, f in found.items()) >= 0.9 * 5 * len(found)


def test_toxicity(spark, tables, docs):
    out = rows(spark, tables, "op10_toxicity", ["doc_id", "held_out", "score", "predicted"])
    each_once(out, docs)
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_sharding(spark, tables, docs):
    out = rows(spark, tables, "op11_sharding", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])
    each_once(out, docs)
    shards = collections.defaultdict(list)
    for r in out:
        shards[r.shard].append(r.slot)
    assert set(shards) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(len(shards.get(i, [])) for i in range(24)) <= 1


@pytest.mark.parametrize("name", ["op2_license_scan", "op9_decontamination"])
def test_scans(spark, tables, docs, name):
    """Their spans and windows are held against brute force in tests of their own."""
    out = rows(spark, tables, name, ["doc_id"])
    assert {r.doc_id for r in out} <= {d["doc_id"] for d in docs}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, tables, name):
    folder = SF_SMALL if name == "op5_line_dedup" else tables  # its statement tells documents apart by id, so none may repeat
    df = E.queries()[name](spark, folder)
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert collections.Counter(tuple(r) for r in df.select(*names).collect()) == collections.Counter(map(tuple, result.fetchall()))
