"""Registered queries of this folder: each applies its operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jestframe.llm import ann, decontaminate, langid, license_scan, line_dedup, merkle, minhash, mixing, secrets, sharding, spelling, token_count, toxicity
from jestframe.llm.common import crc_mod, read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.per_document(mixing.mix(read_table(spark, sf_dir, "documents"), with_text=False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    return (langid.predict(docs, model, keep=["doc_id"])
            .select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
            .select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5")))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line, regexp_extract_all(lower(line), '\S+') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)),
c AS (
  SELECT array_to_string(w, ' ') AS k, any_value(w) AS w, min(doc_id * 1000000000 + pos) AS f FROM l WHERE len(w) >= 3 GROUP BY 1),
v AS (
  SELECT k, f, n, i, array_to_string(list_concat(w[1:i-1], w[i+1:n]), ' ') AS d
  FROM (SELECT k, f, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM c WHERE len(w) >= 8)),
near AS (
  SELECT k FROM (SELECT k, f, min(f) OVER (PARTITION BY d, i, n) AS m FROM v) WHERE m < f
  UNION SELECT v.k FROM v JOIN c ON c.k = v.d WHERE c.f < v.f
  UNION SELECT c.k FROM v JOIN c ON c.k = v.d WHERE v.f < c.f),
gone AS (
  SELECT l.doc_id, l.pos FROM l JOIN c ON array_to_string(l.w, ' ') = c.k
  WHERE l.doc_id * 1000000000 + l.pos > c.f OR c.k IN (SELECT k FROM near)),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY 1)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, md5(k.text) AS text_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (secrets.scan(read_table(spark, sf_dir, "documents"))
            .select("doc_id", "word_no", F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("fingerprint"), "score", "is_secret"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return (toxicity.score(docs, model, keep=["doc_id"])
            .select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), 24)
    return out.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.crc32("text").alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fields = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.COLUMNS]
    docs = docs.withColumn("tampered", F.when(crc_mod("doc_id", 2) == 0, merkle.leaf_digest(fields)))
    out = merkle.manifest(docs, keep=["doc_id", "tampered"])
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.digest(siblings).alias("proof_sha256"),
                     merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = r"""
WITH RECURSIVE
leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS g,
         sha256(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')
                || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')
                || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS changed,
         xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
             lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS crc
  FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
tree AS (
  SELECT g, 0 AS lvl, i, leaf AS node, n FROM numbered
  UNION ALL
  SELECT g, lvl + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), any_value((n + 2) // 3) FROM tree WHERE n > 1 GROUP BY g, lvl, i // 3),
subroots AS (SELECT g, node AS subroot, lvl AS height, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, i, subroot AS node, n FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), any_value((n + 2) // 3) FROM top WHERE n > 1 GROUP BY lvl, i // 3),
runs AS (SELECT g, lvl, i // 3 AS run, list(node ORDER BY i) AS nodes FROM tree WHERE n > 1 GROUP BY 1, 2, 3),
top_runs AS (SELECT lvl, i // 3 AS run, list(node ORDER BY i) AS nodes FROM top WHERE n > 1 GROUP BY 1, 2),
walk AS (
  SELECT g, doc_id, i AS leaf_no, 0 AS lvl, i AS at, CASE WHEN crc % 2 = 0 THEN changed ELSE leaf END AS node, '' AS proof FROM numbered
  UNION ALL
  SELECT w.g, w.doc_id, w.leaf_no, w.lvl + 1, w.at // 3,
         sha256(array_to_string(r.nodes[1:w.at % 3], '') || w.node || array_to_string(r.nodes[w.at % 3 + 2:], '')),
         w.proof || array_to_string(r.nodes[1:w.at % 3], '') || array_to_string(r.nodes[w.at % 3 + 2:], '')
  FROM walk w JOIN runs r ON r.g = w.g AND r.lvl = w.lvl AND r.run = w.at // 3),
risen AS (
  SELECT w.g, w.leaf_no, w.node, w.proof, s.subroot, s.i AS at, 0 AS lvl FROM walk w JOIN subroots s ON s.g = w.g AND s.height = w.lvl
  UNION ALL
  SELECT w.g, w.leaf_no, sha256(array_to_string(r.nodes[1:w.at % 3], '') || w.node || array_to_string(r.nodes[w.at % 3 + 2:], '')),
         w.proof || array_to_string(r.nodes[1:w.at % 3], '') || array_to_string(r.nodes[w.at % 3 + 2:], ''), w.subroot, w.at // 3, w.lvl + 1
  FROM risen w JOIN top_runs r ON r.lvl = w.lvl AND r.run = w.at // 3),
root AS (SELECT lvl, node AS root FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, r.subroot, t.root, sha256(r.proof) AS proof_sha256, r.node AS folded_root, r.node = t.root AS verified
FROM numbered l JOIN risen r ON r.g = l.g AND r.leaf_no = l.i JOIN root t ON t.lvl = r.lvl
"""


def with_slips(run: Column, doc_id: Column) -> Column:
    """The run less a code point where 199 divides the crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 199 == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2, F.length(run)))).otherwise(run)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(read_table(spark, sf_dir, "documents"), edited=with_slips))


OP13_SQL = r"""
WITH RECURSIVE
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, 2 * strlen(doc_id || ':' || run), 2),
           lambda p: [('0x' || substr(hex(encode(doc_id || ':' || run)), p, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h
  FROM counted),
words AS (
  SELECT row_number() OVER (ORDER BY encode(word)) AS id, word, n FROM (
    SELECT word, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 6 GROUP BY word) WHERE n >= 5),
holes AS (SELECT id, word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
cut AS (SELECT id, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM holes),
near AS (
  SELECT a.id, b.id AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.id <> b.id
  UNION SELECT a.id, b.id, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.id, a.id, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT id, count(*) AS n_near, arg_min(other, (-n, other)) AS form, max(n) AS form_n FROM near GROUP BY id),
forms AS (SELECT b.id, b.form, b.form_n FROM best b JOIN words w USING (id) WHERE b.form_n >= 5 * w.n),
walk AS (
  SELECT id, id AS last FROM words
  UNION ALL SELECT w.id, f.form FROM walk w JOIN forms f ON f.id = w.last),
ends AS (SELECT id, last FROM walk WHERE last NOT IN (SELECT id FROM forms))
SELECT w.word, f.word AS form, r.word AS root, w.n, coalesce(b.n_near, 0) AS n_near, o.form_n
FROM words w LEFT JOIN best b USING (id) LEFT JOIN forms o USING (id) LEFT JOIN words f ON f.id = o.form
JOIN ends e ON e.id = w.id JOIN words r ON r.id = e.last
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_secret_scan": op7_secret_scan,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_sharding": op11_sharding,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op12_merkle_manifest": OP12_SQL, "op13_spelling_variants": OP13_SQL}
