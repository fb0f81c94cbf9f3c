"""DuckDB SQL for every query key that SQL can express: the independent
answer the Spark plans are checked against.  Written the direct way (window
functions, IN-lists, correlated forms) rather than the way the Spark plans
compute it."""

from __future__ import annotations

from ..sources.fixtures import CLASS_TOKENS, END_TOKEN, EXCLUSIVE_HUMOR, EXCLUSIVE_NON_HUMOR, MAX_LENGTH, \
    REPETITION_TOKENS, SQL, u_sql
from ..sources.experiments import EXPERIMENTS
from ..sources.registry import registry_sql

NL_T = 429496730  # ceil(0.1 * 2^32): a newline separator with probability 0.1


def _ctes(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    parts = [f"{n} AS ({SQL[n]})" for n in names]
    parts += [f"{n} AS ({q})" for n, q in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n"


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _sep(g: str, j: str) -> str:
    """Separator after token j: word ((j-1) % 4) of md5(seed:g:s||((j-1)//4+1))."""
    blk = f"'s' || CAST(({j} - 1) // 4 + 1 AS VARCHAR)"
    word = (f"CAST('0x' || substr(md5(concat_ws(':', '79', CAST({g} AS VARCHAR), {blk})), "
            f"1 + 8 * (({j} - 1) % 4), 8) AS BIGINT)")
    return f"CASE WHEN {word} < {NL_T} THEN chr(10) ELSE ' ' END"


def _u_tag(g: str, prefix: str, i: str) -> str:
    return u_sql(g, f"'{prefix}' || CAST({i} AS VARCHAR)")


Q: dict[str, str] = {}

# C1
_tot = "votes_1 + votes_2 + votes_3 + votes_4 + votes_5"
Q["t01_vote_resolution"] = _ctes("x_votes") + f"""
SELECT id, text, CAST(CASE
  WHEN is_humor = 0 THEN 0
  WHEN ({_tot}) = 0 THEN 0
  {' '.join(f'WHEN 2 * votes_{i} > ({_tot}) THEN {i}' for i in range(1, 6))}
  {' '.join(f'WHEN 4 * votes_{i} >= ({_tot}) THEN {i}' for i in range(5, 0, -1))}
  ELSE 0 END AS BIGINT) AS score
FROM x_votes"""

# C8
_KEPT = """
, kept AS (SELECT * FROM x_annot WHERE id IN (SELECT id FROM x_annot WHERE id IS NOT NULL GROUP BY id HAVING count(*) >= 4)),
firsts AS (SELECT id, text FROM kept WHERE text IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord, text) = 1)"""
Q["t02_annotation_detection"] = _ctes("x_annot") + _KEPT + """
SELECT k.id, f.text,
  CAST(sum(CASE WHEN sentiment = 0 THEN 1 ELSE 0 END) <= sum(CASE WHEN sentiment IS DISTINCT FROM 0 THEN 1 ELSE 0 END)
       AS BIGINT) AS score
FROM kept k LEFT JOIN firsts f ON k.id = f.id GROUP BY k.id, f.text"""

# C7
Q["t03_annotation_classification"] = _ctes("x_annot") + _KEPT + """,
g AS (SELECT id,
        sum(CASE WHEN sentiment = 0 THEN 1 ELSE 0 END) AS zero_count,
        sum(CASE WHEN sentiment IS DISTINCT FROM 0 THEN 1 ELSE 0 END) AS non_zero_count,
        max(CASE WHEN sentiment <> 0 THEN sentiment END) AS max_s
      FROM kept GROUP BY id),
m AS (SELECT id, sentiment AS s, count(*) AS c,
        row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, sentiment) AS rn
      FROM kept WHERE sentiment <> 0 GROUP BY id, sentiment)
SELECT g.id, f.text,
  CAST(CASE WHEN g.non_zero_count = 0 THEN 0 WHEN m.c * 2 > g.non_zero_count THEN m.s ELSE g.max_s END - 1 AS BIGINT) AS score
FROM g LEFT JOIN m ON g.id = m.id AND m.rn = 1 LEFT JOIN firsts f ON g.id = f.id
WHERE g.non_zero_count >= g.zero_count"""

# C4
Q["t04_rated_items"] = _ctes("x_rated") + """
, conflict AS (SELECT body FROM x_rated GROUP BY body HAVING count(DISTINCT rating) > 1),
kept AS (SELECT * FROM x_rated
         WHERE body NOT IN (SELECT body FROM conflict) AND body <> '' AND length(body) <= 512),
firsts AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY id) AS rn FROM kept)
SELECT id, body AS text, CAST(round_even(rating, 0) AS BIGINT) AS score FROM firsts WHERE rn = 1"""

# D1
Q["t05_drop_all_duplicates"] = """
SELECT * FROM documents QUALIFY count(*) OVER (PARTITION BY text) = 1"""

# D2
Q["t06_keep_first"] = """
SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""

_CORPORA = """u AS (
  SELECT 'documents' AS corpus, doc_id AS id, text FROM documents
  UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations
  UNION ALL SELECT 'benchmark', item_id, text FROM benchmark)"""

Q["t07_union_unique"] = f"""
WITH {_CORPORA}
SELECT * FROM u QUALIFY count(*) OVER (PARTITION BY text) = 1"""

for _key, _q, _op in (("t08_long_slice", 0.9, ">="), ("t09_short_slice", 0.1, "<=")):
    Q[_key] = f"""
SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_len FROM documents
WHERE length(text) {_op} (SELECT quantile_cont(length(text), {_q}) FROM documents)"""

Q["t10_transform_detection"] = _ctes("x_scored") + """
SELECT id, text, CAST(CASE WHEN score IS DISTINCT FROM 0 THEN 1 ELSE 0 END AS BIGINT) AS score FROM x_scored"""

Q["t11_transform_classification"] = _ctes("x_scored") + """
SELECT id, text, CAST(score - 1 AS BIGINT) AS score FROM x_scored WHERE score > 0"""

# R1 + J3: rows ranked by a keyed draw; draw i takes position U('sample', i) % n
Q["t13_sample_rows"] = f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {u_sql('doc_id', "'pos'")}, doc_id) - 1 AS pos FROM documents),
n AS (SELECT count(*) AS c FROM documents),
d AS (SELECT pos AS draw, {u_sql("'sample'", 'pos')} % (SELECT c FROM n) AS pick FROM r)
SELECT CAST(d.draw AS BIGINT) AS draw, r.doc_id FROM d JOIN r ON r.pos = d.pick"""

# R2 + R3 over whole texts
_vh = _list(EXCLUSIVE_HUMOR)
Q["t14_random_join"] = f"""
WITH base AS (SELECT doc_id, 'join:' || CAST(doc_id AS VARCHAR) AS g, string_split(text, ' ') AS w FROM documents),
words AS (SELECT doc_id, g, unnest(w) AS tok, unnest(generate_series(1, len(w))) AS j FROM base),
extra AS (SELECT doc_id, g, len(w) AS nw, unnest(generate_series(1, 1 + {u_sql('g', "'k'")} % 3)) AS i FROM base),
toks AS (SELECT doc_id, g, tok, j FROM words
         UNION ALL SELECT doc_id, g, {_vh}[1 + {_u_tag('g', 't', 'i')} % 3], nw + i FROM extra)
SELECT doc_id, {STRIP.format(x="string_agg(tok || " + _sep('g', 'j') + ", '' ORDER BY j)")} AS text
FROM toks GROUP BY doc_id"""


def _contradiction_sql() -> str:
    """R4 over x_scored: CTE chain ending in ``exc`` (draw, id, text, score)."""
    return f"""
, r AS (SELECT id, text, score, row_number() OVER (ORDER BY {u_sql('id', "'pos'")}, id) - 1 AS pos FROM x_scored),
n AS (SELECT count(*) AS c FROM x_scored),
d AS (SELECT pos AS draw, {u_sql("'exclusive'", 'pos')} % (SELECT c FROM n) AS pick FROM r),
s AS (SELECT d.draw, r.id, r.text, r.score, 'exclusive:' || CAST(d.draw AS VARCHAR) AS g FROM d JOIN r ON r.pos = d.pick),
ph AS (SELECT draw, g, score, unnest(generate_series(1, 1 + {u_sql('g', "'k'")} % 3)) AS i FROM s),
toks AS (SELECT draw, g, text AS tok, 1 AS j FROM s
         UNION ALL SELECT draw, g,
           CASE WHEN score = 0 THEN {_list(EXCLUSIVE_HUMOR)}[1 + {_u_tag('g', 't', 'i')} % 3]
                ELSE {_list(EXCLUSIVE_NON_HUMOR)}[1 + {_u_tag('g', 't', 'i')} % 3] END, 1 + i FROM ph),
joined AS (SELECT draw, {STRIP.format(x="string_agg(tok || " + _sep('g', 'j') + ", '' ORDER BY j)")} AS text
           FROM toks GROUP BY draw),
gen AS (SELECT s.draw, s.id, joined.text, s.score FROM s JOIN joined ON s.draw = joined.draw),
exc AS (SELECT * FROM gen QUALIFY count(*) OVER (PARTITION BY text) = 1)"""


Q["t15_contradiction_rows"] = _ctes("x_scored") + _contradiction_sql() + """
SELECT CAST(draw AS BIGINT) AS draw, id, text, CAST(score AS BIGINT) AS score FROM exc"""

_vocab = sorted(set(EXCLUSIVE_HUMOR) | set(REPETITION_TOKENS))


def _repetition_sql() -> str:
    """CTE chain ending in ``rep`` (gen, text, score, part)."""
    return f"""
rg AS (SELECT doc_id * 2 + j AS gen FROM documents, (VALUES (0), (1)) AS t(j)),
rb AS (SELECT gen, 'repetition:' || CAST(gen AS VARCHAR) AS g FROM rg),
rt AS (SELECT gen, g, unnest(generate_series(1, 1 + {u_sql('g', "'k'")} % 50)) AS i FROM rb),
rj AS (SELECT gen, {STRIP.format(x="string_agg(" + _list(_vocab) + "[1 + " + _u_tag('g', 't', 'i') + f" % {len(_vocab)}] || " + _sep('g', 'i') + ", '' ORDER BY i)")} AS text
       FROM rt GROUP BY gen),
ru AS (SELECT gen, text, 0 AS score FROM rj QUALIFY count(*) OVER (PARTITION BY text) = 1),
rr AS (SELECT *, row_number() OVER (ORDER BY {u_sql('gen', "'repetition_split'")}, gen) AS rk FROM ru),
rep AS (SELECT gen, text, score,
          CASE WHEN rk <= floor((SELECT count(*) FROM ru) * 0.5) THEN 'test' ELSE 'train' END AS part FROM rr)"""


Q["t16_repetition_rows"] = "WITH " + _repetition_sql() + """
SELECT CAST(gen AS BIGINT) AS gen, text, CAST(score AS BIGINT) AS score, part FROM rep"""

Q["t17_exact_split"] = _ctes("x_scored") + f"""
, r AS (SELECT id, score, row_number() OVER (ORDER BY {u_sql('id', "'split'")}, id) AS rk FROM x_scored)
SELECT id, CAST(score AS BIGINT) AS score,
  CASE WHEN rk <= ceil(0.2 * (SELECT count(*) FROM x_scored)) THEN 'valid' ELSE 'train' END AS part FROM r"""

Q["t18_under_sample"] = _ctes("x_scored") + f"""
, s AS (SELECT id, score, row_number() OVER (PARTITION BY score ORDER BY {u_sql('id', "'under'")}, id) AS rk
        FROM x_scored WHERE score IS NOT NULL),
m AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM x_scored WHERE score IS NOT NULL GROUP BY score))
SELECT id, CAST(score AS BIGINT) AS score FROM s WHERE rk <= (SELECT m FROM m)"""

Q["t19_over_sample"] = _ctes("x_scored") + f"""
, c AS (SELECT score, count(*) AS n FROM x_scored WHERE score IS NOT NULL GROUP BY score),
r AS (SELECT id, score, row_number() OVER (PARTITION BY score ORDER BY {u_sql('id', "'over_rank'")}, id) AS rk
      FROM x_scored WHERE score IS NOT NULL),
d AS (SELECT score, n, unnest(range(0, (SELECT max(n) FROM c))) AS draw FROM c),
p AS (SELECT score, draw, {u_sql('score', "'over' || CAST(draw AS VARCHAR)")} % n + 1 AS rk FROM d)
SELECT CAST(p.score AS BIGINT) AS score, CAST(p.draw AS BIGINT) AS draw, r.id FROM p JOIN r ON p.score = r.score AND p.rk = r.rk"""


def _softmax_cols(k: int) -> tuple[str, list[str]]:
    m = "greatest(" + ", ".join(f"logits[{i}]" for i in range(1, k + 1)) + ")"
    den = " + ".join(f"exp(logits[{i}] - {m})" for i in range(1, k + 1))
    cols = [f"exp(logits[{i + 1}] - {m}) / ({den})" for i in range(k)]
    return m, cols


def _argmax(k: int, m: str) -> str:
    return "CASE " + " ".join(f"WHEN logits[{i + 1}] = {m} THEN {i}" for i in range(k)) + " END"


_m5, _p5 = _softmax_cols(5)
Q["t20_softmax_argmax"] = _ctes("x_logits5") + f"""
SELECT CAST(id AS BIGINT) AS id, CAST(label AS BIGINT) AS label,
  {', '.join(f'round({p}, 6) AS score_{i}' for i, p in enumerate(_p5))},
  CAST({_argmax(5, _m5)} AS BIGINT) AS labels
FROM x_logits5"""

_m2, _p2 = _softmax_cols(2)
Q["t21_threshold_label"] = _ctes("x_logits2") + f"""
SELECT CAST(id AS BIGINT) AS id, CAST(label AS BIGINT) AS label,
  {', '.join(f'round({p}, 6) AS score_{i}' for i, p in enumerate(_p2))},
  CAST(CASE WHEN {_p2[1]} > 0.65 THEN 1 ELSE 0 END AS BIGINT) AS labels
FROM x_logits2"""

_XPRED = f"""x_pred AS (SELECT id, label, id % 5 AS suite,
   CASE WHEN id % 17 = 0 THEN -1 ELSE {_argmax(2, _m2)} END AS pred FROM x_logits2)"""


def _report_sql(by: str | None) -> str:
    g = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON TRUE"
    return f"""
, classes AS (SELECT DISTINCT {g}label AS cls FROM x_pred UNION SELECT DISTINCT {g}pred FROM x_pred),
st AS (SELECT {g}cls,
         (SELECT count(*) FROM x_pred p WHERE p.label = c.cls AND p.pred = c.cls {('AND p.' + by + ' = c.' + by) if by else ''}) AS tp,
         (SELECT count(*) FROM x_pred p WHERE p.label <> c.cls AND p.pred = c.cls {('AND p.' + by + ' = c.' + by) if by else ''}) AS fp,
         (SELECT count(*) FROM x_pred p WHERE p.label = c.cls AND p.pred <> c.cls {('AND p.' + by + ' = c.' + by) if by else ''}) AS fn
       FROM classes c),
m AS (SELECT {g}cls, tp, fp, fn, tp + fn AS support,
        CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS prec,
        CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS rec,
        CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM st),
tot AS (SELECT {g}sum(support) AS n, sum(tp) AS tp FROM m {gb}),
avgs AS (SELECT {g}avg(prec) AS mp, avg(rec) AS mr, avg(f1) AS mf,
           sum(prec * support) / sum(support) AS wp, sum(rec * support) / sum(support) AS wr,
           sum(f1 * support) / sum(support) AS wf FROM m {gb}),
longs AS (
  SELECT {g}CAST(cls AS VARCHAR) || '_precision' AS metric, prec AS value FROM m
  UNION ALL SELECT {g}CAST(cls AS VARCHAR) || '_recall', rec FROM m
  UNION ALL SELECT {g}CAST(cls AS VARCHAR) || '_f1-score', f1 FROM m
  UNION ALL SELECT {g}CAST(cls AS VARCHAR) || '_support', support FROM m
  UNION ALL SELECT {g}'accuracy', tp / n FROM tot
  UNION ALL SELECT {g}'macro_avg_precision', mp FROM avgs
  UNION ALL SELECT {g}'macro_avg_recall', mr FROM avgs
  UNION ALL SELECT {g}'macro_avg_f1-score', mf FROM avgs
  UNION ALL SELECT {g}'macro_avg_support', n FROM tot
  UNION ALL SELECT {g}'weighted_avg_precision', wp FROM avgs
  UNION ALL SELECT {g}'weighted_avg_recall', wr FROM avgs
  UNION ALL SELECT {g}'weighted_avg_f1-score', wf FROM avgs
  UNION ALL SELECT {g}'weighted_avg_support', n FROM tot)"""


Q["t22_classification_report"] = _ctes("x_logits2") + ", " + _XPRED + _report_sql(None) + """
SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM longs"""

Q["t23_suite_report"] = _ctes("x_logits2") + ", " + _XPRED + _report_sql("suite") + """
SELECT CAST(suite AS BIGINT) AS suite, metric, round(CAST(value AS DOUBLE), 6) AS value FROM longs"""


def _wce(view: str, k: int, weights: list[float]) -> str:
    m = "greatest(" + ", ".join(f"logits[{i}]" for i in range(1, k + 1)) + ")"
    lse = f"(ln({' + '.join(f'exp(logits[{i}] - {m})' for i in range(1, k + 1))}) + {m})"
    w = "[" + ", ".join(repr(float(x)) for x in weights) + "]"
    return (f"SELECT count(*) AS n, sum({w}[label + 1] * ({lse} - logits[label + 1])) / sum({w}[label + 1]) AS loss "
            f"FROM {view} WHERE label IS NOT NULL")


Q["t24_weighted_cross_entropy"] = _ctes("x_logits2", "x_logits5") + f"""
SELECT 'detection' AS task, CAST(n AS BIGINT) AS n, round(loss, 6) AS loss FROM ({_wce('x_logits2', 2, [1.05, 1.0])})
UNION ALL
SELECT 'classification', CAST(n AS BIGINT), round(loss, 6) FROM ({_wce('x_logits5', 5, [1.0, 1.3, 1.2, 1.75, 4.0])})"""

Q["t25_best_step"] = _ctes("x_log") + """
SELECT model, step AS best_step, macro_f1 AS best_macro_f1 FROM x_log WHERE macro_f1 IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY model ORDER BY macro_f1 DESC, step) = 1"""

Q["t26_running_best"] = _ctes("x_log") + """
SELECT model, step, macro_f1,
  macro_f1 IS NOT NULL AND (max(macro_f1) OVER w IS NULL OR macro_f1 > max(macro_f1) OVER w) AS is_best
FROM x_log WINDOW w AS (PARTITION BY model ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

Q["t56_stream_best"] = Q["t26_running_best"]

Q["t27_curve_series"] = _ctes("x_log") + """
, best AS (SELECT model, step AS best FROM x_log WHERE macro_f1 IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY model ORDER BY macro_f1 DESC, step) = 1),
long AS (SELECT model, step, 'macro_f1' AS series, CAST(macro_f1 AS DOUBLE) AS value FROM x_log
         UNION ALL SELECT model, step, 'loss', loss FROM x_log)
SELECT long.model, long.step, series, round(value, 6) AS value, coalesce(long.step = best.best, FALSE) AS is_best_step
FROM long LEFT JOIN best ON long.model = best.model"""


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _template_sql(template: str, col: str) -> str:
    pre, _, post = template.partition("{input}")
    return f"{_sql_str(pre)} || {col} || {_sql_str(post)}"


def _prompts() -> str:
    from .queries import PROMPTS

    return "SELECT doc_id, " + ",\n  ".join(f"{_template_sql(t, 'text')} AS {name}" for name, t in PROMPTS.items()) + " FROM documents"


Q["t29_llm_labels"] = _ctes("x_resp") + """
SELECT id, substr(md5(text), 1, 1) AS response, CASE WHEN text IS NULL THEN 'refused' ELSE 'ok' END AS status,
  CAST(CASE substr(md5(text), 1, 1) WHEN '0' THEN 0 WHEN '1' THEN 1 ELSE -1 END AS BIGINT) AS labels FROM x_resp"""

Q["t30_batched_rewrite"] = _ctes("x_rated") + """
, b AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 32 AS batch, substr(md5(body), 1, 1) = '0' AS bad FROM x_rated),
f AS (SELECT *, bool_or(bad) OVER (PARTITION BY batch) AS batch_bad FROM b)
SELECT id,
  CASE WHEN batch_bad AND bad THEN NULL ELSE '[es] ' || body END AS body,
  CASE WHEN batch_bad AND bad THEN NULL ELSE rating END AS rating,
  CASE WHEN batch_bad AND bad THEN 'recitation' ELSE 'ok' END AS status
FROM f"""

# a batch with a '0' fails, with a '1' is cut short (all its items go alone), '2' items are left out and go alone;
# alone, '0' fails, '1' and '2' stay without an answer
Q["t43_faulty_rewrite"] = _ctes("x_rated") + """
SELECT id, CASE WHEN m IN ('0', '1', '2') THEN NULL ELSE '[es] ' || body END AS body,
  CASE WHEN m IN ('0', '1', '2') THEN NULL ELSE rating END AS rating,
  CASE m WHEN '0' THEN 'error' WHEN '1' THEN 'invalid' WHEN '2' THEN 'invalid' ELSE 'ok' END AS status
FROM (SELECT *, substr(md5(body), 1, 1) AS m FROM x_rated)"""

Q["t44_cascade_scorers"] = _ctes("x_resp") + """
, c AS (SELECT id, text, CASE WHEN text IS NULL THEN -1 WHEN contains(text, 'th') THEN 1 ELSE 0 END AS det FROM x_resp),
r AS (SELECT id, det, CASE WHEN det = 1 THEN
        CASE WHEN substr(md5(text), 1, 1) IN ('1', '2', '3', '4', '5') THEN CAST(substr(md5(text), 1, 1) AS INTEGER) - 1 ELSE -1 END
      END AS rating FROM c)
SELECT id, CAST(det AS BIGINT) AS detection, CAST(rating AS BIGINT) AS rating,
  CASE WHEN det = -1 THEN 'error' WHEN det <> 1 THEN 'no_humor' WHEN rating IS NULL OR rating = -1 THEN 'humor_unrated'
       ELSE 'humor_' || CAST(rating + 1 AS VARCHAR) END AS message
FROM r"""

_mc2 = "greatest(e[1], e[2])"
_mc5 = "greatest(e[1], e[2], e[3], e[4], e[5])"
_det = "CASE WHEN e[1] = " + _mc2 + " THEN 0 ELSE 1 END"
_rate = "CASE " + " ".join(f"WHEN e[{i + 1}] = {_mc5} THEN {i}" for i in range(5)) + " END"
Q["t31_cascade"] = f"""
WITH x AS (SELECT vec_id AS id, list_transform(embedding[1:5], lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
y AS (SELECT id, e, {_det} AS detection, CASE WHEN {_det} = 1 THEN {_rate} END AS rating FROM x)
SELECT CAST(id AS BIGINT) AS id, CAST(detection AS BIGINT) AS detection, CAST(rating AS BIGINT) AS rating,
  CASE WHEN detection = -1 THEN 'error' WHEN detection <> 1 THEN 'no_humor'
       WHEN rating IS NULL OR rating = -1 THEN 'humor_unrated'
       ELSE 'humor_' || CAST(rating + 1 AS VARCHAR) END AS message,
  round(exp(e[2] - {_mc2}) / (exp(e[1] - {_mc2}) + exp(e[2] - {_mc2})), 6) AS humor,
  round(exp(e[1] - {_mc2}) / (exp(e[1] - {_mc2}) + exp(e[2] - {_mc2})), 6) AS no_humor
FROM y"""

_ct = "[" + ", ".join(str(t) for t in CLASS_TOKENS) + "]"
Q["t32_pack_examples"] = _ctes("x_tokens") + f"""
, m AS (SELECT id, tokens, score, list_transform(generate_series(1, len(tokens)), lambda i: CASE WHEN (i - 1) % 3 = 0 THEN 0 ELSE 1 END) AS mask
        FROM x_tokens),
a AS (SELECT id,
          CASE WHEN len(tokens) > {MAX_LENGTH} THEN tokens[len(tokens) - {MAX_LENGTH} + 1:] ELSE tokens END AS ids,
          CASE WHEN len(tokens) > {MAX_LENGTH} THEN mask[len(tokens) - {MAX_LENGTH} + 1:] ELSE mask END AS mask,
          coalesce({_ct}[score + 1], {END_TOKEN}) AS lab FROM m),
b AS (SELECT id,
        CASE WHEN lab = {END_TOKEN} THEN
               CASE WHEN ids[-1] = {END_TOKEN} THEN ids[1:len(ids) - 1] ELSE ids END
             WHEN ids[-1] = {END_TOKEN} THEN list_concat(ids[1:len(ids) - 1], [lab])
             WHEN len(ids) + 1 > {MAX_LENGTH} THEN list_concat(ids, [lab])[2:]
             ELSE list_concat(ids, [lab]) END AS input_ids,
        CASE WHEN lab = {END_TOKEN} THEN
               CASE WHEN ids[-1] = {END_TOKEN} THEN mask[1:len(ids) - 1] ELSE mask END
             WHEN ids[-1] = {END_TOKEN} THEN list_concat(mask[1:len(ids) - 1], [1])
             WHEN len(ids) + 1 > {MAX_LENGTH} THEN list_concat(mask, [1])[2:]
             ELSE list_concat(mask, [1]) END AS attention_mask FROM a)
SELECT id, CAST(len(input_ids) AS BIGINT) AS n_tokens, array_to_string(input_ids, ' ') AS input_ids,
  array_to_string(attention_mask, ' ') AS attention_mask FROM b"""

_last = "coalesce(list_max(list_transform(generate_series(1, len(labels)), lambda i: CASE WHEN labels[i] <> -100 THEN i - 1 ELSE 0 END)), 0)"
Q["t33_mask_last_label"] = _ctes("x_tokens") + f"""
, a AS (SELECT id, labels, {_last} AS last_pos FROM x_tokens)
SELECT id, CAST(last_pos AS BIGINT) AS last_pos,
  array_to_string(list_transform(generate_series(1, len(labels)),
      lambda i: CASE WHEN i - 1 = last_pos THEN labels[i] ELSE -100 END), ' ') AS masked,
  array_to_string(list_concat(labels[2:], [-100]), ' ') AS shifted
FROM a"""

_lookup = "CASE {x} " + " ".join(f"WHEN {t} THEN {i}" for i, t in enumerate(CLASS_TOKENS)) + " ELSE -100 END"
Q["t34_last_valid_gather"] = _ctes("x_tokens") + f"""
, a AS (SELECT id, tokens, labels, {_last} AS last_pos FROM x_tokens),
b AS (SELECT id, last_pos, labels[last_pos + 1] AS label_tok,
        CASE WHEN last_pos - 1 < 0 THEN tokens[last_pos - 1] ELSE tokens[last_pos] END AS pred_tok FROM a)
SELECT id, CAST(last_pos AS BIGINT) AS last_pos,
  CAST({_lookup.format(x='label_tok')} AS BIGINT) AS label_class,
  CAST(pred_tok AS BIGINT) AS pred_token,
  CAST({_lookup.format(x='pred_tok')} AS BIGINT) AS pred_class
FROM b"""


def _profile_sql() -> str:
    cols = [("doc_id", "num"), ("text", "str"), ("lang", "str"), ("source", "str"), ("n_chars", "num")]
    rows = ["SELECT '*' AS \"column\", 'rows' AS stat, CAST(count(*) AS DOUBLE) AS value FROM documents"]
    for c, kind in cols:
        stats = [("count", f"count({c})"), ("missing", f"count(*) - count({c})"),
                 ("distinct", f"count(DISTINCT {c})"), ("any_missing", f"CAST(bool_or({c} IS NULL) AS INTEGER)")]
        if kind == "num":
            stats += [("min", f"min({c})"), ("max", f"max({c})"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})")]
            stats += [(f"p{int(q * 100)}", f"quantile_cont({c}, {q})") for q in (0.25, 0.5, 0.75)]
        else:
            stats += [("min_length", f"min(length({c}))"), ("max_length", f"max(length({c}))"),
                      ("mean_length", f"avg(length({c}))")]
        rows += [f"SELECT '{c}', '{s}', CAST({e} AS DOUBLE) FROM documents" for s, e in stats]
    rows.append("SELECT '*', 'duplicate_rows', CAST(coalesce(sum(n - 1), 0) AS DOUBLE) FROM "
                "(SELECT count(*) AS n FROM documents GROUP BY ALL_COLUMNS)")
    body = "\nUNION ALL ".join(rows).replace("GROUP BY ALL_COLUMNS", "GROUP BY doc_id, text, lang, source, n_chars")
    return f"SELECT \"column\", stat, round(value, 6) AS value FROM ({body})"


Q["t35_profile"] = _profile_sql()

Q["t55_merged_profile"] = f"""
SELECT "column", stat, CASE WHEN stat IN ('distinct', 'duplicate_rows') OR regexp_matches(stat, '^p[0-9]') THEN 1.0 ELSE value END AS value
FROM ({Q["t35_profile"]})"""

_top = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM documents GROUP BY 2"
                        for c in ("lang", "source", "n_chars"))
Q["t45_top_values"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS FIRST) AS rank FROM ({_top})) WHERE rank <= 5"""

Q["t36_param_diff"] = """
WITH p AS (
  SELECT event_id, 'trainer_optim' AS param, event_type AS value, 'view' AS dflt FROM events
  UNION ALL SELECT event_id, 'trainer_per_device_train_batch_size', json_extract_string(props, '$.k'), '50' FROM events)
SELECT event_id, param, value FROM p WHERE value IS DISTINCT FROM dflt"""

Q["t37_metrics_sink"] = """
WITH runs AS (
  SELECT user_id AS model, min(ts) AS started, avg(value) AS eval_loss,
    CAST(max(floor(value)) AS DOUBLE) AS "eval_macro_avg_f1-score",
    count(*) FILTER (WHERE value > 10) / count(*) AS eval_accuracy, CAST(count(*) AS DOUBLE) AS eval_runtime
  FROM events GROUP BY user_id),
long AS (
  SELECT model, started, 'eval_loss' AS metric, eval_loss AS value FROM runs
  UNION ALL SELECT model, started, 'eval_macro_avg_f1-score', "eval_macro_avg_f1-score" FROM runs
  UNION ALL SELECT model, started, 'eval_accuracy', eval_accuracy FROM runs
  UNION ALL SELECT model, started, 'eval_runtime', eval_runtime FROM runs)
SELECT 'test_model' || CAST(model AS VARCHAR) AS experiment,
  'encoder_detection_' || strftime(started, '%H:%M:%S-%d/%m/%Y') AS run_name,
  replace(metric, 'eval_', '') AS metric, round(value, 6) AS value
FROM long WHERE regexp_matches(metric, '(accuracy|f1-score|loss|precision|recall)$')"""

Q["t39_registry_join"] = f"""
WITH reg AS ({registry_sql()})
SELECT e.event_id, r.name, r.decoder, r.file_name, r.load_tuned, r.threshold,
  round(1.0 - e.value / 500.0, 6) AS score_0, round(e.value / 500.0, 6) AS score_1,
  CAST(CASE WHEN e.value / 500.0 > coalesce(r.threshold, 0.5) THEN 1 ELSE 0 END AS BIGINT) AS labels
FROM events e JOIN reg r ON e.user_id % 11 = r.idx"""

Q["t40_csv_roundtrip"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"

Q["t41_json_roundtrip"] = _ctes("x_rated") + "SELECT id, body, rating FROM x_rated"


def _train_family_sql() -> str:
    return (
        _ctes("x_scored", "x_rated") + _contradiction_sql() + ",\n" + _repetition_sql() + """
, base AS (SELECT text, score FROM x_scored),
rep_train AS (SELECT text, score FROM rep WHERE part = 'train'),
exc_rows AS (SELECT text, score FROM exc),
u1 AS (SELECT * FROM base UNION ALL SELECT * FROM rep_train UNION ALL SELECT * FROM exc_rows),
train AS (SELECT * FROM u1 QUALIFY count(*) OVER (PARTITION BY text) = 1),
conflict AS (SELECT body FROM x_rated GROUP BY body HAVING count(DISTINCT rating) > 1),
rated AS (SELECT body AS text, CAST(round_even(rating, 0) AS INTEGER) AS score FROM x_rated
          WHERE body NOT IN (SELECT body FROM conflict) AND body <> '' AND length(body) <= 512
          QUALIFY row_number() OVER (PARTITION BY body ORDER BY id) = 1),
u2 AS (SELECT * FROM train UNION ALL SELECT * FROM rated),
multi AS (SELECT * FROM u2 QUALIFY count(*) OVER (PARTITION BY text) = 1),
fam AS (SELECT 'train' AS family, text, score FROM train UNION ALL SELECT 'train_multilingual', text, score FROM multi),
views AS (
  SELECT family, 'base' AS view, score FROM fam
  UNION ALL SELECT family, 'classification', score - 1 FROM fam WHERE score > 0
  UNION ALL SELECT family, 'detection', CASE WHEN score IS DISTINCT FROM 0 THEN 1 ELSE 0 END FROM fam)
SELECT family, view, CAST(score AS BIGINT) AS score, count(*) AS n FROM views GROUP BY family, view, score"""
    )


Q["t12_train_family"] = _train_family_sql()


Q["t54_growing_families"] = Q["t12_train_family"]

Q["t46_train_family_files"] = _ctes("x_scored") + """
SELECT 'base' AS view, text, CAST(score AS BIGINT) AS score FROM x_scored
UNION ALL SELECT 'classification', text, CAST(score - 1 AS BIGINT) FROM x_scored WHERE score > 0
UNION ALL SELECT 'detection', text, CAST(CASE WHEN score IS DISTINCT FROM 0 THEN 1 ELSE 0 END AS BIGINT) FROM x_scored"""

Q["t47_json_arrays"] = _ctes("x_rated") + "SELECT id, body, rating FROM x_rated"

Q["t48_training_logs"] = """
WITH l AS (SELECT CAST(event_id AS BIGINT) AS step, value / 4 AS macro_f1, 'm' || CAST(user_id % 7 AS VARCHAR) AS model,
             CASE WHEN user_id % 2 = 0 THEN 'classification' ELSE 'detection' END AS task FROM events)
SELECT model, task, step AS best_step, round(macro_f1, 6) AS best_macro_f1 FROM l WHERE macro_f1 IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY model, task ORDER BY macro_f1 DESC, step) = 1"""

Q["t49_missing_gate"] = _ctes("x_resp") + """
SELECT substr(text, 1, 1) AS head, bool_or(text IS NULL OR length(text) % 13 = 0) AS missing, count(*) AS n
FROM x_resp GROUP BY 1"""

_exp = ", ".join(f"({i}, '{m}', '{t}', '{steps}', '{batch}')"
                 for i, (m, t, steps, batch, *_) in enumerate(sorted(EXPERIMENTS, key=lambda e: e[:2])))
Q["t50_changed_arguments"] = f"""
WITH x AS (SELECT * FROM (VALUES {_exp}) AS v(idx, model, task, steps, batch)),
a AS (SELECT idx, model, task, 'trainer_max_steps' AS param, steps AS value FROM x WHERE steps <> '-1'
      UNION ALL SELECT idx, model, task, 'trainer_per_device_train_batch_size', batch FROM x WHERE batch <> '8')
SELECT e.event_id, a.model, a.task, a.param, a.value FROM events e JOIN a ON e.user_id % 14 = a.idx"""

Q["t51_fixed_test_set"] = _ctes("x_scored") + """
, d AS (SELECT id, CASE WHEN score IS DISTINCT FROM 0 THEN 1 ELSE 0 END AS score FROM x_scored WHERE text IS NOT NULL),
c AS (SELECT score, count(*) AS n FROM d WHERE id % 5 <> 0 GROUP BY score),
m AS (SELECT score, (SELECT min(n) FROM c) AS n, CASE score WHEN 0 THEN 1.05 ELSE 1.0 END AS w FROM c)
SELECT 'test_' || CAST(score AS VARCHAR) || '_support' AS name, CAST(count(*) AS DOUBLE) AS value FROM d WHERE id % 5 = 0 GROUP BY score
UNION ALL SELECT 'probabilities_sum_to_1', 1.0
UNION ALL SELECT 'train_rows_' || CAST(score AS VARCHAR), CAST(n AS DOUBLE) FROM m
UNION ALL SELECT 'train_weight_' || CAST(score AS VARCHAR), round(CAST(n * w AS DOUBLE), 6) FROM m"""

# K4: five suites, keyword scorer, report per suite
_KW = "|".join(EXCLUSIVE_HUMOR)
Q["t42_evaluation_suites"] = _ctes("x_scored") + _contradiction_sql() + ",\n" + _repetition_sql() + f"""
, test AS (SELECT text, CASE WHEN score IS DISTINCT FROM 0 THEN 1 ELSE 0 END AS score FROM x_scored),
suites AS (
  SELECT 'test' AS suite, text, score FROM test
  UNION ALL SELECT 'exclusive', text, CASE WHEN score IS DISTINCT FROM 0 THEN 1 ELSE 0 END FROM exc
  UNION ALL SELECT 'long_lengths', text, score FROM test
    WHERE length(text) >= (SELECT quantile_cont(length(text), 0.9) FROM test)
  UNION ALL SELECT 'short_lengths', text, score FROM test
    WHERE length(text) <= (SELECT quantile_cont(length(text), 0.1) FROM test)
  UNION ALL SELECT 'repetition', text, score FROM rep WHERE part = 'test'),
x_pred AS (SELECT suite, score AS label,
             CASE WHEN text IS NULL THEN -1 WHEN regexp_matches(text, '{_KW}') THEN 1 ELSE 0 END AS pred FROM suites)
""" + _report_sql("suite") + """
SELECT suite, metric, round(CAST(value AS DOUBLE), 6) AS value FROM longs"""


# K3: the run restated step by step; a state of 10 classes x (64 + 1) weights, the intercept last
Q["t52_training_run"] = f"""
WITH RECURSIVE
v AS (SELECT vec_id AS id, label AS y, 1 + label % 2 AS wt, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) || [1.0::DOUBLE] AS x FROM embeddings),
ranked AS (SELECT *, row_number() OVER (ORDER BY {u_sql('id', "'batches'")}, id) - 1 AS rk, count(*) OVER () AS n FROM v WHERE id % 5 <> 0),
tr AS (SELECT *, rk // ((n + 7) // 8) AS batch FROM ranked),
nb AS (SELECT max(batch) + 1 AS n FROM tr),
run(step, w, m, loss) AS (
  SELECT 0, list_transform(range(650), lambda i: 0.0::DOUBLE), list_transform(range(650), lambda i: 0.0::DOUBLE), 0.0::DOUBLE
  UNION ALL
  SELECT step + 1, list(wv - 0.5 * (1 - step / (2.0 * n)) * mv ORDER BY i), list(mv ORDER BY i), any_value(loss)
  FROM (
    SELECT step, n, i, any_value(w0) AS wv, 0.9 * any_value(m0) + sum(g) / any_value(sw) AS mv, any_value(sl) / any_value(sw) AS loss
    FROM (
      SELECT step, n, unnest(range(650)) AS i, unnest(w) AS w0, unnest(m) AS m0,
             unnest(list_transform(range(650), lambda i: x[i % 65 + 1] * wt * (p[i // 65 + 1] - CASE WHEN y = i // 65 THEN 1 ELSE 0 END))) AS g, sw, sl
      FROM (
        SELECT step, n, w, m, x, y, wt, p, sum(wt) OVER () AS sw, sum(-wt * ln(p[y + 1])) OVER () AS sl
        FROM (
          SELECT step, n, w, m, x, y, wt, list_transform(z, lambda a: exp(a - list_max(z)) / list_sum(list_transform(z, lambda b: exp(b - list_max(z))))) AS p
          FROM (
            SELECT r.step, nb.n, r.w, r.m, t.x, t.y, t.wt, list_transform(range(10), lambda c: list_dot_product(t.x, r.w[c * 65 + 1:c * 65 + 65])) AS z
            FROM run r, nb, tr t WHERE t.batch = r.step % nb.n AND r.step < 2 * nb.n))))
    GROUP BY step, n, i)
  GROUP BY step, n),
judged AS (SELECT step, w FROM run, nb WHERE step > 0 AND (step % 4 = 0 OR step = 2 * n)),
margins AS (SELECT step, y, wt, list_transform(range(10), lambda c: list_dot_product(x, w[c * 65 + 1:c * 65 + 65])) AS z FROM judged, v WHERE id % 5 = 0),
out AS (SELECT step, y, wt, list_position(z, list_max(z)) - 1 AS guess,
               ln(list_sum(list_transform(z, lambda b: exp(b - list_max(z))))) + list_max(z) - z[y + 1] AS nll FROM margins),
cls AS (SELECT step, y AS c FROM out UNION SELECT step, guess FROM out),
f AS (SELECT c.step, c.c, count(*) FILTER (o.y = c.c) AS support, 2 * count(*) FILTER (o.y = c.c AND o.guess = c.c) / (count(*) FILTER (o.y = c.c) + count(*) FILTER (o.guess = c.c)) AS f1
      FROM cls c JOIN out o USING (step) GROUP BY ALL),
fs AS (SELECT step, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM f GROUP BY step),
os AS (SELECT step, sum(wt * nll) / sum(wt) AS loss, avg(CASE WHEN y = guess THEN 1.0 ELSE 0.0 END) AS accuracy FROM out GROUP BY step),
tl AS (SELECT j.step, avg(r.loss) AS train_loss FROM judged j JOIN run r ON r.step <= j.step AND r.step > j.step - 4 AND r.step > (j.step - 1) // 4 * 4 GROUP BY j.step)
SELECT CAST(step AS BIGINT) AS step, round(train_loss, 6) AS train_loss, round(loss, 6) AS loss, round(CAST(accuracy AS DOUBLE), 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
  round(CAST(weighted_f1 AS DOUBLE), 6) AS weighted_f1, row_number() OVER (ORDER BY macro_f1 DESC, step) = 1 AS is_best
FROM os JOIN fs USING (step) JOIN tl USING (step)"""


Q["t53_request_ledger"] = _ctes("x_resp") + """
SELECT id, substr(md5(text), 1, 1) AS response, CASE WHEN text IS NULL THEN 'refused' ELSE 'ok' END AS status,
  CAST(CASE substr(md5(text), 1, 1) WHEN '0' THEN 0 WHEN '1' THEN 1 ELSE -1 END AS BIGINT) AS labels,
  CAST(CASE WHEN text IS NULL THEN NULL WHEN text IN (SELECT text FROM x_resp WHERE id % 2 = 0 AND text IS NOT NULL) THEN 0 ELSE 1 END AS BIGINT) AS call
FROM x_resp"""


Q["t57_committed_appends"] = _ctes("x_rated") + """
SELECT id, body, CASE WHEN rating < 2.5 THEN rating ELSE rating + 100 END AS rating FROM x_rated"""

Q["t58_ordered_files"] = """
SELECT doc_id, lang, n_chars, TRUE AS in_order FROM documents
WHERE doc_id BETWEEN (SELECT CAST(trunc(quantile_cont(doc_id, 0.25)) AS BIGINT) FROM documents) AND (SELECT CAST(trunc(quantile_cont(doc_id, 0.75)) AS BIGINT) FROM documents)"""


Q["t59_registry_load"] = _ctes("x_scored") + """
SELECT format, text, CAST(score AS BIGINT) AS score FROM x_scored, (VALUES ('csv'), ('json'), ('parquet')) AS f(format)"""

Q["t60_routed_models"] = _ctes("x_resp") + """
, r AS (SELECT id, text, ['classes', 'words', 'detector', 'none'][id % 4 + 1] AS model, CAST('0x' || substr(md5(text), 1, 2) AS INTEGER) / 255.0 AS p FROM x_resp)
SELECT id, model,
  CASE model WHEN 'classes' THEN substr(md5(text), 1, 1) WHEN 'words' THEN CASE WHEN contains(text, 'th') THEN '1' ELSE '0' END
    WHEN 'detector' THEN CASE WHEN p = 0 THEN '0.0' WHEN p = 1 THEN '1.0' ELSE CAST(CAST(p AS DOUBLE) AS VARCHAR) END END AS response,
  CASE WHEN model = 'none' THEN 'unrouted' WHEN text IS NULL THEN 'refused' ELSE 'ok' END AS status,
  CASE WHEN model = 'detector' THEN round(CAST(1 - p AS DOUBLE), 6) END AS score_0, CASE WHEN model = 'detector' THEN round(CAST(p AS DOUBLE), 6) END AS score_1,
  CAST(CASE WHEN text IS NULL THEN -1 ELSE CASE model
    WHEN 'classes' THEN CASE substr(md5(text), 1, 1) WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 'c' THEN 2 ELSE -1 END
    WHEN 'words' THEN CASE WHEN contains(text, 'th') THEN 1 ELSE 0 END
    WHEN 'detector' THEN CASE WHEN p > 0.65 THEN 1 ELSE 0 END ELSE -1 END END AS BIGINT) AS labels
FROM r"""

Q["t61_class_probabilities"] = _ctes("x_logits5") + " UNION ALL ".join(
    f"SELECT CAST(id AS BIGINT) AS id, CAST({i + 1} AS BIGINT) AS class, round({p}, 6) AS p FROM x_logits5" for i, p in enumerate(_p5))


def oracle_sql() -> dict[str, str]:
    out = dict(Q)
    out["t28_prompts"] = _prompts()
    return dict(sorted(out.items()))
