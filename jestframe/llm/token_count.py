"""Operator 1: token counts by a map-side two-tier lookup.

Pass 1 gives every task's most frequent pre-tokens (a bounded summary of the
task's whole texts); their merged top ``table_size`` are encoded once and
broadcast as a table pre-token -> number of tokens.  Pass 2 splits every whole
text again and sums the lengths: first tier the broadcast table, second tier a
bounded cache in each Python worker whose misses are encoded.  No pre-token
occurrence is ever shuffled, and the table only changes speed, not counts.

Where the split can't be taken over from the tokenizer (another kind of
pre-tokenizer, a special string in the text, characters whose Unicode class
may differ between libraries) the tokenizer encodes the whole text.

Null text counts as empty: 0 bytes, 0 tokens.  Rows are neither merged nor
dropped, whatever the id (null and repeated ids included); the result has one
row per input row.  An empty table gives an empty result.  Columns other than
the id and the text aren't read, so their names can't clash.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jestframe.llm.common import written

# Fixed value: the byte-level pre-tokenizer's split pattern.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters on whose class (letter, number, space) all regex engines agree.
PLAIN_TEXT = r"[\t-\r -~¡-ɏ‐-‧‰-⁞₠-₿]*"

TABLE_SIZE = 1 << 15
CACHE_SIZE = 1 << 18


class Counting:
    """One worker's tokenizer, split pattern and length tables."""

    def __init__(self, kind: str, model: bytes, table: dict[str, int] | None = None, cache_size: int = CACHE_SIZE):
        import regex

        self.splits, self.special = False, []
        if kind == "model":
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=model)
            self.encoded = lambda text: len(processor.encode(text, add_bos=False, add_eos=False, num_threads=1))
        else:
            from tokenizers import Tokenizer

            spec = json.loads(model)
            tokenizer = Tokenizer.from_str(model.decode())
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encoded = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
            pre = spec.get("pre_tokenizer") or {}
            self.splits = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space")
            self.special = [a["content"] for a in spec.get("added_tokens") or []]
        self.find = regex.compile(BYTE_LEVEL_SPLIT).findall
        self.plain = regex.compile(PLAIN_TEXT).fullmatch
        encoded, cache = self.encoded, {}

        class Lengths(dict):
            def __missing__(self, piece: str) -> int:
                n = cache.get(piece)
                if n is None:
                    if len(cache) >= cache_size:
                        cache.clear()
                    n = cache[piece] = encoded(piece)
                return n

        self.length = Lengths(table or {}).__getitem__

    def pieces(self, text: str) -> list[str] | None:
        """The text's pre-tokens; None where only the tokenizer may split it."""
        if not self.splits or not self.plain(text) or any(s in text for s in self.special):
            return None
        return self.find(text)

    def count(self, text: str) -> int:
        if not text:
            return 0
        pieces = self.pieces(text)
        return self.encoded(text) if pieces is None else sum(map(self.length, pieces))


def frequent_pieces(texts: DataFrame, kind: str, model, size: int) -> list[str]:
    """The ``size`` most frequent pre-tokens over all texts, from summaries of
    at most ``size`` entries per task."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting, seen = Counting(kind, model.value), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(counting.pieces(text or "") or ())
            if len(seen) > 16 * size:
                seen = Counter(dict(seen.most_common(8 * size)))
        top = seen.most_common(size)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    top = texts.mapInArrow(summary, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)
    return [r["piece"] for r in written(top, "pieces").collect()]


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024, table_size: int = TABLE_SIZE, cache_size: int = CACHE_SIZE) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    ``tokenizer_path``: a ``tokenizers`` .json or a ``sentencepiece`` .model; the
    driver reads it and broadcasts its bytes (a few MB, bounded by the file).
    """
    sc = docs.sparkSession.sparkContext
    kind = "model" if tokenizer_path.endswith(".model") else "json"
    with open(tokenizer_path, "rb") as f:
        model = sc.broadcast(f.read())
    local = Counting(kind, model.value)
    texts = docs.select(F.col(text_col).alias("text"))
    frequent = frequent_pieces(texts, kind, model, table_size) if local.splits else []
    table = sc.broadcast({p: local.encoded(p) for p in frequent})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(kind, model.value, table.value, cache_size)
        for batch in batches:
            n = pa.array([counting.count(t or "") for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("n_bytes"), n], names=[id_col, "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    return (docs.select(id_col, n_bytes, F.col(text_col).alias("text"))
            .mapInArrow(count, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
