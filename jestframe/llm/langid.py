"""Operator 4: language identification by prediction by partial matching.

Each language has a byte context tree of orders 0..3 (the bytes of the
lower-cased text), with escape probabilities by method C: in a context seen
with n symbols of d kinds, a known byte of count c costs -log2(c/(n+d)), an
escape -log2(d/(n+d)), and below order 0 each of the 256 bytes costs 8 bits.
The counts are frozen after training.  A text's code length under a language
is the exact sum over all its bytes; the shortest wins (ties: the smaller
language name).  ``score`` is the winner's posterior under equal priors.

Defined results: a text that is null, empty or without any letter gets
``und`` and score 0; so does every text if no row can be learned from.  Rows
with a null language, text or id are not learned from; a null id is not held
out.  Repeated rows are scored each.  Long texts are scored whole; they are learned
from in pieces, so a language with long texts only is learned too.  Kept columns
called lang_pred, score or bits give way to the operator's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jestframe.llm.common import free_name, others

ORDER = 3
SAMPLE_BYTES = 4_000_000  # of training text for each language, about
PIECE = 200_000  # bytes of a long text that are sampled together
CHUNK = 1 << 19  # bytes scored at once: a worker's arrays take about a hundred times that


def lower_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def grams(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte its ORDER predecessors and itself in one number; bytes
    before a text's start count as 0."""
    out = data.astype(np.int64)
    back = np.zeros(len(data), np.int64)  # position within the text, up to ORDER
    first = np.zeros(len(data), bool)
    first[starts[starts < len(data)]] = True
    back = np.where(first, 0, ORDER)
    for k in range(1, ORDER):
        at = starts + k
        at = at[at < len(data)]
        at = at[~first[at]]
        back[at] = np.minimum(back[at], k)
    for k in range(1, ORDER + 1):
        shifted = np.zeros(len(data), np.int64)
        shifted[k:] = data[:-k] if k < len(data) else 0
        out |= np.where(back >= k, shifted, 0) << (8 * k)
    return out


class ContextTrees:
    """Frozen counts of all languages as sorted arrays per language and order."""

    def __init__(self, rows: pd.DataFrame):
        self.langs = sorted(rows["lang"].unique())
        self.levels = []  # per language, from the longest order down: (symbols, counts, contexts, totals, kinds)
        for lang in self.langs:
            own, levels = rows[rows["lang"] == lang], []
            for k in range(ORDER, -1, -1):
                sym = pd.Series(own["n"].to_numpy(np.float64)).groupby(own["gram"].to_numpy() & ((1 << (8 * (k + 1))) - 1)).sum()
                ctx = sym.groupby(sym.index.to_numpy() >> 8).agg(["sum", "size"])
                levels.append((sym.index.to_numpy(), sym.to_numpy(), ctx.index.to_numpy(), ctx["sum"].to_numpy(np.float64), ctx["size"].to_numpy(np.float64)))
            self.levels.append(levels)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte: array (languages, keys)."""

        def find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(table, x), len(table) - 1)
            return at, table[at] == x

        out = np.zeros((len(self.langs), len(keys)))
        for row, levels in zip(out, self.levels, strict=True):
            todo = np.arange(len(keys))
            for k, (syms, counts, ctxs, totals, kinds) in zip(range(ORDER, -1, -1), levels, strict=True):
                x = keys[todo] & ((1 << (8 * (k + 1))) - 1)
                c, known = find(ctxs, x >> 8)
                s, hit = find(syms, x)
                whole = totals[c] + kinds[c]
                row[todo] += np.where(hit, -np.log2(counts[s] / whole), np.where(known, -np.log2(kinds[c] / whole), 0.0))
                todo = todo[~hit]
            row[todo] += 8.0
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits: array (texts, languages)."""
        total = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) for t in texts], np.int64)
        i = 0
        while i < len(texts):
            if sizes[i] > CHUNK:  # a long text in parts, each after the bytes before it
                for at in range(0, sizes[i], CHUNK):
                    back = min(at, ORDER)
                    own = np.frombuffer(texts[i][at - back:at + CHUNK], np.uint8)
                    codes, keys = pd.factorize(grams(own, np.zeros(int(at == 0), np.int64))[back:])
                    total[i] += self.bits(keys) @ np.bincount(codes, minlength=len(keys))
                i += 1
                continue
            j = max(i + 1, i + int(np.searchsorted(np.cumsum(sizes[i:]), CHUNK, side="right")))
            data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
            if len(data):
                own = sizes[i:j]
                codes, keys = pd.factorize(grams(data, np.cumsum(own) - own))
                cost, doc = self.bits(keys), np.repeat(np.arange(j - i), own)
                for n in range(len(self.langs)):
                    total[i:j, n] = np.bincount(doc, weights=cost[n][codes], minlength=j - i)
            i = j
        return total


def fit(docs: DataFrame, learnable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_bytes: int = SAMPLE_BYTES) -> ContextTrees | None:
    """Count the grams of about ``sample_bytes`` of text per language: a keyed
    sample of the learnable rows, and of the pieces of texts over PIECE bytes; at
    most that many counts reach the driver."""
    rows = docs.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.sum(F.octet_length(text_col)).alias("n")).collect()}
    if not any(sizes.values()):
        return None
    share = F.coalesce(*[F.when(F.col(lang_col) == lang, F.lit(min(1.0, sample_bytes / max(n, 1)))) for lang, n in sizes.items()])
    keyed = F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1_000_003)) < share * 1_000_003

    def pieces(key: str, text: str, part: float) -> list[bytes]:
        """A text that was sampled whole, or the sampled pieces of a long one."""
        data = lower_bytes(text)
        if len(text.encode("utf-8", "replace")) <= PIECE:
            return [data]
        return [data[i:i + PIECE] for i in range(0, len(data), PIECE) if xxhash.xxh64_intdigest(f"{key}:{i}") % 1_000_003 < part * 1_000_003]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for key, lang, text, part in zip(*(batch.column(c).to_pylist() for c in ("id", "lang", "text", "share")), strict=True):
                by_lang.setdefault(lang, []).extend(pieces(key, text, part))
            for lang, texts in by_lang.items():
                if not any(texts):
                    continue
                data, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
                codes, keys = pd.factorize(grams(data, np.cumsum(size) - size))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(np.bincount(codes, minlength=len(keys)), pa.int64())], names=["lang", "gram", "n"])

    chosen = keyed | (F.octet_length(text_col) > PIECE)
    counts = (rows.where(chosen).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), share.alias("share"))
              .mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    return ContextTrees(counts) if len(counts) else None


def predict(docs: DataFrame, model: ContextTrees | None, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row with lang_pred, score and bits."""
    trees = docs.sparkSession.sparkContext.broadcast(model)
    keep = others(keep, ["lang_pred", "score", "bits"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            usable = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool) & (trees.value is not None)
            pred, conf, bits = np.full(len(texts), "und", object), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if usable.any():
                lengths = trees.value.lengths([lower_bytes(texts[i]) for i in np.flatnonzero(usable)])
                least = lengths.min(axis=1)
                pred[usable] = np.array(trees.value.langs, object)[lengths.argmin(axis=1)]
                conf[usable] = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(axis=1)
                bits[usable] = least
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(pred, pa.string()), pa.array(conf), pa.array(bits)],
                                             names=[*keep, "lang_pred", "score", "bits"])

    schema = "".join(f"`{c}` {t}, " for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, F.col(text_col).alias(free_name(docs, "text_"))).mapInArrow(score, f"{schema}lang_pred string, score double, bits double")
