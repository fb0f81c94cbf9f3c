"""Operator 9: benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased runs of letters and digits.  For every item size (in
words) the windows of that size in a document get a 64-bit SimHash of their
words (weight: letters of the word), at every word position.  Multi-index
Hamming search: a fingerprint within RADIUS = 11 of an item's lies within 2 in
at least one of four 16-bit blocks, so the tables of all block values within 2
of an item's block miss no fingerprint within the radius.  A window over the
threshold may lie beyond the radius, so windows whose shared shingles weigh at
least ``threshold`` of the item are candidates too (a similarity of ``threshold``
takes as much): none is missed.  Candidates are verified exactly: weighted Jaccard similarity of the ``shingle``-word shingles
of window and item (as multisets, weight: letters of the shingle) of at least
``threshold``.  Windows are only opened where they hold a shingle of some item,
as no other window can pass the verification.

The Hamming search finds nearly all matches by itself (449 of 453 in a test of edited
items of 15 to 30 words); what it misses lies beyond the radius, and the shared
weights complete it.

The benchmark goes to the workers in slices of at most SLICE_ITEMS items and about
SLICE_BYTES of their texts.  Each slice is a pass of its own over the documents
(written in between), so a worker holds one bounded index at a time.

Defined results: items and documents without words (or null) never match; an
item of fewer words than ``shingle`` is one shingle; a document shorter than an
item is one window.  Repeated rows are each judged; an empty benchmark flags
nothing.  The other columns are handed through untouched; a kept column called
matches gives way to the operator's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jestframe.llm.common import free_name, others, written

RADIUS, NEAR = 11, 2  # 4 blocks of 16 bits: RADIUS < 4 * (NEAR + 1)
SLICE_ITEMS = 20_000
SLICE_BYTES = 1 << 24
WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: odd multiplier (2^64 over the golden ratio)
FLIPS = np.array([0, *(1 << i for i in range(16)), *((1 << i) | (1 << j) for i in range(16) for j in range(i))], np.uint16)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def hashed(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * MIX + hashes[k:len(hashes) - width + 1 + k]
    return out


def fingerprints(hashes: np.ndarray, letters: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words at ``starts`` (ascending)."""
    out = np.zeros(len(starts), np.uint64)
    cuts = np.flatnonzero(np.diff(starts) > size) + 1
    for run in np.split(np.arange(len(starts)), cuts):
        for i in range(0, len(run), 2048):
            own = starts[run[i:i + 2048]]
            lo, hi = own[0], own[-1] + size
            bits = ((hashes[lo:hi, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int32) * 2 - 1
            sums = np.zeros((hi - lo + 1, 64), np.int32)
            np.cumsum(bits * letters[lo:hi, None], axis=0, out=sums[1:])
            signs = sums[own - lo + size] - sums[own - lo] > 0
            out[run[i:i + 2048]] = np.packbits(signs, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def shingle_weights(words: list[str], shingle: int) -> Counter:
    width = min(shingle, len(words))
    return Counter(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def similarity(x: Counter, y: Counter) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    weight = {s: sum(map(len, s)) for s in x | y}
    both = sum(n * weight[s] for s, n in (x & y).items())
    every = sum(n * weight[s] for s, n in (x | y).items())
    return both / every if every else 0.0


class ItemIndex:
    """Gate grams, and per item size the fingerprints and their block tables."""

    def __init__(self, items: list[tuple[int, list[str]]], shingle: int):
        self.shingle, self.gates, self.sizes, self.shared = shingle, {}, {}, {}
        by_size: dict[int, list] = {}
        for item_id, words in items:
            by_size.setdefault(len(words), []).append((item_id, words, hashed(words)))
        for size, own in sorted(by_size.items()):
            width = min(shingle, size)
            self.gates.setdefault(width, []).extend(grams(h, width) for _, _, h in own)
            prints = np.array([fingerprints(h, np.array([len(w) for w in words]), np.zeros(1, np.int64), size)[0] for _, words, h in own], np.uint64)
            tables = np.zeros((4, 1 << 16), bool)
            for k, block in enumerate(prints.view(np.uint16).reshape(-1, 4).T):
                tables[k, (block[:, None] ^ FLIPS).ravel()] = True
            pairs = np.unique(np.array([(g, k) for k, (_, _, h) in enumerate(own) for g in grams(h, width).tolist()], np.uint64).reshape(-1, 2), axis=0)
            weights = np.array([sum(n * sum(map(len, s)) for s, n in shingle_weights(words, shingle).items()) for _, words, _ in own], np.float64)
            self.shared[size] = pairs[:, 0].copy(), pairs[:, 1].astype(np.int64), weights
            self.sizes[size] = (prints, tables, [(item_id, shingle_weights(words, shingle)) for item_id, words, _ in own])
        self.gates = {w: np.unique(np.concatenate(g)) for w, g in self.gates.items()}

    def near(self, prints: np.ndarray, size: int) -> list[tuple[int, int]]:
        """(window, item) pairs within the radius."""
        own, tables, _ = self.sizes[size]
        blocks = prints.view(np.uint16).reshape(-1, 4)
        at = np.flatnonzero(tables[0, blocks[:, 0]] | tables[1, blocks[:, 1]] | tables[2, blocks[:, 2]] | tables[3, blocks[:, 3]])
        out = []
        for i in range(0, len(at), 256):
            w, k = np.nonzero(np.bitwise_count(prints[at[i:i + 256], None] ^ own) <= RADIUS)
            out += zip(at[i:i + 256][w].tolist(), k.tolist(), strict=True)
        return out

    def sharing(self, own: np.ndarray, hits: np.ndarray, letters: np.ndarray, size: int, window: int, threshold: float) -> list[tuple[int, int]]:
        """(start, item) of all windows whose shingles (``own``, at ``hits``) shared with an item weigh ``threshold`` of it or more."""
        keys, items, weights = self.shared[size]
        width = min(self.shingle, size)
        left, right = np.searchsorted(keys, own[hits]), np.searchsorted(keys, own[hits], side="right")
        n = right - left
        at = np.repeat(hits, n)
        item = items[np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.concatenate([[0], np.cumsum(letters, dtype=np.int64)])
        weight = ends[at + width] - ends[at]
        least = weights * threshold * (1 - 1e-9)
        out = []
        for k in np.flatnonzero(np.bincount(item, weights=weight, minlength=len(weights)) >= least):
            mine = item == k
            sums = np.zeros(len(own) + 1, np.int64)
            sums[at[mine] + 1] = weight[mine]
            sums = np.cumsum(sums)
            starts = np.arange(len(letters) - window + 1)
            out += [(int(s), int(k)) for s in np.flatnonzero(sums[starts + window - width + 1] - sums[starts] >= least[k])]
        return out

    def matches(self, text: str | None, threshold: float, complete: bool = True) -> list[dict]:
        """The best window (then the first) of every item that some window matches;
        of the windows within the radius alone, if not ``complete``."""
        words = words_of(text)
        if not words or not self.sizes:
            return []
        hashes = hashed(words)
        hits, every = {}, {}
        for width, gate in self.gates.items():
            own = every[width] = grams(hashes, width)
            at = np.minimum(np.searchsorted(gate, own), len(gate) - 1)
            hits[width] = np.flatnonzero(gate[at] == own)
        if not any(map(len, hits.values())):
            return []
        letters, best = np.array([len(w) for w in words], np.int32), {}
        for size in self.sizes:
            width, window = min(self.shingle, size), min(size, len(words))
            if not len(hits[width]):
                continue
            first, last = np.maximum(hits[width] - (size - width), 0), np.minimum(hits[width], len(words) - window)
            edge = np.zeros(len(words) + 2, np.int32)  # starts of windows that hold a hit
            np.add.at(edge, np.minimum(first, len(words) - window), 1)
            np.add.at(edge, last + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge) > 0)
            prints, items = fingerprints(hashes, letters, starts, window), self.sizes[size][2]
            near = {(int(starts[w]), k) for w, k in self.near(prints, size)}
            if complete:
                near.update(self.sharing(every[width], hits[width], letters, size, window, threshold))
            for start, k in near:
                item_id, weights = items[k]
                s = similarity(shingle_weights(words[start:start + window], self.shingle), weights)
                if s >= threshold and (s, -start) > best.get((size, k), ((0, 0), 0))[0]:
                    best[size, k] = (s, -start), {"item_id": item_id, "similarity": s, "start_word": start, "n_words": window}
        return sorted((m for _, m in best.values()), key=lambda m: (m["item_id"] is None, m["item_id"]))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None,
                 shingle: int = 5, threshold: float = 0.8, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """The columns ``keep`` (all) of every row with ``matches``: per benchmark
    item found item_id, similarity, start_word and n_words of its best window."""
    keep, text = others(docs.columns if keep is None else keep, ["matches"]), free_name(docs, "text_")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    n_items, n_bytes = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    slices = max(1, -(-n_items // slice_items), -(-n_bytes // SLICE_BYTES))
    item = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())])
    schema = "".join(f"`{c}` {t}, " for c, t in docs.select(*keep).dtypes)
    kind = "array<struct<item_id: long, similarity: double, start_word: long, n_words: long>>"
    out = docs.select(*keep, F.col(text_col).alias(text), F.array().cast(kind).alias("matches"))
    for k in range(slices):
        out = written(out, "searched") if k else out  # one slice's workers at a time
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()
        index = docs.sparkSession.sparkContext.broadcast([(r["item_id"], w) for r in own if (w := words_of(r["text"]))])

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            built = ItemIndex(index.value, shingle)
            for batch in batches:
                found = [(m or []) + built.matches(t, threshold) for t, m in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep) + 1], pa.array(found, pa.list_(item))], names=[*keep, text, "matches"])

        out = out.mapInArrow(search, f"{schema}`{text}` string, matches {kind}")
    return out.drop(text)
