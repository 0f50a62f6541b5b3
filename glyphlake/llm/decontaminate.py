"""Benchmark decontamination by pigeonhole edit matching.

An item of w words may be found with k = floor(w * errors) word edits. Cut into k + 1 pieces, at least one piece is left
untouched by k edits. Pieces are looked up in every text as hashes of word sequences; each hit fixes a window of w + 2k words,
in which Myers' bit-parallel algorithm, one word a step, gives the least edit distance of the item to any part.

Items are taken to the executors in blocks of BLOCK at most, so what a task holds is bounded whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import discard, written
from glyphlake.llm.words import bounded_batches, bytes_of, mixed, word_hashes

ERRORS = 0.2
#: Items that go to the executors at a time.
BLOCK = 20_000

_KEEP = np.full(256, ord(" "), np.uint8)
for _r in ((48, 58), (97, 123), (128, 256)):
    _KEEP[slice(*_r)] = np.arange(*_r)


def normalised(texts: pa.Array) -> pa.Array:
    """Lower-cased texts in which all that is no ASCII letter or digit and no byte of another character is a blank."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    data, offsets = bytes_of(texts)
    return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(_KEEP[data].tobytes())])


def sequence_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each `length` words in a row."""
    h = np.zeros(max(0, len(words) - length + 1), np.uint64)
    for k in range(length):
        h = mixed(h + words[k : k + len(h)] + np.uint64(k + 1))
    return h


class Items:
    """A block of items, their pieces by length, and their words' bit masks for Myers' algorithm."""

    def __init__(self, ids: list[int], texts: list[str], errors: float = ERRORS):
        words, counts = word_hashes(normalised(pa.array(texts, pa.string())))
        self.ids, ends = ids, np.cumsum(counts)
        self.words = [words[e - c : e] for e, c in zip(ends, counts, strict=True)]
        self.errors = [int(len(w) * errors) for w in self.words]
        self.masks = [self._masks(w) for w in self.words]
        by: dict[int, list[tuple[int, int, int]]] = {}
        for i, (w, k) in enumerate(zip(self.words, self.errors, strict=True)):
            cuts = [len(w) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    by.setdefault(b - a, []).append((int(sequence_hashes(w[a:b], b - a)[0]), i, a))
        self.pieces = {}
        for length, rows in by.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            maybe = np.zeros(1 << 20, bool)
            maybe[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.pieces[length] = (keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), maybe)

    @staticmethod
    def _masks(words: np.ndarray) -> dict[int, int]:
        masks: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            masks[w] = masks.get(w, 0) | 1 << i
        return masks

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, where its first word would stand) for all pieces found in the words, each once."""
        found = set()
        for length, (keys, items, offsets, maybe) in self.pieces.items():
            h = sequence_hashes(words, length)
            for at in np.flatnonzero(maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]):
                lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
                found.update((int(items[j]), int(at) - int(offsets[j])) for j in range(lo, hi))
        yield from sorted(found)

    def distance(self, item: int, window: list[int]) -> tuple[int, int]:
        """(least edit distance of the item to any part of the window, where that part ends)."""
        m, masks = len(self.words[item]), self.masks[item]
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best, end = full, 0, m, m, 0
        for at, w in enumerate(window, 1):
            eq = masks.get(w, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & full, pv & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = ph << 1 & full, mh << 1 & full  # the item may begin anywhere in the window
            pv, mv = mh | ~(xv | ph) & full, ph & xv
            if score < best:
                best, end = score, at
        return best, end

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item's id, distance, word after the match) of each item within its error budget; the best place, the first of ties."""
        best: dict[int, tuple[int, int]] = {}
        for item, start in self.hits(words):
            if item in best and best[item][0] == 0:
                continue
            k, m = self.errors[item], len(self.words[item])
            a = max(0, start - k)
            d, end = self.distance(item, words[a : start + m + k].tolist())
            if d <= k and (item not in best or d < best[item][0]):
                best[item] = (d, a + end)
        return sorted((self.ids[i], d, e) for i, (d, e) in best.items())


def of_texts(texts: pa.Array, items: Items) -> list[list[tuple[int, int, int]]]:
    """The matches of each text. Pieces are looked up in all texts at once; only texts with a hit are gone through."""
    words, counts = word_hashes(normalised(texts))
    ends = np.cumsum(counts)
    live = np.zeros(len(counts), bool)
    for length, (keys, _, _, maybe) in items.pieces.items():
        h = sequence_hashes(words, length)
        at = np.flatnonzero(maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = at[keys[np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)] == h[at]]
        live[np.minimum(np.searchsorted(ends, at, "right"), len(live) - 1)] = True
    return [items.matches(words[e - c : e]) if use else [] for use, e, c in zip(live, ends, counts, strict=True)]


def blocks(benchmark: DataFrame, id_col: str | None, text_col: str = "text", errors: float = ERRORS) -> Iterator[Items]:
    """Blocks of about half of BLOCK items, one at a time on the driver. Without id_col, items have no identifiers."""
    n = -(-benchmark.count() // (BLOCK // 2)) or 1
    for k in range(n):
        part = benchmark.select((F.col(id_col) if id_col else F.lit(0)).cast("bigint").alias("i"), F.col(text_col).alias("t"))
        if n > 1:
            part = part.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        rows = part.filter("i is not null").collect()
        yield Items([r[0] for r in rows], [r[1] or "" for r in rows], errors)


def matches(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row (id_col, item_col, distance, end_word, n_words) for each document and item found in it within the error budget.

    Null and empty texts, and items without words, match nothing; an item with a null identifier is left out here, for a row must
    name it; repeated documents and items each count. Other columns are ignored. An empty table on either side gives no rows.
    What one block of items found is written before the next is fetched, so neither the driver nor the plan grows with them.
    """
    bounded_batches(docs.sparkSession)
    found = []
    for items in blocks(benchmark, item_col, item_text, errors):
        part = docs.select(id_col, text_col).mapInArrow(_matching(items), f"{id_col} bigint, {item_col} bigint, distance bigint, end_word bigint, n_words bigint")
        if found or benchmark.count() > BLOCK // 2:
            part = written(part, "benchmark-matches")
        found.append(part)
    return reduce(DataFrame.unionByName, found)


def _matching(items: Items) -> Callable:
    def run(batches):
        size = {i: len(w) for i, w in zip(items.ids, items.words, strict=True)}
        for b in batches:
            rows = [(i, *m, size[m[0]]) for i, found in zip(b.column(0).to_pylist(), of_texts(b.column(1), items), strict=True) for m in found]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [b.schema.names[0], "item", "distance", "end_word", "n_words"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, text_col: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no item of the benchmark is found; items need no identifier here.

    No shuffle: one block of items filters the scan. Of several blocks each filters what the one before left, which is written.
    """
    bounded_batches(docs.sparkSession)
    at, several = docs.columns.index(text_col), benchmark.count() > BLOCK // 2
    schema, before = docs.schema, None
    for items in blocks(benchmark, None, item_text, errors):

        def run(batches, items=items):
            for b in batches:
                yield b.filter(pa.array([not x for x in of_texts(b.column(at), items)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
        if several:
            docs = written(docs, "benchmark-clean")
            if before is not None:
                discard(before)
            before = docs
    return docs
