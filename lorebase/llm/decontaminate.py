"""Benchmark decontamination: BM25 with block-max pruning over an inverted index of test items.

The index holds the items: posting lists with impacts, cut in segments by blocks of items, with the largest
impact of each segment. Impacts are divided by the item's own threshold (a share of the score it gives itself), so
the threshold is 1 for all. Every training passage is a query: windows of twice the longest item, half a
window apart, so any occurrence of an item lies in one. As in block-max WAND, a window is dropped when the
lists' maxima don't sum to the threshold, a block of items is skipped when its segments' maxima don't, and in the
blocks left pivots skip to the items that can reach it; no item over the threshold is lost. A retrieved item counts as leaked if the
passage holds enough of its five-word shingles, of its question (the first two thirds) and of its
answer (the rest) alike.

Scale: texts are read once and never move; an index is built from about `block` items or 16 MB of them at a
time, whose size in memory is some ten times that of the items (a checked bound on what tasks get); further items
take further passes, with word statistics of all items, so scores don't depend on the passes.

Edge cases: null or empty items match nothing; items under five words are one shingle; null texts have no
passages; repeated items each report; further columns are ignored. One row per document and item.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NON_WORD, Words, drop_table, materialize, slices, tune, windows

SHINGLE = 5
BLOCK_ITEMS = 4
#: Bounds (windows x blocks) that one step holds.
CELLS = 1 << 20
K1, B = 1.2, 0.75
#: The threshold, 1, less what sums may lose in rounding.
ENOUGH = 1 - 1e-9
SCHEMA = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


class Index:
    """Posting lists of the items with impacts; blocks of items with the largest impact of each term in them."""

    def __init__(self, ids: list[int], seqs: list[np.ndarray], share: float, df: dict[int, int], n: int, avg: float):
        order = sorted(range(len(ids)), key=lambda i: len(seqs[i]))  # blocks of like lengths have tight maxima
        self.ids, self.seqs, self.share = [ids[i] for i in order], [seqs[i] for i in order], share
        self.vocab = np.unique(np.concatenate(self.seqs))
        count = np.array([df[int(t)] for t in self.vocab])
        idf = np.log(1 + (n - count + 0.5) / (count + 0.5))
        terms, items, impacts = [], [], []
        for i, s in enumerate(self.seqs):
            t, tf = np.unique(s, return_counts=True)
            at = np.searchsorted(self.vocab, t)
            w = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(s) / avg))
            terms.append(at)
            items.append(np.full(len(at), i))
            impacts.append(w / (share * w.sum()))
        term, item, impact = (np.concatenate(x) for x in (terms, items, impacts))
        sort = np.lexsort((item, term))
        term, self.item, self.impact = term[sort].astype(np.int64), item[sort].astype(np.int32), impact[sort]
        # a segment is the stretch of a term's list that lies in one block of items
        block = self.item // BLOCK_ITEMS
        self.segments = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
        self.seg_block, self.seg_max = block[self.segments], np.maximum.reduceat(self.impact, self.segments)
        self.seg_end = np.append(self.segments[1:], len(term))
        self.lists = np.searchsorted(term[self.segments], np.arange(len(self.vocab) + 1))  # the segments of each term
        self.list_max = np.maximum.reduceat(self.seg_max, self.lists[:-1])
        self.blocks = -(-len(self.ids) // BLOCK_ITEMS)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.vocab >> np.uint64(44)] = True
        self.parts = []
        for s in self.seqs:
            cut = -(-2 * len(s) // 3)
            self.parts.append([self._shingles(s), self._shingles(s[:cut]), self._shingles(s[cut:])])

    @staticmethod
    def _shingles(s: np.ndarray) -> tuple[int, np.ndarray]:
        k = min(SHINGLE, max(1, len(s)))
        return k, np.unique(windows(s, k))

    def terms(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of h with a term of the index, and the terms."""
        at = np.flatnonzero(self.seen[h >> np.uint64(44)])
        t = np.minimum(np.searchsorted(self.vocab, h[at]), len(self.vocab) - 1)
        ok = self.vocab[t] == h[at]
        return at[ok], t[ok]

    def retrieve(self, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(window, item, score over threshold) for the windows h[lo:hi] of words."""
        at, t = self.terms(h)
        total = np.concatenate([[0.0], np.cumsum(self.list_max[t])])
        a, b = np.searchsorted(at, lo), np.searchsorted(at, hi)
        some = np.flatnonzero(total[b] - total[a] >= ENOUGH)
        step = max(1, CELLS // self.blocks)
        for k in range(0, len(some), step):
            yield from self._retrieve(some[k : k + step], a, b, t)

    def _retrieve(self, some: np.ndarray, a: np.ndarray, b: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, int, float]]:
        # the distinct terms of every window, and their segments
        n = b[some] - a[some]
        window = np.repeat(np.arange(len(some)), n)
        term = t[np.arange(n.sum()) + np.repeat(a[some] - (np.cumsum(n) - n), n)]
        key = np.unique(window * len(self.vocab) + term)
        window, term = key // len(self.vocab), key % len(self.vocab)
        enough = np.bincount(window, self.list_max[term], len(some)) >= ENOUGH
        window, term = window[enough[window]], term[enough[window]]
        n = self.lists[term + 1] - self.lists[term]
        seg = np.arange(n.sum()) + np.repeat(self.lists[term] - (np.cumsum(n) - n), n)
        cell = np.repeat(window, n) * self.blocks + self.seg_block[seg]
        bound = np.bincount(cell, self.seg_max[seg], len(some) * self.blocks)
        left = bound[cell] >= ENOUGH
        cell, seg = cell[left], seg[left]
        order = np.argsort(cell, kind="stable")
        cell, seg = cell[order], seg[order]
        cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])) if len(cell) else []
        starts, ends, tops = self.segments[seg].tolist(), self.seg_end[seg].tolist(), self.seg_max[seg].tolist()
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            lists = [(self.item[i:j].tolist(), self.impact[i:j].tolist(), m) for i, j, m in zip(starts[x:y], ends[x:y], tops[x:y], strict=True)]
            for i, score in wand(lists, ENOUGH):
                yield int(some[cell[x] // self.blocks]), i, score

    def overlaps(self, h: np.ndarray, item: int) -> list[float]:
        """The shares of the item's, its question's and its answer's shingles that h holds."""
        return [float(np.isin(s, windows(h, k)).mean()) if len(s) else 1.0 for k, s in self.parts[item]]


def wand(lists: list[tuple[list[int], list[float], float]], least: float) -> Iterator[tuple[int, float]]:
    """(item, score) of at least `least` from posting lists (items in order, impacts, largest impact).

    The pivot is the first item, in order, at which the maxima of the lists that stand at or before it reach
    `least`; lists before it skip there at once, as no item before it can reach it.
    """
    cursors = [[items[0], 0, items, impacts, top] for items, impacts, top in lists]
    while cursors:
        cursors.sort(key=lambda c: c[0])
        reach, pivot = 0.0, None
        for c in cursors:
            reach += c[4]
            if reach >= least:
                pivot = c[0]
                break
        if pivot is None:
            return
        if cursors[0][0] == pivot:
            here = [c for c in cursors if c[0] == pivot]
            score = math.fsum(c[3][c[1]] for c in here)
            if score >= least:
                yield pivot, score
            for c in here:
                c[1] += 1
        else:
            for c in cursors:
                if c[0] < pivot:
                    c[1] = bisect_left(c[2], pivot, c[1])
        cursors = [c for c in cursors if c[1] < len(c[2])]
        for c in cursors:
            c[0] = c[2][c[1]]


def build(rows: list[tuple[int, str]], share: float, whole: tuple[dict[int, int], int, float, int] | None = None) -> tuple[list[Index], int]:
    """The index of the items (none without items), and the longest item's words; whole: df, items, mean and longest length where rows are a block of more."""
    rows = [r for r in rows if r[0] is not None and r[1]]
    if not rows:
        return [], 0
    w = Words(pa.array([r[1] for r in rows]), NON_WORD, LOWER)
    h = w.hashes()
    seqs = [h[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    keep = [i for i, s in enumerate(seqs) if len(s)]
    if not keep:
        return [], 0
    if whole:
        df, n, avg, longest = whole
    else:
        df = {}
        for i in keep:
            for t in np.unique(seqs[i]).tolist():
                df[t] = df.get(t, 0) + 1
        n, avg, longest = len(keep), float(np.mean([len(seqs[i]) for i in keep])), max(len(seqs[i]) for i in keep)
    return [Index([rows[i][0] for i in keep], [seqs[i] for i in keep], share, df, n, avg)], longest


def leaks_in(texts: pa.Array, indexes: list[Index], longest: int, least: float, least_part: float) -> list[tuple[int, int, float, list[float]]]:
    """(text, item id, score, overlaps) of every leak in the texts, the best passage of each."""
    w = Words(texts, NON_WORD, LOWER)
    h = w.hashes()
    step = max(longest, SHINGLE)
    n = np.where(w.counts > 0, np.maximum(1, -(-w.counts // step) - 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    lo = w.bounds[doc] + k * step
    hi = np.minimum(lo + 2 * step, w.bounds[doc + 1])
    best: dict[tuple[int, int], tuple] = {}
    for index in indexes:
        for win, item, score in index.retrieve(h, lo, hi):
            over = index.overlaps(h[lo[win] : hi[win]], item)
            if over[0] >= least and min(over[1:]) >= least_part:
                key = (int(doc[win]), index.ids[item])
                best[key] = max(best.get(key, ()), (score * index.share, over))
    return [(i, item, score, over) for (i, item), (score, over) in sorted(best.items())]


def _terms(benchmark: DataFrame) -> DataFrame:
    """words, terms (distinct, as signed hashes) of every item with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            w = Words(batch.column(0), NON_WORD, LOWER)
            h = w.hashes()
            terms = [np.unique(h[a:b]).view(np.int64) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(w.counts, np.int64)), pa.array(terms, pa.list_(pa.int64()))], ["words", "terms"])

    return benchmark.where("item_id is not null and text <> ''").select("text").mapInArrow(run, "words long, terms array<long>").where("words > 0")


def _indexes(benchmark: DataFrame, share: float, block: int) -> Iterator[tuple[list[Index], int]]:
    """Indexes of about `block` items or 16 MB of them at a time, and the longest item of all."""
    size = benchmark.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).first()
    blocks = max(1, -(-size["n"] // block), -(-(size["c"] or 0) // (16 << 20)))
    if blocks > 1:  # scores must not depend on the blocks
        terms = _terms(benchmark)
        every = terms.agg(F.count("*"), F.avg("words"), F.max("words")).first()
        df = materialize(terms.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")), "df")
    for k in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = own.select("item_id", "text").orderBy("item_id", "text").collect()  # at most about a block
        whole = None
        if blocks > 1:
            used = df.join(_terms(own).select(F.explode("terms").alias("t")).distinct(), "t").collect()
            whole = ({r["t"] % (1 << 64): r["df"] for r in used}, *every)
        yield build([tuple(r) for r in rows], share, whole)
    if blocks > 1:
        drop_table(df)


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, least: float = 0.8, least_part: float = 0.5, block: int = 20_000) -> DataFrame:
    """doc_id, item_id, score (share of the item's own), overlaps: one row per leak, none for clean documents."""
    tune(docs.sparkSession)
    found = []
    for indexes, longest in _indexes(benchmark, share, block):

        def search(batches: Iterator[pa.RecordBatch], indexes=indexes, longest=longest) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, most=1 << 20):
                got = leaks_in(batch.column(1), indexes, longest, least, least_part) if indexes else []
                if got:
                    cols = [batch.column(0).take(pa.array([g[0] for g in got])), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64()), *(pa.array([g[3][j] for g in got], pa.float64()) for j in range(3))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        found.append(docs.select("doc_id", "text").mapInArrow(search, SCHEMA))
    return reduce(DataFrame.unionByName, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, least: float = 0.8, least_part: float = 0.5, block: int = 20_000) -> DataFrame:
    """docs without the rows whose own text holds a leak; nothing is shuffled."""
    tune(docs.sparkSession)
    at = docs.columns.index("text")
    for indexes, longest in _indexes(benchmark, share, block):

        def clean(batches: Iterator[pa.RecordBatch], indexes=indexes, longest=longest) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, most=1 << 20):
                keep = np.ones(batch.num_rows, bool)
                if indexes:
                    keep[[g[0] for g in leaks_in(batch.column(at), indexes, longest, least, least_part)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
