"""Full-text retrieval: BM25 over content, project and tags for a table of queries.

Queries come as (query_id, query). Texts are tokenized in the JVM where they lie and read twice, for the words' statistics and for the
scores. All queries meet Arrow batches of token lists, frequent words as a matrix product and others by lists of the queries that
hold them, and a task returns only what can be among a query's first rows, so neither texts nor postings are
shuffled. Long OR queries match most documents, which makes joined rows slow. Scores are negative, smaller is better.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from .common import small, spread, top

#: Numbers in a matrix of a task (8 bytes each).
CELLS = 1 << 20
#: Words that at least one in DENSE queries holds, up to MOST_DENSE, are scored as a matrix.
DENSE, MOST_DENSE = 12, 512


def terms_of(queries: DataFrame) -> DataFrame:
    """(query_id, term) without repeats."""
    return queries.select("query_id", F.explode(F.array_distinct(T.query_terms(F.col("query")))).alias("term"))


def _weighted(tokens: Column, weight: int) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))


def postings(memories: DataFrame, terms: DataFrame | None = None, tokenize=T.tokens) -> DataFrame:
    """(id, dl, term, f): weighted frequency of each term (of `terms` only, if given) and the document's length."""
    cols = {c: tokenize(F.col(c)) for c in K.BM25_WEIGHTS}
    docs = memories.select("id", *[v.alias(f"t_{c}") for c, v in cols.items()])
    dl = sum((F.size(f"t_{c}") for c in cols), F.lit(0))
    rows = docs.select("id", dl.alias("dl"), F.explode(F.concat(*[_weighted(F.col(f"t_{c}"), w) for c, w in K.BM25_WEIGHTS.items()])).alias("p")).select("id", "dl", "p.term", "p.w")
    if terms is not None:
        rows = rows.join(small(terms.select("term").distinct()), "term")
    return rows.groupBy("id", "dl", "term").agg(F.sum("w").alias("f"))


class _Queries:
    """Queries as numbers: their ids, their words' places in the vocabulary, and of each word the queries that hold it."""

    def __init__(self, queries: DataFrame):
        place: dict[str, int] = {}
        ids, own = [], []
        rows = queries.select("query_id", F.array_distinct(T.query_terms(F.col("query"))).alias("t")).where(F.size("t") > 0)
        for q, terms in rows.toLocalIterator():
            ids.append(q)
            own.append(np.array([place.setdefault(t, len(place)) for t in terms], np.int32))
        self.ids, self.n_terms = np.array(ids, np.int64), np.array([len(t) for t in own], np.int32)
        self.words = pa.array(place.keys(), pa.string())
        terms = np.concatenate(own) if own else np.zeros(0, np.int32)
        order = np.argsort(terms, kind="stable")
        self.holders = np.repeat(np.arange(len(own), dtype=np.int32), self.n_terms)[order]
        self.held = np.bincount(terms, minlength=len(place))
        self.start = np.concatenate([[0], np.cumsum(self.held)])

    def places(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of each token that a query has."""
        at = pc.fill_null(pc.index_in(col.flatten(), self.words), -1).to_numpy()
        own = at >= 0
        return pc.list_parent_indices(col).to_numpy()[own], at[own]


def bm25(memories: DataFrame, queries: DataFrame, tokenize=T.tokens, condition: Column | None = None, keep: int | None = None, whole: bool = True, offset: Column | None = None) -> DataFrame:
    """(query_id, id, bm25, matched, n_terms) for every document that meets the condition and has a term of the query.

    With `keep`, each task leaves out what can't be among a query's first `keep`, neither of the rows with all terms nor of the others;
    without `whole` these aren't told apart, and matched is null. `offset`, of the memories' columns, is added to bm25 for the order.
    """
    fields = [tokenize(F.col(c)).alias(f"t_{c}") for c in K.BM25_WEIGHTS]
    schema = "query_id long, id long, bm25 double, matched int, n_terms int"
    asked = _Queries(queries)
    if not len(asked.ids):
        return memories.sparkSession.createDataFrame([], schema)
    dealt = spread(memories)
    every = dealt.select("id", *fields)
    counts = every.mapInArrow(_Counter(asked).run, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # at most one number for each word
    at, n = counts["place"].to_numpy(), counts["n"].to_numpy()
    total, length = n[at == -1].sum(), n[at == -2].sum()
    df = np.zeros(len(asked.words))
    df[at[at >= 0]] = n[at >= 0]
    idf = np.where(df > 0, np.maximum(np.log((total - df + 0.5) / (df + 0.5)), 1e-6), 0.0)
    docs = dealt if condition is None else dealt.where(condition)
    docs = docs.select(F.col("id").cast("long").alias("id"), *fields, F.coalesce((F.lit(0.0) if offset is None else offset).cast("double"), F.lit(float("-inf"))).alias("offset"))
    scorer = _Scorer(asked, idf, length / total if length else 1.0, keep, whole, 0.0 if offset is None else 2e-6)
    return docs.mapInArrow(scorer.run, schema)


class _Counter:
    """Per task: how many documents hold each word (by its place), how many there are (-1), and their length (-2)."""

    def __init__(self, asked: _Queries):
        self.asked = asked

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = len(self.asked.words)
        df, n, length = np.zeros(words), 0, 0
        for batch in batches:
            seen = []
            for col in batch.columns[1:]:
                row, at = self.asked.places(col)
                seen.append(row * words + at)
                length += len(col.flatten())
            df += np.bincount(np.unique(np.concatenate(seen)) % words, minlength=words)
            n += batch.num_rows
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, [-1, -2]]).astype(np.int32)), pa.array(np.concatenate([df[own], [n, length]]))], ["place", "n"])


class _Pool:
    """What can be among each query's first k: columns of query, value, id and others; values up to `slack` over the last stay."""

    def __init__(self, queries: int, k: int, slack: float):
        self.k, self.slack, self.most, self.edge = k, slack, max(CELLS // 4, 4 * queries * k), np.full(queries, np.inf)
        self.parts: list[list[np.ndarray]] = []
        self.new = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(list(columns))
        self.new += len(columns[0])
        if self.new > self.most or len(self.parts) == 1:
            self.prune()

    def prune(self) -> list[np.ndarray] | None:
        if not self.parts:
            return None
        own = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        q, value, ids = own[:3]
        order = np.lexsort((ids, value, q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], np.arange(len(self.edge)))[q[order]]
        last = order[rank == self.k - 1]
        self.edge[q[last]] = value[last] + self.slack
        keep = order[rank < self.k] if not self.slack else np.flatnonzero(value <= self.edge[q])
        own = [c[keep] for c in own]
        self.parts, self.new = [own], 0
        return own


class _Scorer:
    """Scores Arrow batches of (id, token lists, offset) for all queries, some documents at a time, so that matrices have about CELLS numbers."""

    def __init__(self, asked: _Queries, idf: np.ndarray, avg: float, keep: int | None, whole: bool, slack: float):
        self.asked, self.idf, self.avg, self.keep, self.whole, self.slack = asked, idf, avg, keep, whole or keep is None, slack

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = self.asked
        queries, words = len(asked.ids), len(asked.words)
        often = np.argsort(-asked.held, kind="stable")[:MOST_DENSE]
        often = often[asked.held[often] * DENSE >= queries]
        column = np.full(words, -1)
        column[often] = np.arange(len(often))
        has = np.zeros((len(often), queries))
        for k, t in enumerate(often):
            has[k, asked.holders[asked.start[t] : asked.start[t + 1]]] = 1.0
        pools = [_Pool(queries, self.keep, self.slack) for _ in range(1 + self.whole)] if self.keep else []
        for batch in batches:
            ids, offset = batch.column(0).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            places, weights, dl = [], [], np.zeros(batch.num_rows)
            for col, weight in zip(batch.columns[1:-1], K.BM25_WEIGHTS.values(), strict=True):
                dl += pc.fill_null(pc.list_value_length(col), 0).to_numpy()
                row, at = asked.places(col)
                places.append(row * words + at)
                weights.append(np.full(len(at), float(weight)))
            places, inverse = np.unique(np.concatenate(places), return_inverse=True)
            f, row, term = np.bincount(inverse, np.concatenate(weights), len(places)), places // words, places % words
            part = self.idf[term] * f * (K.BM25_K1 + 1) / (f + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * dl / self.avg)[row])
            more = np.where(column[term] < 0, asked.held[term], 0)  # queries that are reached by lists
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            cost = np.concatenate([[0], np.cumsum(more)])[first] + np.arange(batch.num_rows + 1) * queries
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(cost, cost[lo] + CELLS, "right")) - 1)
                own = slice(first[lo], first[hi])
                yield from self._score(pools, has, ids[lo:hi], offset[lo:hi], row[own] - lo, term[own], part[own], column[term[own]], more[own])
                lo = hi
        for pool in pools:
            if (c := pool.prune()) is not None:
                yield self._batch(c[0], c[2], c[3], c[4] if self.whole else None)

    def _batch(self, j: np.ndarray, ids: np.ndarray, score: np.ndarray, matched: np.ndarray | None) -> pa.RecordBatch:
        told = pa.nulls(len(j), pa.int32()) if matched is None else pa.array(matched.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(self.asked.ids[j]), pa.array(ids), pa.array(score), told, pa.array(self.asked.n_terms[j])], ["query_id", "id", "bm25", "matched", "n_terms"])

    def _score(self, pools, has, ids, offset, row, term, part, column, more) -> Iterator[pa.RecordBatch]:
        queries = has.shape[1]
        lists = more > 0
        n = more[lists]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(n) else 0) + np.repeat(self.asked.start[term[lists]] - (ends - n), n)
        cell = np.repeat(row[lists] * queries, n) + self.asked.holders[at]
        dense = np.zeros((len(ids), len(has)))
        dense[row[~lists], column[~lists]] = part[~lists]
        score = (dense @ has).ravel()
        score += np.bincount(cell, np.repeat(part[lists], n), len(score))
        score = score.reshape(len(ids), queries)
        matched = None
        if self.whole:
            matched = ((dense > 0) @ has).ravel().astype(np.int32)
            matched = (matched + np.bincount(cell, minlength=len(matched)).astype(np.int32)).reshape(score.shape)
        ok = score > 0
        if not pools:
            i, j = np.nonzero(ok)
            yield self._batch(j, ids[i], np.round(-score[i, j], 6), matched[i, j])
            return
        value = offset[:, None] - score
        full = matched == self.asked.n_terms if self.whole else None
        for k, pool in enumerate(pools):
            fit = ok & (value <= pool.edge + 1e-6)
            if full is not None:
                fit &= full if k else ~full
            i, j = np.nonzero(fit)
            if len(i):
                own = np.round(-score[i, j], 6)
                pool.add(j, own + offset[i], ids[i], own, *([matched[i, j]] if self.whole else []))


def search(memories: DataFrame, queries: DataFrame, limit: int, condition: Column | None = None, and_first: bool = True, order: Column | None = None, tokenize=T.tokens, offset: Column | None = None) -> DataFrame:
    """(query_id, id, bm25, rank) and the memory's columns: the best rows that meet the condition; rows with all terms alone, if there are any.

    Statistics cover all memories. `order` may rank by columns of the memories as well as by bm25; if it is bm25 plus an `offset`
    of such columns, pass that too, and tasks return only what can be among the best.
    """
    hits = bm25(memories, queries, tokenize, condition, limit if order is None or offset is not None else None, and_first, offset)
    if and_first:
        full = F.col("matched") == F.col("n_terms")
        hits = hits.withColumn("any_full", F.max(full).over(W.partitionBy("query_id"))).where(full | ~F.col("any_full"))
    if order is None:
        return top(hits.withColumn("order", F.col("bm25")), limit, [F.col("order"), F.col("id")], ["query_id"]).join(memories, "id")
    hits = hits.join(memories, "id").withColumn("order", F.round(order, 6))
    return top(hits, limit, [F.col("order"), F.col("id")], ["query_id"])
