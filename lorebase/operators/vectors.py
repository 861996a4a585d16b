"""Vector operators: exact nearest neighbours and similarity pairs.

Spark has no vector functions. Queries (a stated set, in blocks of QUERY_BLOCK) meet all rows as matrix
products in tiles of TILE numbers; a task keeps its best k a query, so it returns k rows a query however many it reads.
Pairs within a table are products of blocks dealt by hash, of which a task holds two; what it finds leaves it tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, top

QUERY_BLOCK = 4096
#: Blocks of a table for pairs: of PAIR_BLOCK rows or more, so that there are no more than PAIR_BLOCKS and each row is sent so often; of PAIR_MOST rows at most.
PAIR_BLOCK, PAIR_BLOCKS, PAIR_MOST = 2048, 16, 32768
#: Numbers in a matrix of products.
TILE = 1 << 20


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """The unit vector; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_of_cosine(c: Column) -> Column:
    """The distance of unit vectors with that cosine."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * c))


def check_width(vectors: DataFrame, width: int) -> DataFrame:
    """vectors; a row of another width fails the query."""
    return vectors.withColumn("embedding", F.when(F.size("embedding") == width, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"vector width is not {width}: "), F.size("embedding").cast("string")))))


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


class _Best:
    """The k best of each of n rows so far: the smallest values, ties to the smaller id."""

    def __init__(self, n: int, k: int, worst: float = np.inf):
        self.k, self.worst = k, worst
        self.value, self.id = np.full((n, k), worst), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, value: np.ndarray, ids: np.ndarray) -> None:
        """Values of ids for the rows `at`."""
        rows, own = np.unique(at, return_inverse=True)
        own = np.concatenate([np.repeat(np.arange(len(rows)), self.k), own])
        value, ids = np.concatenate([self.value[rows].ravel(), value]), np.concatenate([self.id[rows].ravel(), ids])
        order = np.lexsort((ids, value, own))
        own = own[order]
        keep = order[np.arange(len(own)) - np.searchsorted(own, np.arange(len(rows)))[own] < self.k]
        self.value[rows], self.id[rows] = value[keep].reshape(-1, self.k), ids[keep].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, ids and values."""
        i, j = np.nonzero(self.id < np.iinfo(np.int64).max)
        return i, self.id[i, j], self.value[i, j]


def _tiles(n: int, m: int) -> Iterator[tuple[slice, slice]]:
    """Stretches of n rows and m columns whose product has TILE numbers at most."""
    wide = max(1, min(m, 2048))
    high = max(1, TILE // wide)
    for lo in range(0, n, high):
        for left in range(0, m, wide):
            yield slice(lo, min(lo + high, n)), slice(left, min(left + wide, m))


class _Nearest:
    """Per task: the k rows nearest to each query; blocks of (ids, matrix)."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray]], k: int):
        self.blocks, self.k = blocks, k

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(len(ids), self.k) for ids, _ in self.blocks]
        for batch in batches:
            if batch.num_rows:
                own, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                for (_, q), state in zip(self.blocks, best, strict=True):
                    self._meet(own, x, q.astype(np.float64), state)
        for (ids, _), state in zip(self.blocks, best, strict=True):
            i, near, d = state.found()
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(near), pa.array(d)], ["query_id", "id", "distance"])

    def _meet(self, own: np.ndarray, x: np.ndarray, q: np.ndarray, best: _Best) -> None:
        xx, qq = (x * x).sum(1), (q * q).sum(1)
        fuzz = 1e-12 * (qq + xx.max())
        edge = lambda d, f: (d + 1e-6) ** 2 + f  # noqa: E731  squares up to which the rounded distance can be d
        for r, c in _tiles(len(q), len(x)):
            p = q[r] @ x[c].T
            d2 = qq[r, None] + xx[None, c] - 2 * p
            most = edge(best.value[r, -1], fuzz[r])
            if np.isinf(most).any() and d2.shape[1] > self.k:
                most = np.minimum(most, edge(np.sqrt(np.maximum(0, np.partition(d2, self.k - 1, axis=1)[:, self.k - 1])), fuzz[r]))
            i, j = np.nonzero(d2 <= most[:, None])
            if len(i):
                best.add(r.start + i, np.round(np.sqrt(np.maximum(0, d2[i, j])), 6), own[c][j])


def _asked(queries: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The queries' ids and vectors, in blocks of QUERY_BLOCK."""
    kind = np.float32 if queries.schema["embedding"].dataType.elementType == T.FloatType() else np.float64
    rows, out = queries.select("query_id", "embedding").toLocalIterator(), []
    while block := [r for _, r in zip(range(QUERY_BLOCK), rows, strict=False)]:
        out.append((np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], kind)))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int, overfetch: Column | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k rows of vectors(id, embedding) nearest to each of queries(query_id, embedding).

    Filter vectors beforehand; with `overfetch`, a condition on them, 3k rows are fetched and
    filtered afterwards, which may leave fewer than k. Distances are rounded to six digits, ties go to the smaller id.
    The rows are dealt over the cores, each of which reads its share once and holds k rows a query.
    """
    fetch = k if overfetch is None else 3 * k
    blocks = _asked(queries)
    if not blocks:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, distance double, rank int")
    base = vectors.select(F.col("id").cast("long").alias("id"), "embedding").repartition(max(8, vectors.sparkSession.sparkContext.defaultParallelism))
    found = base.mapInArrow(_Nearest(blocks, fetch).run, "query_id long, id long, distance double")
    out = top(found, fetch, [F.col("distance"), F.col("id")], ["query_id"])
    if overfetch is not None:
        out = top(out.drop("rank").join(vectors.where(overfetch).select("id"), "id", "left_semi"), k, [F.col("distance"), F.col("id")], ["query_id"])
    return out.select("query_id", "id", "distance", "rank")


class _Side:
    """Rows of one block: ids, unit vectors, groups."""

    def __init__(self, t: pa.Table):
        self.id = t["id"].to_numpy()
        x = _matrix(t["embedding"])
        n = np.linalg.norm(x, axis=1, keepdims=True)
        self.x = x / np.where(n > 0, n, 1)
        self.short = self.x.astype(np.float32)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Side, _Side, np.ndarray | None, np.ndarray | None, bool]]:
    """Of rows sorted by key, the two blocks of each, their groups, and whether they are one."""

    def tables() -> Iterator[pa.Table]:
        held, at = [], None
        for batch in batches:
            runs, lo = pc.run_end_encode(batch["key"]), 0
            for key, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if held and key != at:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                at, lo = key, hi
        if held:
            yield pa.Table.from_batches(held)

    for t in tables():
        side = t["side"].to_numpy()  # 0: the left block, 1: the right one, 2: both
        grp = t["grp"].combine_chunks().dictionary_encode().indices.to_numpy() if "grp" in t.column_names else None
        at = lambda n: np.flatnonzero((side == n) | (side == 2))
        one = len(side) > 0 and side[0] == 2
        left = _Side(t.take(at(0)))
        right = left if one else _Side(t.take(at(1)))
        yield left, right, None if grp is None else grp[at(0)], None if grp is None else grp[at(1)], one


def _exact(left: _Side, right: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    step = max(1, TILE // max(1, left.x.shape[1]))
    parts = [np.einsum("ij,ij->i", left.x[i[k : k + step]], right.x[j[k : k + step]]) for k in range(0, len(i), step)]
    return np.round(np.concatenate(parts), 6) if parts else np.zeros(0)


def _pairs_batch(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["a", "b", "cosine"])


class _Above:
    """The pairs of each two blocks with cosine >= floor. Products of short floats tell which can be; those are taken exactly."""

    def __init__(self, floor: float):
        self.floor = floor

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, gl, gr, one in _met(batches):
            slack = 1.2e-7 * (left.x.shape[1] + 8) + 1e-6
            for r, s in _tiles(len(left.id), len(right.id)):
                few = self.floor > 0
                c = left.short[r] @ right.short[s].T if few else np.round(left.x[r] @ right.x[s].T, 6)
                ok = c >= self.floor - slack if few else c >= self.floor
                if gl is not None:
                    ok &= gl[r, None] != gr[None, s]
                i, j = np.nonzero(ok)
                a, b = left.id[r][i], right.id[s][j]
                own = a < b if one else a != b
                i, j, a, b = i[own], j[own], a[own], b[own]
                if not len(i):
                    continue
                c = _exact(left, right, r.start + i, s.start + j) if few else c[i, j]
                fit = slice(None) if not few else c >= self.floor
                a, b, c = a[fit], b[fit], c[fit]
                for k in range(0, len(a), TILE // 4):
                    x, y = a[k : k + TILE // 4], b[k : k + TILE // 4]
                    yield _pairs_batch(np.minimum(x, y), np.maximum(x, y), c[k : k + TILE // 4])


class _Top:
    """Each row's k nearest among the other rows of its two blocks with cosine >= floor; with `after`, among larger ids."""

    def __init__(self, floor: float, k: int, after: bool):
        self.floor, self.k, self.after = floor, k, after

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, gl, gr, one in _met(batches):
            slack = 1.2e-7 * (left.x.shape[1] + 8) + 1e-6
            bests = [_Best(len(x.id), self.k, -self.floor) for x in ((left,) if one else (left, right))]
            for r, s in _tiles(len(left.id), len(right.id)):
                c = left.short[r] @ right.short[s].T
                if one:
                    c[left.id[r, None] == right.id[None, s]] = -3
                if gl is not None:
                    c[gl[r, None] == gr[None, s]] = -3
                larger = left.id[r, None] < right.id[None, s] if self.after else None
                self._offer(bests[0], left, right, r, s, c if larger is None else np.where(larger, c, np.float32(-3)), slack)
                if not one:
                    self._offer(bests[1], right, left, s, r, (c if larger is None else np.where(larger, np.float32(-3), c)).T, slack)
            for own, best in zip((left, right), bests, strict=False):
                i, b, c = best.found()
                yield _pairs_batch(own.id[i], b, -c)

    def _offer(self, best: _Best, own: _Side, other: _Side, r: slice, s: slice, c: np.ndarray, slack: float) -> None:
        least = np.maximum(-2, -best.value[r, -1]) - slack
        ok = c >= least[:, None]
        if np.count_nonzero(ok) > 16 * self.k * len(c) and c.shape[1] > self.k:
            least = np.maximum(least, np.partition(c, -self.k, axis=1)[:, -self.k] - 2 * slack)
            ok = c >= np.maximum(least, -2)[:, None]
        i, j = np.nonzero(ok)
        if len(i):
            exact = _exact(own, other, r.start + i, s.start + j)
            fit = exact >= self.floor
            best.add(r.start + i[fit], -exact[fit], other.id[s][j[fit]])


class _Counts:
    """Per task: how often each cosine, in millionths, occurs among the pairs."""

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = 1_000_010
        every = np.zeros(2 * zero + 1, np.int64)
        for left, right, _, _, one in _met(batches):
            for r, s in _tiles(len(left.id), len(right.id)):
                at = np.rint(np.round(left.x[r] @ right.x[s].T, 6) * 1e6).astype(np.int64) + zero
                own = left.id[r, None] < right.id[None, s] if one else left.id[r, None] != right.id[None, s]
                every += np.bincount(at[own], minlength=len(every))
        at = np.flatnonzero(every)
        for k in range(0, len(at), TILE // 4):
            part = at[k : k + TILE // 4]
            yield pa.RecordBatch.from_arrays([pa.array((part - zero) / 1e6), pa.array(every[part])], ["cosine", "n"])


def _meetings(vectors: DataFrame, group: Column | None, apart: bool) -> DataFrame:
    """(key, side, id, embedding[, grp]), sorted by key within partitions: the rows of each two blocks that meet; of one group, unless apart."""
    v = vectors.select(F.col("id").cast("long").alias("id"), "embedding", (F.lit("") if group is None else F.coalesce(group.cast("string"), F.lit("\0"))).alias("grp"))
    blocks_of = lambda n: F.greatest(F.lit(1), F.least(F.ceil(n / PAIR_BLOCK), F.lit(PAIR_BLOCKS)), F.ceil(n / PAIR_MOST)).cast("int")
    if group is not None and not apart:  # blocks of one group meet among themselves alone
        v = v.join(small(v.groupBy("grp").agg(blocks_of(F.count("*")).alias("blocks"))), "grp")
    else:
        v = v.withColumn("blocks", F.lit(v.agg(blocks_of(F.count("*"))).first()[0]))
    v = v.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    key = F.concat_ws(",", F.least("own", "other"), F.greatest("own", "other"), *([] if apart else ["grp"]))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).cast("tinyint")
    rows = v.select(key.alias("key"), side.alias("side"), "id", "embedding", *(["grp"] if apart else []))
    context = vectors.sparkSession
    parts = max(4 * context.sparkContext.defaultParallelism, int(context.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "key").sortWithinPartitions("key")


def similar_pairs(vectors: DataFrame, floor: float, group: Column | None = None, apart: bool = False, top_k: int | None = None, after: bool = False) -> DataFrame:
    """(a, b, cosine) of vectors(id, embedding) with cosine >= floor: a < b, or both ways with top_k.

    group: only pairs with an equal value, or with `apart` a different one. top_k keeps each row's nearest k, with `after` those
    among larger ids. Blocks of rows (of one group, unless apart) meet pairwise; a task holds two of them. Cosines are rounded to six digits.
    """
    kind = _Above(floor) if top_k is None else _Top(floor, top_k, after)
    pairs = _meetings(vectors, group, apart).mapInArrow(kind.run, "a long, b long, cosine double")
    return pairs if top_k is None else top(pairs, top_k, [F.desc("cosine"), F.col("b")], ["a"])


def cosine_counts(vectors: DataFrame, group: Column | None = None) -> DataFrame:
    """(cosine, n): how many pairs of rows (of one group, if given) have it; rounded to six digits, so there are two million rows at most."""
    counts = _meetings(vectors, group, False).mapInArrow(_Counts().run, "cosine double, n long")
    return counts.groupBy("cosine").agg(F.sum("n").alias("n"))


def mutual_neighbours(vectors: DataFrame, k: int, floor: float, group: Column | None = None) -> DataFrame:
    """(a, b, cosine), a < b, of rows among each other's k nearest of the whole table; group is tested afterwards."""
    near = similar_pairs(vectors, floor, top_k=k)
    back = near.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = near.join(back, ["a", "b"], "left_semi").where("a < b").select("a", "b", "cosine")
    if group is None:
        return both
    g = vectors.select("id", group.alias("g"))
    return both.join(g.toDF("a", "ga"), "a").join(g.toDF("b", "gb"), "b").where("ga = gb").select("a", "b", "cosine")
