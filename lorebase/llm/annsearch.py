"""Approximate nearest neighbours: kd-trees over low-dimensional stable projections.

Largest inner product becomes nearest Euclidean neighbour by one more component, sqrt(M^2 - |x|^2)
with M the largest norm. A Gaussian (2-stable) projection to a few dimensions keeps distances in
distribution: (projected / true)^2 is chi-square with that many degrees of freedom. A search takes
projected neighbours one after another from a kd-tree, nearest first, and verifies each on the original
vectors. It stops at the first projected neighbour so far away that a vector nearer than the k-th found would
have come before it with probability `sure`. `verified` counts the vectors that a query verified.

Distribution: the top of one kd-tree, fitted on a bounded sample, deals all rows to shards. A query first
goes to its own shard, which bounds its k-th distance; it then goes only to the shards whose boxes the same test
doesn't rule out. A shard with more rows than fit is cut in pieces, and queries of a shard are dealt to
groups of QUERIES; a task holds one piece and streams one group past it. Equal vectors are one point with
its k + 1 smallest ids, and equal queries one query, so a vector that a third of all rows share is one point. What
tasks get is bounded: projections, and one box a shard (at most max_shards).

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor rows without
id, nor vectors of another length than the most frequent one; fewer candidates than k give all; an empty table none.
Rows that repeat a vec_id are rows of their own: each is a query if its id is one, and a candidate of all others.
Further columns are ignored. Scores are summed in a fixed order, so ties don't depend on how rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, parts, tune

DIMS, LEAF = 24, 128
#: Bytes of vectors in a shard or piece; queries that one task streams past a piece.
SHARD_BYTES, QUERIES = 4 << 20, 4096


def chi2_quantile(p: float, m: int) -> float:
    """The p-quantile of chi-square with m degrees of freedom, by bisection on the regularized gamma series."""

    def cdf(x: float) -> float:
        a, x = m / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-14:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    lo, hi = 1e-9, 10.0 * m + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class Top:
    """The top of a kd-tree: splits fitted on a sample, by the widest dimension's median."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.shards = max(1, 1 << max(0, math.ceil(math.log2(max(1, shards)))))
        self.dims, self.cuts = np.zeros(self.shards, np.int64), np.zeros(self.shards)
        queue = [(1, sample)]
        while queue:
            node, x = queue.pop()
            if node < self.shards and len(x):
                dim = int(np.argmax(x.max(0) - x.min(0)))
                at = float(np.median(x[:, dim]))
                self.dims[node], self.cuts[node] = dim, at
                queue += [(2 * node, x[x[:, dim] <= at]), (2 * node + 1, x[x[:, dim] > at])]

    def shard(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.shards.bit_length() - 1):
            node = 2 * node + (x[np.arange(len(x)), self.dims[node]] > self.cuts[node])
        return node - self.shards


def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes (points x boxes)."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d : d + 1]
        out += np.maximum(0, np.maximum(low[:, d] - x, x - high[:, d])) ** 2
    return out


class Tree:
    """A kd-tree whose leaves are stretches of the reordered points."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        order, cuts, low, high = [], [0], [], []
        stack = [np.arange(len(x))]
        while stack:
            rows = stack.pop()
            if len(rows) <= leaf:
                order.append(rows)
                cuts.append(cuts[-1] + len(rows))
                low.append(x[rows].min(0))
                high.append(x[rows].max(0))
                continue
            dim = int(np.argmax(x[rows].max(0) - x[rows].min(0)))
            rows = rows[np.argpartition(x[rows, dim], len(rows) // 2)]
            stack += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
        self.order, self.cuts = np.concatenate(order), np.array(cuts)
        self.low, self.high, self.points = np.array(low), np.array(high), x[self.order]

    def walk(self, q: np.ndarray, away: np.ndarray, within: list[float]) -> Iterator[np.ndarray]:
        """Places in order of (blocks of) the points nearest to q, nearest first, up to a squared distance of within[0].

        away: squared distances of q to the leaves. The caller may lower within[0] between blocks. A
        point is handed out only when no leaf that is still closed could hold a nearer one.
        """
        leaves = np.argsort(away, kind="stable")
        far, at, step = away[leaves], 0, 4
        held, near = np.empty(0, np.int64), np.empty(0)
        while True:
            if at < len(leaves) and far[at] <= within[0]:
                some = np.concatenate([np.arange(self.cuts[i], self.cuts[i + 1]) for i in leaves[at : at + step]])
                held, near = np.concatenate([held, some]), np.concatenate([near, ((self.points[some] - q) ** 2).sum(1)])
                at, step = at + step, 2 * step
                sort = np.argsort(near, kind="stable")
                held, near = held[sort], near[sort]
            horizon = far[at] if at < len(leaves) else math.inf
            lo, block = 0, 32
            while (hi := min(lo + block, int(np.searchsorted(near, min(horizon, within[0]), "right")))) > lo:
                yield held[lo:hi]
                lo, block = hi, 2 * block
            if horizon > within[0] or at >= len(leaves):
                return
            held, near = held[lo:], near[lo:]


def search(tree: Tree, x: np.ndarray, ids: list, q: np.ndarray, q_projected: np.ndarray, away: np.ndarray, bound: float, k: int, ratio: float, top: float) -> tuple[list[tuple[float, int, bool]], float, int]:
    """Up to k (score, id, whether it is q's own vector), best first, the k-th squared distance, and how many vectors were verified.

    x and ids are in the tree's order. bound: the squared distance (of the lengthened vectors) to beat.
    ratio: the chi-square quantile; a projected neighbour beyond ratio times the k-th squared distance ends the walk.
    """
    base = top * top + float(q @ q)
    slack = 1e-9 * (1 + base)  # products of a block may differ in their last digits
    limit, verified = bound, 0
    within = [ratio * max(limit, 0.0) + 1e-12]
    score, row = np.empty(0), np.empty(0, np.int64)
    for some in tree.walk(q_projected, away, within):
        verified += len(some)
        score, row = np.concatenate([score, x[some] @ q]), np.concatenate([row, some])
        if len(score) > k:
            edge = float(np.partition(score, -k)[-k])
            keep = score >= edge - slack
            score, row = score[keep], row[keep]
            limit = min(limit, base - 2 * edge)
            within[0] = ratio * max(limit, 0.0) + 1e-12
    exact, own = (x[row] * q).sum(1), (x[row] == q).all(1)
    found = sorted((-s, int(i), bool(o)) for s, r, o in zip(exact.tolist(), row.tolist(), own.tolist(), strict=True) for i in ids[r])[:k]
    return [(-s, i, o) for s, i, o in found], limit, verified


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array<double>) of rows that take part."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine & F.exists("x", lambda c: c != 0))
    size = v.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return v.where(F.size("x") == (size[0]["d"] if size else 0))


_FOUND = "qid string, x array<double>, shard long, bound double, scores array<double>, ids array<long>, own array<boolean>, verified long"


def _meet(routes: DataFrame, dealt: DataFrame, sizes: dict[int, int], rows: int, work) -> DataFrame:
    """The answers of routes(qid, x, shard, bound): each query meets every piece of its shard.

    sizes: rows of each shard. Points come first in a group (bound is null) and stay in memory, a piece of about `rows`; queries stream.
    """
    spark = routes.sparkSession
    pieces = {s: -(-n // (2 * rows)) for s, n in sizes.items()}
    asked = {r["shard"]: r["n"] for r in routes.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    facts = F.broadcast(spark.createDataFrame([(s, pieces[s], -(-n // QUERIES)) for s, n in asked.items()], "shard long, pieces int, salts int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    points = dealt.join(facts, "shard").select("shard", F.pmod(F.xxhash64("x"), "pieces").cast("int").alias("piece"), every("salts").alias("salt"), "x", "ids", F.lit(None).cast("double").alias("bound"), F.lit(None).cast("string").alias("qid"))
    queries = routes.join(facts, "shard").select("shard", every("pieces").alias("piece"), F.pmod(F.xxhash64("qid"), "salts").cast("int").alias("salt"), "x", F.lit(None).cast("array<long>").alias("ids"), "bound", "qid")
    groups = sum(pieces[s] * -(-n // QUERIES) for s, n in asked.items())
    both = points.unionByName(queries).repartition(parts(spark, groups, 2), "shard", "piece", "salt")
    return both.sortWithinPartitions("shard", "piece", "salt", F.col("bound").asc_nulls_first()).mapInPandas(work, _FOUND)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, sure: float = 0.88, sample: int = 20_000, shard_rows: int | None = None, max_shards: int = 4096, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score, verified: for rows whose id `every` divides, the k nearest other rows."""
    spark = vectors.sparkSession
    tune(spark)
    v = usable(vectors)
    ranked = v.withColumn("rn", F.row_number().over(W.partitionBy("x").orderBy("vec_id"))).where(F.col("rn") <= k + 1)
    points = materialize(ranked.groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "points")
    queries = v.where(F.pmod("vec_id", F.lit(every)) == 0)
    facts = points.agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)).alias("m"), F.max(F.size("x")).alias("d")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    top, d = math.sqrt(facts["m"]), facts["d"]
    m = min(DIMS, d + 1)
    rows = shard_rows or max(LEAF, SHARD_BYTES // (8 * d))
    matrix = np.random.default_rng(seed).normal(size=(d + 1, m))
    ratio = chi2_quantile(sure, m)

    def project(x: np.ndarray, query: bool) -> np.ndarray:
        out = x @ matrix[:d]
        return out if query else out + np.sqrt(np.maximum(0, top * top - (x * x).sum(1)))[:, None] * matrix[d]

    drawn = points.select("x").orderBy(F.xxhash64("x")).limit(sample).toPandas()
    fitted = Top(project(np.stack(drawn["x"]), False), min(max_shards, -(-facts["n"] // rows)))

    def deal(batches):
        for b in batches:
            if len(b):
                b["shard"] = fitted.shard(project(np.stack(b["x"]), False))
                yield b

    dealt = materialize(points.mapInPandas(deal, "x array<double>, ids array<long>, shard long"), "dealt")

    def box(batches):
        for b in batches:
            if len(b):
                p, s = project(np.stack(b["x"]), False), b["shard"].to_numpy()
                for one in np.unique(s):
                    own = p[s == one]
                    yield pd.DataFrame({"shard": [one], "n": [len(own)], "low": [own.min(0)], "high": [own.max(0)]})

    cols = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(m)]
    boxes = dealt.select("x", "shard").mapInPandas(box, "shard long, n long, low array<double>, high array<double>").groupBy("shard").agg(F.sum("n").alias("n"), *cols).orderBy("shard").toPandas()  # one row a shard
    shards, sizes = boxes["shard"].to_numpy(), dict(zip(boxes["shard"].tolist(), boxes["n"].tolist(), strict=True))
    low, high = boxes[[f"low{i}" for i in range(m)]].to_numpy(), boxes[[f"high{i}" for i in range(m)]].to_numpy()

    # one name a vector: repeated ids may have several
    asked = queries.groupBy("x").agg(F.min("vec_id").alias("qid")).select("x", F.concat_ws(":", "qid", F.hex(F.xxhash64("x"))).alias("qid"))

    def home(batches):
        for b in batches:
            if len(b):
                b["shard"] = shards[gaps(project(np.stack(b["x"]), True), low, high).argmin(1)]
                b["bound"] = np.inf
                yield b

    def work(batches):
        key, held, tree = None, [], None
        for b in batches:
            if not len(b):
                continue
            names = b[["shard", "piece", "salt"]].to_numpy()
            kind = b["bound"].isna().to_numpy()
            cut = np.flatnonzero((names[1:] != names[:-1]).any(1) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(b)], strict=True):
                if tuple(names[lo]) != key:
                    key, held, tree = tuple(names[lo]), [], None
                part = b.iloc[lo:hi]
                if kind[lo]:
                    held.append(part)
                    continue
                if tree is None and held:
                    x = np.concatenate([np.stack(h["x"]) for h in held])
                    tree = Tree(project(x, False))
                    x, ids = x[tree.order], [i for h in held for i in h["ids"]]
                    ids, held = [ids[i] for i in tree.order], []
                if tree is None:  # a piece without points
                    continue
                q = np.stack(part["x"])
                p = project(q, True)
                away = gaps(p, tree.low, tree.high)
                got = [search(tree, x, ids, q[i], p[i], away[i], float(part["bound"].iloc[i]), k + 1, ratio, top) for i in range(len(q))]
                lists = [[[f[j] for f in g[0]] for g in got] for j in range(3)]
                yield pd.DataFrame({"qid": part["qid"].to_numpy(), "x": list(q), "shard": key[0], "bound": [g[1] for g in got], "scores": lists[0], "ids": lists[1], "own": lists[2], "verified": [g[2] for g in got]})

    near = materialize(_meet(asked.mapInPandas(home, "x array<double>, qid string, shard long, bound double"), dealt, sizes, rows, work), "near")

    def spread(batches):
        for b in batches:
            if len(b):
                away = gaps(project(np.stack(b["x"]), True), low, high)
                go = away <= ratio * np.maximum(b["bound"].to_numpy(), 0)[:, None] + 1e-12
                go &= shards[None, :] != b["shard"].to_numpy()[:, None]
                i, s = np.nonzero(go)
                if len(i):
                    yield pd.DataFrame({"x": b["x"].iloc[i].to_numpy(), "qid": b["qid"].to_numpy()[i], "shard": shards[s], "bound": b["bound"].to_numpy()[i]})

    # a query of a shard in pieces has one row a piece: the least bound holds
    bounds = near.groupBy("qid").agg(F.first("x").alias("x"), F.first("shard").alias("shard"), F.min("bound").alias("bound"))
    wide = _meet(bounds.mapInPandas(spread, "x array<double>, qid string, shard long, bound double"), dealt, sizes, rows, work)
    answers = materialize(near.drop("x", "shard", "bound").unionByName(wide.drop("x", "shard", "bound")), "answers")
    hits = answers.select("qid", F.explode(F.arrays_zip("scores", "ids", "own")).alias("h")).select("qid", F.col("h.scores").alias("score"), F.col("h.ids").alias("vec_id"), F.col("h.own").alias("own"))
    best = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    lists = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "own", "score"))).alias("list"))
    effort = answers.groupBy("qid").agg(F.sum("verified").alias("verified"))
    # back to every query row: the row itself goes, the first k others stay
    named = asked.join(lists, "qid").join(effort, "qid").select("x", "list", "verified")
    itself = F.array_position(F.transform("list", lambda h: F.coalesce(h["own"] & (h["vec_id"] == F.col("vec_id")), F.lit(False))), True)
    out = queries.join(named, "x").select("vec_id", "list", "verified", itself.alias("itself"))
    out = out.select(F.col("vec_id").alias("query_id"), "verified", F.slice(F.filter("list", lambda h, i: i + 1 != F.col("itself")), 1, k).alias("list"))
    out = out.select("query_id", "verified", F.posexplode("list").alias("at", "h"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"), "verified")


def brute_force(rows: list[tuple[int, list[float]]], k: int, every: int) -> list[tuple[int, int, int, float]]:
    """What an exact search over rows (vec_id, vector) returns, for tests and for measuring recall."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = []
    for q in np.flatnonzero(ids % every == 0):
        s = (x * x[q]).sum(1)
        near = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        out += [(int(ids[q]), r + 1, int(ids[i]), float(s[i])) for r, i in enumerate(near)]
    return out
