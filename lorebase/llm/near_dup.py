"""Near duplicates by SetSketch registers: banded candidates, joint likelihood, exact verification.

A document's set is its distinct k-word shingles. Each register is a truncated minimum on an
exponential scale, floor(OFFSET - log_b(min exponential)), so sketches of parts merge by maximum
and two sets agree in a register about as often as their Jaccard similarity. Documents with equal sets
are one node. Nodes that agree in a whole band of registers are candidates; a pair is dropped if its
sizes can't reach the threshold or if its registers' joint likelihood under every similarity from the
threshold on is hopeless against the best one; all others are verified on full sets.

Components without all pairs: in each band's group the node with most company is the hub, and only
(member, hub) pairs are verified at first. Members of a group that then still lie in different components
are compared with each other by sketch, in blocks of at most BLOCK nodes, and each node's FEW likeliest
partners are verified. A node with more partners than that is marked, and where it still lies apart it meets the sets of all
plausible members of its group inside a task, which tells one link a component: what is written
and shuffled stays in proportion to the group, and no partner is left out. Members in one component need no comparison.

With 4 registers a band and 24 bands a pair at the threshold of 0.8 is missed with probability 1e-6.

Scale: documents move as 100-byte sketches; texts of candidates alone are read again (a semi-join whose
id side is broadcast only if counted to be small). A hot set is one node after a partial
aggregate; hubs are salted. Joins on a band that many nodes share send that band's one row to all tasks. Written tables cut the lineage, and
components are found by grouped minima.

Edge cases: texts without words link with nothing; shorter texts have their whole sequence as one shingle;
rows that repeat an id are one document, linked by any of its texts; a null id takes no part, has no component and is kept; further columns are ignored.
Shingles are 52-bit hashes (of 64, 12 number a slice's texts).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Words, binaries, components, drop_table, materialize, mix, parts, release, shingles, slices, tune, with_facts

BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
BASE_B, OFFSET = 1.1, 40
BLOCK, SALT_ROWS, BROADCAST_IDS = 1024, 512, 250_000
#: Partners of a node that are verified as pairs; shingles that a block of sets may hold (8 bytes each).
FEW, BLOCK_SHINGLES = 4, 1 << 20
#: Pairs of sketches that a task compares at a time.
PAIRS = 1 << 15
#: Log-likelihood by which the best similarity may beat all that reach the threshold (about 4 sigma).
SLACK = 8.0
_ODD = np.random.Generator(np.random.PCG64(77)).integers(1 << 62, 1 << 63, REGISTERS, dtype=np.uint64) | np.uint64(1)
_CUT = np.uint64(0x9E3779B97F4A7C15)


def registers(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SetSketch registers (sets x REGISTERS, bytes) of the sets h[bounds[i]:bounds[i + 1]], none empty."""
    out = np.empty((len(bounds) - 1, REGISTERS), np.uint8)
    for i, odd in enumerate(_ODD):
        x = h * odd
        low = np.minimum.reduceat(x, bounds[:-1]).astype(np.float64) * 2.0**-64
        rate = -np.log1p(-np.minimum(low, 1 - 1e-12))
        out[:, i] = np.clip(np.floor(OFFSET - np.log(np.maximum(rate, 1e-30)) / math.log(BASE_B)), 0, 255)
    return out


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of sketches may come from sets of at least the threshold's similarity.

    The joint likelihood of (registers of a larger, smaller, equal) as a function of the similarity,
    given both sizes (Ertl, 2021), on a grid.
    """
    up, down = (a > b).sum(-1), (a < b).sum(-1)
    same = REGISTERS - up - down
    u = na / (na + nb)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE_B - 1) / BASE_B) / math.log(BASE_B)
    grid = np.concatenate([np.linspace(0.0, threshold, 17)[:-1], np.linspace(threshold, 1.0, 9)])
    best_all, best_high = np.full(up.shape, -np.inf), np.full(up.shape, -np.inf)
    most = np.minimum(na, nb) / np.maximum(na, nb)
    for j in grid:
        jj = np.minimum(j, most)
        more, less = np.maximum(p(u - v * jj), 1e-9), np.maximum(p(v - u * jj), 1e-9)
        eq = np.maximum(1 - more - less, 1e-9)
        ll = up * np.log(more) + down * np.log(less) + same * np.log(eq)
        best_all = np.maximum(best_all, ll)
        if j >= threshold - 1e-12:
            best_high = np.maximum(best_high, ll)
    return best_high >= best_all - SLACK


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (of the set), regs; both null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            w = Words(batch.column(2), SPACE, LOWER)
            doc, h = shingles(w, w.hashes(), words)
            h = mix(h)
            n = np.bincount(doc, minlength=batch.num_rows)
            own = np.flatnonzero(n)
            regs, digest = np.zeros((len(n), REGISTERS), np.uint8), np.zeros((len(n), 2), np.uint64)
            if len(own):
                bounds = np.concatenate([[0], np.cumsum(n[own])])
                regs[own] = registers(h, bounds)
                digest[own, 0] = np.add.reduceat(h, bounds[:-1])
                digest[own, 1] = np.add.reduceat(mix(h ^ _CUT), bounds[:-1])
            none = n == 0
            wide = lambda x: pa.array([None if e else r.tobytes() for e, r in zip(none, x, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), wide(digest), wide(regs)], ["doc_id", "text_hash", "n_shingles", "digest", "regs"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, regs binary")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), REGISTERS)


def _fits(na, nb, threshold: int):
    """Sizes that can reach the threshold (a percentage)."""
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * threshold


def _plausible(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that the likelihood lets pass."""
    n = nodes.select("node", "n", "regs")
    both = pairs.join(n.toDF("a", "na", "ra"), "a").join(n.toDF("b", "nb", "rb"), "b").select("a", "b", "na", "nb", "ra", "rb")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = likely(_matrix(batch.column(4)), _matrix(batch.column(5)), batch.column(2).to_numpy(), batch.column(3).to_numpy(), threshold / 100)
                yield batch.select([0, 1]).filter(pa.array(ok))

    return both.mapInArrow(test, "a long, b long")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, h): the sorted shingle hashes of the wanted nodes(node), each from the text of the row that names it."""
    names = nodes.join(wanted, "node", "left_semi").select("node", F.col("first").alias("doc_id"), "text_hash")
    names = F.broadcast(names) if names.count() <= BROADCAST_IDS else names
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(names, ["doc_id", "text_hash"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(batch.column(1), SPACE, LOWER)
            doc, h = shingles(w, w.hashes(), words)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays([batch.column(0), binaries(h, bounds)], ["node", "h"])

    return materialize(texts.mapInArrow(run, "node long, h binary"), "sets")


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, threshold: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets reach the threshold: a's set meets its b's in a stream.

    Pairs of one a are dealt to salted groups of about SALT_ROWS, each with a's set first.
    """
    spark = docs.sparkSession
    pairs = materialize(pairs, "pairs")
    sets = _sets(docs, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), words)
    each = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    salted = pairs.join(each, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    members = salted.join(sets, F.col("b") == F.col("node")).select("a", "salt", "b", "h")
    hubs = each.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(sets, F.col("a") == F.col("node")).select("a", "salt", F.lit(None).cast("long").alias("b"), "h")
    both = hubs.unionByName(members).repartition(parts(spark, 1, 1), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, np.uint64)
        for batch in batches:
            out_a, out_b = [], []
            for a, salt, b, h in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                h = np.frombuffer(h.as_buffer(), np.uint64)
                if b is None:
                    at, own = (a, salt), h
                elif at == (a, salt) and min(len(own), len(h)) * 100 >= threshold * max(len(own), len(h)):
                    place = np.minimum(np.searchsorted(own, h), len(own) - 1)
                    common = int((own[place] == h).sum())
                    if 100 * common >= threshold * (len(own) + len(h) - common):
                        out_a.append(a)
                        out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    edges = materialize(both.mapInArrow(meet, "a long, b long"), "edges")
    drop_table(sets)
    return edges


def _blocks(groups: DataFrame, chunks: Column, columns: list[str]) -> DataFrame:
    """The members of each band dealt to `chunks` blocks, one row for each pair of blocks that a member is in."""
    g = groups.withColumn("chunks", chunks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    g = g.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    g = g.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", "node", "n", "label", "regs", *columns)
    return g.repartition(parts(groups.sparkSession, 1, 1), "band", "i", "j").sortWithinPartitions("band", "i", "j")


def _each_block(batches: Iterator[pa.RecordBatch], work: Callable[[tuple, pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """work for each run of rows with one (band, i, j), the first three columns."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in range(3)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for lo, hi in zip([0, *change], [*change, batch.num_rows], strict=True):
            now = tuple(int(c[lo]) for c in cols)
            if key is not None and now != key:
                yield work(key, pa.Table.from_batches(held))
                held = []
            key = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield work(key, pa.Table.from_batches(held))


class _Members:
    """The members of one pair of blocks, and which of them a member is to be compared with."""

    def __init__(self, key: tuple, t: pa.Table, threshold: int):
        self.node, self.n, self.label = (t[c].to_numpy() for c in ("node", "n", "label"))
        self.regs, self.k, self.threshold = _matrix(t["regs"]), int(t["k"][0].as_py()), threshold
        self.bands = self.regs.view(np.uint32)  # a band's ROWS registers are one number
        own, self.same = t["own"].to_numpy(), key[1] == key[2]
        self.left = np.arange(len(own)) if self.same else np.flatnonzero(own == key[1])
        self.right = self.left if self.same else np.flatnonzero(own == key[2])

    def partners(self, rows: np.ndarray, others: np.ndarray, later: bool) -> Iterator[tuple[int, np.ndarray]]:
        """Each of rows that has any, with those of others in a component of their own that sizes and sketches let pass, likeliest first.

        Pairs of an earlier band are left to that one; with later, a row's partners come after it.
        """
        n, label, regs = self.n, self.label, self.regs
        step = max(1, PAIRS // max(1, len(others)))
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step, None]
            ok = (label[some] != label[others]) & (np.minimum(n[some], n[others]) * 100 >= self.threshold * np.maximum(n[some], n[others]))
            at, to = np.nonzero(ok & (others > some) if later else ok)
            a, b = some[at, 0], others[to]
            if len(a) and self.k:
                fresh = ~(self.bands[a, : self.k] == self.bands[b, : self.k]).any(1)
                a, b = a[fresh], b[fresh]
            if len(a):
                ok = likely(regs[a], regs[b], n[a], n[b], self.threshold / 100)
                a, b = a[ok], b[ok]
            if len(a):
                order = np.lexsort((-(regs[a] == regs[b]).sum(1), a))
                a, b = a[order], b[order]
                cuts = np.flatnonzero(a[1:] != a[:-1]) + 1
                yield from zip(a[[0, *cuts]].tolist(), np.split(b, cuts), strict=True)


def _across(groups: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of a band's members that lie in different components and may be links, FEW a member and block.

    A row without b tells that member a has more of them in that band. groups: band, node, n, regs, label, c (members).
    """

    def work(key: tuple, t: pa.Table) -> pa.RecordBatch:
        m = _Members(key, t, threshold)
        rows: list[tuple] = []
        for i, at in m.partners(m.left, m.right, m.same):
            rows += [(key[0], min(m.node[i], m.node[j]), max(m.node[i], m.node[j])) for j in at[:FEW]]
            if len(at) > FEW:
                rows.append((key[0], m.node[i], None))
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["band", "a", "b"])

    return _blocks(groups, F.ceil(F.col("c") / BLOCK), []).mapInArrow(lambda batches: _each_block(batches, work), "band long, a long, b long")


def _across_marked(groups: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between marked members and members of other components of their bands, one a component at least.

    groups: band, node, n, regs, label, c, total (of n), marked, h (the set). Sets meet inside a task: a
    member is compared with the likeliest first, and no more with a component once a link to it is found.
    """

    def work(key: tuple, t: pa.Table) -> pa.RecordBatch:
        m = _Members(key, t, threshold)
        marked, sets = t["marked"].to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for c in t["h"].chunks for x in c]
        found: list[tuple] = []
        sides = ((m.left, m.right), (m.right, m.left))[: 1 if m.same else 2]
        for i, at in (found for own, others in sides for found in m.partners(own[marked[own]], others, False)):
            own, step = sets[i], 8
            while len(at):
                some, at, step = at[:step], at[step:], min(256, 2 * step)
                bounds = np.cumsum([0, *(len(sets[j]) for j in some)])
                h = np.concatenate([sets[j] for j in some])
                common = np.add.reduceat((own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h).astype(np.int64), bounds[:-1])
                linked = some[100 * common >= threshold * (len(own) + np.diff(bounds) - common)]
                if len(linked):
                    linked = linked[np.unique(m.label[linked], return_index=True)[1]]
                    found += [(m.node[i], m.node[j]) for j in linked]
                    at = at[~np.isin(m.label[at], m.label[linked])]
        cols = list(zip(*found, strict=True)) or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    chunks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("total") / BLOCK_SHINGLES))
    return _blocks(groups, chunks, ["marked", "h"]).mapInArrow(lambda batches: _each_block(batches, work), "a long, b long")


def _nodes(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (digest, node, first, text_hash, n, regs), one for each distinct set, and ties (a, b) of sets that one document has.

    first is the smallest document that has the set; its id names the node, unless that document is the first of
    several sets: then all but one of them are named by a hash.
    """
    real = sketches.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    sets = real.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("f"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    sets = materialize(sets.select("digest", F.col("f.doc_id").alias("first"), F.col("f.text_hash").alias("text_hash"), "n", "regs"), "digests")
    digest = F.xxhash64("digest")
    ties = materialize(real.groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select("doc_id"), "several")
    if ties.isEmpty():
        return sets.withColumn("node", F.col("first")), ties.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    again = sets.groupBy("first").agg(F.min("text_hash").alias("plain"), F.count("*").alias("k")).where("k > 1").select("first", "plain")
    own = F.col("plain").isNull() | (F.col("plain") == F.col("text_hash"))
    nodes = sets.join(again, "first", "left").withColumn("node", F.when(own, F.col("first")).otherwise(F.xxhash64("first", "text_hash", F.lit("set")))).drop("plain")
    nodes = materialize(nodes, "nodes")
    drop_table(sets)
    held = real.select("doc_id", "digest").join(ties, "doc_id", "left_semi").distinct()
    tied = held.join(nodes.select("digest", "node"), "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    return nodes, materialize(tied, "ties")


def classes_and_components(docs: DataFrame, words: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches, nodes (see _nodes) and labels (node, label) of nodes with a link; label is the smallest document reached."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", "text")
    sketches = materialize(sketch(docs, words), "sketches")
    nodes, tied = _nodes(sketches)

    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), F.substring("regs", ROWS * k + 1, ROWS)).alias("band")) for k in range(BANDS)])
    bands = nodes.select("node", "n", F.inline(keys))
    common = materialize(bands.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"), "common")
    bands = materialize(with_facts(bands, common, "band"), "bands")
    drop_table(common)
    company = bands.groupBy("node").agg(F.sum("c").alias("company"))
    hubs = bands.join(company, "node").groupBy("band").agg(F.max_by(F.struct("node", "n"), F.struct("company", -F.col("node"))).alias("hub"), F.first("c").alias("c"))
    stars = with_facts(bands.drop("c"), materialize(hubs, "hubs"), "band").where((F.col("node") != F.col("hub.node")) & _fits(F.col("n"), F.col("hub.n"), threshold))
    stars = materialize(stars.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    edges = _verify(_plausible(stars, nodes, threshold), docs, nodes, words, threshold)
    labels = components(edges.unionByName(tied))
    joined = lambda more: components(labels.toDF("a", "b").unionByName(more))  # noqa: E731  (the labels stand for all edges so far)

    def still_open(labels: DataFrame, bands: DataFrame) -> DataFrame:
        """The bands whose members lie in several components, with labels."""
        known = bands.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_ = known.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("total"), F.first("c").alias("c")).where("lo < hi").select("band", "total", "c")
        return with_facts(known.drop("c"), materialize(open_, "open"), "band").join(nodes.select("node", "regs"), "node")

    found = materialize(_across(still_open(labels, bands), threshold), "across")
    rest = found.where("b is not null").select("a", "b").distinct()
    rest = rest.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    labels = joined(_verify(rest, docs, nodes, words, threshold))
    marks = found.where("b is null").select("band", F.col("a").alias("node"), F.lit(True).alias("marked")).distinct()
    groups = still_open(labels, bands.join(marks.select("band").distinct(), "band", "left_semi"))
    groups = materialize(groups.join(marks, ["band", "node"], "left").withColumn("marked", F.coalesce("marked", F.lit(False))), "marked")
    if not groups.isEmpty():
        sets = _sets(docs, nodes, groups.select("node").distinct(), words)
        links = materialize(_across_marked(groups.join(sets, "node"), threshold), "links")
        if not links.isEmpty():
            labels = joined(links)
    if not nodes.where("node <> first").isEmpty():  # names by hash say nothing of the smallest document
        full = nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = full.groupBy("label").agg(F.min("first").alias("least"), F.count("*").alias("c"))
        labels = with_facts(full, materialize(least, "least"), "label").select("node", F.col("least").alias("label"))
    drop_table(bands)
    release(spark)
    return sketches, nodes, labels


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; threshold is a percentage."""
    sketches, nodes, labels = classes_and_components(docs, words, threshold)
    named = nodes.join(labels, "node", "left").select(F.col("digest").alias("own"), F.coalesce("label", "first").alias("label"))
    out = sketches.join(named, F.col("digest") == F.col("own"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {words} - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words} + 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT md5(string_agg(g, '|' ORDER BY g)) AS k, doc_id FROM s GROUP BY doc_id),
c AS (SELECT k, min(doc_id) AS node FROM k GROUP BY 1),
r AS (SELECT s.* FROM s JOIN c ON s.doc_id = c.node),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t AS (SELECT node AS a, node AS b FROM c UNION SELECT t.a, u.b FROM t JOIN u ON t.b = u.a),
l AS (SELECT a AS node, min(b) AS label FROM t GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(label, d.doc_id) AS component_id, d.doc_id = coalesce(label, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN c USING (k) LEFT JOIN l USING (node)
""".replace("{words}", "4").replace("{docs}", "documents")
