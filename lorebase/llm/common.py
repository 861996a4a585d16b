"""What the operators of this subpackage share: word hashing on Arrow buffers, written tables.

Words are hashed by numpy straight from Arrow's UTF-8 buffers, so no Python object is made
for a word. Slices of a few MB bound what a worker holds whatever the batch size is.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a worker handles (a longer text is a slice of its own).
SLICE_BYTES = 2 << 20
#: Texts that one step handles.
SLICE_ROWS = 4000
#: Rows from which on a key of a join may count as hot.
HOT_ROWS = 500
#: The white space of the contracts: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters and digits.
NON_WORD = np.zeros(256, bool)
NON_WORD[[c for c in range(128) if not chr(c).isalnum()]] = True
SAME = np.arange(256, dtype=np.uint8)
#: A-Z to a-z.
LOWER = SAME.copy()
LOWER[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = [int(x) | 1 for x in _RNG.integers(1 << 60, 1 << 63, 8)]
_powers: dict[int, np.ndarray] = {}
_own_dirs: dict[str, str] = {}
#: Per application, the tables written in the innermost scope.
_written: dict[str, list[str]] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(1024, 1 << (n - 1).bit_length() if n > 1 else 1024)
        got = np.full(size, base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a column of texts: data (folded bytes), starts, ends, bounds.

    Words of text i are starts[bounds[i]:bounds[i + 1]]; a null text has none.
    """

    def __init__(self, texts: pa.Array, sep: np.ndarray = SPACE, fold: np.ndarray = SAME):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.raw, self.offsets = data, offsets - offsets[0]
        self.data = data if fold is SAME else fold[data]
        gap = sep[data]
        first, last = ~gap, ~gap
        if len(data):
            first[1:] &= gap[:-1]
            last[:-1] &= gap[1:]
            at = self.offsets[:-1]
            at = at[at < len(data)]
            first[at] = ~gap[at]
            before = at[at > 0] - 1
            last[before] = ~gap[before]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._first = first
        self._gap = gap
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)

    def hashes(self, most: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, or of its first `most` bytes."""
        n = len(self.starts)
        if not n:
            return np.zeros(0, np.uint64)
        head = int(self.starts[0])
        word = np.cumsum(self._first[head:], dtype=np.int32)
        at = np.arange(len(word), dtype=np.int64)
        at -= (self.starts - head)[word - 1]
        longest = int(at.max()) + 1
        x = _BYTE[self.data[head:]]
        x *= powers(_BASE[0], longest)[at]
        gap = self._gap[head:]
        x[gap if not most else gap | (at >= most)] = 0
        return mix(np.add.reduceat(x, self.starts - head))

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)

    def place(self) -> np.ndarray:
        """The place of each word in its text, from 0."""
        return np.arange(len(self.starts), dtype=np.int64) - np.repeat(self.bounds[:-1], self.counts)

    def left(self) -> np.ndarray:
        """How many words of its text start at each word or later."""
        return np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.starts), dtype=np.int64)


def windows(h: np.ndarray, k: int, salt: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of k words (len(h) - k + 1 of them), in time that doesn't grow with k."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    base = _BASE[salt]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(base, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(pow(base, -1, 1 << 64), n - k + 1))


def shingles(w: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct k-word shingles, sorted by text and hash.

    A text of fewer words has its whole sequence as one; one without words has none. Hashes
    keep 64 bits less those that number a slice's texts, the same ones in any slice.
    """
    bits = SLICE_ROWS.bit_length()
    assert len(w.counts) <= SLICE_ROWS
    doc, left = w.doc(), w.left()
    full = np.zeros(len(h), np.uint64)
    full[: max(0, len(h) - k + 1)] = windows(h, k)
    ok = left >= k
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    key = (doc[ok].astype(np.uint64) << np.uint64(64 - bits)) | (full[ok] >> np.uint64(bits))
    if len(short):
        own = [windows(h[w.bounds[i] : w.bounds[i + 1]], int(w.counts[i]), 2)[0] for i in short]
        key = np.concatenate([key, (short.astype(np.uint64) << np.uint64(64 - bits)) | (np.array(own, np.uint64) >> np.uint64(bits))])
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    low = key & np.uint64((1 << (64 - bits)) - 1)
    return (key >> np.uint64(64 - bits)).astype(np.int64), low << np.uint64(bits)


def shingle_set(text: str | None, k: int) -> set:
    """The distinct k-word shingles of one text as tuples: the plain form, for tests."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each slice has up to `most` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
        offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        lo = 0
        while lo < batch.num_rows:
            hi = min(lo + SLICE_ROWS, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1))
            yield batch.slice(lo, hi - lo)
            lo = hi


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of bytes: data (of any type) cut at bounds."""
    size = data.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def tune(spark: SparkSession) -> None:
    """Arrow batches that stay small with very long texts, unless the session has its own setting.

    The setting must hold when the caller runs the lazy result, so it stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # the default
        spark.conf.set(name, "2000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on one machine a folder of our own."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = path = tempfile.mkdtemp(prefix="lorebase-")
        atexit.register(shutil.rmtree, path, True)
    return f"file://{_own_dirs[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (app := spark.sparkContext.applicationId) in _written:
        _written[app].append(path)
    return path


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lorebase_path = path
    return out


def smallest_hashes(rows: DataFrame, group: str, each: int, id_: str = "doc_id") -> list:
    """Rows (group, id, h) of the `each` ids of every group with the smallest hashes, as a list on the driver.

    Counts of the groups set a cut on the hash that leaves some more than `each`; only those few rows move.
    Where repeated ids let it leave fewer, the cut is widened.
    """
    keyed = rows.select(group, id_, F.xxhash64(F.col(id_).cast("string")).alias("h"))
    left = {r[group]: r["n"] for r in keyed.groupBy(group).agg(F.count("*").alias("n")).collect()}  # one row a group
    out, aim = [], each + 6 * int(each**0.5) + 30
    while left:
        cuts = [(g, min((1 << 63) - 1, -(1 << 63) + int(aim / n * 2.0**64))) for g, n in left.items()]
        kind = rows.schema[group].dataType.simpleString()
        small = F.broadcast(rows.sparkSession.createDataFrame(cuts, f"{group} {kind}, cut long"))
        got: dict = {}
        for r in keyed.join(small, group).where(F.col("h") <= F.col("cut")).drop("cut").distinct().collect():
            got.setdefault(r[group], []).append(r)
        for g, n in list(left.items()):
            if len(got.get(g, ())) >= each or aim >= n:
                out += sorted(got.get(g, ()), key=lambda r: r["h"])[:each]
                del left[g]
        aim *= 8
    return out


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that were written inside are deleted at its end, but for those that `keep` names."""
    app = spark.sparkContext.applicationId
    outer = _written.get(app)
    _written[app] = []
    try:
        yield
    finally:
        for path in _written.pop(app):
            _delete(spark, path)
        if outer is not None:
            _written[app] = outer


def keep(df: DataFrame) -> DataFrame:
    """Takes a table that materialize wrote out of the scope it was written in."""
    own = _written.get(df.sparkSession.sparkContext.applicationId, [])
    if df._lorebase_path in own:
        own.remove(df._lorebase_path)
    return df


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Deletes what materialize wrote, once nothing reads it any more."""
    path = getattr(df, "_lorebase_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files that no live plan refers to."""
    spark._jvm.System.gc()


def input_bytes(df: DataFrame, default: int = 64 << 20) -> int:
    """The stored size of what df reads, by Spark's statistics; `default` where it is unknown."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        size = int(str(leaves.apply(i).stats().sizeInBytes()))
        total += default if size > 1 << 55 else size
    return max(1, total)


def parts(spark: SparkSession, rows_or_bytes: float, each: float) -> int:
    """Shuffle partitions for work that grows with the input: at least the session's number."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows_or_bytes // each)))


def deal(df: DataFrame, n: int, by: Column) -> DataFrame:
    """df in n partitions, row to partition by % n, so that buckets 0 .. n - 1 don't meet by chance."""
    return df.repartitionById(n, F.pmod(by.cast("int"), F.lit(n)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows joined with facts(key, c, ...): one row a key, c at least the number of rows that have it.

    The facts of a key that holds over a 20,000th of all rows go to every task, and such keys are at most 20,000
    by arithmetic; its rows stay where they are. Rows of other keys are shuffled to their facts. facts should be a written table.
    """
    stats = facts.agg(F.max("c").alias("most"), F.sum("c").alias("total")).first()
    limit = max(HOT_ROWS, (stats["total"] or 0) // 20_000)
    if (stats["most"] or 0) <= limit:
        return rows.join(facts, key)
    hot = facts.where(F.col("c") > limit)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col("c") <= limit), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def contracted(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) from the nodes of each run of about `most` edges (a, b) to the smallest that the run lets them reach."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate([b.column(c).to_numpy() for c in (0, 1) for b in held]), return_inverse=True)
        label, (a, b) = np.arange(len(ids)), at.reshape(2, -1)
        while True:
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            apart = low < high
            if not apart.any():
                break
            np.minimum.at(label, high[apart], low[apart])
            while (label[label] != label).any():
                label = label[label]
        moved = label < np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= most:
            yield star(held)
            held = []
    if held:
        yield star(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of edges(a, b) reaches; only nodes with an edge. A written table.

    Each task contracts the edges it reads; then small-star and large-star (Kiveris et al., 2014) alternate over written
    tables until the edges are stars, which the minima of the next step tell: no node has a smaller neighbour and another one.
    Every step is a grouped minimum, no group's members are gathered, and the centre of a large star is no hot key of a join.
    """
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    e = materialize(e.mapInArrow(contracted, "u long, v long").distinct(), "edges")
    while True:
        least = materialize(both(e).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"), F.count_if(F.col("v") < F.col("u")).alias("c")), "least")
        if least.where("m < u AND k > 1").isEmpty():
            drop_table(least)
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        small = with_facts(e, least.where("c > 0").select("u", "m", "c"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = materialize(small, "small")
        drop_table(e)
        drop_table(least)
        least = materialize(both(small).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c"), "least")
        large = with_facts(both(small).where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = materialize(large.where("u <> v"), "edges")
        drop_table(small)
        drop_table(least)
