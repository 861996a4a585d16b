"""Substring dedup with fixed-block anchors.

Every 50-word window holds a whole block of 25 words that starts at a multiple of 25 in its document. So the
index holds each document's non-overlapping blocks with the smallest document of each; every rolling
25-word window of every document probes it; and around the hits, where only a repeat can be, 50-word windows
extend them to maximal exact repeats: runs of windows that start in a smaller document too.

Scale: probes travel packed, a few bytes a word (a bucket number and 32 bits of the hash that the bucket
doesn't imply), one row per slice of texts and bucket. A bucket holds its distinct blocks in memory
and streams the probes past them, so a passage that a third of all documents share takes one entry. Hits come
back by document; only there are texts read again, and only windows near hits are compared, by 96-bit
hashes: each slice of texts first settles its own repeats and sends one document a distinct window.
A task has one bucket, and buckets grow in number with the input.

Edge cases: null texts have no words; texts under 50 words lose none; rows that repeat an id are judged each by
its own text, and not against each other; rows without id keep all their words and are no reference; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, binaries, deal, input_bytes, materialize, mix, release, slices, tune, windows

WINDOW, BLOCK = 50, 25
#: Stored bytes of text a bucket, up to MANY buckets; from there on buckets grow, to LARGE_BYTES, before they multiply again.
BUCKET_BYTES, MANY, LARGE_BYTES = 4 << 20, 4096, 512 << 20
_LOW = np.uint64(0xFFFFFFFF)


def _bits(stored: int, each: int = BUCKET_BYTES) -> int:
    """log2 of the number of buckets: each holds some `each` bytes. Rows pack a slice's probes by bucket, so buckets
    beyond MANY would leave single probes in a row; they hold up to LARGE_BYTES first, whose blocks take under 100 MB."""
    return max(2, min(stored // each, max(MANY, stored // LARGE_BYTES)).bit_length())


def _rolling(w: Words, h: np.ndarray, k: int, salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of single texts, and the words they start at."""
    at = np.flatnonzero(w.left() >= k)
    return windows(h, k, salt)[at], at


def _cut(group: np.ndarray) -> np.ndarray:
    """Where sorted group numbers change, with both ends."""
    return np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]]) if len(group) else np.zeros(1, np.int64)


_PROBE = "bucket int, kind int, ids binary, counts binary, keys binary"


def _probes(docs: DataFrame, bits: int, block: int) -> DataFrame:
    """Packed rows of blocks (kind 0: keys, ids) and probes (kind 1: keys of the documents ids, counts each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(batch.column(0).is_valid())
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            w = Words(batch.column(1))
            h, at = _rolling(w, w.hashes(), block)
            if not len(h):
                continue
            doc, place = w.doc()[at], w.place()[at]
            bucket = (h >> np.uint64(64 - bits)).astype(np.uint32)
            low = (h & _LOW).astype(np.uint32)
            rows: list[tuple] = []
            # blocks: the smallest document of each
            own = np.flatnonzero(place % block == 0)
            order = own[np.lexsort((ids[doc[own]], low[own], bucket[own]))]
            b, k = bucket[order], low[order]
            new = np.concatenate([[True], (b[1:] != b[:-1]) | (k[1:] != k[:-1])])
            order, b = order[new], b[new]
            cut = _cut(b)
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                rows.append((int(b[lo]), 0, ids[doc[order[lo:hi]]].tobytes(), b"", low[order[lo:hi]].tobytes()))
            # probes, by bucket and document
            order = np.argsort(bucket, kind="stable")
            b, d, k = bucket[order], doc[order], low[order]
            cut = _cut(b)
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                each = _cut(d[lo:hi])
                rows.append((int(b[lo]), 1, ids[d[lo:hi][each[:-1]]].tobytes(), np.diff(each).astype(np.uint32).tobytes(), k[lo:hi].tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["bucket", "kind", "ids", "counts", "keys"])

    return docs.mapInArrow(run, _PROBE)


def _hits(probes: DataFrame, bits: int) -> DataFrame:
    """(id, bucket, keys): the block hashes that a document shares with another, itself holding them or not."""
    spread = deal(probes, 1 << bits, F.col("bucket")).sortWithinPartitions("bucket", "kind")

    def emit(bucket: int, ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        cut = _cut(ids)
        return pa.RecordBatch.from_arrays([pa.array(ids[cut[:-1]], pa.int64()), pa.array(np.full(len(cut) - 1, bucket, np.int32)), binaries(keys, cut)], ["id", "bucket", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        keys = least = live = None

        def index() -> None:
            nonlocal keys, least, live
            k, i = (np.concatenate([b[j] for b in blocks]) for j in (0, 1)) if blocks else (np.empty(0, np.uint32), np.empty(0, np.int64))
            order = np.lexsort((i, k))
            k, i = k[order], i[order]
            new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
            keys, least = k[new], i[new]
            live = np.zeros(len(keys), bool)

        def firsts() -> Iterator[pa.RecordBatch]:
            """At the end of a bucket, the first holders of blocks that others hit."""
            if keys is not None and live.any():
                i, k = least[live], keys[live]
                order = np.argsort(i, kind="stable")
                yield emit(now, i[order], k[order])

        for batch in batches:
            for j in range(batch.num_rows):
                bucket, kind = batch.column(0)[j].as_py(), batch.column(1)[j].as_py()
                if bucket != now:
                    if now is not None:
                        yield from firsts()
                    now, blocks, keys = bucket, [], None
                ids, k = np.frombuffer(batch.column(2)[j].as_buffer(), np.int64), np.frombuffer(batch.column(4)[j].as_buffer(), np.uint32)
                if kind == 0:
                    blocks.append((k, ids))
                    continue
                if keys is None:
                    index()
                    blocks = []
                if not len(keys):
                    continue
                doc = np.repeat(ids, np.frombuffer(batch.column(3)[j].as_buffer(), np.uint32))
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                hit = np.flatnonzero((keys[at] == k) & (least[at] < doc))
                if len(hit):
                    live[at[hit]] = True
                    yield emit(now, doc[hit], k[hit])
        if now is not None:
            yield from firsts()

    return spread.mapInArrow(run, "id long, bucket int, keys binary")


def _kept(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_STAGED = "doc_id long, text string, n_words long, kept_sha256 string, starts binary"


def _stage(docs: DataFrame, hits: DataFrame, bits: int, window: int, block: int) -> DataFrame:
    """Documents without candidates come out done; others keep their text and where candidate windows start."""
    by_doc = hits.groupBy("id").agg(F.collect_list(F.struct("bucket", "keys")).alias("hits"))  # a row a bucket and slice at most
    joined = docs.join(by_doc, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, held = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found: dict[int, np.ndarray] = {}
            some = [i for i, h in enumerate(held) if h]
            counts = np.zeros(len(texts), np.int64)
            if some:
                w = Words(batch.column(1).take(pa.array(some)))
                h, at = _rolling(w, w.hashes(), block)
                low = (h & _LOW) | ((h >> np.uint64(64 - bits)) << np.uint64(32))
                wanted = np.unique(np.concatenate([np.frombuffer(x["keys"], np.uint32).astype(np.uint64) | (np.uint64(x["bucket"]) << np.uint64(32)) for i in some for x in held[i]]))
                near = np.minimum(np.searchsorted(wanted, low), len(wanted) - 1)
                q = at[wanted[near] == low]
                # a window over a hit starts up to window - block words before it
                step = np.zeros(len(w.starts) + 1, np.int64)
                np.add.at(step, np.maximum(q - (window - block) + 1, w.bounds[w.doc()[q]]), 1)
                np.add.at(step, q + 1, -1)
                ok = (np.cumsum(step[:-1]) > 0) & (w.left() >= window)
                where, doc, place = np.flatnonzero(ok), w.doc(), w.place()
                cut = np.searchsorted(doc[where], np.arange(len(some) + 1))
                for n, i in enumerate(some):
                    counts[i] = w.counts[n]
                    if cut[n + 1] > cut[n]:
                        found[i] = place[where[cut[n] : cut[n + 1]]].astype(np.uint32)
            out = []
            for i, text in enumerate(texts):
                if i in found:
                    out.append((text, int(counts[i]), None, found[i].tobytes()))
                else:
                    words = (text or "").encode().split()
                    out.append((None, len(words), _kept(words), None))
            cols = list(zip(*out, strict=True))
            types = (pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "text", "n_words", "kept_sha256", "starts"])

    return joined.mapInArrow(run, _STAGED)


def _tag(text: str) -> int:
    return zlib.crc32(text.encode())


_ENTRIES = "bucket int, ids binary, tags binary, counts binary, starts binary, keys binary, checks binary"


def least_in(h: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n consecutive hashes, in log n steps."""
    out, held = h, 1
    while held < n and len(out):
        step = min(held, n - held)
        out = np.minimum(out[:-step], out[step:])
        held += step
    return out


def _repeats(staged: DataFrame, window: int, block: int) -> DataFrame:
    """(id, tag, starts): the candidate windows that also start in a smaller document.

    A window's bucket is that of the smallest hash among its blocks-long parts, which neighbours mostly have in
    common: a repeat falls to a few buckets, not to one a window.

    A slice of texts tells its own repeats at once and sends on, for each distinct window, only its
    smallest document's places, so what meets in a bucket is one entry a slice however often a passage occurs.
    """
    bits = _bits(input_bytes(staged), BUCKET_BYTES // 2)

    def packed(bucket: int, ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> tuple:
        """Entries in order of text; bucket -1 holds repeats that are known already."""
        cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]))
        counts = np.diff(np.append(cut, len(ids))).astype(np.uint32)
        return (bucket, ids[cut].tobytes(), tags[cut].tobytes(), counts.tobytes(), starts.tobytes(), keys.tobytes(), checks.tobytes())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(batch.column(1))
            h = w.hashes()
            found = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(2)]
            doc = np.repeat(np.arange(batch.num_rows), [len(x) for x in found])
            starts = np.concatenate(found)
            at = starts.astype(np.int64) + w.bounds[doc]
            key, check = windows(h, window, 2)[at], (windows(h, window, 3)[at] >> np.uint64(32)).astype(np.uint32)
            ids = batch.column(0).to_numpy()[doc]
            tags = np.array([_tag(t) for t in batch.column(1).to_pylist()], np.uint32)[doc]
            order = np.lexsort((ids, check, key))
            k, c = key[order], check[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            least = np.empty(len(ids), np.int64)
            least[order] = ids[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
            rows = []
            known = np.flatnonzero(ids > least)
            if len(known):
                rows.append(packed(-1, ids[known], tags[known], starts[known], key[:0], check[:0]))
            rest = np.flatnonzero(ids == least)
            bucket = (mix(least_in(windows(h, block), window - block + 1)[at[rest]]) >> np.uint64(64 - bits)).astype(np.int32)  # the least are small: mix anew
            order = np.argsort(bucket, kind="stable")
            rest, bucket = rest[order], bucket[order]
            cut = _cut(bucket)
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                o = rest[lo:hi]
                rows.append(packed(int(bucket[lo]), ids[o], tags[o], starts[o], key[o], check[o]))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "ids", "tags", "counts", "starts", "keys", "checks"])

    rows = staged.where("starts is not null").select("doc_id", "text", "starts").mapInArrow(spread, _ENTRIES)
    # known repeats need no company: they stay spread
    own = F.when(F.col("bucket") < 0, F.hash("ids", "starts")).otherwise(F.col("bucket"))
    rows = deal(rows, 1 << bits, own).sortWithinPartitions("bucket")

    def told(ids: np.ndarray, tags: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((starts, tags, ids))
        ids, tags, starts = ids[order], tags[order], starts[order]
        cut = np.append(np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])), len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[cut[:-1]], pa.int64()), pa.array(tags[cut[:-1]].astype(np.int64)), binaries(starts, cut)], ["id", "tag", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ids, tags, starts, keys, checks = (np.concatenate([x[j] for x in held]) for j in range(5))
            order = np.lexsort((ids, checks, keys))
            k, c, d = keys[order], checks[order], ids[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            again = order[d > d[np.flatnonzero(new)[np.cumsum(new) - 1]]]
            if len(again):
                yield told(ids[again], tags[again], starts[again])

        for batch in batches:
            for j in range(batch.num_rows):
                bucket = batch.column(0)[j].as_py()
                if bucket != now:
                    yield from flush()
                    now, held = bucket, []
                part = [np.frombuffer(batch.column(c)[j].as_buffer(), t) for c, t in enumerate((np.int64, np.uint32, np.uint32, np.uint32, np.uint64, np.uint32), 1)]
                ids, tags = np.repeat(part[0], part[2]), np.repeat(part[1], part[2])
                if bucket < 0:
                    yield told(ids, tags, part[3])
                else:
                    held.append((ids, tags, *part[3:]))
        yield from flush()

    return rows.mapInArrow(run, "id long, tag long, starts binary")


def substring_dedup(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every document.

    kept_text is null where nothing was removed. A window of `window` words must hold a whole block: 2 * block - 1 <= window.
    """
    if 2 * block - 1 > window:
        raise ValueError("blocks must not be longer than half a window")
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", "text")
    bits = _bits(input_bytes(docs))
    hits = _hits(_probes(docs, bits, block), bits)
    staged = materialize(_stage(docs, hits, bits, window, block), "staged")
    release(spark)
    found = materialize(_repeats(staged, window, block), "repeats")
    release(spark)
    by_text = found.groupBy("id", "tag").agg(F.collect_list("starts").alias("again"))
    open_ = staged.where("starts is not null").withColumn("crc", F.crc32(F.encode("text", "UTF-8")))
    joined = open_.join(by_text, (F.col("doc_id") == F.col("id")) & (F.col("crc") == F.col("tag")), "left").select("doc_id", "text", "again")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, again in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split()
                step = np.zeros(len(words) + 1, np.int64)
                for one in again or ():
                    s = np.frombuffer(one, np.uint32).astype(np.int64)
                    np.add.at(step, s, 1)
                    np.add.at(step, s + window, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((len(words), int(gone.sum()), _kept(kept), b" ".join(kept).decode() if gone.any() else None))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    changed = joined.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    done = staged.where("starts is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    return done.unionByName(changed)


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT k, min(doc_id) AS m FROM e GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM e JOIN m USING (k) WHERE m < doc_id),
g AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]), ' ') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
