"""Secret scans: known shapes, and sliding-window Shannon entropy over candidate strings.

Base kinds are regular expressions: assignments to password-like names, access key ids and long
runs of hex. The method adds spans of kind "entropy": in every run of key-like characters, a
window slides over the run; a step takes one character out and one in, and the counts of the two in the window
change the sum of c log c by two entries of a table (whole numbers, so a window's entropy doesn't depend on where it
stands). All runs of a text are done at once. A window counts by the class of its characters (hex; letters and digits,
with signs or not; letters alone; letters of both cases and signs), each with a threshold of its own; windows
over the threshold that touch are one span. An allow-list (UUIDs, integrity hashes, and words of letters and
digits that hold an alphabet or a placeholder) cuts its own stretches out of a run, and the rest is judged;
it never suppresses base spans, and a span that a base span already holds is not told twice.
Random letters of one case often stay under the threshold of letters, as their entropy is that of words.

Scale: one pass over the texts in Arrow slices, no shuffle. Edge cases: null text is empty and has
no spans; ids may be null or repeated; a text of any length is scanned whole; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, tune

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
#: As ASSIGN needs one of these (in any case), most texts are done with a few fast searches.
_HINTS = re.compile(r"[:=]")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character, of at most log2(WINDOW) = 4.32.
THRESHOLDS = {"hex": 3.0, "mixed": 3.6, "letters": 3.8, "signs": 4.0}
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"^sha(?:1-[A-Za-z0-9+/]{0,27}|256-[A-Za-z0-9+/]{0,43}|384-[A-Za-z0-9+/]{0,64}|512-[A-Za-z0-9+/]{0,86})={0,2}"),
)
#: Suppresses the whole word of letters and digits that holds it.
PLACEHOLDER = re.compile(r"(?i)example|placeholder|changeme|abcdefgh|0123456789|qwertyui")
_WORD = re.compile(r"[A-Za-z0-9]+")
#: Fixed-point units of a bit.
UNIT = 1 << 32
_CLOG = np.array([0] + [round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 1)], np.int64)
_DIGIT, _LOWER, _UPPER, _NOT_HEX = (np.zeros(128, bool) for _ in range(4))
_DIGIT[48:58] = _LOWER[97:123] = _UPPER[65:91] = _NOT_HEX[:] = True
_NOT_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = False
#: The largest sum of c log c with which a window reaches its class's threshold.
_MOST = {k: math.floor(WINDOW * (math.log2(WINDOW) - v) * UNIT + WINDOW) for k, v in THRESHOLDS.items()}


def entropy_spans(runs: list[str], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each run (of ASCII, at least a window long) the (start, end) of what windows over their class's threshold cover."""
    if not runs:
        return []
    code = np.frombuffer("".join(runs).encode(), np.uint8).astype(np.int64)
    n, size = len(code), np.array([len(r) for r in runs])
    starts = np.cumsum(size) - size
    run = np.repeat(np.arange(len(runs)), size)
    # places in order of (run, character): a count in a stretch is a difference of two ranks
    key = ((run << 7) | code) * n + np.arange(n)
    order = np.sort(key)
    rank = np.empty(n, np.int64)
    rank[order % n] = np.arange(n)
    at = np.arange(n)
    full = at - starts[run] >= window
    out = at[full] - window
    left = np.searchsorted(order, key[out] - out + at[full]) - rank[out]  # the leaving character's count before it leaves
    entering = rank - np.searchsorted(order, key - at + np.maximum(at - window + 1, starts[run]))  # the entering one's count before
    step = _CLOG[entering + 1] - _CLOG[entering]
    step[full] -= _CLOG[left] - _CLOG[left - 1]
    total = np.cumsum(step)
    before = np.concatenate([[0], total])[starts]
    total -= before[run]

    def held(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[code])])
        return sums[ends + 1] - sums[ends + 1 - window]

    ends = np.flatnonzero(at - starts[run] >= window - 1)
    digits, low, up, others = (held(x) for x in (_DIGIT, _LOWER, _UPPER, _NOT_HEX))
    letters, sums = low + up, total[ends]
    most = np.full(len(ends), -1, np.int64)
    most[(letters > 0) & (digits > 0)] = _MOST["mixed"]
    most[(letters > 0) & (digits > 0) & (others == 0)] = _MOST["hex"]
    most[letters == window] = _MOST["letters"]
    most[(digits == 0) & (letters < window) & (low > 0) & (up > 0)] = _MOST["signs"]
    ends = ends[sums <= most]
    spans: list[list[tuple[int, int]]] = [[] for _ in runs]
    if len(ends):
        cut = np.flatnonzero(np.concatenate([[True], (ends[1:] - ends[:-1] > window) | (run[ends[1:]] != run[ends[:-1]]), [True]]))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            r = int(run[ends[lo]])
            spans[r].append((int(ends[lo] - starts[r]) - window + 1, int(ends[hi - 1] - starts[r]) + 1))
    return spans


def judged(run: str) -> list[tuple[int, int]]:
    """(start, end) of the parts of a run that no allow-listed stretch holds, if a window fits."""
    out, at = [], 0
    held = [m.span() for allow in ALLOW for m in allow.finditer(run)]
    if PLACEHOLDER.search(run):
        held += [m.span() for m in _WORD.finditer(run) if PLACEHOLDER.search(m.group())]
    for a, b in sorted(held):
        out.append((at, a))
        at = max(at, b)
    return [(a, b) for a, b in [*out, (at, len(run))] if b - a >= WINDOW]


def find_spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans as (start, end, kind), by start, then kind as listed."""
    text = text or ""
    base = []
    if _HINTS.search(text):
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base.sort(key=order)
    starts = [x[0] for x in base]
    reach = list(itertools.accumulate((x[1] for x in base), max))
    parts = [(m.start() + lo, m.start() + hi) for m in RUN.finditer(text) for lo, hi in judged(m.group())]
    more = []
    for (lo, hi), found in zip(parts, entropy_spans([text[lo:hi] for lo, hi in parts]), strict=True):
        for a, b in found:
            k = bisect_right(starts, lo + a)
            if not (k and reach[k - 1] >= lo + b):  # no base span holds it
                more.append((lo + a, lo + b, "entropy"))
    return base, sorted(base + more, key=order)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[REDACTED]") -> str:
    """The text with each stretch of touching spans replaced by the mark."""
    out, at, i = [], 0, 0
    merged: list[list[int]] = []
    for a, b, _ in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_spans, spans of every document."""
    tune(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = find_spans(text)
                kinds = [s[2] for s in every]
                told = joined(base)
                rows.append((*(kinds.count(k) for k in KINDS), told, hashlib.sha256(told.encode()).hexdigest(), joined(every)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_spans", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_spans string, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every span replaced; n_chars follows where the text changed."""
    tune(docs.sparkSession)
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, sizes = batch.column(at).to_pylist(), None if chars is None else batch.column(chars).to_pylist()
            for i, text in enumerate(texts):
                if text and (spans := find_spans(text)[1]):
                    texts[i] = redact(text, spans, mark)
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            if chars is not None:
                cols[chars] = pa.array(sizes, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(clean, docs.schema)
