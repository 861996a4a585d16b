"""Toxicity: a convolutional text classifier on hashed word embeddings, trained by numpy.

A word is the sum of two hashed embeddings, of the whole word (A-Z lowered) and of its first bytes,
so inflected forms share what they have in common. Filters of several widths slide over the words; each filter's
largest value in the text (max pooling) goes to a logistic unit. Thresholds are calibrated on a part of the
sample that training doesn't see, by language: the language is guessed from function words in the text
itself, so that no other column is an input of a score. The score is the logistic of the distance to that
threshold, so 0.5 is the threshold in every language.

Training takes a bounded sample of labelled rows: up to `per_class` documents of either label, smallest
hash first, none longer than `longest` characters. Scoring is one pass over all whole texts: each filter is
folded with the embeddings into one table per place, a width-w filter is w lookups a word, and the maximum
over a text is one reduction.

Edge cases: null and empty texts have score 0 (no evidence); without labels of both classes every score is 0;
conflicting labels of one document count as toxic; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NON_WORD, Words, slices, smallest_hashes, tune

WORD_BITS, STEM_BITS, STEM = 15, 13, 5
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
_FUNCTION_WORDS = {
    "en": "the and of to is that for with it on as at this be are was not",
    "de": "der die das und in zu den mit von ist ein eine auf nicht sich im dem",
    "fr": "le la les et des un une du que dans pour est qui pas sur au avec",
    "es": "el los las y en que un una por con para del se no es lo como",
    "it": "il lo gli e di che un una per con non del della sono si",
    "pt": "o os as e de que um uma para com não do da em se no na",
    "nl": "de het een en van in is dat op te zijn met voor niet aan",
}
LANGS = [*_FUNCTION_WORDS, "other"]


def word_ids(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of the texts with the numbers of their two embeddings."""
    w = Words(texts, NON_WORD, LOWER)
    return w, (w.hashes() >> np.uint64(64 - WORD_BITS)).astype(np.int32), (w.hashes(STEM) >> np.uint64(64 - STEM_BITS)).astype(np.int32)


def _guess_tables() -> tuple[np.ndarray, np.ndarray]:
    hashes, langs = [], []
    for k, words in enumerate(_FUNCTION_WORDS.values()):
        h = Words(pa.array([words]), NON_WORD, LOWER).hashes()
        hashes += h.tolist()
        langs += [k] * len(h)
    order = np.argsort(np.array(hashes, np.uint64), kind="stable")
    return np.array(hashes, np.uint64)[order], np.array(langs)[order]


_GUESS_HASH, _GUESS_LANG = _guess_tables()


def guess_language(w: Words, h: np.ndarray) -> np.ndarray:
    """For each text the language most of whose function words it has, as a place in LANGS."""
    votes = np.zeros((len(w.counts), len(LANGS)))
    votes[:, -1] = 0.5
    doc = w.doc()
    lo, hi = np.searchsorted(_GUESS_HASH, h, "left"), np.searchsorted(_GUESS_HASH, h, "right")
    for step in range(int((hi - lo).max(initial=0))):
        ok = lo + step < hi
        np.add.at(votes, (doc[ok], _GUESS_LANG[lo[ok] + step]), 1)
    return votes.argmax(1)


class Net:
    """Embeddings, filters, a logistic unit and one threshold a language."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.word = r.normal(0, 0.02, (1 << WORD_BITS, DIM)).astype(np.float32)
        self.stem = r.normal(0, 0.02, (1 << STEM_BITS, DIM)).astype(np.float32)
        self.filters = {w: r.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = r.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.out_bias = np.float32(-1.0)
        self.threshold = np.zeros(len(LANGS))
        self.empty = True

    def fold(self) -> dict:
        """Per width and place, each embedding's value under the filters."""
        return {w: [(self.word @ f, self.stem @ f) for f in self.filters[w]] for w in WIDTHS}

    def pooled(self, word: np.ndarray, stem: np.ndarray, bounds: np.ndarray, folded: dict | None = None, where: bool = False) -> tuple[np.ndarray, list]:
        """Max-pooled filter values (texts x filters), and at which word each maximum starts if asked. Texts have words."""
        values, places = [], []
        e = None if folded else self.word[word] + self.stem[stem]
        for w in WIDTHS:
            n = len(word)
            conv = np.zeros((n, FILTERS), np.float32)
            for j in range(w):
                if n > j:
                    conv[: n - j] += folded[w][j][0][word[j:]] + folded[w][j][1][stem[j:]] if folded else e[j:] @ self.filters[w][j]
            # a window must lie in one text; a shorter text has no value for this width
            for j in range(1, w):
                conv[np.maximum(bounds[1:] - j, bounds[:-1])] = -1e9
            best = np.maximum.reduceat(conv, bounds[:-1], axis=0)
            if where:
                at = np.empty(best.shape, np.int64)
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    at[i] = a + conv[a:b].argmax(0)
                places.append(at)
            values.append(np.where(best < -1e8, -1.0, best + self.bias[w]))
        return np.concatenate(values, 1), places

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.out_bias

    def train(self, texts: list[np.ndarray], stems: list[np.ndarray], y: np.ndarray, epochs: int = 8, rate: float = 0.02, batch: int = 32, seed: int = 11, steps: int = 450) -> None:
        """Adam on the log loss for `epochs`, or as many as make `steps`; gradients of a maximum go to the words of the window that reached it."""
        epochs = max(epochs, -(-steps * batch // max(1, len(texts))))
        r = np.random.default_rng(seed)
        params = {"word": self.word, "stem": self.stem, "out": self.out, **{f"f{w}": self.filters[w] for w in WIDTHS}, **{f"b{w}": self.bias[w] for w in WIDTHS}}
        m = {k: np.zeros_like(v) for k, v in params.items()}
        s = {k: np.zeros_like(v) for k, v in params.items()}
        weight = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
        t = 0
        for epoch in range(epochs):
            lr = rate * (1 - epoch / epochs)
            order = r.permutation(len(texts))
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                bounds = np.cumsum([0, *(len(texts[i]) for i in rows)])
                word, stem = np.concatenate([texts[i] for i in rows]), np.concatenate([stems[i] for i in rows])
                z, places = self.pooled(word, stem, bounds, where=True)
                p = 1 / (1 + np.exp(-np.clip(self.logits(z), -30, 30)))
                d = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                dz = np.outer(d, self.out) * (z > 0)
                grads, lazy = {"out": np.maximum(z, 0).T @ d + 1e-4 * self.out}, {}
                touched_w, touched_s, deltas = [], [], []
                for k, w in enumerate(WIDTHS):
                    part = dz[:, k * FILTERS : (k + 1) * FILTERS].copy()
                    at = places[k]
                    part[at + w > bounds[1:, None]] = 0
                    grads[f"b{w}"] = part.sum(0)
                    gf = np.zeros_like(self.filters[w])
                    i, f = np.nonzero(part)
                    for j in range(w):
                        x = at[i, f] + j
                        e = self.word[word[x]] + self.stem[stem[x]]
                        np.add.at(gf[j].T, f, e * part[i, f][:, None])
                        touched_w.append(word[x])
                        touched_s.append(stem[x])
                        deltas.append(self.filters[w][j].T[f] * part[i, f][:, None])
                    grads[f"f{w}"] = gf
                delta = np.concatenate(deltas)
                for name, ids in (("word", np.concatenate(touched_w)), ("stem", np.concatenate(touched_s))):
                    rows_u, inv = np.unique(ids, return_inverse=True)
                    g = np.zeros((len(rows_u), DIM), np.float32)
                    np.add.at(g, inv, delta)
                    lazy[name] = (rows_u, g)
                t += 1
                c1, c2 = 1 - 0.9**t, 1 - 0.999**t
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    params[k] -= lr * (m[k] / c1) / (np.sqrt(s[k] / c2) + 1e-8)
                for k, (u, g) in lazy.items():  # only rows that this batch touched
                    m[k][u] += 0.1 * (g - m[k][u])
                    s[k][u] += 0.001 * (g * g - s[k][u])
                    params[k][u] -= lr * (m[k][u] / c1) / (np.sqrt(s[k][u] / c2) + 1e-8)
                self.out_bias -= np.float32(lr * d.sum())
        self.empty = False

    def calibrate(self, logits: np.ndarray, langs: np.ndarray, y: np.ndarray, negatives: float) -> None:
        """Per language the threshold with the fewest weighted errors, midway between neighbours.

        negatives: how many times a clean row of the sample counts, so that errors weigh as in the
        corpus. A language with few rows takes the threshold of all.
        """

        def best(z: np.ndarray, t: np.ndarray) -> float:
            order = np.argsort(z)
            z, t = z[order], t[order]
            missed = np.concatenate([[0], np.cumsum(t)])  # threshold above the first i rows
            alarms = negatives * np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
            cost = missed + alarms
            at = np.flatnonzero(cost <= cost.min() + 1e-9)
            edge = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
            return float(np.median(edge[at]))

        every = best(logits, y) if len(y) else 0.0
        for k in range(len(LANGS)):
            own = langs == k
            self.threshold[k] = best(logits[own], y[own]) if y[own].sum() >= 15 and (1 - y[own]).sum() >= 15 else every

    def score(self, texts: pa.Array, folded: dict) -> np.ndarray:
        w, word, stem = word_ids(texts)
        out = np.zeros(len(w.counts))
        rows = np.flatnonzero(w.counts)
        if len(rows) and not self.empty:
            z, _ = self.pooled(word, stem, np.concatenate([w.bounds[rows], w.bounds[-1:]]), folded)
            shift = self.threshold[guess_language(w, w.hashes())][rows]
            out[rows] = 1 / (1 + np.exp(-np.clip(self.logits(z) - shift, -30, 30)))
        return out


def train_toxicity(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 2000, longest: int = 12_000) -> Net:
    """Fits a network on a bounded sample of rows of docs that labels marks and the condition `train` admits."""
    net = Net()
    marks = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    fit = docs.where(train & F.col("text").isNotNull() & F.length("text").between(1, longest))
    # only ids are moved; the texts of the chosen ones, of which there are at most 2 * per_class, are read again
    rows = fit.select("doc_id").distinct().join(marks, F.col("doc_id") == F.col("label_id")).select("doc_id", "toxic")
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (total.get(0) and total.get(1)):
        return net
    chosen = {r["doc_id"]: (r["h"], r["toxic"]) for r in smallest_hashes(rows, "toxic", per_class)}
    texts = fit.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    got = [r for r in sorted((*chosen[r["doc_id"]], r["text"]) for r in texts.collect()) if re.search(r"\w", r[2])]
    y = np.array([r[1] for r in got], np.float64)
    own, stems, langs = [], [], np.zeros(0, np.int64)
    for lo in range(0, len(got), 200):  # hashing takes some 30 bytes a character
        w, word, stem = word_ids(pa.array([r[2] for r in got[lo : lo + 200]]))
        own += np.split(word, w.bounds[1:-1])
        stems += np.split(stem, w.bounds[1:-1])
        langs = np.concatenate([langs, guess_language(w, w.hashes())])
    ok = np.array([len(x) > 0 for x in own])
    held = np.arange(len(y)) % 4 == 3
    first = np.flatnonzero(ok & ~held)
    if not 0 < y[first].sum() < len(first):
        return net
    net.train([own[i] for i in first], [stems[i] for i in first], y[first])
    test = np.flatnonzero(ok & held)
    if len(test):
        z, _ = net.pooled(np.concatenate([own[i] for i in test]), np.concatenate([stems[i] for i in test]), np.cumsum([0, *(len(own[i]) for i in test)]))
        clean, toxic = max(1, (y == 0).sum()), max(1, (y == 1).sum())
        net.calibrate(net.logits(z), langs[test], y[test], max(1.0, total[0] / total[1] * toxic / clean))
    return net


def score_toxicity(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, score and predicted, for every row of docs."""
    tune(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = net.fold()
        for batch in slices(batches, most=1 << 20):
            p = net.score(batch.column(1), folded)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, net: Net) -> DataFrame:
    """docs, all its columns as they are, without the rows whose text the net rejects."""
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = net.fold()
        for batch in slices(batches, most=1 << 20):
            yield batch.filter(pa.array(net.score(batch.column(at), folded) < 0.5))

    return docs.mapInArrow(clean, docs.schema)
