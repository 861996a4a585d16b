"""Language identification in two levels: the family first, then the language within it.

Features are hashed byte 2- to 4-grams of the lower-cased text, with all ASCII but letters as one
separator, as shares of all its n-grams. At each level one-versus-one linear support vector
machines (squared hinge, trained by numpy) vote; summed margins break ties. Being linear in the
shares, a machine's value is the mean of its weights over the text's n-grams, so a text of any
length is scored whole in one pass without a feature vector.

Training takes a bounded sample: up to `per_lang` documents of each language, smallest hash first,
none longer than `longest` characters, of every language that has any. All else
covers every row: scoring is one pass over the texts with the weights (a few hundred KB) in the task.

Edge cases: null text, or one without any letter, is `und` with score 0; with nothing to learn from,
everything is `und`; one language alone is always predicted. Further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, smallest_hashes, tune

FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu se",
    "indic": "hi bn ur pa gu mr ne",
    "turkic": "tr az kk uz tk",
    "celtic": "ga cy br gd",
    "baltic": "lt lv",
}
_FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs.split()}
BITS = 13
_SALTS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def family(lang: str) -> str:
    """A language's family; one that isn't listed is its own."""
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of the 2-, 3- and 4-grams at each place (fewer at the end)."""
    b = _FOLD[data].astype(np.uint32)
    out, g = [], b
    for k, salt in zip((1, 2, 3), _SALTS, strict=True):
        g = g[:-1] | (b[k:] << np.uint32(8 * k)) if len(g) > 1 else g[:0]
        out.append(((g * salt) >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def shares(texts: list[str]) -> np.ndarray:
    """The feature matrix of texts: root shares aren't needed, as shares keep scoring linear."""
    out = np.zeros((len(texts), 3 << BITS), np.float32)
    for i, text in enumerate(texts):
        data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
        for k, g in enumerate(grams(data)):
            out[i, k << BITS : (k + 1) << BITS] = np.bincount(g, minlength=1 << BITS) / max(1, len(g))
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradients; y is +-1."""
    n = len(x)
    balance = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    # the largest curvature, by a few power steps
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):
        v = x.T @ (balance * (x @ v))
        v /= max(1e-9, float(np.linalg.norm(v)))
    lips = 2 * c / n * (float(np.linalg.norm(np.sqrt(balance) * (x @ v))) ** 2 + n) + 1
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ pw + pb)) * balance * y
        nw = pw - (pw - 2 * c / n * (x.T @ gap)) / lips
        nb = pb + 2 * c / n * float(gap.sum()) / lips
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


class Model:
    """machines: (level, positive, negative) with a weight column each; level is None or a family."""

    def __init__(self, langs: list[str]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.families.setdefault(family(lang), []).append(lang)
        self.machines = [(None, a, b) for a, b in itertools.combinations(sorted(self.families), 2)]
        self.machines += [(f, a, b) for f, own in sorted(self.families.items()) for a, b in itertools.combinations(own, 2)]
        self.weights = np.zeros((3 << BITS, len(self.machines)), np.float32)
        self.bias = np.zeros(len(self.machines), np.float32)
        self.scale = np.ones(len(self.machines), np.float32)

    @classmethod
    def train(cls, texts: list[str], langs: list[str]) -> Model:
        model = cls(sorted(set(langs)))
        if not model.machines:
            return model
        x = shares(texts)
        spread = x.std(0) + 3e-4  # rare n-grams count for more, but not without bound
        x /= spread
        x *= 1 / np.sqrt(x.shape[1])
        of, fam = np.array(langs), np.array([family(v) for v in langs])
        for k, (level, a, b) in enumerate(model.machines):
            own = fam if level is None else of
            rows = np.flatnonzero((own == a) | (own == b))
            xs, y = x[rows], np.where(own[rows] == a, 1.0, -1.0).astype(np.float32)
            w, bias = fit_svm(xs, y)
            model.scale[k] = 4 / max(1e-6, float(np.median(np.abs(xs @ w + bias))))
            model.weights[:, k], model.bias[k] = w / spread / np.sqrt(x.shape[1]), bias
        return model

    def decide(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) for machine values of texts (texts x machines)."""
        n, sure = len(values), np.ones(len(values))
        margin = (values + self.bias) * self.scale

        def vote(level: str | None, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
            votes, sums = np.zeros((n, len(names))), np.zeros((n, len(names)))
            for k, (at, a, b) in enumerate(self.machines):
                if at == level:
                    i, j, m = names.index(a), names.index(b), margin[:, k]
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    sums[:, i] += np.tanh(m)
                    sums[:, j] -= np.tanh(m)
            best = (votes + sums / (2 * len(names) + 1)).argmax(1)
            least = np.full(n, np.inf)
            for k, (at, a, b) in enumerate(self.machines):
                if at == level:
                    m = margin[:, k]
                    least = np.where(best == names.index(a), np.minimum(least, m), np.where(best == names.index(b), np.minimum(least, -m), least))
            return best, 1 / (1 + np.exp(-np.clip(least, -30, 30)))

        families = sorted(self.families)
        top, p = vote(None, families) if len(families) > 1 else (np.zeros(n, int), np.ones(n))
        sure *= p
        out = np.empty(n, object)
        for i, f in enumerate(families):
            own, rows = self.families[f], top == i
            best, p = vote(f, own) if len(own) > 1 else (np.zeros(n, int), np.ones(n))
            out[rows] = np.array(own, object)[best[rows]]
            sure[rows] *= p[rows]
        return out, sure


def training_sample(docs: DataFrame, per_lang: int, longest: int) -> tuple[list[str], list[str]]:
    """Texts and languages of a bounded sample of rows with both."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.length("text").between(1, longest))
    # only ids are moved; the texts of the chosen ones, of which there are at most per_lang a language, are read again
    chosen = [(r["lang"], r["doc_id"], r["h"]) for r in smallest_hashes(rows.where(F.col("doc_id").isNotNull()), "lang", per_lang)]
    names = F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, doc_id long, h long"))
    texts = rows.join(names, ["lang", "doc_id"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    got = sorted((r["lang"], r["h"], r["text"]) for r in texts.collect())
    got = [g for g in got if any(map(str.isalpha, g[2]))]
    return [g[2] for g in got], [g[0] for g in got]


def train_language(docs: DataFrame, train: Column, per_lang: int = 300, longest: int = 20_000) -> Model:
    return Model.train(*training_sample(docs.where(train), per_lang, longest))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    tune(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            texts = batch.column(1).to_pylist()
            known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool) & bool(model.families)
            low = [f" {t.lower()} ".encode("utf-8", "replace") if k else b"" for t, k in zip(texts, known, strict=True)]
            at = np.cumsum([0, *map(len, low)])
            data = np.frombuffer(b"".join(low), np.uint8)
            rows = np.flatnonzero(known)
            values = np.zeros((len(texts), len(model.machines)), np.float64)
            if len(rows) and model.machines:
                for k, g in enumerate(grams(data)):
                    # n-grams that reach into the next text are dropped by its sum's end
                    ends, starts = np.minimum(at[rows + 1] - k - 1, len(g)), at[rows]
                    for j in range(len(model.machines)):
                        total = np.concatenate([[0.0], np.cumsum(model.weights[k << BITS : (k + 1) << BITS, j][g], dtype=np.float64)])
                        values[rows, j] += (total[ends] - total[np.minimum(starts, ends)]) / np.maximum(1, ends - starts)
            langs, score = model.decide(values) if model.families else (np.full(len(texts), "und", object), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(known, langs, "und").tolist(), pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
