"""Deterministic stand-ins for models, and how real ones are plugged in.

A model is a Python callable on lists; `as_udf` makes a pandas UDF of it that is built once a worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def hash_embedder(dims: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Unit vectors of signed hashed words."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dims] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).tolist()

    return embed


def _words(t: str | None) -> set[str]:
    return set(re.findall(r"\w+", (t or "").lower()))


def lexical_scorer(queries: list[str], texts: list[str]) -> list[float]:
    """The share of a query's words that a text holds."""
    return [len(_words(q) & _words(t)) / max(1, len(_words(q))) for q, t in zip(queries, texts, strict=True)]


def lexical_entailment(premises: list[str], hypotheses: list[str]) -> list[tuple[float, float]]:
    """(entailment, contradiction): word containment; a negation on one side alone turns it over."""
    out = []
    for p, h in zip(premises, hypotheses, strict=True):
        a, b = _words(p), _words(h)
        share = len(a & b) / max(1, len(b))
        turned = bool(a & {"not", "no", "never"}) != bool(b & {"not", "no", "never"})
        out.append((0.0, share) if turned else (share, 0.0))
    return out


def embedder_udf(embed: Callable | None = None, prefix: str = ""):
    embed = embed or hash_embedder()

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(embed([prefix + (x or "") for x in s]))

    return F.pandas_udf(run, "array<float>")


def scorer_udf(score: Callable = lexical_scorer):
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(score(q.tolist(), t.tolist()), dtype=float)

    return F.pandas_udf(run, "double")


def nli_udf(score: Callable = lexical_entailment):
    """struct(e, c) of premise and hypothesis."""

    def run(p: pd.Series, h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(score(p.tolist(), h.tolist()), columns=["e", "c"])

    return F.pandas_udf(run, "e double, c double")


def prefixes(model: str) -> tuple[str, str]:
    """What a model family wants before queries and passages."""
    low = model.lower()
    if "e5" in low:
        return "query: ", "passage: "
    return ("Represent this sentence for searching relevant passages: ", "") if "bge" in low and "-en" in low else ("", "")


def model_id(model: str, glyphs_mapped: bool) -> str:
    return model + ("+cmlnorm2" if glyphs_mapped else "")


def english_only(model: str) -> bool:
    """Whether the model's name says that it knows English only."""
    low = model.lower()
    return not any(x in low for x in ("multilingual", "m3", "multi")) and (low.endswith("-en") or "-en-" in low or "minilm" in low)
