"""Language ID by hierarchical discrimination.

One linear support vector machine per family (one against the rest) picks the family; within a family, one-versus-one
machines vote between its languages. Features are hashed character n-grams (1 to 3) of the lower-cased letters of the
whole text. Training uses at most ``MAX_TRAIN`` texts per language, those of smallest hash.

Texts that are null or hold no letter are ``und`` with score 0. Without training rows every text is ``und``. Languages
outside the family table are families of their own. Very long texts are read whole; equal texts get equal languages, and ties
of votes go to the greater margin. Own columns named ``lang_pred`` or ``score`` are replaced.
"""

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, quoted, sample, small_batches, unboxed

MAX_TRAIN, BUCKETS, SEED = 600, 1 << 13, 7
# Language families by language code.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "mr", "bn", "gu", "pa"],
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_GAP = re.compile(r"[\W\d_]+")


def features(text: str) -> np.ndarray | None:
    """Unit vector of square-rooted n-gram counts, or None without letters."""
    s = _GAP.sub(" ", f" {text.lower()} ")
    if not any(map(str.isalpha, s)):
        return None
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    grams = [c * np.uint64(0x9E3779B1), (c[:-1] * np.uint64(0x85EBCA77) + c[1:]) * np.uint64(0xC2B2AE3D)]
    if len(c) > 2:
        grams.append(((c[:-2] * np.uint64(0x27D4EB2F) + c[1:-1]) * np.uint64(0x165667B1) + c[2:]) * np.uint64(0x9E3779B1))
    slot = (np.concatenate(grams) & np.uint64(0xFFFFFFFF)) >> np.uint64(19)
    v = np.sqrt(np.bincount(slot.astype(np.int64), minlength=BUCKETS))
    return (v / np.linalg.norm(v)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, epochs: int = 12, reg: float = 1e-4) -> np.ndarray:
    """Weights (bias last) of a linear SVM by mini-batch sub-gradient steps; classes weigh the same. ``y`` is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    rng, w, t = np.random.default_rng(SEED), np.zeros(x.shape[1]), 0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 32):
            i, t = order[at : at + 32], t + 1
            miss = i[y[i] * (x[i] @ w) < 1]
            w *= 1 - 1 / (t + 100)
            if len(miss):
                w += (weight[miss] * y[miss]) @ x[miss] / (reg * (t + 100) * 32 * 100)
    return w.astype(np.float32)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most: int = MAX_TRAIN):
    """The model, or None without usable rows; rows with null text or language are left out."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = sorted(r[0] for r in rows.select(lang).distinct().collect())
    x, y = [], []
    for code in known:
        for t in sample(rows.where(F.col(lang) == code), text, doc_id, most):
            if (v := features(t)) is not None:
                x.append(v)
                y.append(code)
    if not x:
        return None
    x, y = np.array(x), np.array(y)
    members = {}
    for code in sorted(set(y.tolist())):
        members.setdefault(FAMILY.get(code, code), []).append(code)
    family = np.array([FAMILY.get(c, c) for c in y.tolist()])
    top = [(f, svm(x, np.where(family == f, 1.0, -1.0))) for f in members] if len(members) > 1 else []
    inner = {f: [(a, b, svm(x[m], np.where(y[m] == a, 1.0, -1.0))) for a, b in combinations(codes, 2) for m in [(y == a) | (y == b)]] for f, codes in members.items()}
    return members, top, inner


def classify(v: np.ndarray, model) -> tuple[str, float]:
    members, top, inner = model
    at = lambda w: float(v @ w[:-1] + w[-1])
    sure = lambda m: 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
    family, p = next(iter(members)), 1.0
    if top:
        best, family = max((at(w), f) for f, w in top)
        p = sure(best)
    won, margin = dict.fromkeys(members[family], 0), dict.fromkeys(members[family], 0.0)
    for a, b, w in inner[family]:
        m = at(w)
        won[a if m >= 0 else b] += 1
        margin[a] += m
        margin[b] -= m
    lang = max(members[family], key=lambda c: (won[c], margin[c]))
    return lang, float(p * (sure(margin[lang]) if inner[family] else 1.0))


def identify(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            out = []
            for t in s:
                v = features(t) if t and model else None
                out.append(("und", 0.0) if v is None else classify(v, model))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    done = docs.select(boxed(docs), run(F.col(quoted(text))).alias("_p"))
    return done.select(*unboxed(docs.columns, ("lang_pred", F.col("_p.lang_pred")), ("score", F.col("_p.score"))))
