"""Toxicity: a counterfactual-regularised classifier.

Logistic regression over word and word-beginning indicators. For every labelled text a counterfactual is made by
swapping its identity terms for others of the same language (or, if it names none, by adding one), and the squared
change of the score between a text and its counterfactual is part of the loss. A neutral mention of a group then
moves the score as little as the labels allow. Terms are listed for four languages.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, text_or_empty
from .labelled import fit_in_task, labelled_sample

#: Names of groups, by language; each is swapped for others of its language.
IDENTITY = {
    "en": (
        "women", "men", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "latino", "african", "european",
        "muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "buddhist", "atheist", "immigrants", "refugees",
        "deaf", "blind", "disabled", "elderly", "young",
    ),
    "de": (
        "frauen", "männer", "schwule", "lesben", "schwarze", "weiße", "asiaten", "afrikaner", "europäer", "muslime", "christen", "juden",
        "hindus", "buddhisten", "atheisten", "einwanderer", "flüchtlinge", "gehörlose", "blinde", "behinderte", "senioren", "jugendliche",
    ),
    "fr": (
        "femmes", "hommes", "homosexuels", "lesbiennes", "noirs", "blancs", "asiatiques", "africains", "européens", "musulmans", "chrétiens",
        "juifs", "hindous", "bouddhistes", "athées", "immigrés", "réfugiés", "sourds", "aveugles", "handicapés", "retraités", "jeunes",
    ),
    "es": (
        "mujeres", "hombres", "homosexuales", "lesbianas", "negros", "blancos", "asiáticos", "africanos", "europeos", "musulmanes", "cristianos",
        "judíos", "hindúes", "budistas", "ateos", "inmigrantes", "refugiados", "sordos", "ciegos", "discapacitados", "ancianos", "jóvenes",
    ),
}
_TERMS = tuple(tuple(t.encode() for t in own) for own in IDENTITY.values())
_PLACE = {t: (k, i) for k, own in enumerate(_TERMS) for i, t in enumerate(own)}
_MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
WIDTH = 1 << 24
CACHE = 300_000


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").lower().split())


@lru_cache(200_000)
def word_features(word: bytes) -> frozenset[int]:
    """Hashes of a word without the marks around it, and of its beginnings of 4 to 6 bytes."""
    w = word.strip(_MARKS)
    if not w:
        return frozenset()
    parts = [b"=" + w, *(b"^" + w[:n] for n in (4, 5, 6) if len(w) >= n)]
    return frozenset(xxhash.xxh32_intdigest(x) % WIDTH for x in parts)


def features(own: set[bytes]) -> np.ndarray:
    out: set[int] = set()
    for w in own:
        out |= word_features(w)
    return np.array(sorted(out), np.int64)


def counterfactual(own: set[bytes], turn: int) -> set[bytes]:
    """own with each identity term swapped for the one `turn` places on in its language; a text that names none gains one,
    of a language that `turn` draws."""
    bare = {w: w.strip(_MARKS) for w in own}
    if not any(b in _PLACE for b in bare.values()):
        terms = _TERMS[turn % len(_TERMS)]
        return own | {terms[turn // len(_TERMS) % len(terms)]}

    def swapped(word: bytes) -> bytes:
        language, place = _PLACE[word]
        terms = _TERMS[language]
        return terms[(place + 1 + turn % (len(terms) - 1)) % len(terms)]

    return {swapped(b) if b in _PLACE else w for w, b in bare.items()}


def pair(text: str | None) -> list[np.ndarray]:
    own = words(text)
    return [features(own), features(counterfactual(own, xxhash.xxh32_intdigest((text or "").encode("utf-8", "surrogatepass"))))]


@dataclass
class Model:
    """Weights by feature hash; a text's score adds those of its distinct features."""

    at: np.ndarray
    weights: np.ndarray
    bias: float
    cache: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.by_hash = dict(zip(self.at.tolist(), self.weights.tolist()))

    def __getstate__(self):
        return {"at": self.at, "weights": self.weights, "bias": self.bias}

    def __setstate__(self, state):
        self.__init__(**state)

    def score(self, texts) -> np.ndarray:
        cache, known, out = self.cache, self.by_hash, []
        for t in texts:
            own = words(t)
            if new := [w for w in own if w not in cache]:
                if len(cache) + len(new) > CACHE:
                    cache.clear()
                    new = list(own)
                for w in new:
                    cache[w] = frozenset(f for f in word_features.__wrapped__(w) if f in known)
            found = frozenset().union(*map(cache.__getitem__, own))
            out.append(self.bias + sum(known[f] for f in sorted(found)))
        return 1 / (1 + np.exp(-np.clip(np.array(out, float), -60, 60)))


def fit(y: np.ndarray, rows: list[list[np.ndarray]], strength: float = 2.0, decay: float = 0.3, least: float = 30.0, most: int = 8192, steps: int = 600, clean: float = 0.02) -> Model:
    """Features: the `most` of highest G2 above `least`, and those of identity terms. strength: of the counterfactual penalty.
    clean: score of a text without features; it is fixed, so that one telling word can decide a short text.

    Without both classes the score is that of the share of toxic rows (0.01 without rows), for every text.
    """
    n, share = len(y), (y.mean() if len(y) else 0.0)
    empty = np.empty(0, np.int64)
    base = lambda s: float(np.log(s / (1 - s)))
    if n == 0 or share in (0.0, 1.0):
        return Model(empty, np.empty(0), base(min(max(share, 0.01), 0.99)))
    a, flat = np.repeat(np.arange(n), [len(r[0]) for r in rows]), np.concatenate([r[0] for r in rows])
    ids, at = np.unique(flat, return_inverse=True)
    df, hit = np.bincount(at, minlength=len(ids)).astype(float), np.bincount(at, weights=y[a], minlength=len(ids))
    n1, g2 = float(y.sum()), np.zeros(len(ids))
    for seen, expected in ((hit, df * n1 / n), (df - hit, df * (n - n1) / n), (n1 - hit, (n - df) * n1 / n), (n - n1 - df + hit, (n - df) * (n - n1) / n)):
        g2 += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    order = np.argsort(-g2, kind="stable")[:most]
    chosen = np.union1d(ids[order[g2[order] >= least]], features(set(_PLACE)))

    def placed(k: int) -> tuple[np.ndarray, np.ndarray]:
        row, x = np.repeat(np.arange(n), [len(r[k]) for r in rows]), np.concatenate([r[k] for r in rows])
        f = np.minimum(np.searchsorted(chosen, x), len(chosen) - 1)
        ok = chosen[f] == x
        return row[ok], f[ok]

    (r0, f0), (r1, f1) = placed(0), placed(1)
    w, bias = np.zeros(len(chosen)), base(clean)
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigma = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for t in range(1, steps + 1):
        s0 = sigma(np.bincount(r0, weights=w[f0], minlength=n) + bias)
        s1 = sigma(np.bincount(r1, weights=w[f1], minlength=n) + bias)
        d = 2 * strength * (s0 - s1)
        g0, g1 = (s0 - y + d * s0 * (1 - s0)) / n, -d * s1 * (1 - s1) / n
        g = np.bincount(f0, weights=g0[r0], minlength=len(chosen)) + np.bincount(f1, weights=g1[r1], minlength=len(chosen)) + decay / n * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model(chosen, w, bias)


def train(docs: DataFrame, labels: DataFrame, rows: int = 12000, folds: int = 4, fold: int = 2) -> Model:
    """Fitted on at most `rows` labelled documents outside the held-out fold."""
    return fit_in_task(labelled_sample(docs, labels, "toxic", folds, fold, rows), pair, fit)


def classify(docs: DataFrame, labels: DataFrame, rows: int = 12000, folds: int = 4, fold: int = 2, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1, higher is likelier toxic) and predicted; only whole texts enter a score.

    Null and empty texts get the score of a text without words. No documents give no rows; without labels every score
    is 0.01. Columns of docs named score or predicted are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows, folds, fold))

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(texts))

    return docs.withColumn("score", score(text_or_empty("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. Null texts are empty; repeated rows are each scored, alike; rows
    without an id are held out; ties of features and of drawn rows are broken by hash. No rows give no rows; other
    columns of docs and labels are ignored. Without labels, or with one kind of them, all texts have one score."""
    return classify(docs.select("doc_id", "text"), labels).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
