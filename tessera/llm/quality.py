"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Indicators of byte n-grams (1 to 3) and of word-shape n-grams are scaled by the log ratio of their counts in the two
classes; a linear model with hinge loss is then fitted by dual coordinate descent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, text_or_empty
from .labelled import fit_in_task, labelled_sample

HASH_BITS = 18
_PAIRS, _TRIPLES = 256, 256 + 65536
_SHAPES = _TRIPLES + (1 << HASH_BITS)
WIDTH = _SHAPES + (1 << 16)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Kinds of bytes: 0 other symbols, 1 lower case and bytes beyond ASCII, 2 upper case, 3 digits, 4 marks that end words.
_KIND = np.zeros(256, np.int64)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[128:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[ord(c) for c in ".,;:?"]] = 4
_MIX = np.random.default_rng(11).integers(0, 1 << 62, 256, dtype=np.int64)


def _hashed(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - bits)


def grams(text: str | None) -> np.ndarray:
    """Indices of the n-grams of a whole text, repeats included."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    if not len(b):
        return np.empty(0, np.int64)
    pairs = b[:-1] * 256 + b[1:]
    out = [b, _PAIRS + pairs, _TRIPLES + _hashed(pairs[:-1] * 256 + b[2:], HASH_BITS)]
    space = np.concatenate([[True], _SPACE[b], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    if len(starts):
        sums = np.concatenate([[0], np.cumsum(_MIX[b])])
        own, size = sums[ends] - sums[starts], ends - starts
        same = np.append(False, (own[1:] == own[:-1]) & (size[1:] == size[:-1]))
        shape = ((_KIND[b[starts]] * 5 + _KIND[b[ends - 1]]) * 6 + np.minimum(np.log2(size).astype(np.int64), 5)) * 2 + same + 1
        two = shape[:-1] * 400 + shape[1:]
        run = same[:-2] & same[1:-1] & same[2:]
        out += [_SHAPES + _hashed(x, 16) for x in (shape, two, two[:-1] * 400 + shape[2:], run.astype(np.int64) + 7_000_000_000)]
    return np.concatenate(out)


class Distinct:
    """Distinct members of small-range arrays without sorting or clearing."""

    def __init__(self):
        self.seen = np.zeros(WIDTH, np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.arange(len(x))
        self.seen[x] = at
        return x[self.seen[x] == at]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts) -> np.ndarray:
        distinct, margins = Distinct(), []
        for t in texts:
            own = distinct(grams(t))
            margins.append(self.weights[own].sum(dtype=float) / np.sqrt(max(len(own), 1)) + self.bias)
        return 1 / (1 + np.exp(-np.clip(2 * np.array(margins, float), -60, 60)))


def fit(y: np.ndarray, rows: list[list[np.ndarray]], c: float = 1.0, epochs: int = 12, seed: int = 5) -> Model:
    """Dual coordinate descent for the hinge loss on scaled indicators. Without both classes the bias alone speaks."""
    feats = [r[0] for r in rows]
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(WIDTH, np.float32), 0.0 if len(y) == 0 else float(2 * y[0] - 1))
    p, q = (1.0 + np.bincount(np.concatenate([f for f, v in zip(feats, y) if v == k]), minlength=WIDTH) for k in (1, 0))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(p == 1) & (q == 1)] = 0
    sign = np.where(y == 1, 1.0, -1.0)
    cost = c * len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum()))  # both classes weigh the same
    values = [ratio[f] / np.sqrt(max(len(f), 1)) for f in feats]
    norm = np.array([v @ v for v in values]) + 1
    w, bias, alpha, rng = np.zeros(WIDTH), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, v = feats[i], values[i]
            g = sign[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if step := (new - alpha[i]) * sign[i]:
                w[f] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return Model((w * ratio).astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000, folds: int = 3, fold: int = 1) -> Model:
    """Fitted on at most `rows` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", folds, fold, rows)
    return fit_in_task(sample, lambda t: [np.unique(grams(t))], fit)


def classify(docs: DataFrame, labels: DataFrame, rows: int = 6000, folds: int = 3, fold: int = 1, threshold: float = 0.5) -> DataFrame:
    """docs with score (0 to 1, higher is better) and predicted; only whole texts enter a score.

    Null and empty texts get the score of a text without n-grams. No documents give no rows; without labels every
    score is 0.5. Columns of docs named score or predicted are replaced.
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
    return classify(docs.select("doc_id", "text"), labels).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier accepts; columns as they were, whatever their names. Repeated rows stay or go together; see
    report() for other edges."""
    own = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    return classify(own, labels).where("predicted = 1").select("__row.*")
