"""LM scoring with Brown class-based bigrams.

Words are counted over all training documents. Frequent words are put in classes by exchange clustering: the most
frequent ones on their bigram counts with each other, then all others on theirs with those. The class of any rarer word
follows from its last characters, by the classes of the frequent words that end alike. A text's probability is the
product of smoothed class transitions and of word emissions within classes.
"""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, save, small_batches, text_or_empty

FREQUENT, CLUSTERED, CLASSES = 30_000, 1200, 48
FLUSH = 150_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, n) over all texts; tasks add up what they read before it is shuffled, in bounded tables."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for frame in frames:
            for t in frame["text"]:
                counts.update(tokens(t))
                if len(counts) > FLUSH:
                    yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                    counts.clear()
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    return texts.mapInPandas(task, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def gains(base: np.ndarray, out: np.ndarray, into: np.ndarray, own: float = 0.0) -> np.ndarray:
    """What a word adds to the likelihood of the class bigrams `base` in each class.

    out, into: its counts with the classes after it and before it, without those with itself, own. In class d, row d
    gains out, column d gains into, the corner both.
    """
    plain, rows, cols, corner = _xlogx(base), base.sum(1), base.sum(0), np.diag(base)
    gain = (_xlogx(base + out[None, :]) - plain).sum(1) + (_xlogx(base + into[:, None]) - plain).sum(0)
    gain += _xlogx(corner + out + into + own) - _xlogx(corner + out) - _xlogx(corner + into) + _xlogx(corner)
    return gain - (_xlogx(rows + out.sum() + own) - _xlogx(rows) + _xlogx(cols + into.sum() + own) - _xlogx(cols))


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 8) -> np.ndarray:
    """Exchange clustering: each word in turn moves to the class that most raises the likelihood of the class bigrams.

    bigrams: counts by (word, next word). Starts from words dealt round by frequency, as in the order given; ends when
    a round moves none, or after `rounds`.
    """
    n = len(bigrams)
    k = max(1, min(classes, n))
    of = np.arange(n) % k
    b = bigrams.astype(float)
    one = np.zeros((n, k))
    one[np.arange(n), of] = 1
    left, right = b.T @ one, b @ one  # of each word: counts with the classes before it and after it
    pairs = one.T @ right
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            c, own = of[w], b[w, w]
            # without w
            out, into = right[w].copy(), left[w].copy()
            out[c] -= own
            into[c] -= own
            base = pairs.copy()
            base[c] -= out
            base[:, c] -= into
            base[c, c] -= own
            gain = gains(base, out, into, own)
            d = int(np.argmax(gain))
            if gain[d] <= gain[c] + 1e-9:
                d = c
            if d != c:
                moved += 1
                of[w] = d
                base[d] += out
                base[:, d] += into
                base[d, d] += own
                pairs = base
                left[:, c] -= b[w]
                left[:, d] += b[w]
                right[:, c] -= b[:, w]
                right[:, d] += b[:, w]
        if not moved:
            break
    return of


def exchange_rest(pairs: np.ndarray, after: np.ndarray, before: np.ndarray, of: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Exchange clustering of further words among classes that hold clustered ones: each word in turn moves to the class
    that most raises the likelihood of the class bigrams in which one of the two words is a clustered one.

    pairs: counts of class bigrams of the clustered words; after, before: each further word's counts with the classes of
    the clustered words after and before it; of: the classes to start from.
    """
    of, pairs = of.copy(), pairs.astype(float)
    np.add.at(pairs, of, after)
    np.add.at(pairs.T, of, before)
    for _ in range(rounds):
        moved = 0
        for w in range(len(of)):
            c, out, into = of[w], after[w], before[w]
            pairs[c] -= out
            pairs[:, c] -= into
            gain = gains(pairs, out, into)
            d = int(np.argmax(gain))
            if gain[d] > gain[c] + 1e-9:
                of[w], c, moved = d, d, moved + 1
            pairs[c] += out
            pairs[:, c] += into
        if not moved:
            break
    return of


@dataclass
class Classes:
    """Class of any word; class `end` is that of the end token, and the last one that of words with unknown endings."""

    frequent: dict[bytes, int]
    endings: dict[bytes, int]
    end: int
    cache: dict = field(default_factory=dict, repr=False)

    @property
    def count(self) -> int:
        return self.end + 2

    def of(self, word: bytes) -> int:
        if (c := self.frequent.get(word)) is not None:
            return c
        for n in (4, 3, 2, 1):
            if (c := self.endings.get(word[-n:])) is not None and len(word) >= n:
                return c
        return self.end + 1

    def __getstate__(self):
        return {"frequent": self.frequent, "endings": self.endings, "end": self.end}

    def __setstate__(self, state):
        self.__init__(**state)

    def all(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        if len(cache) > 200_000:
            cache.clear()
        got = list(map(cache.get, words))
        if None in got:
            for i, c in enumerate(got):
                if c is None:
                    got[i] = cache[words[i]] = self.of(words[i])
        return np.array(got, np.int64)


def cluster(texts: DataFrame, top: list[tuple[bytes, int]], clustered: int, classes: int) -> Classes:
    """Classes from the bigrams of the `clustered` most frequent words over all texts. Bounded by clustered squared counts."""
    head = [w for w, _ in top[:clustered]]
    m = len(head)
    follow = texts.sparkSession.sparkContext.broadcast({w: i for i, (w, _) in enumerate(top)})

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, seen = follow.value, {}
        for frame in frames:
            for t in frame["text"]:
                at = np.array([place.get(w, -1) for w in tokens(t)], np.int64)
                if len(at) < 2:
                    continue
                a, b = at[:-1], at[1:]
                ok = (a >= 0) & (b >= 0) & ((a < m) | (b < m))
                seen.setdefault("k", []).append(a[ok] * (1 << 32) + b[ok])
                seen["n"] = seen.get("n", 0) + int(ok.sum())
                if seen["n"] > 4_000_000:
                    yield _counted(seen)
                    seen = {}
        if seen.get("k"):
            yield _counted(seen)

    n = len(top)
    counts = texts.mapInPandas(task, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = save(counts, "lm-bigrams")
    k = max(1, min(classes, m))

    def exchanged(frame: pd.DataFrame) -> pd.DataFrame:
        pair, square = frame["pair"].to_numpy(np.int64), np.zeros((m, m))
        square[pair >> 32, pair & 0xFFFFFFFF] = frame["n"].to_numpy(float)
        of = exchange(square, classes)
        one = np.zeros((m, k))
        one[np.arange(m), of] = 1
        return pd.DataFrame({"made": [pickle.dumps((of, one.T @ square @ one))]})

    # at most clustered squared counts, in one task; its few bytes come to the driver
    inner = counts.where(f"pair >> 32 < {m} and pair & 4294967295 < {m}").groupBy(F.lit(1).alias("all")).applyInPandas(exchanged, "made binary").collect()
    of, pairs = pickle.loads(inner[0]["made"]) if inner else (np.arange(m) % k, np.zeros((k, k)))
    frequent = {w: int(c) for w, c in zip(head, of.tolist())}
    if n > m:
        # the other frequent words by their counts with the classes of these, summed per (word, class)
        label = F.broadcast(texts.sparkSession.createDataFrame(pd.DataFrame({"i": np.arange(m), "c": of}), "i long, c int"))
        a, b = F.shiftright("pair", 32), F.col("pair").bitwiseAND(0xFFFFFFFF)
        after = counts.where((a >= m) & (b < m)).select(a.alias("w"), b.alias("i"), "n").join(label, "i").groupBy("w", "c").agg(F.sum("n").alias("n")).withColumn("s", F.lit(0))
        before = counts.where((a < m) & (b >= m)).select(b.alias("w"), a.alias("i"), "n").join(label, "i").groupBy("w", "c").agg(F.sum("n").alias("n")).withColumn("s", F.lit(1))

        def placed(frame: pd.DataFrame) -> pd.DataFrame:
            sides = np.zeros((2, n - m, k))
            sides[frame["s"].to_numpy(np.int64), frame["w"].to_numpy(np.int64) - m, frame["c"].to_numpy(np.int64)] = frame["n"]
            seen = np.flatnonzero(sides.sum((0, 2)) > 0)
            own = pairs + 0.1
            # log odds of a neighbour's class given this word's class, against its overall share: where the exchange starts
            lift = np.log(own * own.sum() / (own.sum(1, keepdims=True) * own.sum(0, keepdims=True)))
            score = sides[0, seen] @ lift.T + sides[1, seen] @ lift
            score[:, np.bincount(of, minlength=k) == 0] = -np.inf
            best = exchange_rest(pairs, sides[0, seen], sides[1, seen], score.argmax(1))
            return pd.DataFrame({"made": [pickle.dumps((seen + m, best))]})

        # at most 2 x frequent x classes counts, in one task
        if near := after.union(before).groupBy(F.lit(1).alias("all")).applyInPandas(placed, "made binary").collect():
            seen, best = pickle.loads(near[0]["made"])
            frequent |= {top[i][0]: int(c) for i, c in zip(seen.tolist(), best.tolist())}
    votes: dict[bytes, np.ndarray] = {}
    weight = dict(top)
    for w, c in frequent.items():
        for e in range(1, 5):
            if len(w) >= e:
                votes.setdefault(w[-e:], np.zeros(k))[c] += np.log1p(weight[w])
    endings = {e: int(v.argmax()) for e, v in votes.items()}
    # words beyond the frequent ones get classes of their own, beside those of the words they end like
    return Classes(frequent, {e: k + c for e, c in endings.items()}, 2 * k)


def _counted(seen: dict) -> pd.DataFrame:
    pair, n = np.unique(np.concatenate(seen["k"]), return_counts=True)
    return pd.DataFrame({"pair": pair, "n": n})


@dataclass
class Model:
    classes: Classes
    known: dict[bytes, int]  # counts of the frequent words; of others they come by a join
    transition: np.ndarray  # log10 of P(next class | class)
    emission: np.ndarray  # of each class: log10 of the denominator of P(word | class)
    total: int
    distinct: int
    documents: int


def transitions(texts: DataFrame, classes: Classes) -> np.ndarray:
    """Counts of class pairs over all texts, each text between two ends."""
    shared = texts.sparkSession.sparkContext.broadcast(classes)
    k, end = classes.count, classes.end

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, counts = shared.value, np.zeros(k * k, np.int64)
        for frame in frames:
            for t in frame["text"]:
                c = np.concatenate([[end], own.all(tokens(t)), [end]])
                counts += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"at": at, "n": counts[at]})

    rows = texts.mapInPandas(task, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most k squared
    out = np.zeros(k * k)
    out[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out.reshape(k, k)


def train(texts: DataFrame, frequent: int = FREQUENT, clustered: int = CLUSTERED, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model, and the table (word, n) of all training words in the shared folder."""
    words = save(count_words(texts), "lm-words")
    # all words above the count from which on they would be too many, and a draw by hash of those of that count
    uses = words.groupBy("n").agg(F.count("*").alias("words")).withColumn("reach", F.sum("words").over(Window.orderBy(F.desc("n"))))
    edge = uses.where(F.col("reach") > frequent).agg(F.max(F.struct("n", "reach", "words"))).first()[0]  # there are few different counts
    chosen = words
    if edge is not None:
        share = (frequent - (edge["reach"] - edge["words"])) / edge["words"]
        unit = F.xxhash64("word").cast("double") / F.lit(2.0**64) + 0.5
        chosen = words.where((F.col("n") > edge["n"]) | ((F.col("n") == edge["n"]) & (unit < share)))
    top = sorted(((bytes(r["word"]), r["n"]) for r in chosen.collect()), key=lambda x: (-x[1], x[0]))
    documents = texts.count()
    own = cluster(texts, top, clustered, classes)
    shared, k = texts.sparkSession.sparkContext.broadcast(own), own.count

    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, v = np.zeros(k), np.zeros(k)
        for frame in frames:
            c = shared.value.all([bytes(w) for w in frame["word"]])
            n += np.bincount(c, weights=frame["n"].to_numpy(float), minlength=k)
            v += np.bincount(c, minlength=k)
        yield pd.DataFrame({"c": np.arange(k), "n": n.astype(np.int64), "v": v.astype(np.int64)})

    sums = words.mapInPandas(sizes, "c int, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas().set_index("c").reindex(range(k), fill_value=0)
    n, v = sums["n"].to_numpy(float), sums["v"].to_numpy(float)
    pairs = transitions(texts, own)
    overall = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * k)
    strength = 5.0  # counts that the overall shares of the classes stand for
    move = (pairs + strength * overall[None, :]) / (pairs.sum(1, keepdims=True) + strength)
    emission = np.log10(n + 0.5 * (v + 1))
    emission[own.end] = 0.0
    ends = documents
    total, distinct = int(n.sum()) + ends, int(v.sum()) + (1 if ends else 0)
    return Model(own, dict(top), np.log10(move), emission, total, distinct, ends), words


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """One row per row of docs, in the columns that report() names.

    Frequent words are looked up in a broadcast table of bounded size; the others of a text, each with its number of
    uses, meet their counts in a join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        known = {w: np.log10(n + 0.5) for w, n in m.known.items()}
        end, base_end, low = m.classes.end, np.log10(m.documents + 0.5), np.log10(m.total + 0.5 * (m.distinct + 1))
        for frame in frames:
            rows = []
            for row, doc, t in zip(frame["row"], frame["doc_id"], frame["text"]):
                own = tokens(t)
                c = np.concatenate([[end], m.classes.all(own), [end]]) if own else np.array([end, end])
                found = list(map(known.get, own))
                rare = Counter([w for w, p in zip(own, found) if p is None])
                hits, plain = len(own) - sum(rare.values()) + int(m.documents > 0), base_end + sum(filter(None, found))
                moves = float(m.transition[c[:-1], c[1:]].sum() - m.emission[c[1:]].sum())
                rows.append((row, doc, len(own) + 1, hits, plain, -low * (len(own) + 1), moves - base_end, list(rare), list(rare.values())))
            yield pd.DataFrame(rows, columns=["row", "doc_id", "n_tokens", "hits", "plain", "less", "moves", "words", "uses"]).astype({"doc_id": "Int64"})

    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty("text").alias("text"))
    told = save(own.mapInPandas(task, "row long, doc_id long, n_tokens long, hits long, plain double, less double, moves double, words array<binary>, uses array<int>"), "lm-told")
    rare = told.select("row", F.explode(F.arrays_zip("words", "uses")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.uses").alias("uses"))
    # in units of 1e-10, so that the sum does not hang on the order of the rows
    part = F.round(F.col("uses") * F.log10(F.coalesce("n", F.lit(0)) + 0.5) * 1e10).cast("long")
    met = rare.join(words, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("uses")).otherwise(0)).alias("met"), F.sum(part).alias("more"))
    both = told.drop("words", "uses").join(met, "row", "left")
    more = F.coalesce(F.col("more") / 1e10, F.lit(0.0))
    return both.select(
        "doc_id", "n_tokens", (F.col("hits") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("plain") + more + F.col("less")).alias("base_score"), (F.col("plain") + more + F.col("moves")).alias("score"),
    )


def report(docs: DataFrame, folds: int = 5, fold: int = 1, frequent: int = FREQUENT, clustered: int = CLUSTERED, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (by token) for every row of docs.

    Learns from the rows outside the held-out fold; null texts count as empty there and here, and an empty text is its
    end token. Rows without an id are held out. Without training rows every class is as likely as any other.
    """
    small_batches(docs.sparkSession, 1000)
    texts = docs.where(~held_out(F.col("doc_id"), folds, fold)).select(text_or_empty("text").alias("text"))
    model, words = train(texts, frequent, clustered, classes)
    own = score(docs, model, words).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return own.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
