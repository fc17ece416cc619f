"""Benchmark decontamination: the n-grams of the test items as a broadcast hash set, against which the token windows of
all texts are scanned.

Items and texts are lower-cased (A-Z) and cut in words. An item's windows are its runs of n words, or all its words if
it has fewer. The set holds a 64-bit hash of each distinct window; a worker numbers a text's words by the set's own
vocabulary (words beyond it end a run), takes the hashes of all windows of a batch at once, and compares the words
themselves wherever a hash is in the set. A benchmark whose windows take more than `block_bytes` is dealt in blocks by
the hash of the window, one scan a block, so what is broadcast is bounded whatever the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, free_name, save, small_batches, text_or_empty

WINDOW = 10
#: A word, of lower-cased texts; in UTF-8 all bytes of other characters are of 0x80 or more, so it reads bytes alike.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPANS = "array<struct<start:int,end:int>>"
_FACTORS = np.random.default_rng(20).integers(1 << 62, size=(64, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words that are scanned together.
_WORDS = 1 << 19


def item_windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct (item, text, size) of items: the item's id as text, a window's words joined by spaces, their number.

    Null texts and texts without words have no windows; items without an id are one item named by the empty text; rows
    that share an id are one item.
    """
    words = F.regexp_extract_all(F.translate(text_or_empty("text"), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - size + 1))
    return own.select("item", "w", size.alias("size"), starts.alias("at")).select("item", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("text"), "size").distinct()


class WindowSet:
    """The hash set of some windows: hashes by window size, each hash of one window only, with its items."""

    def __init__(self, windows: list[tuple[str, str]]):
        texts = sorted({t for _, t in windows})
        place = {t: i for i, t in enumerate(texts)}
        self.items = sorted({i for i, _ in windows})
        number = {x: i for i, x in enumerate(self.items)}
        pairs = np.array(sorted((place[t], number[i]) for i, t in windows), np.int64).reshape(-1, 2)
        self.item, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(texts) + 1))
        split = [t.encode().split(b" ") for t in texts]
        self.ids: dict[bytes, int] = {}
        for w in (w for ws in split for w in ws):
            self.ids.setdefault(w, len(self.ids) + 1)
        self.by_size = {}
        for size in sorted({len(ws) for ws in split}):
            at = np.array([i for i, ws in enumerate(split) if len(ws) == size], np.int64)
            words = np.array([[self.ids[w] for w in split[i]] for i in at], np.uint32)
            for factors in _FACTORS:  # the first under which no two windows agree
                h = _hash(words.ravel().astype(np.uint64), size, factors)[::size]
                order = np.argsort(h, kind="stable")
                if (np.diff(h[order]) > 0).all():
                    break
            else:
                raise ValueError("no factor tells the windows apart")
            self.by_size[size] = (factors, h[order], words[order], at[order])

    def number(self, words: list[bytes]) -> list[int]:
        """The numbers of words, 0 for those that no window has."""
        get = self.ids.get
        return [get(w, 0) for w in words]

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, where such a window begins in ids, its number) for the sizes that windows have."""
        known = np.cumsum(np.concatenate([[0], ids > 0]))
        for size, (factors, hashes, words, at) in self.by_size.items():
            if len(ids) < size:
                continue
            start = np.flatnonzero(known[size:] - known[:-size] == size)
            h = _hash(ids.astype(np.uint64), size, factors)[start]
            near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[near] == h
            start, near = start[hit], near[hit]
            same = (ids[start[:, None] + np.arange(size)] == words[near]).all(axis=1)  # the words decide
            yield size, start[same], at[near[same]]


def _hash(ids: np.ndarray, size: int, factors: np.ndarray) -> np.ndarray:
    """A hash of each run of size words."""
    mixed = (ids + factors[1]) * factors[0]
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(max(len(ids) - size + 1, 0), np.uint64)
    for k in range(size):
        out = out * factors[0] + mixed[k : k + len(out)]
    return out


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """The runs of True, ends exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _scan(texts: list[bytes], held: WindowSet) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: its words, the runs of words that are hit, the items whose windows it holds."""
    words = [_WORD.findall(t) for t in texts]
    size = np.array([len(w) + 1 for w in words], np.int64)  # a text ends with a word that no window has
    first = np.concatenate([[0], np.cumsum(size)])
    ids = np.zeros(first[-1], np.uint32)
    for i, w in enumerate(words):
        ids[first[i] : first[i] + len(w)] = held.number(w)
    cover = np.zeros(len(ids) + 1, np.int64)
    found: dict[int, list[np.ndarray]] = {}
    for n, start, window in held.find(ids):
        np.add.at(cover, start, 1)
        np.add.at(cover, start + n, -1)
        text = np.searchsorted(first, start, side="right") - 1  # ascending, as the starts are
        cuts = np.flatnonzero(np.diff(text)) + 1
        for own_text, some in zip(np.split(text, cuts), np.split(window, cuts)):
            if len(some):
                found.setdefault(int(own_text[0]), []).append(np.unique(some))
    hit = np.cumsum(cover) > 0
    for i, w in enumerate(words):
        if i not in found:
            yield len(w), [], []
            continue
        windows = np.unique(np.concatenate(found[i]))
        items = np.unique(np.concatenate([held.item[held.first[k] : held.first[k + 1]] for k in windows]))
        yield len(w), _runs(hit[first[i] : first[i] + len(w)]), [held.items[k] for k in items]


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, those that meet or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, items: DataFrame, n: int = WINDOW, text: str = "text", block_bytes: int = 48 << 20, keep: list[str] | None = None) -> DataFrame:
    """docs with three columns more: __words (int), __runs (array<struct<start,end>>: runs of words inside an occurrence of
    an item's window, ends exclusive) and __items (array<string>: those items' ids in order).

    keep names the columns of docs that stay, all by default; clashing names of docs are refused. Null and empty texts
    have no words. Each of repeated rows is scanned. Without items nothing is hit; no rows give no rows.
    """
    spark = docs.sparkSession
    if clash := {"__words", "__runs", "__items"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs must not have the columns {sorted(clash)}")
    small_batches(spark)
    windows = save(item_windows(items, n), "leak-windows")
    taken = windows.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 8 * F.col("size") + 40)).first()[0] or 0
    blocks = max(1, -(-taken // block_bytes))
    kept = [docs[c] for c in (docs.columns if keep is None else keep)]
    rows = docs.select(*kept, docs[text].alias("__text"), F.lit(0).alias("__words"), F.array().cast(SPANS).alias("__runs"), F.array().cast("array<string>").alias("__items"))
    for k in range(blocks):
        block = windows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).select("item", "text").toPandas()
        shared = spark.sparkContext.broadcast(WindowSet(list(block.itertuples(index=False, name=None))))

        def found(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for frame in frames:
                texts = [t.encode().lower() if t else b"" for t in frame["__text"]]
                out, at = [], 0
                while at < len(texts):
                    end, size = at, 0
                    while end < len(texts) and (end == at or size + len(texts[end]) <= 4 * _WORDS):
                        size += len(texts[end])
                        end += 1
                    out += _scan(texts[at:end], shared.value)
                    at = end
                runs = [_merged([(x["start"], x["end"]) for x in old] + new) for old, (_, new, _) in zip(frame["__runs"], out)]
                frame["__words"] = np.array([w for w, _, _ in out], np.int32)
                frame["__runs"] = [[{"start": a, "end": b} for a, b in r] for r in runs]
                frame["__items"] = [sorted({*old, *new}) for old, (_, _, new) in zip(frame["__items"], out)]
                yield frame

        rows = rows.mapInPandas(found, rows.schema)
        if k < blocks - 1:
            rows = save(rows, "leak-scan")
    return rows


def report(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit (words inside an occurrence of an item's window), n_items, the digest
    of their ids in order of text joined by commas (of the empty text without any), contaminated. See scan() for edges."""
    rows = scan(docs.select("doc_id", "text"), items, n, keep=["doc_id"])
    hit = F.aggregate("__runs", F.lit(0), lambda s, x: s + x["end"] - x["start"])
    count = F.size("__items").cast("long")
    return rows.select("doc_id", F.col("__words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), count.alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (F.size("__runs") > 0).alias("contaminated"))


def without_runs(text: str, runs: list[tuple[int, int]]) -> str:
    """text without the words of the runs, each run from its first word to the beginning of the next word, or to the end."""
    data = text.encode()
    at = [m.start() for m in _WORD.finditer(data.lower())] + [len(data)]
    out, last = [], 0
    for a, b in runs:
        out.append(data[last : at[a]])
        last = at[b]
    return b"".join([*out, data[last:]]).decode()


def drop_documents(docs: DataFrame, items: DataFrame, n: int = WINDOW, least: int = 1) -> DataFrame:
    """The rows of docs that hold fewer than `least` hit words, with their columns. See scan() for edges."""
    hit = F.aggregate("__runs", F.lit(0), lambda s, x: s + x["end"] - x["start"])
    return scan(docs, items, n).where(hit < least).select(*docs.columns)


def cut_spans(docs: DataFrame, items: DataFrame, n: int = WINDOW, text: str = "text") -> DataFrame:
    """docs with the hit words cut from its texts, all other columns and rows as they were. Null texts stay null."""
    rows = scan(docs, items, n, text)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["__text"] = [t if not len(r) else without_runs(t, [(x["start"], x["end"]) for x in r]) for t, r in zip(frame["__text"], frame["__runs"])]
            yield frame

    done = rows.mapInPandas(cut, rows.schema)
    return done.select(*(F.col("__text").alias(c) if c == text else done[c] for c in docs.columns))
