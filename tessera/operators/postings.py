"""Full-text search over a table of postings: lexemes with their positions, and ranks by cover density.

A text's words are runs of letters and digits. The `simple` kind keeps them in lower case; the `english` kind leaves out
stop words, which still count as positions, and stems the rest. A posting keeps at most 256 positions, none beyond 16,383.
They are kept in an index (operators/index.py), so a question reads only its own lexemes.
"""

from __future__ import annotations

import re
from itertools import chain
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stem import STOP, stem

POSITIONS, LAST, WEIGHT = 256, 16_383, 0.1
_WORD, _PLAIN = re.compile(r"[^\W_]+"), re.compile("[a-z]+")


def lexemes(text: str, english: bool) -> list[str | None]:
    """The lexeme at each position of a text, None for a stop word."""
    own = _WORD.findall(text.lower())
    return [None if w in STOP else stem(w) for w in own] if english else own


def positions(text: str | None, english: bool) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for n, w in enumerate(lexemes(text or "", english), 1):
        if w is not None:
            own = out.setdefault(w, [])
            if len(own) < POSITIONS and (not own or own[-1] < LAST):
                own.append(min(n, LAST))
    return out


def _numbered(words: list[str], english: bool) -> tuple[np.ndarray, list[str]]:
    """For each word the place of its lexeme among the lexemes in order, -1 for a stop word; and these lexemes."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    own = coded.dictionary.to_pylist()
    if english:
        own = [None if w in STOP else stem(w) for w in own]
    found = sorted({w for w in own if w is not None})
    place = {w: i for i, w in enumerate(found)}
    return np.array([-1 if w is None else place[w] for w in own], np.int64)[coded.indices.to_numpy()], found


def _inverted(texts: list[str], kind: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lexemes of some texts in order; by lexeme and text, the numbers of both, the occurrences and those whose positions are
    kept; and these positions one after the other."""
    split = _PLAIN.findall if kind == "plain" else _WORD.findall
    own = [split(t.lower()) for t in texts]
    sizes = np.array([len(x) for x in own], np.int64)
    codes, found = _numbered(list(chain.from_iterable(own)), kind == "english")
    at = np.arange(1, len(codes) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    group = codes * len(texts) + np.repeat(np.arange(len(texts)), sizes)
    order = np.argsort(group, kind="stable")[np.count_nonzero(codes < 0) :]
    group, at = group[order], at[order]
    first = np.append(True, group[1:] != group[:-1])[: len(group)]
    starts = np.flatnonzero(first)
    count = np.diff(np.append(starts, len(group)))
    kept = np.arange(len(group)) - np.repeat(starts, count) < POSITIONS
    if kind != "plain":
        kept &= first | (np.append(0, at[:-1])[: len(at)] < LAST)
        at = np.minimum(at, LAST)
    held = np.add.reduceat(kept, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    word, text = np.divmod(group[starts], max(len(texts), 1))
    return found, word, text, count if kind == "plain" else held, held, at[kept]


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values, pa.int32()))


def inverted(keys: pa.Array, texts: list[str], kind: str) -> pa.RecordBatch:
    """(lexeme, key, n, positions) of some texts by lexeme and key. `simple` and `english` are positions() of each text; `plain`
    words are runs of a-z, of which n counts all and the first are kept."""
    found, word, text, n, held, at = _inverted(texts, kind)
    columns = [pa.array(found, pa.string()).take(pa.array(word)), keys.take(pa.array(text)), pa.array(n, pa.int64()), _lists(np.cumsum(held), at)]
    return pa.RecordBatch.from_arrays(columns, names=["lexeme", "key", "n", "positions"])


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of zero or more in seven bits a byte, the last byte of each below 128; and where each ends."""
    size = 1 + sum((values >> b > 0).astype(np.int64) for b in range(7, 63, 7))
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for b in range(int(size.max(initial=0))):
        own = size > b
        out[(ends - size)[own] + b] = values[own] >> 7 * b & 127 | (size[own] > b + 1) << 7
    return out, ends


def _unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of _packed(), and where each ends."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.append(0, ends[:-1])[: len(ends)]
    out = np.zeros(len(ends), np.int64)
    for b in range(int((ends - starts).max(initial=0))):
        own = ends - starts > b
        out[own] |= (data[starts[own] + b].astype(np.int64) & 127) << 7 * b
    return out, ends


def _steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What each number of a run adds to the one before it; the first of a run stands as it is."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def _sums(steps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of _steps()."""
    total = np.cumsum(steps)
    return total - np.repeat(total[starts] - steps[starts], sizes)


def _at(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs: starts[0], starts[0] + 1 and so on, as many as its size, then those of the next."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


#: Postings of one lexeme and slice of the keys: the first key, how many there are, and packed the steps of the keys, then each n,
#: then the steps of each one's positions.
PARTS = "lexeme string, first long, held int, data binary"


def gathered(keys: pa.Array, texts: list[str], kind: str, slice: int) -> pa.RecordBatch:
    """The postings of inverted() as PARTS, a slice being so many keys."""
    order = np.argsort(keys.to_numpy(), kind="stable")
    found, word, text, n, held, at = _inverted([texts[i] for i in order], kind)
    key = keys.to_numpy()[order][text]
    row = np.append(True, (word[1:] != word[:-1]) | (key[1:] // slice != key[:-1] // slice))[: len(word)]
    starts, to = np.flatnonzero(row), np.cumsum(held)
    size = np.diff(np.append(starts, len(word)))
    places = np.add.reduceat(held, starts) if len(starts) else held
    a = np.cumsum(2 * size + places) - 2 * size - places  # where the numbers of a row start
    values = np.empty(2 * len(word) + len(at), np.int64)
    steps = _steps(key, starts)
    steps[starts] = 0
    values[_at(a, size)], values[_at(a + size, size)], values[_at(a + 2 * size, places)] = steps, n, _steps(at, to - held)
    data, ends = _packed(values)
    bytes_ = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(0, ends[(a + 2 * size + places) - 1]).astype(np.int32)), pa.py_buffer(data)])
    columns = [pa.array(found, pa.string()).take(pa.array(word[starts])), pa.array(key[starts], pa.int64()), pa.array(size, pa.int32()), bytes_]
    return pa.RecordBatch.from_arrays(columns, names=["lexeme", "first", "held", "data"])


def scattered(rows: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """The postings (bucket, lexeme, key, n, positions, most, block) of PARTS with a bucket; most is the greatest n of a row in a
    block of `width` keys, on the first posting of that block, and null on others."""
    size = rows["held"].to_numpy().astype(np.int64)
    values, ends = _unpacked(np.frombuffer(b"".join(rows["data"].to_pylist()), np.uint8))
    last = np.cumsum(pc.binary_length(rows["data"]).to_numpy().astype(np.int64))
    a = np.append(0, np.searchsorted(ends, last, "right")[:-1])[: len(size)]
    starts = np.cumsum(size) - size
    key = _sums(values[_at(a, size)], starts, size) + np.repeat(rows["first"].to_numpy(), size)
    n = values[_at(a + size, size)]
    held, row = np.minimum(n, POSITIONS), np.repeat(np.arange(len(size)), size)
    to = np.cumsum(held)
    places = np.add.reduceat(held, starts) if len(starts) else held
    at = _sums(values[_at(a + 2 * size, places)], to - held, held)
    block = key // width
    blocks = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (block[1:] != block[:-1]))[: len(row)])
    most, rest = np.zeros(len(row), np.int64), np.full(len(row), True)
    most[blocks], rest[blocks] = np.maximum.reduceat(n, blocks) if len(blocks) else 0, False
    taken = pa.array(row)
    columns = [rows["bucket"].take(taken), rows["lexeme"].take(taken), pa.array(key), pa.array(n), _lists(to, at), pa.array(most, mask=rest), pa.array(block)]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "lexeme", "key", "n", "positions", "most", "block"])


def _pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to `most`, or one row each."""
    ends, a = np.cumsum(sizes.astype(np.int64)), 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _in_parts(docs: DataFrame, key: str, text: str, most: int, made: Callable[[pa.Array, list[str]], pa.RecordBatch], schema: str) -> DataFrame:
    """What is made of the keys and texts of every row that has both. A task takes texts of `most` characters, or one text, at a
    time, so what it holds does not grow with the table."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _pieces(pc.utf8_length(batch["t"]).to_numpy(zero_copy_only=False), most):
                yield made(batch["k"].slice(a, b - a), batch["t"].slice(a, b - a).to_pylist())

    own = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return own.mapInArrow(task, schema)


def lexed(docs: DataFrame, kind: str, key: str = "doc_id", text: str = "text", most: int = 1 << 21) -> DataFrame:
    """(lexeme, key, n, positions) of every text with a key, made where it is read, without a shuffle."""
    schema = f"lexeme string, key {dict(docs.dtypes)[key]}, n long, positions array<int>"
    return _in_parts(docs, key, text, most, lambda keys, texts: inverted(keys, texts, kind), schema)


def parts(docs: DataFrame, kind: str, slice: int, key: str = "doc_id", text: str = "text", most: int = 1 << 21) -> DataFrame:
    """lexed() gathered by lexeme and slice of the integer keys, as PARTS: what is shuffled holds a lexeme once for many texts."""
    return _in_parts(docs.withColumn(key, F.col(key).cast("long")), key, text, most, lambda keys, texts: gathered(keys, texts, kind, slice), PARTS)


def from_parts(rows: DataFrame, width: int, most: int = 1 << 20) -> DataFrame:
    """The postings of PARTS with a bucket, in the order of the rows; see scattered(). A task takes `most` bytes, or one row, at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _pieces(pc.binary_length(batch["data"]).to_numpy(zero_copy_only=False), most):
                yield scattered(batch.slice(a, b - a), width)

    return rows.select("bucket", "lexeme", "first", "held", "data").mapInArrow(task, "bucket int, lexeme string, key long, n long, positions array<int>, most long, block long")


def postings(docs: DataFrame, english: bool, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(lexeme, key, positions) of every text."""
    return lexed(docs, "english" if english else "simple", key, text).select("lexeme", F.col("key").alias(key), "positions")


def covers(places: list[list[int]], weight: float = WEIGHT) -> float:
    """Cover density: over the shortest spans that hold every lexeme, weight / (1 + other words in the span)."""
    merged = sorted((p, k) for k, own in enumerate(places) for p in own)
    total, start, need = 0.0, 0, len(places)
    held: dict[int, int] = {}
    for end, (p, k) in enumerate(merged):
        held[k] = held.get(k, 0) + 1
        while len(held) == need:
            first, j = merged[start]
            if held[j] == 1:
                total += weight / (1 + max(p - first - (end - start), 0)) if p - first >= end - start else weight / (1 + (end - start) // 2)
                del held[j]
            else:
                held[j] -= 1
            start += 1
    return total


def rank_any(own: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score) of texts that hold any of the lexemes, n times each: every occurrence is a cover of its own."""
    return own.groupBy(*keys).agg((F.sum("n") * F.lit(WEIGHT)).alias("score"))


def rank_all(own: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    """(keys, score) of texts that hold all `wanted` lexemes of a question, by cover density."""

    @F.pandas_udf("double")
    def density(places: pd.Series) -> pd.Series:
        return pd.Series([covers([list(p) for p in x]) for x in places], dtype=float)

    whole = own.groupBy(*keys).agg(F.collect_list("positions").alias("places"), F.count_distinct("lexeme").alias("held"), F.first(wanted).alias("wanted"))
    return whole.where("held = wanted").select(*keys, density("places").alias("score"))


def best(ranked: DataFrame, question: str, most: int = 40, key: str = "doc_id") -> DataFrame:
    """The first `most` texts of each question, with their rank; ties by key."""
    place = F.row_number().over(Window.partitionBy(question).orderBy(F.desc("score"), key)).cast("long")
    return ranked.withColumn("rank", place).where(F.col("rank") <= most)
