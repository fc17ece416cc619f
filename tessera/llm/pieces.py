"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A text is cut before runs of spaces and around line breaks, where no piece of the model can cross, so the lattice of
a text is the chain of the lattices of its units. Forward sums are computed once per distinct unit; segmentations are
then drawn backwards for all units of a batch together, each from numbers that depend only on the seed, the row key,
the place in the text and the step. A piece of rank r weighs (r + 10) ** -alpha; characters without pieces are
encoded by their bytes, and so is U+2581 itself, which makes decoding exact.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_or_empty

SPACE = "▁"
UNIT = re.compile(r" *[^ \n]+| +|\n+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units and characters of units that a worker keeps; a node and its edges take some 60 bytes.
CACHE, NODES = 100_000, 2_000_000
_BASE, _ALL = 1_000_003, (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    def __init__(self, path: str, alpha: float = 3.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.names) if re.fullmatch(r"<0x[0-9A-F]{2}>", p)}
        special = {i for i in range(len(self.names)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        rank = {i: r for r, i in enumerate(sorted((i for i in range(len(self.names)) if i not in special), key=lambda i: (-sp.get_score(i), i)))}
        # pieces that hold a space after another character would cross units; the lattice leaves them out
        self.ids = {p.replace(SPACE, " "): (i, float((rank[i] + 10.0) ** -alpha)) for i, p in enumerate(self.names) if i in rank and SPACE not in p.lstrip(SPACE) and "\n" not in p}
        self.longest = max(map(len, self.ids))
        known: dict[int, tuple[int, float]] = {}  # of each beginning of a piece: the piece that ends there or -1, its weight
        for p, (i, w) in self.ids.items():
            h = 0
            for n, c in enumerate(p):
                h = (h * _BASE + ord(c) + 1) & _ALL
                if n == len(p) - 1:
                    known[h] = (i, w)
                else:
                    known.setdefault(h, (-1, 0.0))
        self.begun = np.array(sorted(known), np.uint64)
        self.ends_in = np.array([known[h][0] for h in sorted(known)], np.int64)
        self.weight = np.array([known[h][1] for h in sorted(known)])
        self.out = [b""] * len(self.names)
        for i, p in enumerate(self.names):
            if i not in special:
                self.out[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.out[i] = bytes([b])
        self.ascii = np.array([self.byte[b] for b in range(128)], np.int64)
        self.fallback = float((len(rank) + 10.0) ** -alpha) * 1e-3
        self.clear()

    def clear(self) -> None:
        """Forget the units. Nodes are numbered over all units; a node's edges lie together, the likeliest
        first, each with its cumulative share in units of 2**-24, its piece and the node it comes from (-1: the unit's start)."""
        self.end: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.cum, self.to, self.piece, self.head = (np.empty(1 << 16, np.int32) for _ in range(4))

    def add(self, units: list[str]) -> None:
        """Forward filtering of all the units together: each node's sum over the segmentations of the unit up to it, in
        logarithms, so units of any length stay finite, and each edge's share in the node where it ends.

        Shares are rounded to 2**-24, which keeps draws the same wherever a unit's nodes are numbered.
        """
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.array([len(u) for u in units], np.int64)
        stop = np.repeat(np.cumsum(sizes), sizes)
        first = stop - np.repeat(sizes, sizes)
        total = len(points)
        starts, lengths, found, weights = [], [], [], []
        at, h = np.arange(total), np.zeros(total, np.uint64)
        single = np.zeros(total, bool)
        with np.errstate(over="ignore"):
            for n in range(1, self.longest + 1):
                h = h * np.uint64(_BASE) + (points[at + n - 1] + 1).astype(np.uint64)
                k = np.minimum(np.searchsorted(self.begun, h), len(self.begun) - 1)
                ok = self.begun[k] == h
                at, h, k = at[ok], h[ok], k[ok]
                full = self.ends_in[k] >= 0
                starts.append(at[full])
                lengths.append(np.full(int(full.sum()), n))
                found.append(self.ends_in[k[full]])
                weights.append(self.weight[k[full]])
                if n == 1:
                    single[at[full]] = True
                on = at + n < stop[at]
                at, h = at[on], h[on]
                if not len(at):
                    break
        lone = np.flatnonzero(~single)  # by its bytes
        start = np.concatenate([*starts, lone])
        length = np.concatenate([*lengths, np.ones(len(lone), np.int64)])
        lone_piece = np.where(points[lone] < 128, self.ascii[np.minimum(points[lone], 127)], -1 - points[lone])
        piece = np.concatenate([*found, lone_piece])
        weight = np.log(np.concatenate([*weights, np.full(len(lone), self.fallback)]))
        node = start + length - 1  # an edge's node is the character where it ends
        place, unit = node - first[node], np.repeat(np.arange(len(units)), sizes)[node]
        order = np.argsort(place.astype(np.uint16) if sizes.max() < 1 << 16 else place, kind="stable")
        start, node, piece, weight, unit, length = (x[order] for x in (start, node, piece, weight, unit, length))
        share, logs = np.empty(len(node)), np.zeros(total)
        cuts = np.cumsum(np.bincount(place)).tolist()
        for j, (a, b) in enumerate(zip([0, *cuts], cuts)):
            own, begin, of = node[a:b], start[a:b], unit[a:b]
            if j:  # relative to the node before, from which an edge always comes, so neither end of the range is met
                last = logs[own - 1]
                w = np.exp(weight[a:b] + np.where(length[a:b] <= j, logs[begin - 1], 0.0) - last)
            else:
                last, w = 0.0, np.exp(weight[a:b])
            sums = np.bincount(of, w)[of]
            share[a:b] = w / sums
            logs[own] = last + np.log(sums)
        rounded = np.floor(share * 2**24 + 0.5).astype(np.int64)
        order = np.argsort((node << 30) + ((2**24 - rounded) << 5) + length)
        start, node, piece, rounded = start[order], node[order], piece[order], rounded[order]
        heads = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        run = np.cumsum(rounded)
        run -= np.repeat(run[heads] - rounded[heads], np.diff(np.append(heads, len(node))))
        run = np.minimum(run, 2**24)
        run[np.append(heads[1:], len(node)) - 1] = 2**24
        base, n = self.nodes, self.edges
        if n + len(node) > len(self.cum):
            room = max(2 * len(self.cum), n + len(node))
            self.cum, self.to, self.piece, self.head = (np.concatenate([x, np.empty(room - len(x), x.dtype)]) for x in (self.cum, self.to, self.piece, self.head))
        self.cum[n : n + len(node)] = run
        self.to[n : n + len(node)] = np.where(start > first[start], base + start - 1, -1)
        self.piece[n : n + len(node)] = piece
        self.head[base : base + total] = n + heads
        self.edges, self.nodes = n + len(node), base + total
        self.end.update(zip(units, (base + np.cumsum(sizes) - 1).tolist()))

    def encode(self, keys: list[int], texts: list[str], seed: int) -> list[np.ndarray]:
        """The sampled ids of each text. Equal (seed, key, text) give equal ids, whatever else is in the batch."""
        units = [UNIT.findall(t) for t in texts]
        distinct = set().union(*units) if units else set()
        new = distinct - self.end.keys()
        if len(self.end) + len(new) > CACHE or self.nodes + sum(map(len, new)) > NODES:
            self.clear()
            new = distinct
        if new:
            self.add(list(new))
        cum, to, piece, head = self.cum, self.to, self.piece, self.head
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        total = int(sizes.sum())
        if not total:
            return [np.empty(0, np.int32) for _ in texts]
        node = np.array(list(map(self.end.__getitem__, chain.from_iterable(units))), np.int32)
        place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        with np.errstate(over="ignore"):
            row = _mix(np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64) ^ _mix(np.array([seed & 0xFFFFFFFFFFFFFFFF], np.uint64)))
            state = _mix(np.repeat(row, sizes) + place.astype(np.uint64))
            which, step, got_at, got_piece, got_step = np.arange(total), 0, [], [], []
            while len(which):
                draw = (_mix(state + np.uint64(step)) >> np.uint64(40)).astype(np.int32)
                edge = head[node]
                later = np.flatnonzero(draw >= cum[edge])
                while len(later):
                    edge[later] += 1
                    later = later[draw[later] >= cum[edge[later]]]
                got_at.append(which)
                got_piece.append(piece[edge])
                got_step.append(np.full(len(which), step, np.int32))
                node = to[edge]
                on = node >= 0
                which, node, state = which[on], node[on], state[on]
                step += 1
        at, ids, steps = np.concatenate(got_at), np.concatenate(got_piece), np.concatenate(got_step)
        counts = np.bincount(at, minlength=total)
        home = (np.cumsum(counts) - 1)[at] - steps  # drawn backwards within a unit
        ordered = np.empty(len(ids), np.int64)
        ordered[home] = ids
        ids, owner = ordered, np.repeat(np.repeat(np.arange(len(texts)), sizes), counts)
        if len(lone := np.flatnonzero(ids < 0)):
            raw = [[self.byte[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")] for i in ids[lone].tolist()]
            times = np.ones(len(ids), np.int64)
            times[lone] = [len(x) for x in raw]
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            ids[ids < 0] = [i for x in raw for i in x]
        cuts = np.searchsorted(owner, np.arange(1, len(texts)))
        return [x.astype(np.int32) for x in np.split(ids, cuts)]

    def decode(self, ids) -> str:
        out = self.out
        return b"".join([out[i] for i in ids]).decode("utf-8", "surrogatepass")


_loaded: dict[tuple, Pieces] = {}


def pieces(path: str, alpha: float) -> Pieces:
    """One per worker process; its cache is bounded by units and by their characters."""
    return _loaded.get((path, alpha)) or _loaded.setdefault((path, alpha), Pieces(path, alpha))


def _batches(keys, texts, chars: int = 500_000):
    """Slices of about `chars` characters, so memory follows neither the number of rows nor the longest batch."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield keys[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield keys[start:], texts[start:]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, alpha: float = 3.0, path: str = MODEL) -> DataFrame:
    """docs with ids (array<int>). Null texts count as empty and give no ids; null keys draw as key 0; repeated rows get
    equal ids. A column of docs named ids is replaced. The model file must lie at `path` on every executor."""

    small_batches(docs.sparkSession)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def of(keys: pd.Series, texts: pd.Series) -> pd.Series:
        p = pieces(path, alpha)
        return pd.Series([x for k, t in _batches(keys.tolist(), texts.tolist()) for x in p.encode(k, t, seed)], dtype=object)

    return docs.withColumn("ids", of(F.coalesce(F.col(key).cast("long"), F.lit(0)), text_or_empty(text)))


def decode(encoded: DataFrame, path: str = MODEL, alpha: float = 3.0) -> DataFrame:
    """encoded with decoded (string) from ids; null ids give an empty text."""

    small_batches(encoded.sparkSession)

    @F.pandas_udf(T.StringType())
    def of(ids: pd.Series) -> pd.Series:
        p = pieces(path, alpha)
        return pd.Series([p.decode(x) for x in ids], dtype=object)

    return encoded.withColumn("decoded", of(F.coalesce("ids", F.array().cast("array<int>"))))


def report(docs: DataFrame, seed: int = 1, alpha: float = 3.0, path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256, lossless (decoding gives the text)."""
    import hashlib

    small_batches(docs.sparkSession)

    @F.pandas_udf("n_pieces long, ids_sha256 string, decoded_sha256 string, lossless boolean")
    def of(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        p, rows = pieces(path, alpha), []
        for k, t in _batches(keys.tolist(), texts.tolist()):
            for ids, own in zip(p.encode(k, t, seed), t):
                back = p.decode(ids.tolist())
                rows.append((len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == own))
        return pd.DataFrame(rows, columns=["n_pieces", "ids_sha256", "decoded_sha256", "lossless"])

    return docs.select("doc_id", of(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), text_or_empty("text")).alias("r")).select("doc_id", "r.*")
