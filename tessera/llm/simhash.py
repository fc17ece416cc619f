"""SimHash near-deduplication: exact search within a Hamming radius through sharded BK-trees.

Fingerprints within radius r that are cut in B blocks agree in at least B - r of them, so every combination of B - r
blocks and their bits names a shard, and each linked pair meets in a shard. A shard's BK-tree (children keyed by their
integer distance to the parent) is sent to the tasks that query the shard, and a query follows only edges whose key
lies within the radius of its own distance. Shards above `limit` fingerprints are dealt in blocks: each block's tree is
sent to every block of queries, so no task holds more than two blocks. Nothing is sent to executors that do not query it,
so what a task receives is bounded by `limit`, whatever the corpus.
"""

from __future__ import annotations

from itertools import combinations
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, partitions, save, small_batches, text_or_empty
from .connect import components, star_links

SEED, BITS = 42, 64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None, width: int) -> int:
    """The signed 64-bit SimHash of a text's word shingles, repeats included; 0 for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    n = len(hashes)
    at = np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8) + _OFFSETS
    counts = np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(np.packbits(counts.ravel() * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: str | Column, width: int = 3) -> Column:
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, width) for x in texts], dtype="int64")

    return of(text_or_empty(text))


def _runs(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class BKForest:
    """BK-trees of many shards at once: the first fingerprint of a shard is its root; children are found by (parent, distance)."""

    def __init__(self, prints: np.ndarray, shard: np.ndarray):
        """shard: of each fingerprint, in ascending order."""
        self.prints = prints
        self.shards, self.roots = np.unique(shard, return_index=True)
        rest = np.setdiff1d(np.arange(len(prints)), self.roots, assume_unique=True)
        node = np.repeat(self.roots, np.diff(np.append(self.roots, len(prints))))[rest]
        keys, kids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(rest):
            key = node * (BITS + 1) + np.bitwise_count(prints[rest] ^ prints[node])
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            first = np.append(True, key[1:] != key[:-1])
            keys.append(key[first])
            kids.append(rest[first])
            node = np.repeat(rest[first], np.diff(np.append(np.flatnonzero(first), len(rest))))[~first]
            rest = rest[~first]
        self.keys, self.kids = np.concatenate(keys), np.concatenate(kids)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.kids = self.keys[order], self.kids[order]

    def query(self, prints: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of every query and node of the same shard within radius."""
        at = np.searchsorted(self.shards, shard)
        there = (at < len(self.shards)) & (self.shards[np.minimum(at, len(self.shards) - 1)] == shard)
        query, node = np.flatnonzero(there), self.roots[at[there]]
        found_q, found_n = [], []
        while len(query):
            d = np.bitwise_count(prints[query] ^ self.prints[node]).astype(np.int64)
            near = d <= radius
            found_q.append(query[near])
            found_n.append(node[near])
            base = node * (BITS + 1)
            low = np.searchsorted(self.keys, base + np.maximum(d - radius, 0), "left")
            n = np.searchsorted(self.keys, base + np.minimum(d + radius, BITS), "right") - low
            query, node = np.repeat(query, n), self.kids[np.repeat(low, n) + _runs(n)]
        none = np.empty(0, np.int64)
        return np.concatenate([none, *found_q]), np.concatenate([none, *found_n])


def block_count(distinct: int, radius: int) -> int:
    """Blocks to cut fingerprints in, so that a shard of evenly spread fingerprints holds a few dozen; the result is exact for any."""
    blocks = radius + 1
    while blocks < radius + 4 and distinct >> (BITS * (blocks - radius) // blocks) > 32:
        blocks += 1
    return blocks


def masks(blocks: int, radius: int) -> list[int]:
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    part = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    return [signed(sum(part[i] for i in agree)) for agree in combinations(range(blocks), blocks - radius)]


def dealt(rows: DataFrame, keys: list[str], deal_by: Column, limit: int, size: Column | None = None, few: int = 100_000) -> DataFrame:
    """rows dealt in groups of (keys, i, j) with side: groups of up to limit rows, or of that total size, as they are
    (i = j = 0); larger ones in blocks, each pair of blocks i <= j in a group of its own, where side tells a row's block.

    Only larger groups are listed; up to `few` of them are broadcast, which spares rows a shuffle on their way, more are joined.
    """
    total = F.count("*") if size is None else F.sum(size)
    sizes = rows.groupBy(*keys).agg(total.alias("count")).where(F.col("count") > limit).select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("__blocks"))
    sizes = save(sizes, "dealt-sizes")
    own = rows.join(F.broadcast(sizes) if sizes.count() <= few else sizes, keys, "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    own = own.withColumn("side", F.pmod(F.xxhash64(deal_by), F.col("__blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__other")
    own = own.select("*", other).select(*rows.columns, "side", F.least("side", "__other").alias("i"), F.greatest("side", "__other").alias("j"))
    n = partitions(rows.sparkSession)
    return own.repartition(n, *keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The same rows with every group of a sorted partition in one frame."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = frame[keys].to_numpy()
        cut = int(np.flatnonzero((last != last[-1]).any(axis=1))[-1]) + 1 if (last != last[-1]).any() else 0
        if held and not cut and (held[-1][keys].to_numpy()[-1] == last[-1]).all():
            held.append(frame)
            continue
        if cut:
            held.append(frame.iloc[:cut])
        if held:
            yield pd.concat(held, ignore_index=True)
        held = [frame.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def near_links(prints: DataFrame, radius: int = 3, limit: int = 4096) -> DataFrame:
    """Links (a, b) of fingerprints with the same components as all pairs of prints (fp: distinct) within radius."""
    blocks = block_count(prints.count(), radius)
    shards = F.array(*(F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks(blocks, radius))))
    rows = prints.select("fp", F.explode(shards).alias("s")).select("fp", "s.combo", "s.bits")
    keys = ["combo", "bits", "i", "j"]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in whole_groups(frames, keys):
            at = g[keys].to_numpy()
            shard = np.cumsum(np.append(0, (at[1:] != at[:-1]).any(axis=1)))
            ids, side = g["fp"].to_numpy(), g["side"].to_numpy()
            fp = ids.view(np.uint64)
            tree, ask = np.flatnonzero(side == g["i"].to_numpy()), np.flatnonzero(side == g["j"].to_numpy())
            forest, a, b = BKForest(fp[tree], shard[tree]), [], []
            for k in range(0, len(ask), 2048):
                own = ask[k : k + 2048]
                q, n = forest.query(fp[own], shard[own], radius)
                x, y = ids[own[q]], ids[tree[n]]
                x, y = star_links(x[x != y], y[x != y])
                a.append(x)
                b.append(y)
            if a:
                x, y = star_links(np.concatenate(a), np.concatenate(b))
                yield pd.DataFrame({"a": x, "b": y})

    return dealt(rows, ["combo", "bits"], F.col("fp"), limit).mapInPandas(search, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), component_id (the smallest id reachable over links).

    Null texts count as empty; all texts without words have fingerprint 0 and link. Texts of fewer than `width` words
    have one shingle of all their words. Links run between fingerprints, so rows without an id connect what they link,
    but never name a component unless no row of it has an id (then component_id is null). Copies meet in their
    fingerprint before any search. No rows give no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession, 2000)
    own = save(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), width).alias("fp")), "simhash")
    classes = save(own.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-classes")
    parts = components(near_links(classes.select("fp"), radius))
    named = classes.join(parts, classes["fp"] == parts["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("part"))
    least = named.groupBy("part").agg(F.min("id").alias("component_id"))
    label = save(named.join(least, "part").select("fp", "component_id"), "simhash-labels")
    forget(classes)
    return own.join(label, "fp").select("doc_id", "fp", "component_id")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
