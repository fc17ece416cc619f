"""SimHash near-deduplication of texts whose word shingles have a given Jaccard similarity.

The 64-bit fingerprints of `simhash` find copies within a few bits. Texts of similarity 0.8 differ in some 15% of all
bits, beyond any radius that blocks of a fingerprint can shard. So here shards are named by the texts' shingles: a text
has `BANDS` shard keys, each of the least values of its shingles under `ROWS` hash functions, and texts of similarity s
share one key with a probability of s ** ROWS, whatever the size of the corpus. A shard's BK-tree over 128-bit
fingerprints finds pairs within a wide radius. Of these a spanning forest is kept, which connects what all of them connect,
so the components over all shards hold every found pair. The texts of a component are then compared by their shingles,
each with every other that is not linked to it already, so noisy distances never decide which pairs are checked.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, free_name, in_files, locator, maybe_in, save, small_batches, text_or_empty
from .connect import components, star_links
from .simhash import _BYTE_BITS, _runs, BKForest, dealt, whole_groups

LONGS = 2
#: At similarity 0.8 a pair misses all shard keys with a probability of (1 - 0.8 ** 4) ** 12 = 0.0018, at 0.9 of 0.000007.
BANDS, ROWS = 12, 4
#: Odd multipliers that turn a shingle's hash into those of the longs, and into the values of which the least count.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
LEAST = np.random.default_rng(23).integers(1 << 62, (1 << 64) - 1, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The hashes of a text's distinct shingles of words, A-Z lower-cased; fewer words than `width` are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(len(words) - width + 1, min(len(words), 1))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width])) for i in range(n)), np.uint64, n))


def class_of(hashes: bytes) -> int:
    """What names the class of texts of equal shingle sets, from the bytes of their hashes."""
    return xxhash.xxh64_intdigest(hashes) - (1 << 63)


def wide_print(hashes: np.ndarray) -> list[int]:
    """The 128-bit SimHash of distinct shingles as two signed longs; zeros for none."""
    if not len(hashes):
        return [0] * LONGS
    h = (hashes[:, None] ^ (hashes[:, None] >> np.uint64(31))) * MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    at = h.view(np.uint8).reshape(len(h), 8 * LONGS) + np.arange(8 * LONGS) * 256
    counts = np.bincount(at.ravel(), minlength=2048 * LONGS).reshape(8 * LONGS, 256) @ _BYTE_BITS
    return np.packbits(counts.ravel() * 2 > len(h), bitorder="little").view("<i8").tolist()


def shard_keys(hashes: np.ndarray) -> list[int]:
    """A text's shard keys, one a band: hashes of the band's number and of the least values of the shingles under its
    functions. Sets without shingles share all keys."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    mixed = hashes ^ (hashes >> np.uint64(33))
    for a in range(0, len(mixed), 4096):
        values = mixed[a : a + 4096, None] * LEAST
        least = np.minimum(least, (values ^ (values >> np.uint64(32))).min(axis=0))
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def spanning_forests(a: np.ndarray, b: np.ndarray, d: np.ndarray, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of `times` minimum spanning forests by d of the links (a, b), each of what those before it leave: where
    a link proves wrong, others across the same cut remain."""
    order = np.lexsort((b, a, d))
    a, b, d = a[order], b[order], d[order]
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, kept = np.arange(len(a)), [np.empty(0, np.int64)]
    for _ in range(times):
        edge, u, v, taken = left, at[: len(a)][left], at[len(a) :][left], [np.empty(0, np.int64)]
        while len(edge):
            best = np.full(len(ids), len(a))
            np.minimum.at(best, u, edge)
            np.minimum.at(best, v, edge)
            take = np.unique(best[best < len(a)])
            taken.append(take)
            place = np.searchsorted(edge, take)
            node, root = star_links(u[place], v[place])
            label = np.arange(len(ids))
            label[node] = root
            u, v = label[u], label[v]
            apart = u != v
            u, v, edge = u[apart], v[apart], edge[apart]
        kept += taken
        left = np.setdiff1d(left, np.concatenate(taken), assume_unique=True)
    keep = np.concatenate(kept)
    return a[keep], b[keep], d[keep]


def candidates(prints: DataFrame, radius: int = 21, both: int = 34, limit: int = 4096) -> DataFrame:
    """Links (a, b) with the same components as all pairs of a shard whose fingerprints (id, f0, f1, shards) differ in at
    most `radius` of the first 64 bits and `both` of all 128."""
    rows = prints.select("id", "f0", "f1", F.explode("shards").alias("shard"))
    keys = ["shard", "i", "j"]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in whole_groups(frames, keys):
            at = g[keys].to_numpy()
            shard = np.cumsum(np.append(0, (at[1:] != at[:-1]).any(axis=1)))
            f0, f1, ids, side = g["f0"].to_numpy().view(np.uint64), g["f1"].to_numpy().view(np.uint64), g["id"].to_numpy(), g["side"].to_numpy()
            tree, ask = np.flatnonzero(side == g["i"].to_numpy()), np.flatnonzero(side == g["j"].to_numpy())
            same_block = (g["i"] == g["j"]).to_numpy()
            forest = BKForest(f0[tree], shard[tree])
            a = b = d = np.empty(0, np.int64)
            for k in range(0, len(ask), 256):
                own = ask[k : k + 256]
                q, n = forest.query(f0[own], shard[own], radius)
                x, y = own[q], tree[n]
                new = np.where(same_block[x], x < y, x != y)
                x, y = x[new], y[new]
                far = np.bitwise_count(f0[x] ^ f0[y]).astype(np.int64) + np.bitwise_count(f1[x] ^ f1[y])
                x, y, far = x[far <= both], y[far <= both], far[far <= both]
                a, b, d = np.append(a, x), np.append(b, y), np.append(d, far)
                if len(a) > 1 << 18:
                    a, b, d = spanning_forests(a, b, d, times=1)
            a, b, d = spanning_forests(a, b, d, times=1)
            yield pd.DataFrame({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b])})

    return dealt(rows, ["shard"], F.xxhash64("id"), limit).mapInPandas(search, "a long, b long").where("a < b").distinct()


def set_links(ids: np.ndarray, sets: list[np.ndarray], tree: np.ndarray, ask: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as all pairs of `ask` and `tree` (places in sets) whose sets have a Jaccard
    similarity of `least` or more. Exact: of x's elements, any |x| - least |x| + 1 meet such a y, so y is found in the
    postings of x's rarest ones; found ones are left out only if they are linked to x already."""
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(at, minlength=1)
    in_tree = np.flatnonzero(np.repeat(np.isin(np.arange(len(sets)), tree), sizes))
    order = in_tree[np.argsort(at[in_tree], kind="stable")]
    posted, owner = np.bincount(at[order], minlength=len(often)), np.repeat(np.arange(len(sets)), sizes)[order]
    begins = np.cumsum(posted) - posted
    part = np.unique(ids, return_inverse=True)[1]
    marked, a, b = np.zeros(len(often), bool), [], []
    # sets of common elements first: the original of many edits links them at once
    common = np.array([often[at[starts[x] : starts[x] + sizes[x]]].mean() if sizes[x] else 0.0 for x in ask])
    for x in ask[np.argsort(-common, kind="stable")].tolist():
        if (part[tree] == part[x]).all():
            continue
        own = at[starts[x] : starts[x] + sizes[x]]
        rare = own[np.argsort(often[own], kind="stable")][: max(0, sizes[x] - math.ceil(least * sizes[x] - 1e-9) + 1)]
        y = np.unique(owner[np.repeat(begins[rare], posted[rare]) + _runs(posted[rare])])
        y = y[(part[y] != part[x]) & (sizes[y] >= least * sizes[x] - 1e-9) & (sizes[x] >= least * sizes[y] - 1e-9)]
        if not len(y):
            continue
        marked[own] = True
        theirs = marked[at[np.repeat(starts[y], sizes[y]) + _runs(sizes[y])]].astype(np.int64)
        marked[own] = False
        both = np.add.reduceat(theirs, np.cumsum(sizes[y]) - sizes[y])
        y = y[both >= least * (sizes[x] + sizes[y] - both) - 1e-9]
        joined, first = np.unique(part[y], return_index=True)
        a.append(np.full(len(first), ids[x]))
        b.append(ids[y[first]])
        part[np.isin(part, joined)] = part[x]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def similar_links(texts: DataFrame, least: float, width: int, limit: int = 1 << 20) -> DataFrame:
    """Links (a, b) with the same components as all pairs of one part among texts (part, id, text: of each id one) whose
    shingle sets have a Jaccard similarity of `least` or more. Parts of more than `limit` shingles are dealt in blocks,
    each pair of blocks to a group of its own, so that a task's memory is bounded whatever the part."""

    @F.pandas_udf("binary")
    def hashes(column: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, width).tobytes() for t in column])

    rows = save(texts.select("part", "id", hashes("text").alias("hashes")), "similar-sets")
    keys = ["part", "i", "j"]

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in whole_groups(frames, keys):
            at = g[keys].to_numpy()
            cuts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(axis=1))).tolist()
            for low, high in zip(cuts, [*cuts[1:], len(g)]):
                own = g.iloc[low:high]
                side, sets = own["side"].to_numpy(), [np.frombuffer(x, np.uint64) for x in own["hashes"]]
                tree, ask = np.flatnonzero(side == own["i"].to_numpy()), np.flatnonzero(side == own["j"].to_numpy())
                a, b = set_links(own["id"].to_numpy(), sets, tree, ask, least)
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    size = F.octet_length("hashes") / 8
    return dealt(rows, ["part"], F.xxhash64("id"), limit, size).mapInPandas(check, "a long, b long").where("a < b").distinct()


def similar_groups(docs: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, locator (where the row lies), component_id (the smallest id reachable over links),
    kept (one row of each component: that of the smallest id, the first to lie there if it has several).

    Texts of equal shingle sets link; each such class is searched once, by one of its texts. Others link at a shingle
    similarity of `least` or more: the search misses a small share of the pairs near that similarity, and of the texts
    that what it finds connects all pairs are decided exactly. Null texts count as empty; texts of fewer than `width`
    words have one shingle of all their words, and texts without words link. Rows without an id, and each row of an id
    that has several, take part by their text; a component none of whose rows has an id has a null component_id and keeps
    the row that lies first. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    docs = in_files(docs, "similar-input")
    docs = docs.select("doc_id", locator(docs).alias("locator"), text_or_empty("text").alias("text"))

    @F.pandas_udf("array<long>")
    def described(texts: pd.Series) -> pd.Series:
        sets = [shingle_hashes(t, width) for t in texts]
        return pd.Series([[class_of(s.tobytes()), *wide_print(s), *shard_keys(s)] for s in sets])

    prints = docs.select("doc_id", "locator", described("text").alias("x"))
    prints = save(prints.select("doc_id", "locator", F.col("x")[0].alias("same"), F.slice("x", 2, LONGS + BANDS).alias("x")), "similar-prints")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "locator")
    classes = save(prints.groupBy("same").agg(F.min(row).alias("first"), F.min("x").alias("x")), "similar-classes")
    found = candidates(classes.select(F.col("same").alias("id"), F.col("x")[0].alias("f0"), F.col("x")[1].alias("f1"), F.slice("x", LONGS + 1, BANDS).alias("shards")))
    parts = components(found)
    parts = parts.union(parts.select("component", "component").distinct()).toDF("same", "part")
    asked = save(classes.join(parts, "same").select("part", F.col("same").alias("id"), F.col("first.locator").alias("locator")), "similar-parts")
    # only texts that may be asked for are shuffled
    texts = maybe_in(docs, asked, "locator", "maybe").where("maybe").select("locator", "text").join(asked, "locator")
    joined = components(similar_links(texts, least, width))
    forget(asked)
    named = classes.join(joined, F.col("same") == F.col("node"), "left").select("same", "first", F.coalesce("component", "same").alias("part"))
    label = save(named.join(named.groupBy("part").agg(F.min("first").alias("best")), "part").select("same", "best"), "similar-labels")
    rows = prints.select("doc_id", "locator", "same").join(label, "same")
    return rows.select("doc_id", "locator", F.col("best.doc_id").alias("component_id"), (F.col("best.locator") == F.col("locator")).alias("kept"))


def drop_similar(docs: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """docs with one row of each group, by the rules of similar_groups(); columns as they were, whatever their names."""
    docs = in_files(docs, "similar-input")
    at, maybe = free_name(docs, "locator"), free_name(docs, "maybe")
    gone = save(similar_groups(docs, least, width).where("not kept").select(F.col("locator").alias(at)), "similar-gone")
    rows = maybe_in(docs.withColumn(at, locator(docs)), gone, at, maybe)
    left = rows.where(F.col(maybe)).join(gone, at, "left_anti")
    return rows.where(~F.col(maybe)).select(*docs.columns).union(left.select(*docs.columns))
