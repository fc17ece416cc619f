"""Embedding near-deduplication by a pivot-permutation index.

Each vector is described by its nearest reference points, in order. Inverted lists by reference point bring vectors
together; two vectors of a list are candidates if they share enough reference points. A pair is looked at only in the list
of the first point it shares. Lists above a limit are cut by the second point that a pair shares, and what is then still too
long is dealt in pairs of blocks, so none is cut short and no task holds more than two blocks.

Postings carry no vectors but codes of one byte a component, with the length of what the code leaves out. That bounds how far
a cosine of codes can lie from the true one, so most candidates are decided by their codes; the vectors of those whose bound
reaches over the threshold are fetched, and their cosines taken in double precision.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, forget, save
from .connect import components, star_links
from .simhash import dealt, whole_groups

#: Bytes of reference points that the driver and each worker hold at most, in double precision.
PIVOT_BYTES = 16 << 20


def pivot_count(vectors: int, size: int) -> int:
    """One reference point for every 40 vectors keeps the mean list length, as far as PIVOT_BYTES reaches: 32,768 points of 64
    dimensions. Beyond, lists grow and are cut by second points."""
    return min(max(16, vectors // 40), max(16, PIVOT_BYTES // (8 * max(size, 1))))


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of unit vectors, one signed byte a component, the value of a code's unit, and how far code and vector lie apart."""
    unit = np.abs(x).max(axis=1) / 127
    code = np.rint(x / unit[:, None]).astype(np.int8)
    return code, unit, np.sqrt(((x - code * unit[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12


def bounds(a: tuple, b: tuple, first: np.ndarray, second: np.ndarray, block: int = 65536) -> tuple[np.ndarray, np.ndarray]:
    """The cosines of pairs (first of a, second of b) by their codes, and how far from the true ones they may lie at most."""
    (x, u, r), (y, v, q) = a, b
    r, q = r[first], q[second]
    dots = [np.einsum("ij,ij->i", x[first[c : c + block]].astype(np.int32), y[second[c : c + block]].astype(np.int32)) for c in range(0, len(first), block)]
    about = np.concatenate([np.empty(0), *dots]) * (u[first] * v[second])  # the same in every task: whole numbers, one product
    return about, r + q + 3 * r * q + 1e-9


def near_vectors(vectors: DataFrame, threshold: float = 0.9, nearest: int = 8, shared: int = 2, limit: int = 2048, seed: int = 3) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of different
    lengths do not link. Copies of a vector link with each other and are searched once, as one class with a count;
    repeated rows count as copies. No rows give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    sound = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    own = vectors.select("vec_id", "embedding", F.when(sound, F.xxhash64("embedding")).alias("h"))
    unnumbered = save(own.where("h is not null").groupBy("h", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    # equal hashes of different vectors would clash, so each class is numbered
    classes = save(unnumbered.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    forget(unnumbered)
    count, size = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    drawn = first_by_hash(classes.select("h", "rep", "embedding"), ["h", "rep"], pivot_count(count, size or 1), seed).select("embedding").collect()
    by_size: dict[int, list] = {}
    for i, r in enumerate(drawn):  # a bounded, seeded draw; every vector is indexed
        by_size.setdefault(len(r["embedding"]), []).append((i, r["embedding"]))
    pivots = spark.sparkContext.broadcast({d: _apart(np.array([i for i, _ in x], np.int32), _unit(np.array([p for _, p in x], float))) for d, x in by_size.items()})

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, part in frame.groupby(frame["embedding"].map(len)):
                x = _unit(np.stack(part["embedding"].to_numpy()).astype(float))
                # a dimension that the draw missed has one list of its own, by a number below all pivots
                ids, p = pivots.value.get(size, (np.array([-int(size)], np.int32), np.ones((1, size))))
                k = min(nearest, len(ids))
                for a in range(0, len(part), 1024):
                    y = x[a : a + 1024]
                    near = np.argsort(-(y @ p.T), axis=1, kind="stable")[:, :k] if len(ids) <= 64 else _top(y @ p.T, k)
                    code, unit, rest = coded(y)
                    yield pd.DataFrame({"id": part["id"].iloc[a : a + 1024], "n": part["n"].iloc[a : a + 1024], "order": ids[near].tolist(), "code": [c.tobytes() for c in code], "unit": unit, "rest": rest})

    told = save(classes.select("id", "n", "embedding").mapInPandas(describe, "id long, n long, order array<int>, code binary, unit double, rest double"), "vector-orders")
    long = {r["pivot"] for r in told.select(F.explode("order").alias("pivot")).groupBy("pivot").count().where(F.col("count") > limit).select("pivot").collect()}  # no more than there are pivots
    lists = spark.sparkContext.broadcast(np.array(sorted(long), np.int32))

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, part in frame.groupby(frame["order"].map(len)):
                order = np.stack(part["order"].to_numpy())
                lined = np.sort(order, axis=1)
                rows, pivot, second = [], [], []
                for i in range(k):
                    cut = np.isin(lined[:, i], lists.value) & (k > 1)
                    whole = np.flatnonzero(~cut)
                    rows, pivot, second = [*rows, whole], [*pivot, lined[whole, i]], [*second, np.full(len(whole), ALL)]
                    for j in range(i + 1, k):
                        at = np.flatnonzero(cut)
                        rows, pivot, second = [*rows, at], [*pivot, lined[at, i]], [*second, lined[at, j]]
                rows, pivot, second = np.concatenate(rows), np.concatenate(pivot), np.concatenate(second)
                pack = lambda c, o, u, r: np.array([u, r]).tobytes() + o.astype("<i4").tobytes() + c
                packed = np.array([pack(c, o, u, r) for c, o, u, r in zip(part["code"], order, part["unit"], part["rest"])], object)
                ids, n = part["id"].to_numpy(), part["n"].to_numpy()
                for a in range(0, len(rows), 20_000):
                    at = rows[a : a + 20_000]
                    yield pd.DataFrame({"pivot": pivot[a : a + 20_000], "second": second[a : a + 20_000], "id": ids[at], "n": n[at], "k": np.full(len(at), k, np.int32), "packed": packed[at]})

    postings = told.mapInPandas(post, "pivot int, second int, id long, n long, k int, packed binary")
    keys = ["pivot", "second", "i", "j"]

    def compared(frame: pd.DataFrame):
        """For each group: its rows on both sides, pairs of their places, cosines by codes and bounds."""
        for (pivot, second, i, j), g in frame.groupby(keys, sort=False):
            # codes of one group may differ in length only if their reference points do not meet; those never pair
            for _, g in g.groupby([g["k"], g["packed"].map(len)]):
                side = g["side"].to_numpy()
                a, b = g[side == i], g[side == j]
                if not len(a) or not len(b):
                    continue
                k = int(g["k"].iloc[0])
                read = lambda s: _unpacked(s["packed"], k)
                (oa, *ca), (ob, *cb) = read(a), read(b)
                first, other = _candidates(oa, ob, pivot, second, shared, i == j)
                if len(first):
                    yield (pivot, second, i, j), a, b, first, other, *bounds(tuple(ca), tuple(cb), first, other)

    def links_of(a: pd.DataFrame, b: pd.DataFrame, first: np.ndarray, other: np.ndarray) -> pd.DataFrame:
        ia, ib, na, nb = a["id"].to_numpy(), b["id"].to_numpy(), a["n"].to_numpy(), b["n"].to_numpy()
        who, at = np.unique(np.concatenate([ia[first], ib[other]]), return_inverse=True)
        links = np.bincount(at, weights=np.concatenate([nb[other], na[first]]).astype(float)).astype(np.int64)
        u, w = star_links(ia[first], ib[other])
        return pd.DataFrame({"a": np.concatenate([who, u]), "b": np.concatenate([np.full(len(who), -1), w]), "links": np.concatenate([links, np.zeros(len(u), np.int64)])})

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links that the codes decide, and (with links of -1) the groups' members whose vectors are asked for."""
        for frame in whole_groups(frames, keys):
            for group, a, b, first, other, about, far in compared(frame):
                sure, open_ = about - far >= threshold, np.abs(about - threshold) < far
                if sure.any():
                    yield links_of(a, b, first[sure], other[sure]).assign(pivot=0, second=0, i=0, j=0, side=0)
                sides = [(group[2], a, np.append(first[open_], other[open_]))] if group[2] == group[3] else [(group[2], a, first[open_]), (group[3], b, other[open_])]
                for side, rows, at in sides:
                    asked = rows["id"].to_numpy()[np.unique(at)]
                    if len(asked):
                        yield pd.DataFrame({"a": asked, "b": np.full(len(asked), -1), "links": np.full(len(asked), -1)}).assign(pivot=group[0], second=group[1], i=group[2], j=group[3], side=side)

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links of the pairs that the codes leave open, by the vectors."""
        for frame in whole_groups(frames, keys):
            for group, a, b, first, other, about, far in compared(frame):
                open_ = np.abs(about - threshold) < far
                first, other = first[open_], other[open_]
                if not len(first):
                    continue
                x, y = (_unit(np.stack(s["embedding"].to_numpy()).astype(float)) for s in (a, b))
                ok = np.concatenate([np.einsum("ij,ij->i", x[first[c : c + 65536]], y[other[c : c + 65536]]) >= threshold for c in range(0, len(first), 65536)])
                if ok.any():
                    yield links_of(a, b, first[ok], other[ok])

    decided = save(dealt(postings, ["pivot", "second"], F.col("id"), limit).mapInPandas(decide, "a long, b long, links long, pivot int, second int, i int, j int, side int"), "vector-decided")
    asked = decided.where("links = -1").select(F.col("a").alias("id"), *keys, "side")
    whole = asked.join(classes.select("id", "n", "embedding"), "id").join(told.select("id", F.size("order").alias("k"), _packed(told).alias("packed")), "id")
    open_ = whole.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(settle, "a long, b long, links long")
    found = save(decided.where("links >= 0").select("a", "b", "links").union(open_), "vector-links")
    forget(decided)
    parts = components(found.where("b >= 0").select("a", "b"))
    links = found.where("b < 0").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    own_parts = classes.join(parts, classes["id"] == parts["node"], "left").select("id", "h", "embedding", "rep", "n", F.coalesce("component", "id").alias("part"))
    least = own_parts.groupBy("part").agg(F.min("rep").alias("component_id"))
    label = save(own_parts.join(least, "part").join(links, "id", "left").select("h", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "vector-labels")
    alone = own.where("h is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = own.where("h is not null").join(label, ["h", "embedding"]).select("vec_id", "n_links", "component_id").union(alone)
    return rows.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: Second point of lists that are not cut.
ALL = -(1 << 31)


def _packed(told: DataFrame):
    """What post() packs, of rows that are few."""

    @F.pandas_udf("binary")
    def of(order: pd.Series, code: pd.Series, unit: pd.Series, rest: pd.Series) -> pd.Series:
        return pd.Series([np.array([u, r]).tobytes() + np.asarray(o, "<i4").tobytes() + c for o, c, u, r in zip(order, code, unit, rest)], dtype=object)

    return of("order", "code", "unit", "rest")


def _unpacked(packed: pd.Series, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, code, unit, rest) of rows of one length."""
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    two = raw[:, :16].copy().view("<f8")
    return raw[:, 16 : 16 + 4 * k].copy().view("<i4"), raw[:, 16 + 4 * k :].view(np.int8), two[:, 0], two[:, 1]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares of very small or large components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _apart(ids: np.ndarray, p: np.ndarray, most: float = 0.8, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The reference points without those that lie close to an earlier one: many points of one dense group would order
    its members by chance."""
    kept = np.empty((0, p.shape[1]))
    at: list[int] = []
    for a in range(0, len(p), block):
        own = np.arange(a, min(a + block, len(p)))
        own = own[(p[own] @ kept.T < most).all(axis=1)]
        near, chosen = p[own] @ p[own].T >= most, []
        for i in range(len(own)):
            if not near[i, chosen].any():
                chosen.append(i)
        at += own[chosen].tolist()
        kept = p[at]
    return ids[at], kept


def _top(s: np.ndarray, k: int) -> np.ndarray:
    at = np.argpartition(-s, k, axis=1)[:, :k]
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable"), 1)


def _candidates(p: np.ndarray, q: np.ndarray, pivot: int, second: int, shared: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of p and q that share at least `shared` pivots (or all they have), of which `pivot` is the first and, in a
    cut list, `second` the next."""
    count, early = np.zeros((len(p), len(q)), np.uint8), np.zeros((len(p), len(q)), bool)
    before = second if second != ALL else pivot
    for i in range(p.shape[1]):
        for j in range(q.shape[1]):
            eq = p[:, i, None] == q[None, :, j]
            count += eq
            early |= eq & ((p[:, i] < before) & (p[:, i] != pivot))[:, None]
    ok = (count >= min(shared, p.shape[1])) & ~early
    return np.nonzero(np.triu(ok, 1) if same else ok)
