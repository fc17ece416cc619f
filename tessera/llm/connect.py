"""Connected components over links too many for one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, save


def star_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components, at most one per id: each id to the smallest one of its component."""
    if not len(a):
        return a, b
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    out = label != np.arange(len(ids))
    return ids[out], ids[label[out]]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), component being the smallest id reachable.

    Alternating large-star and small-star passes; each round is written to the shared folder, so lineage stays
    short and only four numbers a round reach the driver. A round's table is removed once the next one is written.
    Self-links and nulls are ignored; no links give no rows.
    """
    edges = save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count("*"), *(F.expr(f"bit_xor(xxhash64(u, v, {k}))") for k in range(3))).first()
        if now == seen or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        before, edges = edges, save(small.select("e.*").where("u <> v").distinct(), "links")
        forget(before)
