"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. A source takes whole passes over its documents and an even share of each
length, and for the budget that then remains a bounded-knapsack dynamic programme over changes to these counts finds the
nearest sum there is; documents are then selected by length count in the order of a seeded hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, in_files, locator, save, text_or_empty

WEIGHTS, MOST = (5, 2, 1), 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), sources by code point, null last.

    The targets are min(most x size, level x weight) for the level at which they add up to all sizes: what resharing
    the excess by weight comes to. One row per source, of which only running sums are kept.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    own = sizes.withColumn("weight", weight).withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    own = own.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(most * F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # sources are capped in the order of their ratio; the level is that of the first that needs no cap
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"], F.lit(float("inf")))
    return own.withColumn("target", F.least(F.lit(float(most)) * F.col("source_size"), level * F.col("weight"))).select("source", "source_size", "target")


def fill(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum comes as near to budget as any choice does, from below if two do.

    First the same share of each length, then, longest first, what still fits. What then lacks is met by taking more of
    some lengths and less of others: a bounded knapsack over such changes, as bit sets of the sums that they reach, at
    first of few copies of the shortest lengths, at last of all. It ends early once no choice can be nearer. A nearest
    choice differs from any start near the budget by at most 2 * longest + 2 documents: in a longer list of changes, put in
    an order that keeps their sums within the longest length, a sum comes twice, and what lies between can be left
    out. So no more copies of a length need be tried, whatever the budget.
    """
    sizes, counts = [int(x) for x in length], [int(x) for x in count]
    total = sum(map(int.__mul__, sizes, counts))
    if total <= budget:
        return count.copy()
    # Python's integers: a count times a budget of a large corpus passes 64 bits
    take = [c * budget // total for c in counts]
    left = budget - sum(map(int.__mul__, sizes, take))
    short = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    for i in reversed(short):
        n = min(counts[i] - take[i], left // sizes[i])
        take[i] += n
        left -= n * sizes[i]
    step = math.gcd(*sizes)
    least = min(budget % step, -budget % step)  # sums are its multiples
    most = 2 * sizes[short[-1]] + 2
    for lengths, copies in ((16, 4), (64, 8), (256, 16), (len(sizes), 2), (len(sizes), most)):
        some = short[:lengths]
        changes = [(i, -n) for i in some for n in _chunks(min(take[i], copies))] + [(i, n) for i in some for n in _chunks(min(counts[i] - take[i], copies))]
        weights = [sizes[i] * n for i, n in changes]
        sums, low = _reached(weights, left + sizes[short[-1]], left)  # beyond one more document, one less is nearer
        gap, at = min(((abs(left - x), x > left, x) for x in _around(sums, low, left)), default=(abs(left), False, 0))[::2]
        if gap <= least or (lengths, copies) == (len(sizes), most):
            for k in _used(weights, at):
                take[changes[k][0]] += changes[k][1]
            break
    return np.array(take, np.int64)


def _chunks(n: int) -> list[int]:
    """Numbers whose sums of some are all of 0 to n: 1, 2, 4 ... and the rest."""
    out = []
    while n > 0:
        out.append(min(1 << len(out), n))
        n -= out[-1]
    return out


def _reached(weights: list[int], high: int, stop: int | None = None) -> tuple[int, int]:
    """The sums up to high of some of the weights, those below zero first, as a bit set whose bit k stands for low + k, and low.
    It ends once `stop` is reached."""
    low = sum(w for w in weights if w < 0)
    sums, mask = 1 << -low, (1 << max(high - low + 1, 1 - low)) - 1
    for w in weights:
        sums |= sums << w & mask if w > 0 else sums >> -w
        if stop is not None and stop >= low and sums >> (stop - low) & 1:
            break
    return sums, low


def _around(sums: int, low: int, x: int) -> list[int]:
    """The sums next to x: the greatest up to x and the least above."""
    at = max(x - low + 1, 0)
    below, above = sums & ((1 << at) - 1), sums >> at
    return [*([low + below.bit_length() - 1] if below else []), *([low + at + (above & -above).bit_length() - 1] if above else [])]


def _used(weights: list[int], total: int) -> list[int]:
    """Places of some weights that add up to total, which their sums reach: halves of the list are split by what each adds, so no
    more than two bit sets are held at a time."""
    if len(weights) <= 1:
        return [0] if weights and total else []
    half = len(weights) // 2
    low_a, low_b = (sum(w for w in x if w < 0) for x in (weights[:half], weights[half:]))
    (a, _), (b, _) = _reached(weights[:half], total - low_b), _reached(weights[half:], total - low_a)
    first, last = max(low_a, total - (low_b + b.bit_length() - 1)), min(low_a + a.bit_length() - 1, total - low_b)
    own = _bits(a, first - low_a, last - low_a)
    other = _bits(b, total - last - low_b, total - first - low_b)[::-1]
    x = first + int(np.argmax(own & other))
    return [*_used(weights[:half], x), *(half + k for k in _used(weights[half:], total - x))]


def _bits(sums: int, first: int, last: int) -> np.ndarray:
    """Bits first to last of a bit set, as booleans."""
    n = last - first + 1
    raw = ((sums >> first) & ((1 << n) - 1)).to_bytes((n + 7) // 8, "little")
    return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=n).astype(bool)


def mix(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = 50_000, keep: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, times, taken (words, repeats counted).

    The uses of a length beyond whole passes go round its documents in their order, that of a hash of id and text. Null
    texts and texts without words have size 0 and take nothing. Null sources are one source. Repeated rows count
    each; which of equal rows is taken is left open. A length that holds very many documents of a source is selected in
    blocks of the hash range, so no task orders more than about `block` of them, besides rows that agree in id and text.
    No rows give no rows; other columns are ignored but for `keep`, which names one to be kept.
    """
    kept = [keep] if keep else []
    own = docs.select("doc_id", "source", word_count(text_or_empty("text")).alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("order"), *kept)
    own = save(own.withColumn("__n", F.monotonically_increasing_id()), "mix-sizes")
    counts = save(own.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    targets = source_targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        size, n = frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
        whole, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        extra = np.zeros(len(size), np.int64)
        if (size > 0).any():
            extra[size > 0] = fill(size[size > 0], n[size > 0] * most, round(target))  # whole passes are shares of all lengths
        return pd.DataFrame({"source": frame["source"], "size": size, "n": n, "source_size": whole, "target": target, "extra": extra})

    t = targets.withColumnRenamed("source", "__s")
    joined = counts.join(t, F.col("source").eqNullSafe(F.col("__s"))).select("source", "size", "n", "source_size", "target")
    plans = save(joined.groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, extra long"), "mix-plan")
    p = plans.select(F.col("source").alias("__s"), F.col("size").alias("__l"), "n", "source_size", "target", "extra")
    every = own.join(p, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__l")))
    rows, empty = every.where("size > 0"), every.where("size = 0")  # texts without words are never taken, so none is ordered
    blocks = F.greatest(F.ceil(F.col("n") / block), F.lit(1))
    unit = F.col("order").cast("double") / F.lit(2.0**64) + 0.5  # 0 to 1, ascending with the hash
    rows = rows.withColumn("__b", F.least(F.floor(unit * blocks), blocks - 1).cast("long"))
    key = ["source", "size", "__b"]
    sizes = rows.where("n > %d" % block).groupBy(*key).agg(F.count("*").alias("__c"))
    before = sizes.select(*(F.col(k).alias(f"_{k}") for k in key), (F.sum("__c").over(Window.partitionBy("source", "size").orderBy("__b")) - F.col("__c")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("order", "doc_id", "__n"))
    rows = rows.withColumn("__r", rank).join(before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("__b") == F.col("___b")), "left")
    place = F.coalesce("__before", F.lit(0)) + F.col("__r")
    times = F.floor(F.col("extra") / F.col("n")) + (place <= F.col("extra") % F.col("n")).cast("long")
    told = lambda df, x: df.select("doc_id", "source", "size", "source_size", "target", x.cast("long").alias("times"), (x * F.col("size")).cast("long").alias("taken"), *kept)
    return told(rows, times).unionByName(told(empty, F.lit(0)))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it; columns as they were, whatever their names.

    Rows are told apart by where they lie, so repeated rows of an id, and rows without one, each have their own uses.
    Rows without words are never taken; no rows give no rows.
    """
    docs = in_files(docs, "mix-input")
    at, times = free_name(docs, "locator"), free_name(docs, "times")
    used = mix(docs.select("doc_id", "source", "text", locator(docs).alias("__at")), keep="__at").where("times > 0").select(F.col("__at").alias(at), F.col("times").cast("int").alias(times))
    rows = docs.withColumn(at, locator(docs)).join(used, at)
    again = free_name(rows, "again")
    return rows.withColumn(again, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*docs.columns)
