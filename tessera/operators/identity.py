"""Bibliographic identity: records that share an identifier."""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from operator import itemgetter
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def first_match(rows: DataFrame, key: str, identifiers: list[str]) -> DataFrame:
    """(key, first, conflict): the smallest key with any identifier in common, and whether another identifier says otherwise.

    Each identifier is one aggregate and one equi-join; null identifiers match nothing.
    """
    out = rows
    for name in identifiers:
        least = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(key).alias(f"__{name}"))
        out = out.join(least, name, "left")
    firsts = [F.coalesce(F.col(f"__{n}"), F.col(key)) for n in identifiers]
    first = F.least(*firsts) if len(firsts) > 1 else firsts[0]
    differ = reduce(lambda a, b: a | b, (f != firsts[0] for f in firsts[1:]), F.lit(False))
    return out.select(key, first.alias("first"), (differ & (first < F.col(key))).alias("conflict"))


def merge_in_order(rows: DataFrame, group: str, order: str, identifiers: list[str], native: str | None = None) -> DataFrame:
    """rows with kept and identity_conflict, in the order given within a group (one search, some dozens of rows): a record goes
    if an earlier kept one shares an identifier and no other identifier of the two disagrees; if one does, both stay, flagged.
    Records without identifiers are told apart by `native`, or not at all."""
    schema = rows.withColumns({"kept": F.lit(True), "identity_conflict": F.lit(False)}).schema
    keys = [*identifiers, *([native] if native else [])]

    def merged(values: list[tuple]) -> tuple[list[bool], set[int]]:
        holder: dict[tuple, int] = {}
        kept, flagged = [], set()
        for i, row in enumerate(values):
            own = [(k, v) for k, v in enumerate(row[: len(identifiers)]) if v is not None and v != ""] or [(k, v) for k, v in enumerate(row) if v is not None]
            first = next((holder[x] for x in own if x in holder), None)
            clash = first is not None and any(v and w and v != w for v, w in zip(row[: len(identifiers)], values[first]))
            kept.append(first is None or clash)
            if clash:
                flagged |= {i, first}
            elif first is None:
                holder.update(dict.fromkeys(own, i))
        return kept, flagged

    kinds, at, places = to_arrow_schema(schema), rows.columns.index(group), [rows.columns.index(k) for k in keys]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, own in groupby((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), itemgetter(at)):
            own = list(own)
            kept, flagged = merged([tuple(row[k] for k in places) for row in own])
            out += [(*row, k, i in flagged) for i, (row, k) in enumerate(zip(own, kept))]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds.types)], schema=kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds.types)], schema=kinds)

    # groups lie one after the other in a task: a call of Python for each would cost more than its rows
    return rows.repartition(F.col(group)).sortWithinPartitions(group, F.col(order).asc_nulls_last()).mapInArrow(task, schema)


def upsert(known: DataFrame, new: DataFrame, identifiers: list[str], key: str = "id") -> DataFrame:
    """What becomes of new records (ref, identifiers) beside known ones (key, identifiers): one row per new record with the
    known key it matches by any identifier, its state (inserted, updated, conflict) and the identifiers that the record then
    has. One that matches several known records, or one whose other identifiers differ, is a conflict and changes nothing."""
    exploded = lambda x, own: x.select(own, F.explode(F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}:"), F.col(n).cast("string"))) for n in identifiers)))).alias("k"))
    met = exploded(new, "ref").join(exploded(known, key), "k").groupBy("ref").agg(F.min(key).alias(key), F.count_distinct(key).alias("matches"))
    old = known.select(F.col(key).alias("__key"), *(F.col(n).alias(f"__{n}") for n in identifiers))
    rows = new.join(met, "ref", "left").join(old, F.col(key) == F.col("__key"), "left")
    differ = reduce(lambda a, b: a | b, (F.coalesce(F.col(n) != F.col(f"__{n}"), F.lit(False)) for n in identifiers))
    state = F.when(F.col(key).isNull(), "inserted").when(differ | (F.col("matches") > 1), "conflict").otherwise("updated")
    filled = [F.when(state == "conflict", F.col(f"__{n}")).otherwise(F.coalesce(f"__{n}", n)).alias(n) for n in identifiers]
    return rows.select("ref", key, state.alias("state"), *filled)
