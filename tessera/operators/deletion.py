"""What goes with a row that is deleted, over a graph of references between tables, and what keeps it.

A reference says what becomes of the rows that refer to a deleted one: they go with it (cascade), keep it from being deleted
(block), or lose the reference (clear). An owned reference points the other way: what only deleted rows refer to goes too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.store import saved


@dataclass(frozen=True)
class Reference:
    table: str
    column: str
    to: str  # the table whose key the column holds
    rule: str  # cascade, block, clear or own


@dataclass(frozen=True)
class Closure:
    tables: dict[str, DataFrame]  # what is left
    gone: dict[str, DataFrame]  # keys of what went, with the root that it went with
    blocked: DataFrame  # (root, by): roots that stay, with a table that keeps them


def delete(tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], start: str, roots: DataFrame) -> Closure:
    """Delete the rows of table `start` whose keys are in roots (key), unless something keeps them.

    All that a root would take along is found first, by joins level by level until nothing is new; a root stays, with all of
    that, if a row that is not itself to go with the same root refers to any of it by a blocking reference. Rows that several roots
    reach go with any of them that goes. Keys must be unique and not null; a null reference refers to nothing; roots that
    are in no table are passed over. Afterwards no reference to a deleted row is left, whatever its rule.
    """
    unknown = {r.rule for r in references} - {"cascade", "block", "clear", "own"}
    if unknown or {r.table for r in references} | {r.to for r in references} | {start} > set(tables):
        raise ValueError(f"unknown rules {sorted(unknown)} or tables")
    spark = roots.sparkSession
    key = lambda t: F.col(keys[t]).alias("key")
    first = tables[start].select(key(start)).join(roots.select(F.col(roots.columns[0]).alias("key")).distinct(), "key", "left_semi")
    found: dict[str, DataFrame] = {start: saved(first.select(F.col("key").alias("root"), "key"), "gone")}
    fresh = dict(found)
    while fresh:
        reached: dict[str, DataFrame] = {}
        for r in references:
            if r.rule == "cascade" and r.to in fresh:
                rows = tables[r.table].select(key(r.table), F.col(r.column).alias("__up")).join(fresh[r.to].select("root", F.col("key").alias("__up")), "__up").select("root", "key")
                reached[r.table] = reached[r.table].unionByName(rows) if r.table in reached else rows
        fresh = {}
        for name, rows in reached.items():
            rows = rows.distinct()
            new = saved(rows.join(found[name], ["root", "key"], "left_anti") if name in found else rows, "gone")
            if not new.isEmpty():
                fresh[name] = new
                found[name] = saved(found[name].unionByName(new), "gone") if name in found else new
    blocked = spark.createDataFrame([], first.schema).select(F.col("key").alias("root"), F.lit("").alias("by"))
    for r in references:
        if r.rule == "block" and r.to in found:
            rows = tables[r.table].select(key(r.table), F.col(r.column).alias("__up")).join(found[r.to].select("root", F.col("key").alias("__up")), "__up")
            rows = rows.join(found[r.table], ["root", "key"], "left_anti") if r.table in found else rows
            blocked = blocked.unionByName(rows.select("root", F.lit(r.table).alias("by")).distinct())
    blocked = saved(blocked.distinct(), "blocked")
    gone = {name: saved(rows.join(blocked, "root", "left_anti"), "gone") for name, rows in found.items()}
    # owned rows go with the last that refers to them; each of these may own others
    waiting = [r for r in references if r.rule == "own"]
    while waiting:
        ready = [r for r in waiting if not any(o.to == r.table for o in waiting)] or waiting[:1]
        for name in {r.to for r in ready}:
            own = [r for r in ready if r.to == name]
            held = lost = None
            for r in own:
                refs = tables[r.table].where(F.col(r.column).isNotNull()).select(key(r.table), F.col(r.column).alias("__to"))
                went = refs.join(gone[r.table].select("root", "key"), "key") if r.table in gone else None
                left = refs.join(gone[r.table].select("key").distinct(), "key", "left_anti") if r.table in gone else refs
                held = left.select("__to") if held is None else held.union(left.select("__to"))
                if went is not None:
                    lost = went.select("root", "__to") if lost is None else lost.union(went.select("root", "__to"))
            if lost is not None:
                other = [r for r in references if r.to == name and r.rule in ("block", "cascade", "clear")]
                for r in other:  # whoever else refers to it keeps it
                    refs = tables[r.table].where(F.col(r.column).isNotNull()).select(key(r.table), F.col(r.column).alias("__to"))
                    held = held.union((refs.join(gone[r.table].select("key"), "key", "left_anti") if r.table in gone else refs).select("__to"))
                rows = lost.join(held, "__to", "left_anti").groupBy("__to").agg(F.min("root").alias("root")).select("root", F.col("__to").alias("key"))
                gone[name] = saved(gone[name].unionByName(rows).distinct() if name in gone else rows, "gone")
        waiting = [r for r in waiting if r not in ready]
    left = {}
    for name, rows in tables.items():
        rest = rows.join(gone[name].select(F.col("key").alias(keys[name])).distinct(), keys[name], "left_anti") if name in gone else rows
        for r in references:
            if r.table == name and r.rule == "clear" and r.to in gone:
                lost = gone[r.to].select(F.col("key").alias("__lost")).distinct()
                rest = rest.join(lost, rest[r.column] == F.col("__lost"), "left").withColumn(r.column, F.when(F.col("__lost").isNull(), rest[r.column])).drop("__lost")
        left[name] = rest.select(rows.columns)
    return Closure(left, gone, blocked)
