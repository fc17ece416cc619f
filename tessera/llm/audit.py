"""Filter interaction audit: what each filter removes at each step of every order in which the filters can be applied.

The orders of the filters form a trie. It is walked depth first; a node's documents are those of its parent without the
ones that the filter on the edge removes, persisted while the node's subtree is walked. Prefixes that hold the same
filters in another order leave the same documents, so a node is made and counted once for each set of filters (32 of
the 326 nodes of five filters) and found again by its set. Each node counts, for every filter that may come next, the
documents that it really removes there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, fresh_path, save, text_or_empty

FILTERS = "ABCDE"


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A..E, good, toxic) for each row of docs: its source, which filters it fails, what labels say of it.

    A: under 200 words; B: fewer than half of the words distinct; C: more than 2 % of the characters are A-Z; D: holds one
    of #$%&*|; E: its text is that of a row with a smaller id, by its SHA-256. Null texts count as empty, null sources as
    the empty text. A row without an id is neither before nor after another; rows of one id do not fail E for each other.
    A document is good (toxic) if any label row of its id says so.
    """
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_or_empty("text").alias("t"))
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    own = own.select("doc_id", "part", F.sha2("t", 256).alias("digest"), F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("different"), F.regexp_count("t", F.lit("[A-Z]")).alias("caps"), F.length("t").alias("chars"), F.col("t").rlike("[#$%&*|]").alias("D"))
    own = own.select("doc_id", "part", "digest", (F.col("words") < 200).alias("A"), (100 * F.col("different").cast("long") < 50 * F.col("words").cast("long")).alias("B"), (100 * F.col("caps").cast("long") > 2 * F.col("chars").cast("long")).alias("C"), "D")
    own = save(own, "audit-flags")
    first = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    said = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")).where("good or toxic")
    rows = own.join(first, "digest", "left").join(said, "doc_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("part", "A", "B", "C", "D", no(F.col("doc_id") > F.col("first")).alias("E"), no(F.col("good")).alias("good"), no(F.col("toxic")).alias("toxic"))


def walk(rows: DataFrame, filters: Sequence[str], count) -> Iterator[DataFrame]:
    """count(rows left, set of filters applied) of each set of filters, in the order of a depth-first walk of the trie.

    Rows of a node are persisted on disk and in memory while its subtree is walked, so no more of them are kept at a time
    than there are filters. What a lost executor held is computed again from rows.
    """
    met: set[frozenset[str]] = set()

    def at(left: DataFrame, done: frozenset[str]) -> Iterator[DataFrame]:
        met.add(done)
        yield count(left, done)
        for f in filters:
            if f not in done and done | {f} not in met:
                child = left.where(~F.col(f)).persist(StorageLevel.MEMORY_AND_DISK)
                yield from at(child, done | {f})
                child.unpersist()

    yield from at(rows, frozenset())


def edges(rows: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row per part and set of filters (a bit mask) that left it documents: left, and for every filter f not in the set
    removed_f, good_f and toxic_f; other filters' columns are null. rows is a saved table with a boolean for each filter."""
    bits = {f: 1 << i for i, f in enumerate(filters)}
    folder = fresh_path(rows.sparkSession, "audit-nodes")
    one = lambda c: F.count(F.when(c, 1))

    def count(left: DataFrame, done: frozenset[str]) -> None:
        told = [F.count("*").alias("left")]
        for f in filters:
            kinds = {"removed": F.col(f), "good": F.col(f) & F.col("good"), "toxic": F.col(f) & F.col("toxic")}
            told += [(one(c) if f not in done else F.lit(None).cast("long")).alias(f"{k}_{f}") for k, c in kinds.items()]
        left.groupBy("part").agg(*told).coalesce(1 + len(done) // len(filters)).write.parquet(f"{folder}/mask={sum(bits[f] for f in done)}")

    for _ in walk(rows, filters, count):
        pass
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("left", T.LongType()), *(T.StructField(f"{k}_{f}", T.LongType()) for f in filters for k in ("removed", "good", "toxic")), T.StructField("mask", T.IntegerType())])
    return rows.sparkSession.read.schema(schema).parquet(folder)


def audit(rows: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, zeros included: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    rows has part, good, toxic and a boolean for each filter, named by one letter, that says whether the row fails it. No
    rows give no rows; repeated rows count each; other columns are ignored.
    """
    spark = rows.sparkSession
    filters = list(filters)
    rows = save(rows.select("part", *filters, "good", "toxic"), "audit-rows")
    nodes = save(edges(rows, filters), "audit-edges")
    fails = [F.count(F.when(F.col(f), 1)).alias(f"fails_{f}") for f in filters]
    only = [F.count(F.when(reduce(Column.__and__, (F.col(g) if g == f else ~F.col(g) for g in filters)), 1)).alias(f"only_{f}") for f in filters]
    parts = save(rows.groupBy("part").agg(*fails, *only), "audit-parts")
    bits = {f: 1 << i for i, f in enumerate(filters)}
    steps = [("".join(o), k + 1, f, sum(bits[g] for g in o[:k]), sum(bits[g] for g in o[: k + 1])) for o in permutations(filters) for k, f in enumerate(o)]
    trie = spark.createDataFrame(steps, "filter_order string, step int, filter string, before int, after int")

    def each(kind: str) -> Column:
        return F.element_at(F.create_map(*(x for f in filters for x in (F.lit(f), F.col(f"{kind}_{f}")))), F.col("filter"))

    edge = parts.crossJoin(F.broadcast(trie.select("filter", "before", "after").distinct()))  # the trie's edges: a fixed number
    edge = edge.select("part", "filter", "before", "after", each("fails").alias("fails"), each("only").alias("unique_fails"))
    here = nodes.select("part", F.col("mask").alias("before"), *(F.col(f"{k}_{f}") for k in ("removed", "good", "toxic") for f in filters))
    edge = edge.join(here, ["part", "before"], "left").join(nodes.select("part", F.col("mask").alias("after"), "left"), ["part", "after"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    edge = edge.select("part", "filter", "before", zero(F.col("left")).alias("kept"), zero(each("removed")).alias("removed"), "fails", "unique_fails", zero(each("good")).alias("good_lost"), zero(each("toxic")).alias("toxic_lost"))
    out = edge.join(F.broadcast(trie), ["filter", "before"])
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))  # as many rows as there are orders
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over documents, by source. See flagged() and audit() for edges."""
    return audit(flagged(docs, labels))
