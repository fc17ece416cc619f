"""Ranked lists, reciprocal-rank fusion, diversity and evidence quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligible(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The retrieval gate: documents reviewed as good and not toxic; those without a review are out."""
    return docs.join(labels.where("quality = 1 and toxic = 0").select("doc_id"), "doc_id", "left_semi")


def ranked(rows: DataFrame, score: Column, most: int, key: str = "doc_id") -> DataFrame:
    """The `most` rows of highest score, ties by key, with rank from 1. Only they are numbered, after a distributed top-k."""
    top = rows.withColumn("list_score", score).where("list_score is not null").orderBy(F.desc("list_score"), key).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("list_score"), key)).cast("long"))


def fuse(lists: list[DataFrame], carry: list[str], key: str = "doc_id", k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (k + rank) over the lists, added in their order."""
    tagged = [x.select(key, *carry, "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    rows = tagged[0]
    for x in tagged[1:]:
        rows = rows.unionByName(x)
    parts = [F.min(F.when(F.col("list") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(lists))]
    own = rows.groupBy(key, *carry).agg(*parts)
    score = sum((F.coalesce(1.0 / (k + F.col(f"r{i}")), F.lit(0.0)) for i in range(1, len(lists))), F.coalesce(1.0 / (k + F.col("r0")), F.lit(0.0)))
    return own.select(key, *carry, score.alias("score"))


def diversity_cut(rows: DataFrame, per_source: int = 12, most: int = 24, key: str = "doc_id") -> DataFrame:
    """In score order, at most `per_source` rows of a source and `most` in all."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), key))
    return rows.withColumn("place", place).where(F.col("place") <= per_source).drop("place").orderBy(F.desc("score"), key).limit(most)


def evidence_quota(rows: DataFrame, most: int = 10, key: str = "doc_id") -> DataFrame:
    """Up to `most` rows: each source's quota first, then the rest in order; labels E1, E2 ... in that order."""
    counted = rows.withColumn("sources", F.size(F.collect_set("source").over(Window.partitionBy())))  # rows are few: lists are cut before
    quota = F.when(F.col("sources") <= 1, F.lit(most)).otherwise(F.ceil(F.lit(most) / F.col("sources")))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), key))
    passes = counted.withColumn("late", (place > quota).cast("int"))
    top = passes.orderBy("late", F.desc("score"), key).limit(most)
    number = F.row_number().over(Window.orderBy("late", F.desc("score"), key))
    return top.withColumn("label", F.concat(F.lit("E"), number.cast("string"))).drop("late", "sources")
