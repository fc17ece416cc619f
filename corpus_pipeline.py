"""The corpus pipeline: each stage a (name, function) of (spark, docs, sf_dir); each one's rows are written as Parquet
and read again as the next one's docs. Null texts count as empty and no stage needs more than the columns of documents; other columns
are kept, whatever their names, but for the last stage. Repeated rows are rows of their own in every stage; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact, mixing, pieces, quality, similar
from tessera.llm.common import save, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; equal rows stay or go together."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the largest doc_id, of equal ids any one."""
    return exact.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: five-word shingles, similarity of 0.8 or more; ties by id and text."""
    return similar.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, repeats with their doc_id; texts without words are never taken."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and the sampled piece ids, from which the text can be decoded."""
    return pieces.encode(docs).select("doc_id", "source", "lang", "ids")


STAGES = [("quality", keep_good), ("exact dedup", drop_copies), ("near dedup", drop_near), ("mixing", mix_sources), ("pieces", encode)]
ORACLE_SQL = None  # the classifier, the mix and the drawn pieces are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
