"""Exact deduplication by stateful streaming, with DataFrame operations only.

A stream of (digest, identifier, locator) rows feeds a keyed aggregation whose state lives in RocksDB on the executors'
disks, with its log in the shared folder. There is no watermark: a digest is never forgotten. The state of a digest
holds the largest identifier with the locator of its content, and the number of rows. Groups of more than one row
(hits) are then checked on their full bytes; texts of equal digest and different bytes are grouped by their bytes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, forget, free_name, fresh_path, in_files, locator, maybe_in, save, text_or_empty

#: How the state is kept: on disk, with a log of changes in the shared folder, and no file larger than what it holds.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)


def state_of(rows: DataFrame) -> DataFrame:
    """(digest, keep, n): the largest identifier of a digest with the locator of its content, and the number of rows."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("n"))


def keep_state(keys: DataFrame, path: str, state: str | None = None, out: str | None = None) -> DataFrame:
    """Stream what is new below path through the state; (digest, keep, n) as the state ends.

    state and out are folders that a later call may name again: rows that arrive by then add to the groups kept so far.
    """
    spark = keys.sparkSession
    out = out or fresh_path(spark, "dedup-groups")
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = (
            state_of(spark.readStream.schema(keys.schema).parquet(path))
            .writeStream.outputMode("update")
            .option("checkpointLocation", state or fresh_path(spark, "dedup-state"))
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # a group is written again whenever a batch adds to it; the last one counts. No row, no batch.
    try:
        groups = spark.read.parquet(out)
    except AnalysisException:
        return state_of(keys).limit(0)
    return groups.groupBy("digest").agg(F.max_by("keep", "batch").alias("keep"), F.max_by("n", "batch").alias("n"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, locator (file and row of its content), keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id stays; among repeated
    rows of one id, the last by locator alone. A group whose ids are all null keeps its last row, with keep_id null.
    No rows give no rows; other columns are ignored, whatever their names.
    """
    docs = in_files(docs, "dedup-input")
    own = docs.select(F.col(id_col).alias("doc_id"), locator(docs).alias("locator"), ascii_lower(text_or_empty(text_col)).alias("text"))
    spark = docs.sparkSession
    path = fresh_path(spark, "dedup-keys")
    own.select("doc_id", "locator", digest_of(F.col("text")).alias("digest")).write.parquet(path)
    keys = spark.read.parquet(path)
    groups = save(keep_state(keys, path), "dedup-kept")
    hits = save(keys.join(groups.where("n > 1").select("digest"), "digest", "left_semi").select("locator", "digest"), "dedup-hits")
    # only rows that may be hits are shuffled with their texts
    full = maybe_in(own, hits, "locator", "maybe").where("maybe").drop("maybe").join(hits, "locator")
    apart = save(full.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("digest"), "dedup-apart")
    if not apart.isEmpty():  # different bytes under one digest: by their bytes
        rows = full.join(apart, "digest", "left_semi")
        exact = rows.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("n"))
        exact = rows.join(exact, ["digest", "text"]).select("doc_id", "locator", "digest", "keep", "n")
        joined = keys.join(apart, "digest", "left_anti").join(groups, "digest").select(*exact.columns).union(exact)
    else:
        joined = keys.join(groups, "digest")
        forget(hits)
    same = F.col("keep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keep.locator") == F.col("locator"))
    return joined.select("doc_id", "locator", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), same.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that dedup() does not keep, by its rules; its columns as they were, whatever their names.

    Null texts are copies of empty ones. Rows that share an id or have none are told apart by where they lie. No rows
    give no rows.
    """
    docs = in_files(docs, "dedup-input")
    at, maybe = free_name(docs, "locator"), free_name(docs, "maybe")
    gone = save(dedup(docs).where("not kept").select(F.col("locator").alias(at)), "dedup-gone")
    rows = maybe_in(docs.withColumn(at, locator(docs)), gone, at, maybe)
    left = rows.where(F.col(maybe)).join(gone, at, "left_anti")
    return rows.where(~F.col(maybe)).select(*docs.columns).union(left.select(*docs.columns))
