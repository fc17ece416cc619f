"""Activity as a stream. The reference polls tables; these are additions of ours over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, folder: str, files: str = "*.parquet") -> DataFrame:
    """The Parquet files of a folder as they arrive; a stream's source is a folder, never one file."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums by kind and time window, with a bound on late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def upsert_batches(latest: str):
    """A foreachBatch sink that keeps one row of the newest time per user: the table at `latest` has a folder for each batch,
    which holds the batch's rows merged with those of the batch before it. A batch that is run again writes its own folder
    again, from the same folder before it, so a restart changes nothing. read_latest() reads the newest whole folder."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("user_id", "event_id", "event_type", "ts")
        if (before := _newest(batch.sparkSession, latest, number)) is not None:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{latest}/batch={before}"))
        newest = rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id")).alias("e"))
        newest.select("user_id", "e.*").write.mode("overwrite").parquet(f"{latest}/batch={number}")
        if before is not None:
            _drop(batch.sparkSession, latest, before)

    return write


def _folders(spark: SparkSession, latest: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(latest)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return store, [x.getPath() for x in (store.listStatus(path) if store.exists(path) else [])]


def _newest(spark: SparkSession, latest: str, below: int | None = None) -> int | None:
    """The number of the newest whole batch, or of the newest before `below`."""
    store, paths = _folders(spark, latest)
    whole = [p for p in paths if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    numbers = [int(p.getName().partition("=")[2]) for p in whole if p.getName().startswith("batch=")]
    return max((n for n in numbers if below is None or n < below), default=None)


def _drop(spark: SparkSession, latest: str, number: int) -> None:
    """Remove the batches before `number`; that one stays, for a batch that is run again."""
    store, paths = _folders(spark, latest)
    for p in paths:
        if p.getName().startswith("batch=") and int(p.getName().partition("=")[2]) < number:
            store.delete(p, True)


def read_latest(spark: SparkSession, latest: str) -> DataFrame:
    return spark.read.parquet(f"{latest}/batch={_newest(spark, latest)}")
