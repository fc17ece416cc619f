"""What the training-data operators share: the shared folder, stage tables, words, held-out folds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: anything between the six ASCII white-space characters, which are also those of bytes.split().
WORD = r"[^\x20\x09-\x0D]+"
#: Characters beyond ASCII that lower() may change; a superset of the Unicode property.
CASED = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one in local mode only."""
    sc = spark.sparkContext
    if root := sc.getConf().get("spark.checkpoint.dir"):
        return root.rstrip("/")
    if found := sc._jsc.sc().getCheckpointDir():
        if not found.isEmpty():
            return found.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(df: DataFrame) -> None:
    """Remove the table of a save() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(docs: DataFrame, name: str) -> str:
    """name, or name with as many underscores in front as no column of docs has, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def in_files(docs: DataFrame, name: str) -> DataFrame:
    """docs itself if its rows lie in files, else a copy in the shared folder."""
    try:
        docs.select(docs.metadataColumn("_metadata"))
        return docs
    except AnalysisException:
        return save(docs, name)


def locator(docs: DataFrame) -> Column:
    """struct<file, row>: where each row of a table in files lies."""
    at = docs.metadataColumn("_metadata")
    return F.struct(at["file_path"].alias("file"), at["row_index"].alias("row"))


def maybe_in(rows: DataFrame, keys: DataFrame, by: str, flag: str, most_bits: int = 27) -> DataFrame:
    """rows with a boolean column: false where column `by` is surely not among those of keys, a saved table.

    A Bloom filter of one hash: about 16 bits a key, at most 2 ** most_bits (16 MB, which bounds what is broadcast); with
    more keys it only lets more rows pass. It spares rows that match nothing a shuffle; what passes must still be joined.
    """
    bits = max(15, min(most_bits, (16 * max(keys.count(), 1) - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits)) + 1
    own, bucket, bitmap = (free_name(rows, n) for n in ("__place", "__bucket", "__map"))
    maps = keys.select(place(F.col(by)).alias(own)).groupBy(F.bitmap_bucket_number(own).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias(bitmap))
    at = rows.withColumn(own, place(F.col(by)))
    bit = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0, F.lit(False))
    return at.join(F.broadcast(maps), F.bitmap_bucket_number(own) == F.col(bucket), "left").select(*(rows[c] for c in rows.columns), hit.alias(flag))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() is right and fast unless it would change letters beyond ASCII."""
    return F.when(text.rlike(CASED), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo folds, equals fold; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def first_by_hash(df: DataFrame, cols: list[str], rows: int, seed: int) -> DataFrame:
    """The `rows` rows of df whose hashes of cols come first: a seeded draw of bounded size. Rows that cannot be among
    them are left out before they are ordered, so each task passes on a few rows only."""
    h = F.xxhash64(*cols, F.lit(seed))
    bound = min(1.0, (2 * rows + 100) / max(df.count(), 1))
    return df.where(h.cast("double") / F.lit(2.0**64) + 0.5 <= bound).orderBy(h, *cols).limit(rows)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let the session's Arrow batches hold at most `rows` rows, so that a Python worker's memory stays small with long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
