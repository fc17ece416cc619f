"""Reading the corpus tables by path, through Spark's readers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """Spark SQL over the named tables, written {name} in the text."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def originals(spark: SparkSession, glob: str) -> DataFrame:
    """Stored originals with their digest, for checks against a manifest: path, length, sha256, content."""
    files = spark.read.format("binaryFile").load(glob)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def manifest_problems(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem) of stored originals (path, length, sha256) beside a manifest (path, bytes, sha256): what is missing, not
    listed, of another size or of another content."""
    own = files.select("path", "length", F.col("sha256").alias("found"))
    both = manifest.join(own, "path", "full_outer")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "not listed").when(F.col("length") != F.col("bytes"), "size").when(F.lower("sha256") != F.col("found"), "content")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def page_map_problems(pages: DataFrame) -> DataFrame:
    """(source, problem) of page maps (source, page) that do not run from 0 without gaps or repeats."""
    own = pages.groupBy("source").agg(F.min("page").alias("a"), F.max("page").alias("b"), F.count("*").alias("n"), F.count_distinct("page").alias("d"))
    problem = F.when(F.col("a") != 0, "start").when(F.col("d") < F.col("n"), "repeated").when(F.col("b") + 1 != F.col("d"), "gap")
    return own.select("source", problem.alias("problem")).where("problem is not null")


def report(rows: DataFrame, file: str) -> None:
    """Write a report as one file of JSON lines: a reader sees the old one or the whole new one, as it takes the old one's place in
    one step once it is complete. Reports are small; their rows pass one task."""
    spark = rows.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    path, part = fs.Path(file), fs.Path(f"{file}.part")
    conf = spark._jsc.hadoopConfiguration()
    store = path.getFileSystem(conf)
    rows.coalesce(1).write.mode("overwrite").json(part.toString())
    (made,) = (s.getPath() for s in store.listStatus(part) if s.getPath().getName().startswith("part-"))
    kinds = getattr(fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kinds, 1)
    over[0] = kinds.OVERWRITE
    fs.FileContext.getFileContext(store.getUri(), conf).rename(store.makeQualified(made), store.makeQualified(path), over)
    store.delete(part, True)
