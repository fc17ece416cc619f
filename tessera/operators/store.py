"""Tables that a query writes on its way, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set by setCheckpointDir; in local mode only, a temporary one."""
    sc = spark.sparkContext
    if own := sc.getConf().get("spark.checkpoint.dir"):
        return own.rstrip("/")
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own: what follows reads files instead of repeating its plan, also after an executor is lost."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
