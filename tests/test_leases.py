"""Leases as a stream against the state function on the same rows, also after a restart."""

import datetime
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.operators import jobs
from tessera.streaming.leases import STATE_STORE, leases

START = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, status string, attempts int, at timestamp"


def run(spark, folder, out, checkpoint):
    stream = leases(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder))
    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b={n}")).start()
    query.awaitTermination()


def latest(spark, out):
    rows = {}
    for r in sorted(spark.read.parquet(out).collect(), key=lambda r: (r.batch, r.at, r.expired)):
        rows[r.id] = (r.state, r.run_after)
    return rows


def test_leases_expire_without_a_row(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        rng, folder, out = random.Random(2), str(tmp_path / "in"), str(tmp_path / "out")
        files, second = [], 0
        for _ in range(3):
            rows = []
            for _ in range(25):
                second += rng.randint(1, 9)
                rows.append((rng.randrange(18), rng.choice(["running", "running", "failed", "waiting", "completed"]), rng.randint(0, 6), START + datetime.timedelta(seconds=second)))
            files.append(rows)
        end = START + datetime.timedelta(seconds=second + 40)
        files[-1].append((99, "completed", 1, end))  # it moves the stream's time past some leases

        def put(rows):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

        put(files[0])
        put(files[1])
        run(spark, folder, out, str(tmp_path / "c"))
        put(files[2])
        run(spark, folder, out, str(tmp_path / "c"))  # a restart goes on from its checkpoint
        last = {}
        for r in sum(files, []):
            last[r[0]] = r
        own = spark.createDataFrame([Row(*r) for r in last.values()], SCHEMA)
        want = {r.id: (r.state, r.run_after) for r in jobs.settle(own, F.lit(end)).collect()}
        assert latest(spark, out) == want
        expired = spark.read.parquet(out).where("expired").count()
        assert expired >= 3
        run(spark, folder, out, str(tmp_path / "c"))  # nothing new, nothing changed
        assert latest(spark, out) == want and spark.read.parquet(out).where("expired").count() == expired
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
