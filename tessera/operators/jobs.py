"""States of leased jobs as functions of a row and a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(jobs: DataFrame, now: Column, lease: int = 90, most: int = 5, unit: str = "mins") -> DataFrame:
    """jobs (status, attempts, at) with state and run_after at `now`: an expired lease waits again or, after `most`
    attempts, has failed; a failure waits attempts squared minutes (or `unit`: secs) before the next attempt."""
    status, attempts = F.col("status"), F.col("attempts")
    expired = (status == "running") & (F.col("at") + F.make_dt_interval(secs=F.lit(float(lease))) < now)
    again = attempts < most
    state = F.when(expired, F.when(again, "waiting").otherwise("failed")).when((status == "failed") & again, "waiting").otherwise(status)
    wait = F.when((status == "failed") & again, F.col("at") + F.make_dt_interval(**{unit: (attempts * attempts).cast("int" if unit == "mins" else "decimal(18,6)")}))
    return jobs.withColumn("state", state).withColumn("run_after", wait)


def claimable(jobs: DataFrame, now: Column, most: int = 1) -> DataFrame:
    """The next jobs to claim: waiting ones whose time has come, by priority, then age, then id."""
    return settle(jobs, now).where((F.col("state") == "waiting") & (F.coalesce("run_after", now) <= now)).orderBy("priority", "at", "id").limit(most)
