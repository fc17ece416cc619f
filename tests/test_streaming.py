"""Activity as a stream: windows with late rows, and an upsert that batches add to and restarts do not change."""

import datetime

from tessera.streaming import activity as A


def write(spark, folder, rows):
    frame = spark.createDataFrame([(i, datetime.datetime(2024, 1, 1, 0, m), u, k, v) for i, m, u, k, v in rows], "event_id long, ts timestamp, user_id long, event_type string, value double")
    frame.coalesce(1).write.mode("append").parquet(folder)


def test_upsert_merges_batches(spark, tmp_path):
    folder, latest = str(tmp_path / "in"), str(tmp_path / "latest")

    def run():
        q = A.events_stream(spark, folder).writeStream.foreachBatch(A.upsert_batches(latest)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {r.user_id: (r.event_id, r.event_type) for r in A.read_latest(spark, latest).collect()}

    write(spark, folder, [(1, 1, 7, "view", 1.0), (2, 5, 7, "click", 1.0), (3, 2, 8, "view", 1.0)])
    assert run() == {7: (2, "click"), 8: (3, "view")}
    write(spark, folder, [(4, 3, 7, "error", 1.0), (5, 9, 9, "view", 1.0), (6, 8, 8, "error", 1.0)])
    want = {7: (2, "click"), 8: (6, "error"), 9: (5, "view")}
    assert run() == want and run() == want
    batch = spark.read.parquet(folder).where("event_id > 3")
    A.upsert_batches(latest)(batch, 1)  # as after a restart in the middle of batch 1
    assert {r.user_id: (r.event_id, r.event_type) for r in A.read_latest(spark, latest).collect()} == want
    assert len(list((tmp_path / "latest").glob("batch=*"))) <= 2


def test_windows_leave_late_rows_out(spark, tmp_path):
    folder = str(tmp_path / "in")

    def run():
        q = A.windowed_counts(A.events_stream(spark, folder)).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.window.start.minute, r.event_type, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    write(spark, folder, [(1, 1, 1, "view", 1.0), (2, 4, 2, "view", 2.0), (3, 7, 1, "click", 3.0)])
    run()
    write(spark, folder, [(4, 40, 1, "view", 5.0)])
    assert run() == [(0, "view", 2, 3.0), (5, "click", 1, 3.0)]
    write(spark, folder, [(5, 2, 1, "view", 9.0), (6, 59, 1, "view", 1.0)])
    assert run() == [(0, "view", 2, 3.0), (5, "click", 1, 3.0), (40, "view", 1, 5.0)]
