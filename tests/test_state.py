"""Jobs purged by timers on event time."""

from pyspark.sql import functions as F

from spanwright.streaming import state


def test_jobs_are_purged_by_timers(spark, tmp_path):
    ttl = 1000
    batches = [
        [("a", 1, 10), ("b", 2, 100), ("a", 3, 400), (None, 9, 50), ("a", None, 50)],
        [("c", 4, 5000)],
        [("c", 5, 6000), ("a", 6, 5200), ("b", 7, 3), ("d", 8, None)],
        [("c", 10, 9000)],
    ]
    source, to = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key string, job long, ms long"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{source}/[0-9]").select("key", "job", F.timestamp_millis("ms").alias("at"))
        query = state.purged(stream, "key", "job", "at", ttl, "0 seconds").writeStream.format("parquet").option("path", to).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r.job: (r.key, r.created_ms, r.orphan) for r in spark.read.parquet(to).collect()}
    # the last watermark is 9000: 10 lives; 7 came too late, and 1's key went on with 3
    assert got == {1: ("a", 10, False), 2: ("b", 100, True), 3: ("a", 400, True), 4: ("c", 5000, False), 5: ("c", 6000, True), 6: ("a", 5200, True)}
