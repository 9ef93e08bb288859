from pyspark.sql import functions as F

from ravelin import streaming


def test_rates_sessions_and_incremental_counts(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.sql("SELECT timestamp_seconds(1700000000 + id * 60) AS ts, concat('k', id % 2) AS k, id % 3 = 0 AS hit FROM range(60)").repartition(3).write.parquet(src)
    stream = lambda: spark.readStream.schema("ts timestamp, k string, hit boolean").option("maxFilesPerTrigger", 1).parquet(src)
    q = streaming.rates(stream(), "ts", ["k"], "30 minutes", "10 minutes", "2 hours").writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT max(n) AS n FROM rates").first().n == 15
    state = str(tmp_path / "state")
    q = stream().writeStream.foreachBatch(streaming.incremental_counts(state, ["k"], "hit")).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.k: (r.n, r.hits) for r in streaming.summed_counts(spark.read.parquet(state), ["k"]).collect()}
    assert got == {"k0": (30, 10), "k1": (30, 10)}
    batch = streaming.sessions(spark.read.parquet(src), "ts", ["k"], "5 minutes", "1 hour")
    assert {r.k: r.n for r in batch.groupBy("k").agg(F.max("n").alias("n")).collect()} == {"k0": 30, "k1": 30}
