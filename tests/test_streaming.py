from pyspark.sql import functions as F

from mediaquarry.streaming import sessions


def drained(query, seconds=60):
    query.processAllAvailable()
    query.stop()


def test_rates_match_the_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i // 6}:{i % 6}0", f"s{i % 2}", float(i)) for i in range(30)]
    spark.createDataFrame(rows, "ts string, source string, amount double").select(F.col("ts").cast("timestamp").alias("ts"), "source", "amount").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    drained(sessions.rates(stream).writeStream.outputMode("complete").format("memory").queryName("rates").start())
    key = lambda r: (r.source, r.end, round(r.rate, 9), r.reads)
    assert sorted(map(key, spark.sql("SELECT * FROM rates").collect())) == sorted(map(key, sessions.rates(batch).collect()))


def test_sessions_and_latest(spark):
    rows = [("2024-01-01 00:00:00", 1), ("2024-01-01 00:00:30", 1), ("2024-01-01 00:05:00", 1), ("2024-01-01 00:00:00", 2)]
    df = spark.createDataFrame(rows, "ts string, key long").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.key, r.events) for r in sessions.sessions(df, "1 minute").collect()) == [(1, 1), (1, 2), (2, 1)]
    last = sessions.latest(df.select("ts", F.col("key").alias("source"), F.unix_timestamp("ts").alias("status"))).collect()
    assert {r.source: r.status for r in last} == {1: 1704067500, 2: 1704067200}


def test_cues_split_and_stream(spark, tmp_path):
    words = [(1, i * 0.5, i * 0.5 + 0.3, f"w{i}") for i in range(12)] + [(1, 20.0, 20.4, "late"), (2, 0.0, 0.2, "x" * 50), (2, 0.3, 0.5, "y" * 50)]
    schema = "key long, start double, end double, word string"
    df = spark.createDataFrame(words, schema)
    got = sorted((r.key, r.cue) for r in sessions.cues(df).collect())
    assert (1, "late") in got and (2, "x" * 50) in got and all(len(c) <= 84 for _, c in got)
    timed = df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("end")))
    timed.coalesce(1).write.parquet(str(tmp_path / "in"))

    def read() -> set[tuple[int, str]]:
        stream = spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in"))
        q = sessions.streaming_cues(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return {(r.key, r.cue) for r in spark.read.schema(sessions.CUES).parquet(str(tmp_path / "out")).collect()}

    closed = read()
    assert closed and closed < set(got) and (1, "late") not in closed  # the open cue of a key is held back
    more = spark.createDataFrame([(3, 500.0, 500.2, "on")], schema).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("end")))
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert read() == set(got)  # the watermark went past the rest of the others; what comes last is still open
