from tributary.streaming.windows import windowed_counts


def test_stream_and_table_agree(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", None), ("2024-01-01 05:00:00", "a", 4.0)]
    df = spark.createDataFrame(rows, "t string, k string, v double").selectExpr("CAST(t AS timestamp) AS t", "k", "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "t", ["k"], "1 hour", "10 minutes", "v").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, windowed_counts(df, "t", ["k"], "1 hour", "10 minutes", "v").collect()))
    assert sorted(map(tuple, spark.table("w").collect())) == want and len(want) == 3
    assert windowed_counts(df.limit(0), "t", ["k"], "1 hour").collect() == []
