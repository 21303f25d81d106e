from trackspark.operators import ring
from trackspark.streaming import live


def test_ring_stream_equals_batch(spark, tmp_path):
    lums = [0.9, 0.02, 0.02, 0.02, None, 0.9, 0.9, 0.9, 0.5, 0.02] * 2
    df = spark.createDataFrame([("v", k, x) for k, x in enumerate(lums)], "video_id string, frame long, lum double")
    for part in range(2):
        df.where(f"frame DIV 10 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.ring_colours(stream).writeStream.format("memory").queryName("rings").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.frame, r.ring) for r in spark.table("rings").collect())
    assert got == sorted((r.frame, r.ring) for r in ring.choose(df, ["video_id"]).collect())


def test_runs_stream(spark, tmp_path):
    df = spark.range(20).selectExpr("'v' AS k", "timestamp_seconds(id + CASE WHEN id >= 10 THEN 600 ELSE 0 END) AS ts", "0.7D AS conf")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.runs(stream, "ts", "k", "10 seconds", "1 second").writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.n for r in spark.table("runs").collect()] == [10]
