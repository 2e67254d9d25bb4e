from pyspark.sql import functions as F

from docloom.streaming import incremental as inc

SF = "/root/testdata/sf0.001"


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_windowed_counts_agree_with_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = inc.event_stream(spark, str(tmp_path / "events"), events.schema)
    drain(inc.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start())
    got = {(r.window.start, r.event_type): r.n for r in spark.table("counts").collect()}
    want = {(r.window.start, r.event_type): r.n for r in events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_catch_up(spark, tmp_path):
    folder = str(tmp_path / "ticks")
    schema = "key string, now_ms long"
    spark.createDataFrame([("a", 1000)], schema).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    query = inc.catch_up_ticks(stream, 100).writeStream.outputMode("update").format("memory").queryName("ticks").start()
    query.processAllAvailable()
    spark.createDataFrame([("a", 1350), ("b", 7)], schema).coalesce(1).write.mode("append").parquet(folder)
    drain(query)
    assert {tuple(r) for r in spark.table("ticks").collect()} == {("a", 0, 1000), ("a", 3, 1300), ("b", 0, 7)}


def test_keep_merged(spark, tmp_path):
    folder, target = str(tmp_path / "rows"), str(tmp_path / "target")
    schema = "path string, mtime long"
    spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], schema).write.parquet(folder)
    for extra in ([], [("b", 5), ("c", 1)]):
        if extra:
            spark.createDataFrame(extra, schema).write.mode("append").parquet(folder)
        inc.keep_merged(spark.readStream.schema(schema).parquet(folder), target, "path", "mtime", str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{target}/1").collect()} == {("a", 2), ("b", 5), ("c", 1)}
