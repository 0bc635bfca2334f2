import json

from pyspark.sql import functions as F

from scriptorium.streaming import usage as stream


def test_log_counts_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"body": json.dumps([{"type": "open", "sketchId": str(i)}] * 2), "ua": "x"}) + "\n")
    for _ in range(2):
        q = stream.write_log(stream.source(spark, str(tmp_path / "in"), "body string, ua string"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_windows_count_an_event_once(spark, tmp_path):
    rows = spark.sql("select * from values (1L, timestamp'2024-01-01 01:00:00', 'a'), (1L, timestamp'2024-01-01 01:00:00', 'a'), (2L, timestamp'2024-01-02 01:00:00', 'a') as t(id, ts, kind)")
    rows.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    q = stream.windowed(s, "ts", "id", "kind").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("w").orderBy("w").collect()] == [1, 1]


def test_foreach_batch(spark, tmp_path):
    spark.range(5).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "e"))
    seen = []
    q = stream.upsert_batches(spark.readStream.schema("id long, x int").parquet(str(tmp_path / "e")), lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sum(seen) == 5
