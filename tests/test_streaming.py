import shutil

from lodestar.streaming import windowed_counts


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "in" / "events.parquet")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).select("start", "event_type", "n").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("counts").collect()))
    assert got == sorted(map(tuple, windowed_counts(batch).select("start", "event_type", "n").collect()))
