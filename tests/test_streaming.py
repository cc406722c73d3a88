"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from chromaflow.operators import histogram
from chromaflow.plans.views import pixels
from chromaflow.streaming import running


def drained(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_running_histogram(spark, sf_dir, tmp_path):
    px = pixels(spark, sf_dir)
    px.repartition(3).write.parquet(str(tmp_path / "px"))
    stream = spark.readStream.schema(px.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "px"))
    drained(running.running_histogram(stream, 5), "running_histogram", "complete")
    want = {(r.image_id, r.key, r.importance) for r in histogram.colour_histogram(px, 5).collect()}
    assert {(r.image_id, r.key, r.importance) for r in spark.table("running_histogram").collect()} == want


def test_windowed_report(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "success", 10, 5), ("2024-01-01 00:02:00", "failure", 10, 10), ("2024-01-01 09:00:00", "success", 4, 1), ("2024-01-02 00:00:00", "success", 1, 1)]
    runs = spark.createDataFrame(rows, "c string, conclusion string, in_bytes long, out_bytes long").withColumn("created", F.to_timestamp("c")).drop("c")
    runs.coalesce(1).write.parquet(str(tmp_path / "runs"))
    stream = spark.readStream.schema(runs.schema).parquet(str(tmp_path / "runs"))
    drained(running.windowed_report(stream), "windowed_report", "append")
    got = {str(r.start): (r.total, r.success, r.failure, r.ratio) for r in spark.table("windowed_report").collect()}
    assert got["2024-01-01 00:00:00"] == (2, 1, 1, 0.75)
