"""A stream and a table give the same windows."""

from pyspark.sql import functions as F

from tessera.streaming import profiles as ST


def test_stream_equals_table(spark, tmp_path):
    rows = spark.range(200).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97).alias("ts"), (F.col("id") % 3).alias("kind"), (F.col("id") % 2).alias("side"), (F.col("id") - 100).cast("double").alias("value")
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, f in (("cells", lambda e: ST.windowed_contingency(e, "kind", "side")), ("profile", lambda e: ST.windowed_profile(e, "kind", "value"))):
        q = f(stream).writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        got, want = spark.table(name), f(spark.read.parquet(str(tmp_path / "in")))
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
