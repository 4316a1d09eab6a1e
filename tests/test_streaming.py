from pyspark.sql import functions as F

from residua.operators.abundance import hits
from residua.sources.corpus import normalise
from residua.streaming.incremental import fragment_counts, keep_histogram


def test_counts_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(i, "acdef ghikl " * (i + 1), "s") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.filter("doc_id < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    docs.filter("doc_id >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = fragment_counts(stream, 3).writeStream.outputMode("complete").format("memory").queryName("frags").start()
    q.processAllAvailable()
    q.stop()
    prots = docs.select(F.col("doc_id").alias("prot_id"), normalise(F.col("text")).alias("seq")).withColumn("len", F.length("seq"))
    want = {r.frag: r.hits for r in hits(prots, 3).collect()}
    assert {r.frag: r["count"] for r in spark.table("frags").collect()} == want

    plain = stream.select(F.col("source").alias("model"), F.length("text").alias("score"), F.lit(1).cast("long").alias("count"))
    q = keep_histogram(plain, str(tmp_path / "h"), str(tmp_path / "c"), ("model",))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "h" / "v1")).first()["count"] == 6
