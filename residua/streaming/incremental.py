"""Histograms of counts that grow with arriving documents.

Not part of the batch results: counts merge, so a stream of documents can keep an abundance table or a score histogram up to
date.  A fragment's count is an ordinary streaming aggregation; merging a histogram with a stored one is done by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from residua.functions.alphabet import normalise
from residua.operators.kmers import windows
from residua.sinks.tables import merge_counts


def fragment_counts(docs: DataFrame, lf: int) -> DataFrame:
    """frag, count over a stream of documents (doc_id, text, source)."""
    prots = docs.select(F.col("doc_id").alias("prot_id"), F.col("source").alias("org"), normalise(F.col("text")).alias("seq")).withColumn("len", F.length("seq"))
    return windows(prots, lf, ("prot_id",), True).groupBy("frag").agg(F.count(F.lit(1)).alias("count"))


def keep_histogram(counts: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...]) -> StreamingQuery:
    """Add each batch's counts to the histogram stored at ``path``, a version a batch, so a batch that runs again writes the
    same version again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        merge_counts(stored, batch, keys).write.mode("overwrite").parquet(f"{path}/v{number}")

    return counts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
