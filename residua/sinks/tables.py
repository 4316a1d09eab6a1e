"""Writers: ordered histograms that merge with what is stored, key-value files, FASTA pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORE_KEYS = ("alignment", "model", "score", "replica", "lf", "domain")


def merge_counts(stored: DataFrame | None, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Counts of both, added up by key."""
    new = new.select(*keys, "count")
    both = new if stored is None else stored.select(*keys, "count").unionByName(new)
    return both.groupBy(*keys).agg(F.sum("count").alias("count"))


def write_histogram(df: DataFrame, path: str, keys: tuple[str, ...] = SCORE_KEYS) -> None:
    """Overwrite a tab-separated histogram, ordered by its keys."""
    df.orderBy(*keys).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_map(df: DataFrame, key: str, value: str, path: str, sep: str = ",", header: bool = True) -> None:
    df.select(key, value).orderBy(key).write.mode("overwrite").option("sep", sep).option("header", header).csv(path)


def write_fasta_pairs(pairs: DataFrame, path: str, bucket: str) -> None:
    """FASTA text of both fragments of each pair, a folder for each value of ``bucket``."""
    text = F.concat(F.lit(">"), F.col("pair_id").cast("string"), F.lit("_1\n"), F.col("a_frag"), F.lit("\n>"), F.col("pair_id").cast("string"), F.lit("_2\n"), F.col("b_frag"))
    pairs.select(text.alias("value"), F.col(bucket)).write.mode("overwrite").partitionBy(bucket).text(path)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet through the committer: readers see all of it or nothing."""
    df.write.mode("overwrite").parquet(path)
