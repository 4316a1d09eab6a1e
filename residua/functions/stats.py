"""Statistics as column expressions and small aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def entropy(df: DataFrame, keys: list[str], count: str, base: float = 2.0, name: str = "entropy") -> DataFrame:
    """Shannon entropy of the counts under each key, and their total; keys without counts have no row."""
    total = F.sum(count).over(Window.partitionBy(*keys))
    p = df.filter(F.col(count) > 0).withColumn("_p", F.col(count) / total)
    agg = p.groupBy(*keys) if keys else p.groupBy()
    return agg.agg((-F.sum(F.col("_p") * F.log(base, F.col("_p")))).alias(name), F.sum(count).alias("total"))


def const_bin(value: Column, size: float) -> tuple[Column, Column]:
    """Bin number and start for bins of one width."""
    b = F.floor(value / size)
    return b, b * F.lit(size)


def log_bin(value: Column, base: float) -> tuple[Column, Column]:
    """Bin number and start for bins that grow by ``base``; values up to 0 have no number (null)."""
    b = F.when(value > 0, F.floor(F.round(F.log(base, value), 9)))
    return b, F.pow(F.lit(base), b)


def binomial(n: Column, k: Column) -> Column:
    """n over k as a double; 1 for k = 0, 0 for k above n."""
    steps = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n - i + 1) / i)


def pmf(n: Column, k: Column, p: Column) -> Column:
    return binomial(n, k) * F.pow(p, k) * F.pow(1 - p, n - k)


def distances(spark: SparkSession, lengths: list[int]) -> DataFrame:
    """lf, pm for 0 <= pm <= lf."""
    return spark.range(max(lengths) + 1).select(F.col("id").cast("int").alias("pm")).join(F.broadcast(spark.createDataFrame([(n,) for n in lengths], "lf int")), F.col("pm") <= F.col("lf"))


def transition(spark: SparkSession, lengths: list[int], precision: float, match: float) -> DataFrame:
    """lf, transition: from lf downwards, the first number of mismatches that chance reaches with at most ``precision``
    (null if none)."""
    d = distances(spark, lengths)
    prob = pmf(F.col("lf"), F.col("pm"), F.lit(1 - match))
    first = F.max(F.when((prob <= precision) & (F.col("pm") <= F.col("lf") * (1 - match)), F.col("pm")))
    return d.groupBy("lf").agg(first.alias("transition"))


def twilight(at: Column, lf: Column, radius: int) -> tuple[Column, Column]:
    """The zone around a transition, kept inside [0, lf]."""
    return F.greatest(at - radius, F.lit(0)), F.least(at + radius, lf)
