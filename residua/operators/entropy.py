"""Next-residue distributions and the locality of residues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.functions.stats import entropy
from residua.operators import within
from residua.operators.kmers import residues, windows


def next_counts(prots: DataFrame, context: int) -> DataFrame:
    """frag (context residues), next, count; windows with X are left out."""
    w = windows(prots, context + 1, ("prot_id",), True)
    return w.groupBy(F.substr("frag", F.lit(1), F.lit(context)).alias("frag"), F.substr("frag", F.lit(context + 1), F.lit(1)).alias("next")).agg(F.count(F.lit(1)).alias("count"))


def conditional(prots: DataFrame, lengths: list[int]) -> DataFrame:
    """lf, entropy (of the next residue given lf - 1, weighted by hits), variance, total, contexts."""
    out = None
    for lf in lengths:
        per = entropy(next_counts(prots, lf - 1), ["frag"], "count")
        mean = F.sum(F.col("entropy") * F.col("total")) / F.sum("total")
        square = F.sum(F.col("entropy") * F.col("entropy") * F.col("total")) / F.sum("total")
        own = per.agg(mean.alias("entropy"), (square - mean * mean).alias("variance"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("contexts")).select(F.lit(lf).alias("lf"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def predictions(prots: DataFrame, context: int) -> DataFrame:
    """frag, predicted (most frequent next residue, ties to the first letter), certainty, total."""
    c = next_counts(prots, context)
    best = F.max(F.struct("count", (-F.ascii("next")).alias("o"), "next"))
    return c.groupBy("frag").agg(best.alias("b"), F.sum("count").alias("total")).select("frag", F.col("b.next").alias("predicted"), (F.col("b.count") / F.col("total")).alias("certainty"), "total")


def predict_along(queries: DataFrame, prots: DataFrame, context: int, key: str) -> DataFrame:
    """key, pos, real, predicted, certainty, real_prob along each query; nulls where its context never occurs."""
    q = windows(queries, context + 1, (key,)).select(key, "pos", F.substr("frag", F.lit(1), F.lit(context)).alias("frag"), F.substr("frag", F.lit(context + 1), F.lit(1)).alias("real"))
    seen = predictions(prots, context)
    counts = next_counts(prots, context).withColumnRenamed("next", "real")
    return q.join(seen, "frag", "left").join(counts, ["frag", "real"], "left").select(key, "pos", "real", "predicted", "certainty", F.when(F.col("total").isNotNull(), F.coalesce(F.col("count"), F.lit(0)) / F.col("total")).alias("real_prob"))


def gap_counts(prots: DataFrame) -> DataFrame:
    """aa, gap, count: distances between neighbouring equal residues of a protein (X left out)."""
    found = within.dealt(prots).mapInArrow(within.gap_counts, "aa string, gap int, n long")
    return found.groupBy("aa", "gap").agg(F.sum("n").alias("count"))


def gap_ends(prots: DataFrame) -> DataFrame:
    """prot_id, aa, to_start, to_end: how far the first and last of a residue stand from the protein's ends."""
    return residues(prots, ("prot_id", "len")).filter("aa <> 'X'").groupBy("prot_id", "aa", "len").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).select("prot_id", "aa", F.col("a").alias("to_start"), (F.col("len") - F.col("b") + 1).alias("to_end"))


def gap_entropies(prots: DataFrame) -> DataFrame:
    """aa, mean, deviation of the proteins' gap entropies."""
    per = within.dealt(prots).mapInArrow(within.gap_entropies, "aa string, entropy double")
    return per.groupBy("aa").agg(F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("deviation"), F.count(F.lit(1)).alias("prots"))
