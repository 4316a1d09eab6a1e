"""Residue counts and frequencies by protein, organism and corpus, and window-weighted frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions.alphabet import LETTERS, RESIDUES
from residua.functions.stats import binomial
from residua.functions.strings import count_of


def letter_counts(prots: DataFrame, keys: tuple[str, ...] = (), letters: str = LETTERS) -> DataFrame:
    """keys, aa, count: by counting each letter inside a sequence and adding up, so that no row is made of a residue."""
    counts = F.array(*[F.struct(F.lit(c).alias("aa"), count_of(F.col("seq"), c).cast("long").alias("n")) for c in letters])
    return prots.select(*keys, F.inline(counts)).groupBy(*keys, "aa").agg(F.sum("n").alias("count")).filter("count > 0")


def frequencies(prots: DataFrame, keys: tuple[str, ...] = (), letters: str = LETTERS) -> DataFrame:
    """letter_counts with freq: the share of all residues under the same keys."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return letter_counts(prots, keys, letters).withColumn("freq", F.col("count") / F.sum("count").over(w))


def pivoted(prots: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, A..Z: counts of all letters under the keys, 0 where there is none."""
    return prots.select(*keys, *[count_of(F.col("seq"), c).cast("long").alias(c) for c in LETTERS]).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in LETTERS])


def length_histogram(prots: DataFrame) -> DataFrame:
    return prots.groupBy("len").agg(F.count(F.lit(1)).alias("count"))


def with_total(prots: DataFrame) -> DataFrame:
    """aa, count, frequency (percent) and a row ``total``."""
    c = letter_counts(prots, (), RESIDUES)
    return c.rollup("aa").agg(F.sum("count").alias("count")).select(F.coalesce("aa", F.lit("total")).alias("aa"), "count", (100.0 * F.col("count") / F.sum(F.when(F.col("aa").isNotNull(), F.col("count"))).over(Window.partitionBy(F.lit(0)))).alias("frequency"))


def prob_map(prots: DataFrame) -> Column:
    """Probabilities of the 20 residues (X left out) as one literal map; 20 entries at most."""
    rows = letter_counts(prots, (), RESIDUES).collect()
    total = sum(r["count"] for r in rows) or 1
    have = {r["aa"]: r["count"] / total for r in rows}
    return F.create_map(*[x for c in RESIDUES for x in (F.lit(c), F.lit(have.get(c, 0.0)))])


def fragment_prob(frag: Column, probs: Column) -> Column:
    """Product of the residues' probabilities."""
    return F.aggregate(F.split(frag, ""), F.lit(1.0), lambda a, c: a * probs[c])


def weighted(prots: DataFrame, lengths: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """lf, keys, aa, weight, prob: frequencies of residues as windows of lf see them (X left out).

    All residues but those near the ends are covered by the most windows: letters are counted with that weight, and only the
    residues near the ends make rows, to take off what they lack."""
    spark = prots.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(n,) for n in lengths], "lf int"))
    most = F.least(F.col("lf"), F.col("len") - F.col("lf") + 1)
    p = prots.join(sizes, F.col("len") >= F.col("lf")).select("lf", *keys, "seq", most.alias("most"))
    whole = F.array(*[F.struct(F.lit(c).alias("aa"), (count_of(F.col("seq"), c) * F.col("most")).cast("long").alias("w")) for c in RESIDUES])
    ends = F.array(F.substr("seq", F.lit(1), F.col("most") - 1), F.substr(F.reverse("seq"), F.lit(1), F.col("most") - 1))
    near = p.select("lf", *keys, "most", F.explode(ends).alias("end")).filter("end <> ''")
    lacking = near.select("lf", *keys, F.inline(F.transform(F.split("end", ""), lambda c, i: F.struct(c.alias("aa"), (i + 1 - F.col("most")).cast("long").alias("w"))))).filter("aa <> 'X'")
    rows = p.select("lf", *keys, F.inline(whole)).unionByName(lacking).groupBy("lf", *keys, "aa").agg(F.sum("w").alias("weight")).filter("weight > 0")
    return rows.withColumn("prob", F.col("weight") / F.sum("weight").over(Window.partitionBy("lf", *keys)))


def mixture(prots: DataFrame, lengths: list[int]) -> DataFrame:
    """lf, d, prob: distances of a protein's windows to windows of the corpus, each protein a binomial with the match
    probability of its composition against the corpus', weighted by its windows."""
    own = weighted(prots, lengths, ("prot_id",)).select("lf", "prot_id", "aa", "weight", "prob")
    whole = weighted(prots, lengths).select("lf", "aa", F.col("prob").alias("q"))
    match = own.join(F.broadcast(whole), ["lf", "aa"]).groupBy("lf", "prot_id").agg(F.sum(F.col("prob") * F.col("q")).alias("m"), F.sum("weight").alias("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy("lf"))
    rows = match.withColumn("share", share).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("lf"))))
    prob = binomial(F.col("lf"), F.col("d")) * F.pow(1 - F.col("m"), F.col("d")) * F.pow(F.col("m"), F.col("lf") - F.col("d"))
    return rows.groupBy("lf", "d").agg(F.sum(prob * F.col("share")).alias("prob"))
