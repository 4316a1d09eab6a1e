"""Samples of fragments and pairs, deterministic and the same in any engine, and histograms over pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions.alphabet import RESIDUES, next_prime
from residua.functions.strings import hamming
from residua.sources.corpus import starts


def keyed(*parts) -> Column:
    """md5 of the parts joined by ':': the order that stands for chance."""
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def keyed_int(n: int, *parts) -> Column:
    """A number from 0 to n - 1 drawn by the key."""
    return F.conv(F.substring(keyed(*parts), 1, 8), 16, 10).cast("long") % n


def systematic(prots: DataFrame, lf: int, step: int, shift: int, batches: int) -> DataFrame:
    """batch, gpos, prot_id, org, pos, frag: the fragment that starts every ``step`` places of the whole corpus, each batch
    ``shift`` further on; fragments that would run over a protein's end are left out."""
    p = starts(prots)
    b = F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))
    rows = p.withColumn("batch", b)
    first = F.col("global_start") + F.pmod(F.col("batch") * shift - F.col("global_start"), F.lit(step))
    last = F.col("global_start") + F.col("len") - lf
    rows = rows.withColumn("_first", first).filter(F.col("_first") <= last)
    rows = rows.withColumn("gpos", F.explode(F.sequence("_first", last, F.lit(step).cast("long"))))
    return rows.withColumn("pos", (F.col("gpos") - F.col("global_start") + 1).cast("int")).select("batch", "gpos", "prot_id", "org", "pos", F.substr("seq", F.col("pos"), F.lit(lf)).alias("frag"))


def strides(total: int) -> tuple[int, int]:
    """Two prime strides: above the fourth root of twice the total, and above its square root."""
    return next_prime(int((2 * total) ** 0.25)), next_prime(int(total**0.5))


def located(places: DataFrame, prots: DataFrame, lf: int, pos: str, prefix: str, few: bool = False) -> DataFrame:
    """Adds the protein, organism, place and fragment that stand at a place of the whole corpus; places without lf residues
    left go.  A protein is found by the ranges of ``WIDTH`` places that it overlaps, each with the residues that fragments
    of the range take.  ``prots`` may have ``global_start`` already; few: the places are so few that every task may hold them."""
    width = 1 << 12
    p = (prots if "global_start" in prots.columns else starts(prots)).filter(F.col("len") >= lf)
    p = p.select(F.col("prot_id").alias(f"{prefix}prot"), F.col("org").alias(f"{prefix}org"), "seq", F.col("global_start").alias("_s"), "len", F.explode(F.sequence(F.floor(F.col("global_start") / width), F.floor((F.col("global_start") + F.col("len") - lf) / width))).alias("_cell"))
    p = p.withColumn("_from", F.greatest(F.col("_cell") * width - F.col("_s"), F.lit(0)).cast("int"))
    p = p.withColumn("_text", F.substr("seq", F.col("_from") + 1, F.lit(width + lf - 1))).drop("seq")
    rows = places.withColumn("_cell", F.floor(F.col(pos) / width))
    rows = p.join(F.broadcast(rows) if few else rows, "_cell").filter((F.col(pos) >= F.col("_s")) & (F.col(pos) <= F.col("_s") + F.col("len") - lf))
    at = (F.col(pos) - F.col("_s") + 1).cast("int")
    return rows.select(*places.columns, f"{prefix}prot", f"{prefix}org", at.alias(f"{prefix}pos"), F.substr("_text", at - F.col("_from"), F.lit(lf)).alias(f"{prefix}frag"))


def pairs(spark: SparkSession, prots: DataFrame, lf: int, n: int, seed: int = 0, around: bool = False, few: int = 100_000) -> DataFrame:
    """pair_id, pos1, pos2 and both sides' protein, organism, place and fragment: two strides around the corpus, pairs kept
    where the second fragment starts after the first ends.  around: n pairs, or as many as it takes the first side, whose
    stride is the shorter one, to go round the corpus once, so that no part of it is left out however large it is."""
    total = prots.agg(F.sum(F.col("len") + 1)).first()[0] or 1
    m1, m2 = strides(total)
    if around:
        n = max(n, -(-total // m1))
    step = max(1, total // 100_000)
    raw = spark.range(n).select(F.col("id").alias("pair_id"), ((F.col("id") * m1) % total).alias("pos1"), ((seed * step + F.col("id") * m2) % total).alias("pos2")).filter(F.col("pos2") > F.col("pos1") + lf)
    return located(located(raw, prots, lf, "pos1", "a_", n <= few), prots, lf, "pos2", "b_", n <= few)


def distance_histogram(p: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return p.groupBy(*keys, hamming(F.col("a_frag"), F.col("b_frag")).alias("pm")).agg(F.count(F.lit(1)).alias("count"))


def domain(seq: Column, length: Column, pos: Column, size: int, lf: int) -> tuple[Column, Column]:
    """Start (from 1) and residues of the window of ``size`` around a fragment, moved to fit; null in a shorter protein."""
    start = F.least(F.greatest(pos - (size - lf) // 2, F.lit(1)), length - size + 1)
    return F.when(length >= size, start), F.when(length >= size, F.substr(seq, start, F.lit(size)))


def same_places(p: DataFrame) -> DataFrame:
    """pair_id, pm, j, aa: places where the fragments of a pair agree."""
    at = F.posexplode(F.zip_with(F.split("a_frag", ""), F.split("b_frag", ""), lambda x, y: F.when(x == y, x))).alias("j", "aa")
    return p.select("pair_id", hamming(F.col("a_frag"), F.col("b_frag")).alias("pm"), at).filter("aa is not null")


def locality(p: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, pm, distance, aa1, aa2, count over pairs of agreeing places of a pair of fragments."""
    agreed = F.filter(F.transform(F.zip_with(F.split("a_frag", ""), F.split("b_frag", ""), lambda x, y: F.when(x == y, x)), lambda c, i: F.struct(i.alias("j"), c.alias("aa"))), lambda s: s["aa"].isNotNull())
    rows = p.select(*keys, hamming(F.col("a_frag"), F.col("b_frag")).alias("pm"), agreed.alias("m"))
    both = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct((y["j"] - x["j"]).alias("distance"), x["aa"].alias("aa1"), y["aa"].alias("aa2")))))
    return rows.select(*keys, "pm", F.inline(both)).groupBy(*keys, "pm", "distance", "aa1", "aa2").agg(F.count(F.lit(1)).alias("count"))


def exchanges(p: DataFrame) -> DataFrame:
    """pm, aa1, aa2, count: residues that stand against each other, by the pair's distance."""
    at = F.inline(F.zip_with(F.split("a_frag", ""), F.split("b_frag", ""), lambda x, y: F.struct(x.alias("aa1"), y.alias("aa2"))))
    return p.select(hamming(F.col("a_frag"), F.col("b_frag")).alias("pm"), at).groupBy("pm", "aa1", "aa2").agg(F.count(F.lit(1)).alias("count"))


def mutation_places(p: DataFrame) -> DataFrame:
    """pm, j, count: where pairs differ."""
    at = F.posexplode(F.zip_with(F.split("a_frag", ""), F.split("b_frag", ""), lambda x, y: x != y)).alias("j", "differs")
    return p.select(hamming(F.col("a_frag"), F.col("b_frag")).alias("pm"), at).filter("differs").groupBy("pm", "j").agg(F.count(F.lit(1)).alias("count"))


def two_mutation_gaps(p: DataFrame) -> DataFrame:
    """gap, count of the pairs that differ at two places."""
    at = F.filter(F.transform(F.zip_with(F.split("a_frag", ""), F.split("b_frag", ""), lambda x, y: x != y), lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
    return p.select(at.alias("at")).filter(F.size("at") == 2).groupBy((F.col("at")[1] - F.col("at")[0]).alias("gap")).agg(F.count(F.lit(1)).alias("count"))


def random_residue(*key) -> Column:
    return F.substr(F.lit(RESIDUES), (keyed_int(20, *key) + 1).cast("int"), F.lit(1))
