"""How often fragments occur: occurrences, proteins, organisms; expectation; orthologs and paralogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from residua.functions.stats import log_bin
from residua.operators import heads, within
from residua.operators.composition import fragment_prob
from residua.operators.kmers import valid_windows, windows
from residua.sinks.scratch import settle


def hits(prots: DataFrame, lf: int, valid_only: bool = True) -> DataFrame:
    """frag, hits."""
    return windows(prots, lf, ("prot_id",), valid_only).groupBy("frag").agg(F.count(F.lit(1)).alias("hits"))


def hits_per_protein(prots: DataFrame, lf: int) -> DataFrame:
    """frag, prots, hits of the fragments without X; a protein without an id isn't counted.  Fragments of up to twelve residues
    are packed words, counted over whole proteins before they are dealt, so that no row tells of one protein.  Longer ones are
    counted by protein first: a frequent fragment sends one row a protein and task."""
    if lf <= within.LETTERS:
        found = within.dealt(prots).mapInArrow(lambda it: within.fragment_counts(it, lf), "word long, prots long, hits long")
        h = found.groupBy("word").agg(F.sum("prots").alias("prots"), F.sum("hits").alias("hits"))
        return h.select(within.text(F.col("word"), lf).alias("frag"), "prots", "hits")
    per = windows(prots, lf, ("prot_id",), True).groupBy("frag", "prot_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("frag").agg(F.count("prot_id").alias("prots"), F.sum("n").alias("hits"))


def histogram(df: DataFrame, value: str, name: str = "frags") -> DataFrame:
    return df.groupBy(value).agg(F.count(F.lit(1)).alias(name))


def per_organism(prots: DataFrame, lf: int) -> DataFrame:
    """frag, org, hits."""
    return windows(prots, lf, ("org",), True).groupBy("frag", "org").agg(F.count(F.lit(1)).alias("hits"))


def most_often(prots: DataFrame, lf: int, least: int = 5) -> DataFrame:
    """The fragments in the most proteins, ties kept; none below ``least`` proteins."""
    h = settle(hits_per_protein(prots, lf).filter(F.col("prots") >= least), "most-often")  # read twice, counted once
    top = h.agg(F.max("prots").alias("top"))
    return h.join(F.broadcast(top), F.col("prots") == F.col("top")).drop("top")


def expected(h: DataFrame, probs: Column, n_windows: int) -> DataFrame:
    """Adds prob, exp and ratio (hits over expectation) to (frag, hits)."""
    return h.withColumn("prob", fragment_prob(F.col("frag"), probs)).withColumn("exp", F.col("prob") * n_windows).withColumn("ratio", F.col("hits") / F.col("exp"))


def n_valid(prots: DataFrame, lf: int) -> int:
    return prots.agg(F.sum(valid_windows(F.col("seq"), F.lit(lf)))).first()[0] or 0


def over_under(e: DataFrame, factor: float) -> DataFrame:
    """Counts of over- and underrepresented fragments and the summed absolute error."""
    return e.agg(
        F.count_if(F.col("hits") > F.col("exp") * factor).alias("over"), F.count_if(F.col("hits") * factor < F.col("exp")).alias("under"),
        F.count(F.lit(1)).alias("frags"), F.sum(F.abs(F.col("hits") - F.col("exp"))).alias("abs_error"),
    )


def prob_hits_histogram(e: DataFrame, base: float = 1.01) -> DataFrame:
    b, _ = log_bin(F.col("prob"), base)
    return e.groupBy(b.alias("prob_bin"), "hits").agg(F.count(F.lit(1)).alias("count"))


def error_to_expectation(e: DataFrame, n_windows: int) -> DataFrame:
    """over, under, unseen: error mass against independence, with the mass of fragments that never occur."""
    d = F.col("hits") - F.col("exp")
    return e.agg(F.sum(F.greatest(d, F.lit(0.0))).alias("over"), F.sum(F.greatest(-d, F.lit(0.0))).alias("under_seen"), ((1 - F.sum("prob")) * n_windows).alias("unseen"))


def ortholog_paralog(prots: DataFrame, lf: int) -> DataFrame:
    """Per fragment with several hits: pairs in different organisms and in one: half the sums of n(T - n) and n(n - 1)."""
    per = per_organism(prots, lf)
    t = per.groupBy("frag").agg(F.sum("hits").alias("total"), F.sum(F.col("hits") * F.col("hits")).alias("sq")).filter("total > 1")
    return t.select("frag", "total", ((F.col("total") * F.col("total") - F.col("sq")) / 2).cast("long").alias("ortho"), ((F.col("sq") - F.col("total")) / 2).cast("long").alias("para"))


def paralog_ratio(prots: DataFrame, lengths: list[int]) -> DataFrame:
    """lf, para, ortho, ratio: the chance that two windows come from one organism."""
    cols = [F.sum(F.greatest(F.col("len") - lf + 1, F.lit(0)).cast("long")).alias(str(lf)) for lf in lengths]
    per = prots.groupBy("org").agg(*cols).unpivot(["org"], [str(lf) for lf in lengths], "lf", "n").filter("n > 0")
    t = per.groupBy(F.col("lf").cast("int").alias("lf")).agg((F.sum(F.col("n") * F.col("n")).cast("double") / (F.sum("n").cast("double") * F.sum("n").cast("double"))).alias("para"))
    return t.select("lf", "para", (1 - F.col("para")).alias("ortho"), ((1 - F.col("para")) / F.col("para")).alias("ratio"))


def search(queries: DataFrame, prots: DataFrame, lf: int, key: str = "item_id") -> DataFrame:
    """key, pos, frag, hits, first_prot: exact occurrences of each query window in the corpus; 0 and null where none."""
    q = windows(queries, lf, (key,))
    wanted = q.select("frag").distinct()
    found = windows(prots, lf, ("prot_id",)).join(wanted, "frag", "left_semi").groupBy("frag").agg(F.count(F.lit(1)).alias("hits"), F.min("prot_id").alias("first_prot"))
    return q.join(found, "frag", "left").select(key, "pos", "frag", F.coalesce("hits", F.lit(0)).alias("hits"), "first_prot")


def representatives(prots: DataFrame, lf: int) -> DataFrame:
    """frag, prot_id, pos: the first place of every distinct fragment; a protein without an id only where no other has it (then
    no place).  Fragments of up to twelve residues are packed words, of which a task hands on the first places it has seen."""
    kind = prots.schema["prot_id"].dataType
    if lf <= within.LETTERS and isinstance(kind, IntegralType):
        rows = prots.select(F.col("prot_id").cast("long"), "seq").mapInArrow(lambda it: heads.first_places(it, lf), "word long, prot_id long, pos int")
        frag, key = within.text(F.col("word"), lf).alias("frag"), "word"
    else:
        rows, frag, key = windows(prots, lf, ("prot_id",)), F.col("frag"), "frag"
    known = F.when(F.col("prot_id").isNotNull(), F.struct("prot_id", "pos"))
    return rows.groupBy(key).agg(F.min(known).alias("f")).select(frag, F.col("f.prot_id").cast(kind).alias("prot_id"), "f.pos")


def context(prots: DataFrame, frags: DataFrame, lf: int, around: int = 20) -> DataFrame:
    """prot_id, pos, frag, before, after: every occurrence of the fragments with the text around it."""
    at = windows(prots, lf, ("prot_id",)).join(frags.select("frag").distinct(), "frag")
    start = F.greatest(F.col("pos") - around, F.lit(1))
    return at.join(prots.select("prot_id", "seq"), "prot_id").select(
        "prot_id", "pos", "frag", F.substr("seq", start, F.col("pos") - start).alias("before"), F.substr("seq", F.col("pos") + lf, F.lit(around)).alias("after")
    )


def ranked(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows under each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
