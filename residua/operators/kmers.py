"""Windows of sequences.  Sequences are cut into overlapping chunks first: taking a substring is linear in its place, so
windows cut from a whole long sequence cost its length squared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 64


def windows(prots: DataFrame, lf: int, keep: tuple[str, ...] = ("prot_id", "org"), valid_only: bool = False) -> DataFrame:
    """keep, pos (from 1), frag of every window of lf residues; valid_only: without X."""
    n = F.col("len") - lf + 1
    # a sequence that is too short has no array; a filter would be pushed down and make its residues once more
    numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")))
    chunks = F.posexplode(F.transform(numbers, lambda c: F.substr("seq", c * CHUNK + 1, F.lit(CHUNK + lf - 1))))
    cut = prots.select(*keep, chunks.alias("c", "chunk"))
    inside = cut.select(*keep, "c", "chunk", F.explode(F.sequence(F.lit(1), F.length("chunk") - lf + 1)).alias("p"))
    out = inside.select(*keep, (F.col("c") * CHUNK + F.col("p")).alias("pos"), F.substr("chunk", F.col("p"), F.lit(lf)).alias("frag"))
    return out.filter(~F.contains("frag", F.lit("X"))) if valid_only else out


def residues(prots: DataFrame, keep: tuple[str, ...] = ("prot_id", "org")) -> DataFrame:
    """keep, pos, aa of every residue."""
    return windows(prots, 1, keep).withColumnRenamed("frag", "aa")


def valid_windows(seq: Column, lf: Column) -> Column:
    """The number of windows of lf residues without X: runs between X each give their length less lf plus 1."""
    return F.aggregate(F.split(seq, "X"), F.lit(0).cast("long"), lambda s, r: s + F.greatest(F.length(r) - lf + 1, F.lit(0)))
