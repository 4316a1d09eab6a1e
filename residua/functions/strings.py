"""Comparisons of two strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from residua.functions.alphabet import RESIDUES


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strings of one length differ; null where the lengths differ."""
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, d: s + d)
    return F.when(F.length(a) == F.length(b), differ)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])


def count_of(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch)))


def composition(text: Column) -> Column:
    """Counts of the 20 residues, in alphabetical order."""
    return F.array(*[count_of(text, c) for c in RESIDUES])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v)


def compositional_overlap(a: Column, b: Column) -> Column:
    """Sum over residues of the smaller count."""
    return total(F.zip_with(composition(a), composition(b), lambda x, y: F.least(x, y)))


def decile(overlap: Column, length: Column) -> Column:
    return F.least(F.floor(F.lit(10) * overlap / length), F.lit(9))


def compositional_expectation(a: Column, b: Column) -> Column:
    """Sum of the products of counts over (n1 + n2 / 2)."""
    products = total(F.zip_with(composition(a), composition(b), lambda x, y: x * y))
    return products / (F.length(a) + F.length(b) / 2)


def consensus(a: Column, b: Column) -> Column:
    """Sum over all pairs of offsets of the common prefix length, over 100."""
    i, j = F.sequence(F.lit(1), F.length(a)), F.sequence(F.lit(1), F.length(b))
    rows = F.transform(i, lambda x: F.aggregate(F.transform(j, lambda y: common_prefix(F.substr(a, x), F.substr(b, y))), F.lit(0), lambda s, v: s + v))
    return F.aggregate(rows, F.lit(0), lambda s, v: s + v) / 100


def best_diagonal(a: Column, b: Column, length: int) -> Column:
    """The most matches on any diagonal of two strings of ``length``."""
    xs, ys = F.split(a, ""), F.split(b, "")

    def on(d: int) -> Column:
        n = length - abs(d)
        x, y = F.slice(xs, 1 + max(0, d), n), F.slice(ys, 1 + max(0, -d), n)
        return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)

    return F.greatest(*[on(d) for d in range(1 - length, length)]) if length > 1 else (a == b).cast("int")
