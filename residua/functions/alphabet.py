"""The residue alphabet, normalisation of text to it, and integer codes of fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 20 residues, and what each letter A-Z counts as (X: none of them).
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
EXCHANGE = "ADCDEFGHIXKLMNKPQRSTCVWXYE"

SPACE = r"[ \t\n\r\x0b\x0c]"


def exchanged(letters: Column) -> Column:
    """Capital letters by the exchange table; anything else stays."""
    return F.translate(letters, LETTERS, EXCHANGE)


def normalise(text: Column, fold_case: bool = True) -> Column:
    """Residues of a text: white space goes, letters follow the exchange table, all else is X.

    fold_case: a-z count as A-Z; a strict sequence file has them as X."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")
    if fold_case:
        bare = F.translate(bare, LETTERS.lower(), LETTERS)
    return F.regexp_replace(exchanged(bare), "[^A-Z]", "X")


def code(fragment: Column) -> Column:
    """The fragment as a number of base 20, first residue most significant; null if it holds X or is over 14 long."""
    digits = F.transform(F.split(fragment, ""), lambda c: F.instr(F.lit(RESIDUES), c) - 1)
    value = F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 20 + d)
    return F.when((F.length(fragment) <= 14) & ~F.contains(fragment, F.lit("X")), value)


def decode(value: Column, length: int) -> Column:
    """The fragment of ``length`` residues that has this code."""
    places = F.sequence(F.lit(length - 1), F.lit(0), F.lit(-1))
    return F.array_join(F.transform(places, lambda p: F.substr(F.lit(RESIDUES), (F.floor(value / F.pow(F.lit(20.0), p)) % 20 + 1).cast("int"), F.lit(1))), "")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def next_prime(n: int) -> int:
    """The smallest prime above n."""
    n += 1
    while not is_prime(n):
        n += 1
    return n
