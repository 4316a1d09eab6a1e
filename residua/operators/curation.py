"""Curation of a genome table and of fragment files by text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that are left out, at their start or anywhere.
BAD_START = r"^(?:[a-z]|Alpha|Beta|Gamma|Candidatus|Uncultured)"
BAD_ANYWHERE = r"[A-Z][a-z]* bacterium|-like|OM182|PVC|SAR"


def unwanted(name: Column) -> Column:
    return name.rlike(BAD_START) | name.rlike(BAD_ANYWHERE)


def genus(name: Column) -> Column:
    """The first word, without brackets, quotes and anything in parentheses."""
    bare = F.regexp_replace(F.regexp_replace(name, r"[\[\]\"']", ""), r"\(.*\)", "")
    return F.regexp_replace(bare, r"^([^ \t]*) .*$", "$1")


def curated(genomes: DataFrame) -> DataFrame:
    """genus, fasta from (species, fasta), sorted."""
    return genomes.filter(~unwanted(F.col("species"))).select(genus(F.col("species")).alias("genus"), "fasta").orderBy("genus", "fasta")
