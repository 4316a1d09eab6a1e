"""Studies of pairs of fragments: distances and places of agreement, as they are and after both sides were shuffled.

A pair is held against ``n`` replicas of itself, each with both sides shuffled by a key of pair and replica; all are rows of one
pass, and what is asked for is counted by series.  A shuffle keeps a fragment's composition, so that what the shuffled series
has less than the natural one doesn't come from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from residua.functions.keys import numbered_keys
from residua.functions.strings import compositional_overlap, decile, hamming
from residua.operators.nullmodels import shuffled
from residua.operators.sampling import locality


def replicated(batches: Iterator[pa.RecordBatch], n: int, seed: str, most: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows (..., pair_id, a_frag, b_frag) with model: natural ones, and n of each with both fragments in keyed order."""
    for batch in batches:
        for begin in range(0, batch.num_rows, most):
            some = batch.slice(begin, most)
            row = np.repeat(np.arange(some.num_rows), n)
            ids, sides = some.column("pair_id").to_pylist(), []
            for side in "ab":
                texts = some.column(f"{side}_frag").to_pylist()
                size = np.array([len(x) for x in texts], np.int64)[row]
                ends = np.cumsum(size)
                owner = np.repeat(np.arange(len(row)), size)
                keys = numbered_keys([f"{seed}{side}:{i}:{r}:".encode() for i in ids for r in range(1, n + 1)], owner, np.arange(len(owner)) - np.repeat(ends - size, size))
                k = keys.copy().view(">u8").astype(np.uint64)
                letters = np.frombuffer("".join(x * n for x in texts).encode(), np.uint8)
                text = letters[np.lexsort((k[:, 1], k[:, 0], owner))].tobytes().decode()
                sides.append(pa.array(texts + [text[e - s : e] for s, e in zip(size.tolist(), ends.tolist(), strict=True)], pa.string()))
            at = pa.array(np.concatenate((np.arange(some.num_rows), row)))
            kept = [c for c in some.schema.names if c not in ("a_frag", "b_frag")]
            model = pa.array(["natural"] * some.num_rows + ["shuffled"] * len(row))
            yield pa.RecordBatch.from_arrays([*[some.column(c).take(at) for c in kept], *sides, model], names=[*kept, "a_frag", "b_frag", "model"])


def replicas(pairs: DataFrame, n: int, seed: str) -> DataFrame:
    """``pairs`` with model (natural, shuffled), each natural row with n others that have both fragments shuffled.  Pairs are dealt
    out by their number, as replicas are many times what a pair is; keys are made and put in order in numpy."""
    rows = pairs.select(*[c for c in pairs.columns if c not in ("a_frag", "b_frag")], "a_frag", "b_frag")
    schema = StructType([*rows.schema.fields, StructField("model", StringType())])
    return rows.repartition(8 * pairs.sparkSession.sparkContext.defaultParallelism).mapInArrow(lambda it: replicated(it, n, seed), schema)


def histogram(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """keys, pm, count."""
    return rows.groupBy(*keys, hamming(F.col("a_frag"), F.col("b_frag")).alias("pm")).agg(F.count(F.lit(1)).alias("count"))


def orthologs(pairs: DataFrame, n: int = 10, seed: str = "s8") -> DataFrame:
    """series, pm, count: pairs of different organisms, natural and shuffled, and, apart, those of one organism."""
    other = F.col("a_org") != F.col("b_org")
    both = histogram(replicas(pairs.filter(other), n, seed).withColumnRenamed("model", "series"), "series")
    same = histogram(pairs.filter(F.col("a_org") == F.col("b_org")).withColumn("series", F.lit("same_organism")), "series")
    return both.unionByName(same)


def paralogs(pairs: DataFrame, n: int = 10, seed: str = "s9") -> DataFrame:
    """org, same_prot, model, pm, count: pairs of one organism, for each, apart where both stand in one protein."""
    rows = pairs.filter(F.col("a_org") == F.col("b_org")).withColumn("same_prot", F.col("a_prot") == F.col("b_prot"))
    return histogram(replicas(rows, n, seed), F.col("a_org").alias("org"), "same_prot", "model")


def paralogs_by_composition(pairs: DataFrame, n: int = 10, seed: str = "s10") -> DataFrame:
    """same_prot, decile (of the compositional overlap), model, pm, count: pairs of one organism."""
    rows = pairs.filter(F.col("a_org") == F.col("b_org")).withColumn("same_prot", F.col("a_prot") == F.col("b_prot"))
    overlap = compositional_overlap(F.col("a_frag"), F.col("b_frag"))
    return histogram(replicas(rows.withColumn("decile", decile(overlap, F.length("a_frag"))), n, seed), "same_prot", "decile", "model")


def twilight_locality(pairs: DataFrame, band: tuple[int, int], n: int = 10, seed: str = "s8") -> DataFrame:
    """model, pm, distance, aa1, aa2, count over pairs of agreeing places, where a pair's distance lies in the band."""
    return locality(replicas(pairs, n, seed), ("model",)).filter(F.col("pm").between(*band))


def shuffle_models(pairs: DataFrame, lengths: tuple[int, int], seed: str = "s12") -> DataFrame:
    """model, lf, pm, count for every length of the range: the first lf residues of each pair as they are, against the second
    side shuffled, and against it with both halves shuffled apart; one pass of a row for each length and model."""
    rows = pairs.select("pair_id", "a_frag", "b_frag", F.explode(F.sequence(F.lit(lengths[0]), F.lit(lengths[1]))).alias("lf"))
    rows = rows.withColumns({"a_frag": F.substr("a_frag", F.lit(1), "lf"), "b_frag": F.substr("b_frag", F.lit(1), "lf"), "half": F.floor(F.col("lf") / 2).cast("int")})
    b = F.col("b_frag")
    full = shuffled(b, F.col("pair_id"), seed)
    halves = F.concat(shuffled(F.substr(b, F.lit(1), F.col("half")), F.col("pair_id"), f"{seed}a"), shuffled(F.substr(b, F.col("half") + 1, F.col("lf") - F.col("half")), F.col("pair_id"), f"{seed}b"))
    models = F.array(*[F.struct(F.lit(n).alias("model"), c.alias("b_frag")) for n, c in (("natural", b), ("full", full), ("half", halves))])
    return histogram(rows.select("lf", "a_frag", F.inline(models)), "model", "lf")


def examples(pairs: DataFrame, k: int = 100) -> DataFrame:
    """pm, rank, pair_id, a_frag, b_frag: the first k pairs of each distance; Spark cuts each task's rows to k before they are dealt."""
    rows = pairs.select(hamming(F.col("a_frag"), F.col("b_frag")).alias("pm"), "pair_id", "a_frag", "b_frag")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("pm").orderBy("pair_id"))).filter(F.col("rank") <= k)
