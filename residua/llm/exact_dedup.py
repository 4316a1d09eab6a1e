"""Exact dedup: a counting Bloom filter finds hashes that may repeat; only their rows shuffle.

Pass 1 hashes every row and counts how often each cell of the filter is hit; a cell that was hit once belongs to a hash that
occurs once, so the filter keeps one bit a cell: hit twice or more.  What moves for that is one cell number a row, added up
in each task before it shuffles (a hot group of copies is one number and a count), never a row.  Pass 2 looks each row's
cell up in the broadcast filter; a row whose cell is unset is unique and passes straight through, the others go to an exact
grouping by SHA-256.

The filter has ``bits_per_row`` cells a row.  Where that passes ``max_broadcast_bytes``, the hashes are dealt to ranges whose
filters don't: the narrow rows are written by range, each range is filtered by its own broadcast filter, and no row
shuffles for that.  Text is never shuffled.  Copies are counted before they shuffle; the join that hands a group's result
back to its rows is an equi-join that adaptive execution splits.

Defined results: a null text equals an empty one; a null id sorts after all others; of rows that repeat both id and text
one stays; texts of any length are hashed whole; ids may be of any type that can be ordered; an empty table gives an empty
result; columns of the input may have any names.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm.scratch import free_name, settle, tidied

BLOCK_BITS = 32768  # one bitmap_construct_agg bitmap: 4 KB


def normalised(text: Column) -> Column:
    """The text without its characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document, written once: doc_id, row_no (tells repeated rows apart), n_points, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("row_no"),
            F.length(text).cast("long").alias("n_points"),
            F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"),
        ),
        "dedup-keys",
    )


def _cell(h: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(1)), F.lit(blocks * BLOCK_BITS))


def repeat_filter(hashes: DataFrame, col: str, blocks: int) -> DataFrame:
    """(block, bits): the cells that were hit at least twice."""
    twice = hashes.select(_cell(F.col(col), blocks).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    place = F.floor(F.col("cell") / BLOCK_BITS).alias("block")
    return twice.select(place, F.pmod("cell", F.lit(BLOCK_BITS)).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def may_repeat(hashes: DataFrame, col: str, filt: DataFrame, blocks: int) -> DataFrame:
    """``hashes`` with a boolean ``may_repeat``; never false for a hash that occurs twice.  ``filt`` is of bounded size."""
    cell = _cell(F.col(col), blocks)
    bit = F.pmod(cell, F.lit(BLOCK_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    joined = hashes.withColumn("block", F.floor(cell / BLOCK_BITS)).join(F.broadcast(filt), "block", "left")
    return joined.withColumn("may_repeat", F.coalesce(F.bit_get(byte, bit.bitwiseAND(F.lit(7))) == 1, F.lit(False))).drop("block", "bits")


def marked(rows: DataFrame, col: str, n_rows: int, bits_per_row: int, max_broadcast_bytes: int) -> DataFrame:
    """``rows`` with ``may_repeat``, range by range of the hashes where one filter would be too large to broadcast."""
    ranges = max(1, ceil(n_rows * bits_per_row / 8 / max(max_broadcast_bytes, BLOCK_BITS // 8)))
    blocks = max(1, ceil(n_rows * bits_per_row / BLOCK_BITS / ranges))
    if ranges == 1:
        return may_repeat(rows, col, settle(repeat_filter(rows, col, blocks), "dedup-filter"), blocks)
    of = F.pmod(F.xxhash64(F.col(col), F.lit(2)), F.lit(ranges)).cast("int")
    dealt = settle(rows.withColumn("hash_range", of), "dedup-ranges", "hash_range")
    out = None
    for r in range(ranges):
        own = dealt.filter(F.col("hash_range") == r).drop("hash_range")
        part = settle(may_repeat(own, col, settle(repeat_filter(own, col, blocks), "dedup-filter"), blocks), "dedup-marked")
        out = part if out is None else out.unionByName(part)
    return out


@tidied
def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 24, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_points, row_no for every row of ``docs``."""
    rows = keys(docs, id_col, text_col)
    tested = marked(rows, "text_sha256", rows.count(), bits_per_row, max_broadcast_bytes)
    unique = tested.filter(~F.col("may_repeat")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "n_points", "row_no"
    )
    maybe = settle(tested.filter("may_repeat").drop("may_repeat"), "dedup-maybe")
    first = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("row_no").alias("r")))
    groups = settle(maybe.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), first.alias("best")), "dedup-groups")
    repeated = maybe.join(groups, "text_sha256").select(
        "doc_id", F.col("best.i").alias("keep_id"), "group_size", (F.col("row_no") == F.col("best.r")).alias("kept"), "text_sha256", "n_points", "row_no"
    )
    return unique.unionByName(repeated)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = 1_000_000, **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are told apart by id, normalised text and length; of rows that agree in all three one stays if any is to stay.
    What goes is broadcast up to ``max_broadcast_rows``."""
    copies = decisions(docs, id_col, text_col, **how).filter("group_size > 1")
    same = copies.groupBy("doc_id", "text_sha256", "n_points").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    name = {c: free_name(docs, f"dedup_{c}") for c in ("id", "hash", "points")}
    same = settle(same.select(F.col("doc_id").alias(name["id"]), F.col("text_sha256").alias(name["hash"]), F.col("n_points").alias(name["points"]), "stays", "n"), "dedup-same")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def met(rows: DataFrame, keys: DataFrame, how_: str) -> DataFrame:
        keys = keys.drop("stays", "n")
        if keys.count() <= max_broadcast_rows:
            keys = F.broadcast(keys)
        on = (F.sha2(normalised(rows[text_col]), 256) == keys[name["hash"]]) & (F.length(F.coalesce(rows[text_col], F.lit(""))) == keys[name["points"]]) & rows[id_col].eqNullSafe(keys[name["id"]])
        return rows.join(keys, on, how_)

    kept = met(docs, same.filter(~F.col("stays")), "left_anti")
    several = same.filter("stays and n > 1")
    if several.isEmpty():
        return kept
    hashed = met(kept, several, "left_semi").withColumn(name["hash"], F.sha2(normalised(F.col(text_col)), 256)).withColumn(name["points"], F.length(text))
    return met(kept, several, "left_anti").unionByName(hashed.dropDuplicates([id_col, name["hash"], name["points"]]).select(*docs.columns))
