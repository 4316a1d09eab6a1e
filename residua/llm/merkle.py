"""A Merkle manifest of a data set: a digest for every row, a tree over the rows of each source, a tree over the sources.

A leaf is the digest of a row's columns, taken where the row is read; texts never move.  Leaves are ordered by a range
partitioning of (source, id) that is written once, and numbered from the counts of its ranges, so that no task holds a source.
Aligned blocks of 3 ** LEVELS leaves are then gathered and walked recursively, in postorder: a call returns its subtree's
digest and, unwinding, appends the siblings of each child to the proofs of the leaves that the child contains.  The blocks'
roots are the nodes of the next such traversal, until each source has one node left; the sources' roots go through the same
function.  Proofs are then completed downwards, block by block, so that no join has a key with more rows than a block.

A proof is one binary cell: for each level a byte (how many siblings stand to the left, times 4, plus how many to the right)
and the siblings' 32-byte digests.  ``folded`` recomputes a root from any leaf and a proof.

Defined results: null columns count as ``-``; a null source is a source of its own, first in order; rows go by id, null first,
equal ids by leaf; repeated rows are leaves each; a very long text costs one pass of SHA-256; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.llm.scratch import settle, tidied

FAN, LEVELS = 3, 5
SOME = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """The digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def digest(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def subtree(nodes: list[bytes], proofs: list[bytearray], first: int, h: int) -> bytes:
    """The digest of the node of height h over the nodes from ``first`` on; siblings are appended to the proofs of what it holds."""
    if h == 0:
        return nodes[first]
    width = FAN ** (h - 1)
    starts = [s for s in range(first, first + FAN * width, width) if s < len(nodes)]
    children = [subtree(nodes, proofs, s, h - 1) for s in starts]
    for k, s in enumerate(starts):
        added = bytes([4 * k + len(children) - 1 - k]) + b"".join(children[:k] + children[k + 1 :])
        for i in range(s, min(s + width, len(nodes))):
            proofs[i] += added
    return digest(children)


def walked(batches: Iterator[pa.RecordBatch], high: int) -> Iterator[pa.RecordBatch]:
    """Blocks (tree, block, total, nodes in order, held) to their roots and the proofs inside them, SOME at a time."""
    for whole in batches:
        for batch in (whole.slice(i, SOME) for i in range(0, whole.num_rows, SOME)):
            roots, found = [], []
            for total, nodes in zip(batch.column("total").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
                proofs = [bytearray() for _ in nodes]
                roots.append(subtree(nodes, proofs, 0, min(high, height(total))))
                found.append(list(map(bytes, proofs)))
            made = {"root": pa.array(roots, pa.binary()), "proofs": pa.array(found, pa.list_(pa.binary()))}
            yield pa.RecordBatch.from_pydict({c: made[c] if c in made else batch.column(c) for c in ("tree", "block", "total", "root", "proofs", "held")})


def numbered(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Adds pos (the place in the tree, from 0) and total (rows of the tree) to rows with ``tree`` (never null)."""
    keys = ["tree", *order]
    # a place is the partition's number in its upper bits and the row's in its lower 33
    ranged = settle(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), "merkle-ranges").withColumn("part", F.shiftright("place", 33))
    counts = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("opens"))
    over = Window.partitionBy("tree")
    base = counts.select("tree", "part", "opens", F.coalesce(F.sum("n").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(over).alias("total"))
    return ranged.join(base, ["tree", "part"]).withColumn("pos", F.col("base") + F.col("place") - F.col("opens")).drop("part", "base", "place", "opens")


def forest(rows: DataFrame, order: tuple[str, ...], held: str, high: int) -> tuple[DataFrame, list[DataFrame]]:
    """The roots (tree, root) of the trees over rows (tree, node and what ``order`` and ``held`` name), and the levels of blocks
    of FAN ** high nodes."""
    block = FAN**high
    nodes, levels = numbered(rows, order).select("tree", "pos", "total", "node", F.col(held).alias("held")), []
    while True:
        at = F.struct((F.col("pos") % block).alias("at"), "node", "held")
        blocks = nodes.groupBy("tree", F.floor(F.col("pos") / block).alias("block")).agg(F.any_value("total").alias("total"), F.sort_array(F.collect_list(at)).alias("_rows"))
        blocks = blocks.select("tree", "block", "total", F.col("_rows.node").alias("nodes"), F.col("_rows.held").alias("held"))
        kind = blocks.schema["held"].dataType.simpleString()
        levels.append(settle(blocks.mapInArrow(lambda it: walked(it, high), f"tree {blocks.schema['tree'].dataType.simpleString()}, block long, total long, root binary, proofs array<binary>, held {kind}"), f"merkle-{len(levels)}"))
        nodes = levels[-1].select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / block).alias("total"), F.col("root").alias("node"), F.lit(None).cast("boolean").alias("held"))
        if not levels[-1].filter(F.col("total") > block).limit(1).count():
            return levels[-1].select("tree", "root"), levels


def completed(levels: list[DataFrame], above: DataFrame, carried: tuple[str, ...], block: int) -> DataFrame:
    """tree, pos, held, proof (from the leaf to the last root) and ``carried`` of every row; above: tree, proof and ``carried``
    of the trees' roots."""
    now = above.select("tree", F.lit(0).cast("long").alias("block"), F.col("proof").alias("upper"), *carried)
    for level in reversed(levels):
        each = level.select("tree", "block", "proofs", "held").join(now, ["tree", "block"]).select("tree", "block", "upper", *carried, F.posexplode(F.arrays_zip("proofs", "held")).alias("at", "x"))
        now = each.select("tree", (F.col("block") * block + F.col("at")).alias("block"), F.concat("x.proofs", "upper").alias("upper"), F.col("x.held").alias("held"), *carried)
        last, now = now, now.drop("held")
    return last.select("tree", F.col("block").alias("pos"), "held", F.col("upper").alias("proof"), *carried)


def siblings(proof: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """A proof's levels from below: the digests to the left and to the right."""
    at = 0
    while at < len(proof):
        left, right = divmod(proof[at], 4)
        cut = [proof[at + 1 + 32 * i : at + 33 + 32 * i] for i in range(left + right)]
        yield cut[:left], cut[left:]
        at += 1 + 32 * (left + right)


def folded(node: bytes, proof: bytes) -> bytes:
    """The root that a leaf and a proof give."""
    return reduce(lambda n, s: digest([*s[0], n, *s[1]]), siblings(proof), node)


def proof_digest(proof: bytes) -> bytes:
    """One digest of all siblings, from leaf to root, left to right."""
    return digest([d for left, right in siblings(proof) for d in left + right])


def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, what each leaf is now, gives way to the digest of its proof and the root that both lead to."""
    for batch in batches:
        proofs = batch.column("proof").to_pylist()
        own = [proof_digest(p) for p in proofs]
        again = [folded(n, p) for n, p in zip(batch.column("now").to_pylist(), proofs, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own, pa.binary()), pa.array(again, pa.binary())], names=[*batch.schema.names[:-1], "proof_digest", "folded_root"])


def leaves(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """tree (the source as a key: null sorts first), doc_id, source, node (the leaf), now (the leaf as the text is now).

    tampered: the text as it is found at checking time; None: nothing has changed."""
    own = leaf([F.col(c) for c in columns])
    now = own if tampered is None else leaf([tampered if c == text_col else F.col(c) for c in columns])
    tree = F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("0"))
    return docs.select(tree.alias("tree"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), own.alias("node"), now.alias("now"))


@tidied
def manifest(docs: DataFrame, high: int = LEVELS, **names) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof, proof_digest, folded_root (all digests binary) of every row; ``names``: as
    for ``leaves``."""
    rows = leaves(docs, **names).withColumn("held", F.struct("doc_id", "source", F.col("node").alias("leaf"), "now"))
    subroots, levels = forest(rows, ("doc_id", "node"), "held", high)
    sources = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("key"), F.col("root").alias("node")).withColumn("held", F.struct("key", F.col("node").alias("subroot")))
    root, upper = forest(sources, ("key",), "held", high)
    whole = root.select("tree", F.lit(b"").alias("proof"), "root")
    above = completed(upper, whole, ("root",), FAN**high).select(F.col("held.key").alias("tree"), "proof", F.col("held.subroot").alias("subroot"), "root")
    found = completed(levels, above, ("subroot", "root"), FAN**high).select("held.doc_id", "held.source", "held.leaf", "subroot", "root", "proof", "held.now")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.drop("now").schema.fields)
    return found.mapInArrow(checked, f"{schema}, proof_digest binary, folded_root binary")
