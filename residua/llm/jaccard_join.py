"""N-gram Jaccard join: exact links between documents by the sets of their word shingles, and their components.

Two documents link when den * intersection >= num * union of their sets of k-word shingles.  A size-aware heavy-light join
finds the candidates without loss:

* Equal sets are one class; one document, the smallest id, stands for it.  All later steps see classes only.
* Small sets (up to a boundary) are enumerated: two linked sets whose larger one has b elements share a subset of
  ceil(num b / den) elements, so the hashes of all subsets of the possible sizes are keys that every linked pair shares.
* Large sets are looked up in inverted lists: linked sets of a and b <= a elements share an element among the first
  a - ceil(num a / den) + 1 of each, in any order common to all sets.  The order puts elements of many documents last, so
  that the lists which are scanned are short.
* The boundary is where enumerating the subsets of a set begins to cost more than scanning its lists, given the corpus'
  mean list length.

The common order needs only to be the same for all; it comes from counts of all shingles of the corpus, gathered as
delta-coded 32-bit hashes by hash range and counted range by range; the level (log2 of the count) of frequent ones is kept
in a table of bounded size, the least count in it rising until it fits.  So the order loses sharpness, never a link.  A
bitmap of bounded size tells which shingles occur twice or more; those that don't are left out of the lists.

A list's documents are joined only where a bound allows a link: sizes within the threshold, and the sum of minima of two
histograms of the elements (about one bin for 16 elements, never below the true intersection) high enough.  What is joined
forms families (connected components on narrow edges), which are linked by the sets themselves.

Lists and families are groups of any size, and are searched alike (``grouped_links``): groups are packed to tasks and
searched breadth-first, comparing what is reached with what is not, so no pair is ever emitted.  A group above its budget is
cut into blocks; every block is searched together with about VISITORS documents of the whole group, which ties the blocks
of a group that hangs together; then the documents that are still outside of the group's largest component meet every
other block, in chunks.  That is exact for any group; it takes more than a constant number of copies of a row only where
a group falls apart although each of its lists or bounds allowed a link.

Defined results: a null or empty text has an empty set and links with nothing, not even another one; a text of fewer than
k words has its whole sequence as its only shingle; texts of any length count whole; ids are whole numbers; rows that repeat
an id with another text are documents of their own, told apart by a hash of the text, each in the component of its own set;
a row without an id has no component (null) and always stays; empty tables give empty results; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm.scratch import free_name, settle, tidied
from residua.llm.textbuf import LOWER_ASCII, NOT_SPACE, bounds, chunks, mix, prefix_sums, release, shingles, slice_hashes, trimmed, utf8

MAX_LEVELS = 1 << 22
MAX_BITS = 29
PART = 1 << 20
VISITORS = 8
MAX_TASKS = 50_000


def sets_of(column: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """The shingle sets of texts, some texts at a time."""
    data, at = utf8(column)
    for i, j in chunks(at):
        own, edges = LOWER_ASCII[data[at[i] : at[j]]], at[i : j + 1] - at[i]
        starts, ends, counts = bounds(own, edges, NOT_SPACE)
        yield shingles(slice_hashes(prefix_sums(own), starts, ends), counts, k)


def class_key(own: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return b"".join(int(mix(own + np.uint64(s)).sum(dtype=np.uint64)).to_bytes(8, "big") for s in (1, 2)) + len(own).to_bytes(4, "big")


# --- counts of all shingles, and the common order ---------------------------------------------------------------------


def gathered(batches: Iterator[pa.RecordBatch], k: int, range_bits: int) -> Iterator[pa.RecordBatch]:
    """All shingles of a few MB of text as 32-bit hashes: for each hash range the sorted differences, compressed."""
    held, n = [], 0

    def blobs() -> pa.RecordBatch:
        a = np.sort((np.concatenate(held) >> np.uint64(32)).astype(np.uint32))
        cut = np.searchsorted(a, np.arange(1 << range_bits, dtype=np.uint64) << np.uint64(32 - range_bits))
        parts = [p for p in np.split(a, cut[1:])]
        keep = [(r, p) for r, p in enumerate(parts) if len(p)]
        out = []
        for _, p in keep:
            d = np.diff(p.astype(np.int64), prepend=0)
            out.append(zlib.compress(d.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in keep], pa.int32()), pa.array(out, pa.binary())], names=["range", "blob"])

    for batch in batches:
        for sets in sets_of(batch.column(0), k):
            held += sets
            n += sum(map(len, sets))
            if n >= 1 << 21:
                yield blobs()
                held, n = [], 0
    if n:
        yield blobs()


COUNTED = "parts int, total long, seen long, hashes binary, counts binary, by_level array<long>"


def counted(_: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one hash range: the hashes that occur at least twice with log2 of their counts, PART of them a row, and how many
    hashes there are; at most 2**(32 - range_bits) distinct ones are held."""
    values, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    held, n, total = [], 0, 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        v, c = np.unique(np.concatenate(held), return_counts=True)
        u, back = np.unique(np.concatenate((values, v)), return_inverse=True)
        return u, np.bincount(back, weights=np.concatenate((counts, c)), minlength=len(u)).astype(np.int64)

    for table in tables:
        for blob in table.column("blob").to_pylist():
            raw = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
            held.append(np.cumsum(raw.astype(np.int64)).astype(np.uint32))
            n += len(raw)
            total += len(raw)
            if n >= 1 << 22:
                values, counts = fold()
                held, n = [], 0
    if held:
        values, counts = fold()
    some = counts >= 2
    often, level = values[some], np.floor(np.log2(np.maximum(counts[some], 1))).astype(np.uint8)
    for i in range(0, max(1, len(often)), PART):
        own, own_level = often[i : i + PART], level[i : i + PART]
        first = i == 0
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(first)], pa.int32()), pa.array([total if first else 0], pa.int64()), pa.array([len(values) if first else 0], pa.int64()),
                pa.array([own.astype("<u4").tobytes()], pa.binary()), pa.array([own_level.tobytes()], pa.binary()),
                pa.array([np.bincount(own_level, minlength=33).tolist()], pa.list_(pa.int64())),
            ],
            names=["parts", "total", "seen", "hashes", "counts", "by_level"],
        )
    release()


def above(batches: Iterator[pa.RecordBatch], floor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            level = np.frombuffer(c, np.uint8)
            some = level >= floor
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, "<u4")[some].astype(np.int64)), pa.array(level[some].astype(np.int32))], names=["hash", "level"])


def bits(batches: Iterator[pa.RecordBatch], size_bits: int) -> Iterator[pa.RecordBatch]:
    """For each row its hashes as bits, by their high bits: the first byte's place, and the bytes."""
    for batch in batches:
        for h in batch.column(0).to_pylist():
            at = np.frombuffer(h, "<u4") >> np.uint32(32 - size_bits)
            if len(at):
                first = int(at[0]) >> 3
                own = np.zeros((int(at[-1]) >> 3) - first + 1, np.uint8)
                np.bitwise_or.at(own, (at >> np.uint32(3)).astype(np.int64) - first, (1 << (at & np.uint32(7))).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["first", "bits"])


def levels(docs: DataFrame, text_col: str, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Levels by the low bits of a hash, bits by its high bits that are set where the hash occurs twice or more, and the mean
    number of documents of a shingle.  Both tables have bounds; where they are too small, more lists are scanned.  The number
    of hash ranges, each counted by a task, follows the number of documents."""
    range_bits = min(16, max(8, (docs.count() // 2000).bit_length()))
    blobs = docs.select(text_col).mapInArrow(lambda it: trimmed(gathered(it, k, range_bits)), "range int, blob binary")
    found = settle(blobs.groupBy("range").applyInArrow(counted, COUNTED), "join-levels")
    ends = found.agg(F.sum("total"), F.sum("seen")).first()
    total, seen = ends[0] or 0, ends[1] or 0
    sizes = dict(found.select(F.posexplode("by_level").alias("level", "n")).groupBy("level").agg(F.sum("n")).filter("level > 1").collect())
    floor = 2
    while sum(n for level, n in sizes.items() if level >= floor) > MAX_LEVELS // 4:
        floor += 1
    rows = found.select("hashes", "counts").mapInArrow(lambda it: above(it, floor), "hash long, level int").toArrow()
    size = 1 << max(10, (4 * max(1, rows.num_rows) - 1).bit_length())
    table = np.zeros(size, np.uint8)
    slot = rows.column("hash").to_numpy() & (size - 1)
    np.maximum.at(table, slot, rows.column("level").to_numpy().astype(np.uint8))

    twice = found.agg(F.sum(F.length("counts").cast("long"))).first()[0] or 0
    size_bits = min(MAX_BITS, max(13, (8 * twice).bit_length()))
    seen_twice = np.zeros(1 << (size_bits - 3), np.uint8)
    for r in found.select("hashes").mapInArrow(lambda it: bits(it, size_bits), "first long, bits binary").toLocalIterator():
        own = np.frombuffer(r.bits, np.uint8)
        seen_twice[r.first : r.first + len(own)] |= own
    return table, seen_twice, total / max(1, seen)


# --- keys -------------------------------------------------------------------------------------------------------------


def needed(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def subset_sizes(n: int, num: int, den: int) -> list[int]:
    """Sizes of the subsets that a set of n shares with a linked one at least as large."""
    return sorted({needed(b, num, den) for b in range(n, n * den // num + 1)})


def enumeration(n: int, num: int, den: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, num, den))


def boundary(mean_list: float, num: int, den: int, most: int = 64) -> int:
    """The largest size up to which enumerating costs less than scanning.

    A subset costs a key; a list costs a key and, for each document met on it, a comparison of n elements of which about
    64 go for the cost of a key.
    """
    best = 0
    for n in range(1, most + 1):
        scan = (n - needed(n, num, den) + 1) * (1 + mean_list * n / 64) * 8
        if enumeration(n, num, den) > scan:
            break
        best = n
    return best


def keys_of(own: np.ndarray, table: np.ndarray, twice: np.ndarray, small: int, num: int, den: int) -> np.ndarray:
    """The keys of a set (sorted distinct hashes): of subsets, of the first elements in the common order, or both.  Elements
    of no other document are no keys."""
    n, out = len(own), []
    if n <= small * den // num:  # it may be the larger set of a pair whose smaller one is small
        with np.errstate(over="ignore"):
            for c in subset_sizes(n, num, den) if n <= small else [needed(n, num, den)]:
                picks = np.array(list(combinations(range(n), c)), int)
                spread = mix(own + np.uint64(77))
                out.append(mix(spread[picks].sum(axis=1, dtype=np.uint64) + np.uint64(c)))
    if n > small:
        p = n - needed(n, num, den) + 1
        level = table[(own >> np.uint64(32)).astype(np.int64) & (len(table) - 1)]
        first = own[np.lexsort((own, level))[:p]]
        at = (first >> np.uint64(64 - (len(twice) * 8).bit_length() + 1)).astype(np.int64)
        out.append(first[twice[at >> 3] >> (at & 7) & 1 == 1])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(own: np.ndarray) -> bytes:
    """Counts of the elements by their low bits, in about a bin for 16 of them; empty where a count passes a byte."""
    bins = 1 << max(4, (len(own) // 16).bit_length())
    c = np.bincount((own & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return c.astype(np.uint8).tobytes() if len(own) and c.max() < 256 else b""


def plausible(sizes: np.ndarray, sketches: list[bytes], num: int, den: int) -> np.ndarray:
    """For each document of a list the first of its component, where links are all pairs that the bound allows."""
    n = len(sizes)
    out, open_ = np.arange(n), np.ones(n, bool)
    bins = np.array([len(x) for x in sketches])
    place = np.zeros(n, int)
    table = {}
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        place[own] = np.arange(len(own))
        table[b] = (own, np.frombuffer(b"".join(sketches[i] for i in own), np.uint8).reshape(len(own), b).astype(np.int32) if b else None)
    for first in range(n):
        if not open_[first]:
            continue
        open_[first] = False
        queue = [first]
        while queue:
            v = queue.pop()
            out[v] = first
            mine = table[bins[v]][1][place[v]] if bins[v] else None
            for b, (own, rows) in table.items():
                pick = np.flatnonzero(open_[own] & (den * np.minimum(sizes[own], sizes[v]) >= num * np.maximum(sizes[own], sizes[v])))
                if not len(pick):
                    continue
                if mine is not None and rows is not None:
                    low = min(b, len(mine))
                    theirs = rows[pick].reshape(len(pick), -1, low).sum(axis=1)
                    most = np.minimum(theirs, mine.reshape(-1, low).sum(axis=0)).sum(axis=1)
                    other = sizes[own[pick]]
                    pick = pick[den * most >= num * (other + sizes[v] - most)]
                hit = own[pick]
                open_[hit] = False
                queue += hit.tolist()
    return out


def by_group(table: pa.Table) -> list[np.ndarray]:
    """The places of each group's rows, by doc_id."""
    group, ids = table.column("group").to_numpy(), table.column("doc_id").to_numpy()
    order = np.lexsort((ids, group))
    return np.split(order, np.flatnonzero(np.diff(group[order]) != 0) + 1) if len(order) else []


def star(ids: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """Edges from the first document of each component; parts: places, and the place in them of each one's first."""
    a = np.concatenate([ids[own[first]] for own, first in parts]) if parts else np.zeros(0, np.int64)
    b = np.concatenate([ids[own] for own, _ in parts]) if parts else np.zeros(0, np.int64)
    pairs = np.unique(np.stack([a, b])[:, a != b], axis=1)
    release()
    return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})


def list_search(num: int, den: int):
    """Edges inside each list of a task, where sizes and sketches allow a link."""

    def run(table: pa.Table) -> pa.Table:
        size, sketches = table.column("n_shingles").to_numpy(), table.column("sketch").to_pylist()
        parts = [(own, plausible(size[own], [sketches[i] for i in own], num, den)) for own in by_group(table) if len(own) > 1]
        return star(table.column("doc_id").to_numpy(), parts)

    return run


def keyed(batches: Iterator[pa.RecordBatch], shared, k: int, small: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    table, twice = shared.value
    for batch in batches:
        i = 0
        for sets in sets_of(batch.column(1), k):
            keys = [keys_of(s, table, twice, small, num, den).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, len(sets)), batch.column(2).slice(i, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "class", "sketch", "keys"],
            )
            i += len(sets)


# --- components -------------------------------------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (smallest node of its component) of all nodes of (a, b).

    Each round hooks every node to the smallest root next to it and halves the way to the root; edges between nodes of one
    root leave.  The rows are written each round, so a lost executor costs one round at most."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc-roots")
    for _ in range(max_rounds):
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        roots = settle(roots.join(up, "root").select("node", F.col("up").alias("root")), "cc-roots")
        by_a, by_b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        open_ = edges.join(by_a, "a").join(by_b, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        edges = settle(open_, "cc-edges")
        unfinished = roots.join(up.withColumnRenamed("root", "k"), roots["root"] == F.col("k")).filter("up <> root").limit(1).count()
        if edges.isEmpty() and not unfinished:
            return roots
        hooks = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).groupBy("hi").agg(F.min("lo").alias("lo"))
        roots = settle(roots.join(hooks, roots["node"] == hooks["hi"], "left").select("node", F.when(F.col("root") == F.col("node"), F.coalesce("lo", "root")).otherwise(F.col("root")).alias("root")), "cc-roots")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


# --- links inside a family --------------------------------------------------------------------------------------------


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The component (its first member's place) of each set, by exact links; sets must not be empty."""
    n = len(sets)
    out = np.arange(n)
    if n == 1:
        return out
    sizes = np.array([len(s) for s in sets])
    universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    member = [flat[starts[i] : starts[i + 1]] for i in range(n)]
    left = np.arange(n)  # not reached yet
    left_flat, left_starts = flat, starts[:-1]
    mark = np.zeros(len(universe), np.uint8)
    while len(left):
        root, queue = left[0], [left[0]]
        gone = np.zeros(len(left), bool)
        gone[0] = True
        while queue:
            v = queue.pop()
            out[v] = root
            mark[member[v]] = 1
            both = np.add.reduceat(mark[left_flat], left_starts, dtype=np.int64)
            mark[member[v]] = 0
            new = np.flatnonzero(~gone & (den * both >= num * (sizes[left] + sizes[v] - both)))
            gone[new] = True
            queue += left[new].tolist()
            if 4 * gone.sum() > len(left) or not queue:  # the sets that are still to be reached move together
                first, alone = left[0], gone[0] and gone.sum() == 1  # the root is first only until sets have moved
                left = left[~gone]
                gone = np.zeros(len(left), bool)
                if not len(left):
                    out[queue] = root
                    break
                left_flat = left_flat[sizes[first] :] if alone else np.concatenate([member[i] for i in left])
                left_starts = np.concatenate(([0], np.cumsum(sizes[left])[:-1]))
    return out


def task_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        i = 0
        for sets in sets_of(batch.column(1), k):
            n = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(2).slice(i, n), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "group", "elements"])
            i += n


def set_search(num: int, den: int):
    """Links inside each family of a task."""

    def run(table: pa.Table) -> pa.Table:
        elements = table.column("elements").combine_chunks()
        at, flat = elements.offsets.to_numpy(), elements.values.to_numpy(zero_copy_only=False).view(np.uint64)
        parts = [(own, linked([flat[at[i] : at[i + 1]] for i in own], num, den)) for own in by_group(table) if len(own) > 1]
        return star(table.column("doc_id").to_numpy(), parts)

    return run


def grouped_links(rows: DataFrame, run, budget: int, pack: int, name: str) -> DataFrame:
    """Edges (a, b) that connect what ``run`` links inside each group, whatever the group's size.

    rows (written): group, doc_id, load (of the whole group), n (its rows), and what ``run`` compares.  Groups with a load up
    to ``budget`` are searched whole, about ``pack`` of load in a task; larger ones are cut into blocks of half a budget."""
    found = "a long, b long"
    small, big = rows.filter(F.col("load") <= budget), rows.filter(F.col("load") > budget)
    total = small.agg(F.sum(F.col("load") / F.col("n"))).first()[0] or 0
    tasks = min(MAX_TASKS, max(1, ceil(total / pack)))  # a number of its own: the work is not in proportion to the bytes
    edges = settle(small.withColumn("task", F.pmod(F.xxhash64("group"), F.lit(tasks))).repartition(tasks, "task").groupBy("task").applyInArrow(run, found), f"{name}-links")
    n_blocks = F.ceil(F.col("load") * 2 / budget)
    big = settle(big.withColumn("blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "doc_id"), n_blocks)), f"{name}-blocks")
    if big.isEmpty():
        return edges
    own = big.columns

    def everywhere(some: DataFrame) -> DataFrame:
        """The rows in each block of their group but their own."""
        to = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("to")
        moved = some.select("*", to).filter("to <> block")
        return moved.drop("block").withColumnRenamed("to", "block").select(*some.columns)

    visitors = everywhere(big.filter(F.pmod(F.xxhash64(F.lit("visit"), "doc_id"), F.col("n")) < VISITORS))
    met = big.unionByName(visitors).groupBy("group", "block").applyInArrow(run, found)
    edges = settle(edges.unionByName(met), f"{name}-links")
    # what is outside of a group's largest component meets every block, some of it at a time
    labels = components(edges).withColumnRenamed("node", "doc_id") if not edges.isEmpty() else None
    labelled = big.join(labels, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")) if labels is not None else big.withColumn("root", F.col("doc_id"))
    largest = labelled.groupBy("group", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("group").agg(F.max(F.struct("m", "root"))["root"].alias("top"))
    outside = settle(labelled.join(largest, "group").filter("root <> top").select(*own), f"{name}-outside")
    if outside.isEmpty():
        return edges
    chunks = outside.groupBy("group").agg(F.ceil(F.count(F.lit(1)) * F.first("load") / F.first("n") / budget).alias("chunks"))
    guests = everywhere(outside).join(chunks, "group").withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "doc_id"), F.col("chunks")))
    hosts = big.join(chunks, "group").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    met = guests.unionByName(hosts.select(*guests.columns)).groupBy("group", "block", "chunk").applyInArrow(run, found)
    return settle(edges.unionByName(met), f"{name}-links")


@tidied
def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", pack_tokens: int = 150_000, list_limit: int = 1000, max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key (xxhash64 of the text) of every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(F.col(text_col)).alias("text_key"))
    table, twice, mean = levels(docs, "text", k)
    small = boundary(mean, num, den)
    shared = docs.sparkSession.sparkContext.broadcast((table, twice))
    rows = settle(docs.mapInArrow(lambda it: trimmed(keyed(it, shared, k, small, num, den)), "doc_id long, text_key long, n_shingles long, class binary, sketch binary, keys array<long>"), "join-keys")
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    # a class is named by a number of its own, since one id may stand in several
    reps = full.groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
    reps = settle(reps.withColumn("rep", class_number(F.col("class"))), "join-reps")
    lists = reps.select("rep", F.explode("keys").alias("key"))
    shared_keys = settle(lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "join-lists")
    entries = lists.join(shared_keys, "key").join(reps.select("rep", "n_shingles", "sketch"), "rep")
    entries = settle(entries.select(F.col("key").alias("group"), F.col("rep").alias("doc_id"), F.col("n").alias("load"), "n", "n_shingles", "sketch"), "join-entries")
    edges = settle(grouped_links(entries, list_search(num, den), list_limit, 25_000, "join-lists").distinct(), "join-edges")
    names = reps.select("class", "rep", "least")
    if edges.isEmpty():
        roots = None
    else:
        named = settle(components(edges).select(F.col("node").alias("rep"), F.col("root").alias("family")), "join-named")
        # one document of each class in a family brings the text
        bring = settle(names.join(named, "rep").select("least.doc_id", "least.text_key", "rep", "family"), "join-bring")
        texts = docs.join(F.broadcast(bring) if bring.count() <= max_broadcast_rows else bring, ["doc_id", "text_key"]).select("rep", "text", "family")
        sets = texts.mapInArrow(lambda it: trimmed(task_sets(it, k)), "doc_id long, group long, elements array<long>").dropDuplicates(["doc_id"])
        members = settle(sets.withColumn("n_shingles", F.size("elements").cast("long")), "join-members")
        sizes = members.groupBy("group").agg(F.sum("n_shingles").alias("load"), F.count(F.lit(1)).alias("n"))
        links = grouped_links(settle(members.join(sizes, "group"), "join-families"), set_search(num, den), pack_tokens, 500_000, "join-sets")
        roots = None if links.isEmpty() else components(links)
    if roots is None:
        of_class = names.select("class", F.col("least.doc_id").alias("component"))
    else:
        by_class = settle(names.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("class", F.col("least.doc_id").alias("least"), F.coalesce("root", "rep").alias("root")), "join-classes")
        smallest = by_class.groupBy("root").agg(F.min("least").alias("component"))
        of_class = by_class.join(smallest, "root").select("class", "component")
    told = rows.select("doc_id", "text_key", "n_shingles", "class").join(settle(of_class, "join-of-class"), "class", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return told.select("doc_id", "n_shingles", own.alias("component_id"), "text_key")


def class_number(name: Column) -> Column:
    """A 63-bit number that stands for a class."""
    return F.xxhash64(name).bitwiseAND(F.lit((1 << 63) - 1))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row of each component of ``docs``: of those with its smallest id, the one with the smallest text hash.  Rows without
    words or without an id stay, but for those that repeat another one's id and text.  ``found`` is the written result of
    jaccard_components; the rows that go are broadcast up to ``max_broadcast_rows``."""
    rows = found.filter("doc_id is not null").groupBy("doc_id", "text_key").agg(F.first("component_id").alias("component_id"), F.first("n_shingles").alias("size"), F.count(F.lit(1)).alias("n"))
    rows = settle(rows, "join-rows")
    own = [F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key")]
    # rows with another id than their component's go; of those with its id, all but one text
    firsts = rows.filter("doc_id = component_id and size > 0")
    several = settle(firsts.groupBy("doc_id").agg(F.min("text_key").alias("head"), F.count(F.lit(1)).alias("texts")).filter("texts > 1").drop("texts"), "join-several")
    other = firsts.join(several, "doc_id").filter("text_key <> head").select(*own)
    gone = settle(rows.filter("size > 0 and doc_id <> component_id").select(*own).unionByName(other), "join-gone")
    twice = settle(rows.filter("n > 1").select(*own), "join-twice")

    def met(some: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = F.broadcast(keys) if keys.count() <= max_broadcast_rows else keys
        return some.join(keys, (some[id_col] == keys["own_id"]) & (text_key(some[text_col]) == keys["own_key"]), how)

    kept = met(docs, gone, "left_anti")
    if twice.isEmpty():
        return kept
    key = free_name(docs, "join_key")
    once = met(kept, twice, "left_semi").withColumn(key, text_key(F.col(text_col))).dropDuplicates([id_col, key]).drop(key)
    return met(kept, twice, "left_anti").unionByName(once)
