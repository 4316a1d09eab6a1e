"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's key and the CRC of its text are hashed to one of ``N_SLOTS`` virtual slots, for good.  Bytes and rows are added
up by slot (at most ``N_SLOTS`` sums, whatever the data), and a map from slot to shard is laid over them: version 0 deals
the slots out in turn, each later version edits the one before by moving the slots that bring the fullest shard nearer the
emptiest.  Growing by shards moves slots into the new shards only.

The map lives at a path: a folder a version, which never changes once written.  A run reads the newest version there,
grows it if more shards are asked for, moves slots if the data have got out of balance, and writes a new version only if
something moved; any past layout can be read again.  The first run writes versions 0 and 1.  Without a path the map is this
run's own.  The map
(``N_SLOTS`` rows) is what gets broadcast.

A record's place inside its shard is the number of rows in the shard's earlier virtual slots plus its rank in its own
virtual slot, so ranking needs no task larger than a virtual slot.

Defined results: a null text has no bytes (size 8) and CRC 0; a null key is a value like any other (the texts spread such
rows over the slots); texts of any length count whole; ties of load go to the shard with the smallest number, ties of place
by id, CRC and size; repeated rows get places of their own; ids may be of any type that can be ordered; an empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import heapq
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.llm.scratch import free_name, settle, shared_dir

N_SLOTS = 4096


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def virtual_slot(key: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string"), text_crc(text)), F.lit(n_slots)).cast("int")


def first_map(n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """Version 0: slots dealt out in turn."""
    return [s % n_shards for s in range(n_slots)]


def rebalance(slot_shard: list[int], slot_bytes: list[int], n_shards: int, max_moves: int | None = None) -> list[int]:
    """The map after moves, and swaps where no move helps, that each bring the fullest shard nearer to another one."""
    new, load = list(slot_shard), [0] * n_shards
    held: list[set[int]] = [set() for _ in range(n_shards)]
    for s, (shard, b) in enumerate(zip(new, slot_bytes, strict=True)):
        load[shard] += b
        if b:
            held[shard].add(s)
    moves = 0
    while max_moves is None or moves < max_moves:
        full, low = max(range(n_shards), key=lambda k: (load[k], -k)), min(range(n_shards), key=lambda k: (load[k], k))
        gap = load[full] - load[low]
        # what leaves the fullest shard on balance must be below the gap; half of it is best
        best = min(((abs(2 * slot_bytes[s] - gap), s, -1) for s in held[full] if slot_bytes[s] < gap), default=None)
        if best is None or best[0] > gap // 4:
            theirs = sorted(held[low], key=lambda s: (slot_bytes[s], s))
            for s in held[full]:
                lo, hi, want = 0, len(theirs), slot_bytes[s] - gap / 2
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if slot_bytes[theirs[mid]] < want else (lo, mid)
                for t in theirs[max(0, lo - 1) : lo + 1]:
                    d = slot_bytes[s] - slot_bytes[t]
                    if 0 < d < gap and (best is None or (abs(2 * d - gap), s, t) < best):
                        best = (abs(2 * d - gap), s, t)
        if best is None:
            return new
        _, s, t = best
        for x, a, b in ((s, full, low), (t, low, full)):
            if x >= 0:
                new[x] = b
                held[a].discard(x)
                held[b].add(x)
                load[a] -= slot_bytes[x]
                load[b] += slot_bytes[x]
        moves += 1
    return new


def grow(slot_shard: list[int], slot_bytes: list[int], n_shards: int, extra: int = 1) -> list[int]:
    """The map for ``n_shards + extra`` shards; slots move into the new shards only."""
    new, load = list(slot_shard), [0] * (n_shards + extra)
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for s, (shard, b) in enumerate(zip(new, slot_bytes, strict=True)):
        load[shard] += b
        heapq.heappush(held[shard], (-b, s))
    share = sum(load) / (n_shards + extra)
    for shard in range(n_shards, n_shards + extra):
        while True:
            full = max(range(n_shards), key=lambda k: load[k])
            while held[full] and -held[full][0][0] > share - load[shard]:
                heapq.heappop(held[full])
            if not held[full] or load[full] <= share:
                break
            b, s = heapq.heappop(held[full])
            new[s] = shard
            load[full] += b
            load[shard] -= b
    return new


# --- the stored map ---------------------------------------------------------------------------------------------------


def numbers_at(spark: SparkSession, path: str) -> dict[int, bool]:
    """The version folders at ``path``, in order, and whether each was written to its end."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path(path)):
        return {}
    found = [f.getPath() for f in fs.listStatus(fs_path(path))]
    numbered = {int(m[1]): x for x in found if (m := re.fullmatch(r"version=(\d+)", x.getName()))}
    return {n: bool(fs.exists(fs_path(x, "_SUCCESS"))) for n, x in sorted(numbered.items())}


def versions_at(spark: SparkSession, path: str) -> list[int]:
    """The versions that are stored at ``path``, in order; a folder that was not written to its end doesn't count."""
    return [n for n, ended in numbers_at(spark, path).items() if ended]


def next_version(spark: SparkSession, path: str) -> int:
    """The number after all that were ever begun, so that a writer that died blocks no later one."""
    return max(numbers_at(spark, path), default=-1) + 1


def write_version(spark: SparkSession, path: str, version: int, slot_shard: list[int]) -> None:
    """Written under a name of its own and renamed in one step, which fails if the version is there: two runs that edit a map
    at once can't overwrite each other, and one that dies on its way leaves no version."""
    rows = spark.createDataFrame(list(enumerate(slot_shard)), "virtual_slot int, shard int")
    own = f"{path}/_writing-{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(own)
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(own), hadoop.Path(f"{path}/version={version}")
    context = hadoop.FileContext.getFileContext(source.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(source, target, none)
    except Exception as e:
        context.delete(source, True)
        raise FileExistsError(f"another run has written version {version} of the map at {path}") from e


def read_version(spark: SparkSession, path: str, version: int) -> list[int]:
    rows = spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}").orderBy("virtual_slot").collect()
    return [r.shard for r in rows]


def map_versions(spark: SparkSession, path: str) -> DataFrame:
    """version, virtual_slot, shard of all stored versions."""
    rows = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    return rows.filter(F.col("version").isin(versions_at(spark, path))).select("version", "virtual_slot", "shard")


def edited(spark: SparkSession, path: str, load: list[int], n_shards: int) -> tuple[list[int], int]:
    """The map at ``path`` for ``n_shards``, balanced over ``load``, and its version; what changes is a new version."""
    stored = versions_at(spark, path)
    if stored:
        version, layout = stored[-1], read_version(spark, path, stored[-1])
        if len(layout) != len(load):
            raise ValueError(f"the map at {path} has {len(layout)} slots, not {len(load)}")
    else:
        version, layout = next_version(spark, path), first_map(n_shards, len(load))
        write_version(spark, path, version, layout)
    before = max(layout) + 1
    new = grow(layout, load, before, n_shards - before) if before < n_shards else layout
    if before > n_shards:
        raise ValueError(f"the map at {path} has {before} shards already, more than {n_shards}")
    new = rebalance(new, load, n_shards)
    if new != layout or not stored:
        version = next_version(spark, path)
        write_version(spark, path, version, new)
    return new, version


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every record, written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text).cast("long") + 8).alias("size")
    return settle(docs.select(F.col(id_col).alias("doc_id"), size, text_crc(F.col(text_col)).alias("text_crc32"), virtual_slot(F.col(id_col), F.col(text_col), n_slots).alias("virtual_slot")), "shard-records")


def slot_bytes(records: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows by virtual slot: ``n_slots`` sums at most come to the driver."""
    total, rows = [0] * n_slots, [0] * n_slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        total[r.virtual_slot], rows[r.virtual_slot] = r.b, r.n
    return total, rows


def own_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/shard-map-{uuid.uuid4().hex}"


def balanced_map(records: DataFrame, n_shards: int, n_slots: int = N_SLOTS, map_path: str | None = None) -> tuple[list[int], list[int], DataFrame, int]:
    """The map balanced by bytes, the rows by virtual slot, the table of all versions of the map, and the map's version."""
    spark, (load, rows) = records.sparkSession, slot_bytes(records, n_slots)
    path = map_path or own_path(spark)
    layout, version = edited(spark, path, load, n_shards)
    return layout, rows, map_versions(spark, path), version


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, map_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records with shard and place, and the table of map versions."""
    spark, records = docs.sparkSession, measured(docs, id_col, text_col, n_slots)
    layout, rows, versions, version = balanced_map(records, n_shards, n_slots, map_path)
    first, offsets = [0] * n_shards, []
    for s, k in enumerate(layout):
        offsets.append((s, k, first[k]))
        first[k] += rows[s]
    where = F.broadcast(spark.createDataFrame(offsets, "virtual_slot int, shard int, first long"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = records.withColumn("rank", rank).join(where, "virtual_slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank")).alias("slot"), "virtual_slot", F.lit(version).alias("map_version")), versions


def with_shards(docs: DataFrame, versions: DataFrame, version: int = 1, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """``docs`` with the shard that a version of the map gives each row; nothing shuffles."""
    slot, to = free_name(docs, "virtual_slot"), free_name(docs, "shard")
    layout = versions.filter(F.col("version") == version).select(F.col("virtual_slot").alias(slot), F.col("shard").alias(to))
    return docs.withColumn(slot, virtual_slot(F.col(id_col), F.col(text_col), n_slots)).join(F.broadcast(layout), slot).select(*docs.columns, slot, to)
