"""Line dedup by winnowing: later repeats of runs of lines are deleted.

A window starts at each line and ends with the line that brings it to ``min_words`` words; what the lines hold decides
where it ends, so equal runs have equal windows.  Of each window the line with the smallest hash (the last such) is
selected: any run that holds a whole window therefore holds a selected fingerprint.

Fingerprints are counted first; that shuffles one number for each, added up in each task before.  Places whose fingerprint
occurs nowhere else end there.  The places that are left are joined by position: each is extended to both sides by every
window that selects its line, from the first to the last (``windows`` of a fingerprint), and the contents of these, as
rolling hashes, meet those of the other places of the fingerprint.  The first place of a content, by doc_id, text hash and
line, keeps it; every other place deletes those lines.  Neighbouring fingerprints go on where one's windows end, so a
match is extended as far as it goes.

All that shuffles is hashes and places, counted or reduced to the first place before the shuffle; the fingerprints that
repeat are broadcast up to ``max_broadcast_rows`` and joined beyond that; the joins are equi-joins of written tables, which
adaptive execution splits where one fingerprint is very frequent.

Defined results: lines end at ``\\n`` and are compared without white space around them; a null text has no lines; a text of
fewer than ``min_words`` words has no window and stays; texts of any length are read whole, in time and memory linear in
their lines; lines without words are lines like others inside a window; ids may be of any type that can be ordered, null
after all others; a row that repeats an id and its text is the same document and is treated like it; an empty table gives
an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.scratch import free_name, settle, tidied

PLACE = pa.struct([("key", pa.binary()), ("first", pa.int32()), ("last", pa.int32())])
PRINT = pa.struct([("anchor", pa.int64()), ("windows", pa.list_(PLACE))])
SCHEMA = "text_key long, n_lines int, prints array<struct<anchor:long,windows:array<struct<key:binary,first:int,last:int>>>>"
#: Rolling hashes of runs of lines: two bases modulo a prime.
PRIME, BASES = (1 << 61) - 1, (0x1B873593CC9E2D51, 0x0C6A4A7935BD1E99)


def windows(text: bytes, min_words: int) -> tuple[int, list[dict]]:
    """The number of lines, and for each window its selected line, its content's hash and its first and last line.

    opens: the window is the first that selects this line, so that a place is counted once."""
    if not text:
        return 0, []
    lines = [x.strip() for x in text.split(b"\n")]
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    sizes = [len(x.split()) for x in lines]
    sums, powers = [], []
    for base in BASES:
        c, p = [0], [1]
        for h in hashes:
            c.append((c[-1] * base + h) % PRIME)
            p.append(p[-1] * base % PRIME)
        sums.append(c)
        powers.append(p)
    out, end, words, picked = [], 0, 0, -1
    least: deque[int] = deque()  # lines of the window that no later one beats, by hash from the smallest
    for start in range(len(lines)):
        while words < min_words and end < len(lines):
            while least and hashes[least[-1]] >= hashes[end]:
                least.pop()
            least.append(end)
            words += sizes[end]
            end += 1
        if words < min_words:
            break
        while least[0] < start:
            least.popleft()
        at = least[0]
        key = b"".join(((c[end] - c[start] * p[end - start]) % PRIME).to_bytes(8, "big") for c, p in zip(sums, powers, strict=True))
        out.append({"anchor": hashes[at] - (1 << 63), "opens": at != picked, "key": key, "first": start, "last": end - 1})
        picked = at
        words -= sizes[start]
    return len(lines), out


def prints(found: list[dict]) -> list[dict]:
    """The windows of each selected line together."""
    out: list[dict] = []
    for w in found:
        if w["opens"]:
            out.append({"anchor": w["anchor"], "windows": []})
        out[-1]["windows"].append({"key": w["key"], "first": w["first"], "last": w["last"]})
    return out


def fingerprinted(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            found = [windows((t or "").encode(), min_words) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1).cast(pa.int64()), pa.array([n for n, _ in found], pa.int32()), pa.array([prints(w) for _, w in found], pa.list_(PRINT))],
                names=["doc_id", "text_key", "n_lines", "prints"],
            )


@tidied
def repeats(docs: DataFrame, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, text_key, n_lines, runs (array of first, last): the line windows to delete from each document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.col(text_col).cast("string"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}"
    per_doc = settle(rows.mapInArrow(lambda it: fingerprinted(it, min_words), schema), "line-prints")
    counted = per_doc.select(F.explode("prints.anchor").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    often = settle(counted.filter("n > 1").select("anchor"), "line-often")
    if often.count() <= max_broadcast_rows:
        often = F.broadcast(often)
    places = per_doc.select("doc_id", "text_key", F.inline("prints")).join(often, "anchor", "left_semi")
    maybe = settle(places.select("doc_id", "text_key", F.inline("windows")), "line-maybe")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_key", "first")
    firsts = settle(maybe.groupBy("key").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "place"), "line-firsts")
    later = maybe.join(firsts, "key").filter(~place.eqNullSafe(F.col("place")))
    runs = later.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs"))
    docs_ = per_doc.select("doc_id", "text_key", "n_lines")
    joined = docs_.join(runs, docs_["doc_id"].eqNullSafe(runs["doc_id"]) & (docs_["text_key"] == runs["text_key"]), "left")
    return joined.select(docs_["doc_id"], docs_["text_key"], "n_lines", F.coalesce("runs", F.array().cast("array<struct<first:int,last:int>>")).alias("runs"))


def deleted_lines(runs):
    """The distinct line numbers that the runs cover, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["last"])))))


def dedup_lines(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the deleted lines; a document that loses them all keeps an empty text."""
    key, tk, gone = free_name(docs, "line_id"), free_name(docs, "line_key"), free_name(docs, "line_gone")
    some = found.filter(F.size("runs") > 0).select(F.col("doc_id").alias(key), F.col("text_key").alias(tk), deleted_lines(F.col("runs")).alias(gone)).dropDuplicates([key, tk])
    rows = docs.join(some, docs[id_col].eqNullSafe(some[key]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == some[tk]), "left")
    all_lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.transform(F.arrays_zip(all_lines.alias("x"), F.transform(all_lines, lambda _, i: F.array_contains(F.col(gone), i)).alias("g")), lambda s: F.when(~s["g"], s["x"])), "\n")
    return rows.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
