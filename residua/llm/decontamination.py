"""Benchmark decontamination: one Aho-Corasick automaton over the items' words, one scan of each text.

Items and texts are normalised alike: A-Z in lower case, words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.  The
benchmark's words are numbered; a text becomes the sequence of its words' numbers, 0 for words of no item.  A window is
``window`` consecutive words of an item, or all its words where there are fewer.

Every window holds one of the item's aligned blocks of half its length, so the automaton's patterns are these blocks (and
whole items that are shorter than a window): its size is that of the benchmark, not ``window`` times that.  Where a block
ends in a text, the windows around it are looked up by hash among all windows of the items and compared word by word, all
at once in numpy; hot phrases cost no more than others.  Hits are counted in words and mapped back to code points.

The benchmark is broadcast in parts of at most ``max_pattern_chars`` characters of item text (50 MB, so that a benchmark of
ordinary size is one part); of a larger one, each part is a pass of its own with its own automaton, chained in one stage.

Defined results: a null text or item has no words; texts of any length are scanned whole, items too; items that repeat a
text all count; an item id of null reads as an empty string; ties (several items in one place) all count, in order of id;
repeated documents are scanned each; ids may be of any type; empty tables give an empty result or no hits; other columns
are kept out.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm.textbuf import MULTIPLIER, chunks, mix, trimmed, utf8

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Byte by byte: lower case; whatever stands between words becomes a space.
NORMAL = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER = {b: b + 32 for b in range(65, 91)}
STATE = "n_words long, hits array<int>, items array<string>"
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
STEP = 1 << 18


def window_hashes(flat: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n numbers from each start, some at a time."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(0, len(starts), STEP):
        own = starts[i : i + STEP]
        h = np.full(len(own), n, np.uint64)
        for j in range(n):
            h = h * MULTIPLIER + mix(flat[own + j].astype(np.uint64) + np.uint64(1))
        out[i : i + STEP] = mix(h)
    return out


@dataclass
class Part:
    """Some items: their words, the numbers of all items' words one after another with 0 between, the patterns' places, and for
    each length of a window the sorted hashes of all windows, one place of each, and the items that hold it."""

    name: str
    window: int
    words: list[bytes]
    flat: np.ndarray
    patterns: list[tuple[int, int]]
    ids: list[str]
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def part_of(items: list[tuple[str, list[bytes]]], window: int) -> Part:
    number: dict[bytes, int] = {}
    block = (window + 1) // 2
    seqs = [[number.setdefault(w, len(number) + 1) for w in words] for _, words in items]
    starts = np.concatenate(([0], np.cumsum([len(s) + 1 for s in seqs]))).astype(np.int64)
    flat = np.zeros(int(starts[-1]), np.int32)
    patterns: dict[tuple, tuple[int, int]] = {}
    places: dict[int, list[np.ndarray]] = {}
    owners: dict[int, list[np.ndarray]] = {}
    for k, (s, at) in enumerate(zip(seqs, starts.tolist(), strict=False)):
        flat[at : at + len(s)] = s
        n = min(window, len(s))
        if n == window:
            for i in range(len(s) // block):
                patterns.setdefault(tuple(s[i * block : (i + 1) * block]), (at + i * block, block))
        else:
            patterns.setdefault(tuple(s), (at, n))
        places.setdefault(n, []).append(at + np.arange(len(s) - n + 1))
        owners.setdefault(n, []).append(np.full(len(s) - n + 1, k))
    tables = {}
    for n, own in places.items():
        at, who = np.concatenate(own), np.concatenate(owners[n]).astype(np.int32)
        h = window_hashes(flat, at, n)
        order = np.lexsort((at, h))
        h, at, who = h[order], at[order], who[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        tables[n] = (h[first], at[first].astype(np.int32 if len(flat) < 1 << 31 else np.int64), np.append(first, len(h)), who)
    return Part(uuid.uuid4().hex, window, list(number), flat, list(patterns.values()), [i for i, _ in items], tables)


def parts(items: Iterator, window: int, max_chars: int) -> Iterator[Part]:
    """The items with words, in parts of at most max_chars characters (or one item)."""
    held, chars = [], 0
    for item_id, text in items:
        words = (text or "").encode().translate(NORMAL).split()
        if words:
            n = sum(map(len, words)) + len(words)
            if held and chars + n > max_chars:
                yield part_of(held, window)
                held, chars = [], 0
            held.append((item_id, words))
            chars += n
    if held:
        yield part_of(held, window)


_BUILT: dict[str, tuple] = {}


def automaton(part: Part) -> tuple[ahocorasick.Automaton, dict[bytes, int]]:
    """Of a broadcast part, with its words' numbers; the one built last is kept."""
    if part.name not in _BUILT:
        _BUILT.clear()
        a = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for at, n in part.patterns:
            a.add_word(tuple(part.flat[at : at + n].tolist()), n)
        a.make_automaton()
        _BUILT[part.name] = a, {w: k + 1 for k, w in enumerate(part.words)}
    return _BUILT[part.name]


def candidates(ends: np.ndarray, lengths: np.ndarray, part: Part) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts): where windows of each length may start in view of the patterns that were met."""
    block = (part.window + 1) // 2
    for n in part.windows:
        if n == part.window:
            last = ends[lengths == block] - block + 1  # a window that holds the block starts there at the latest
            yield n, np.unique((last[:, None] - np.arange(n - block + 1)).ravel())
        else:
            yield n, ends[lengths == n] - n + 1


def hits_of(ids: list[int], part: Part, a: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of all windows that occur in ``ids``, and the place of each in the table of its length."""
    met = list(a.iter(tuple(ids)))
    if not met:
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    seq = np.array(ids, np.int32)
    ends, lengths = np.array(met, np.int64).T
    found, rows = [], []
    for n, starts in candidates(ends, lengths, part):
        starts = starts[(starts >= 0) & (starts + n <= len(seq))]
        hashes, places, _, _ = part.windows[n]
        h = window_hashes(seq, starts, n)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        same = hashes[at] == h
        starts, at = starts[same], at[same]
        if len(starts):
            exact = np.ones(len(starts), bool)
            for j in range(n):
                exact &= seq[starts + j] == part.flat[places[at] + j]
            found.append(np.stack([starts[exact], np.full(exact.sum(), n)], axis=1))
            rows.append(at[exact])
    return (np.concatenate(found), np.concatenate(rows)) if found else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))


def spans_of(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Code points from the first to the last word of each run of hit words."""
    words = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": words[a][0], "end": words[b - 1][1]} for a, b in edge.reshape(-1, 2)]


def scanned(texts: pa.Array, part: Part | None) -> Iterator[tuple[int, int, list[int], dict[int, np.ndarray], dict[int, set[str]]]]:
    """For ranges i, j of texts: the number of words of each; for texts with hits the hit words and the items."""
    data, at = utf8(texts)
    a, number = automaton(part) if part is not None else (None, {})
    for i, j in chunks(at):
        base = at[i]
        raw = data[base : at[j]].tobytes().translate(NORMAL)
        n_words, ids = [], []
        get = number.get
        for d in range(i, j):
            w = raw[at[d] - base : at[d + 1] - base].split()
            n_words.append(len(w))
            if a is not None:
                ids += [get(x, 0) for x in w]
                ids.append(0)  # no pattern reaches over the end of a text
        hits: dict[int, np.ndarray] = {}
        items: dict[int, set[str]] = {}
        if a is not None:
            found, rows = hits_of(ids, part, a)
            if len(found):
                edge = np.zeros(len(ids) + 1, np.int64)
                np.add.at(edge, found[:, 0], 1)
                np.add.at(edge, found[:, 0] + found[:, 1], -1)
                covered = np.cumsum(edge[:-1]) > 0
                ends = np.cumsum(np.array(n_words) + 1)
                whose = np.searchsorted(ends, found[:, 0], side="right")
                for d in np.unique(whose):
                    hits[int(d)] = np.flatnonzero(covered[ends[d] - n_words[d] - 1 : ends[d] - 1])
                    own = whose == d
                    items[int(d)] = set()
                    for n in np.unique(found[own, 1]):
                        _, _, cut, who = part.windows[int(n)]
                        for r in np.unique(rows[own & (found[:, 1] == n)]):
                            items[int(d)].update(part.ids[k] for k in who[cut[r] : cut[r + 1]])
        yield i, j, n_words, hits, items


def passed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Adds a part's hits to what the passes before have found: id, text, n_words, hits, items."""
    for batch in batches:
        before = batch.num_columns > 2
        for i, j, n_words, hits, items in scanned(batch.column(1), shared and shared.value):
            own = batch.slice(i, j - i)
            old_hits, old_items = (own.column(3).to_pylist(), own.column(4).to_pylist()) if before else ([[]] * (j - i), [[]] * (j - i))
            hit = [sorted({*h, *hits[d].tolist()}) if d in hits else h for d, h in enumerate(old_hits)]
            item = [sorted({*x, *items[d]}) if d in items else x for d, x in enumerate(old_items)]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(n_words, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(item, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "hits", "items"])


def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hit words as their number and as code points of the text."""
    for batch in batches:
        texts, n_words, hits = batch.column(1), batch.column(2).to_pylist(), batch.column(3)
        spans = []
        for d, own in enumerate(hits):
            if not len(own):
                spans.append([])
                continue
            hit = np.zeros(n_words[d], bool)
            hit[own.values.to_numpy()] = True
            spans.append(spans_of(texts[d].as_py(), hit))
        n_hit = pc.cast(pc.list_value_length(hits), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n_hit, batch.column(4), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_words", "n_hit", "items", "spans"])


def shared_parts(spark: SparkSession, items: DataFrame, window: int, item_id: str, item_text: str, max_pattern_chars: int) -> list:
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(item_text).cast("string")).toLocalIterator()
    return [spark.sparkContext.broadcast(p) for p in parts(((r[0], r[1]) for r in rows), window, max_pattern_chars)]


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_pattern_chars: int = 50_000_000) -> DataFrame:
    """For every document: doc_id, n_words, n_hit, items (ids with occurring windows), spans (hit code points)."""
    broadcasts = shared_parts(docs.sparkSession, items, window, item_id, item_text, max_pattern_chars)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    for b in broadcasts[:-1]:
        rows = rows.mapInArrow(lambda it, b=b: trimmed(passed(it, b)), f"doc_id {kind}, text string, {STATE}")
    last = broadcasts[-1] if broadcasts else None
    return rows.mapInArrow(lambda it: trimmed(ended(passed(it, last))), f"doc_id {kind}, {FOUND}")


def clean(batches: Iterator[pa.RecordBatch], shared, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, _, hits, _ in scanned(batch.column(at), shared.value):
            yield batch.slice(i, j - i).filter(pa.array([d not in hits for d in range(j - i)], pa.bool_()))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_pattern_chars: int = 50_000_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of an item occurs."""
    at, schema = docs.columns.index(text_col), docs.schema
    for b in shared_parts(docs.sparkSession, items, window, item_id, item_text, max_pattern_chars):
        docs = docs.mapInArrow(lambda it, b=b: trimmed(clean(it, b, at)), schema)
    return docs


def digest(found: DataFrame) -> DataFrame:
    """The columns by which results are compared."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
