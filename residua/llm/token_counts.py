"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

A batch's distinct pre-tokens are held as ragged arrays: one flat array of symbols and one of sequence numbers.  In each
round every sequence merges all occurrences of its lowest-ranked pair, left to right, all sequences at once; a sequence
without a known pair is done, and its surviving symbols are counted.  Counts of pre-tokens are kept between batches in a
cache of bounded size.  The vocabulary (merge list) is read on the driver and broadcast: its size is that of the file.

Strings of added tokens inside a text count one token each, as is the library's default.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; an empty table gives an
empty result; other columns are kept out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: how the vocabulary's library splits a text before merging (\s is Unicode's White_Space there).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHE = 400_000
NONE = np.int32(2**31 - 1)
SCHEMA = "n_bytes long, n_tokens long"


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else 256 and up in turn."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load(path: str) -> dict:
    """Pair keys in order with rank and merged symbol, the symbol of each byte, and the added tokens."""
    file = json.loads(Path(path).read_text(encoding="utf-8"))
    vocab = file["model"]["vocab"]
    size = max(vocab.values()) + 1
    pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    key = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(key)
    start = np.zeros(256, np.int32)
    for ch, b in byte_symbols().items():
        start[b] = vocab[ch]
    return {"size": size, "key": key[order], "rank": order.astype(np.int32), "to": np.array([vocab[a + b] for a, b in pairs], np.int32)[order], "start": start, "added": [t["content"] for t in file.get("added_tokens", [])]}


def count_symbols(tokens: list[bytes], v: dict) -> np.ndarray:
    """The number of symbols that each token ends with."""
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    counts = length.copy()
    ids = v["start"][np.frombuffer(b"".join(tokens), np.uint8)]
    seq = np.repeat(np.arange(len(tokens)), length)
    while len(ids) > 1:
        key = ids[:-1].astype(np.int64) * v["size"] + ids[1:]
        at = np.minimum(np.searchsorted(v["key"], key), len(v["key"]) - 1)
        known = (v["key"][at] == key) & (seq[1:] == seq[:-1])
        rank = np.append(np.where(known, v["rank"][at], NONE), NONE)
        first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        lowest = np.minimum.reduceat(rank, first)
        here = np.repeat(lowest, np.diff(np.append(first, len(seq))))
        open_ = here < NONE
        if not open_.all():  # sequences that are done leave
            done = lowest == NONE
            counts[seq[first[done]]] = np.diff(np.append(first, len(seq)))[done]
            ids, seq, rank, here = ids[open_], seq[open_], rank[open_], here[open_]
            at = np.append(at, 0)[open_]
            if not len(ids):
                return counts
        else:
            at = np.append(at, 0)
        chosen = rank == here
        place = np.arange(len(ids))
        gap = np.maximum.accumulate(np.where(chosen, -1, place))  # the last place before that isn't chosen
        chosen &= (place - gap) % 2 == 1  # of overlapping pairs in a run, every other one
        left = np.flatnonzero(chosen)
        ids = ids.copy()
        ids[left] = v["to"][at[left]]
        stay = np.ones(len(ids), bool)
        stay[left + 1] = False
        ids, seq = ids[stay], seq[stay]
    if len(ids):
        counts[seq[0]] = 1
    return counts


class Counter:
    """Token counts of texts, with a bounded cache of pre-token counts."""

    def __init__(self, vocab: dict):
        self.v, self.cache = vocab, {}
        self.split = regex.compile(PRE_TOKEN)
        self.added = regex.compile("|".join(map(regex.escape, sorted(vocab["added"], key=len, reverse=True)))) if vocab["added"] else None

    def count(self, texts: list[str]) -> list[int]:
        """Counts of a group of texts; what is held meanwhile is linear in the group."""
        totals, held = [], []
        for text in texts:
            special, pieces = 0, (text,)
            if self.added is not None and self.added.search(text):
                pieces = self.added.split(text)
                special = len(pieces) - 1
            tokens: list[str] = []
            for p in pieces:
                tokens += self.split.findall(p)
            totals.append(special)
            held.append(tokens)
        if len(self.cache) > CACHE:
            self.cache.clear()
        fresh = list(set().union(*held).difference(self.cache)) if held else []
        if fresh:
            self.cache.update(zip(fresh, count_symbols([t.encode() for t in fresh], self.v).tolist(), strict=True))
        get = self.cache.__getitem__
        return [n + sum(map(get, tokens)) for n, tokens in zip(totals, held, strict=True)]


def counted(batches: Iterator[pa.RecordBatch], vocab, group_chars: int) -> Iterator[pa.RecordBatch]:
    counter = Counter(vocab.value)
    for batch in batches:
        texts = batch.column(1).fill_null("").to_pylist()
        out, i = [], 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j]) <= group_chars):
                chars += len(texts[j])
                j += 1
            out += counter.count(texts[i:j])
            i = j
        n_bytes = [len(t.encode()) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(out, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", group_chars: int = 2_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document under the vocabulary file at ``path``."""
    vocab = docs.sparkSession.sparkContext.broadcast(load(path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(lambda it: counted(it, vocab, group_chars), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
