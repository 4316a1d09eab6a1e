"""What holds inside proteins, counted in numpy: gaps between equal residues, and how many proteins hold a fragment.

Texts are dealt out by protein, each whole (rows that share an id are one protein), and a task takes about ``PART`` residues of
whole proteins at a time.  Only counts leave a part, so that no residue and no window is a row.  A task holds some tens of bytes
for each residue of a part, and of a protein that is longer than one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, LETTERS, PART = 5, 12, 1 << 20
X = ord("X") & 31
ALPHABET = np.frombuffer(b"\0ABCDEFGHIJKLMNOPQRSTUVWXYZ", "S1").astype("U1")


def dealt(prots: DataFrame) -> DataFrame:
    """prot_id, seq, the rows of an id one after another in one task."""
    tasks = 4 * prots.sparkSession.sparkContext.defaultParallelism
    return prots.select("prot_id", "seq").repartition(tasks, "prot_id").sortWithinPartitions("prot_id")


def grouped(batches: Iterator[pa.RecordBatch], part: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """codes of the texts of some proteins, 0 behind each text; of each code the number of its protein and the place in its
    text (from 1); and of each protein whether it has an id."""
    texts, owners, known, size, last = [], [], [], 0, None

    def told():
        lengths = np.array([len(x) for x in texts])
        place = np.arange(1, size + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return np.frombuffer(b"".join(texts), np.uint8) & 31, np.repeat(np.array(owners), lengths), place, np.array(known)

    for batch in batches:
        ids, seqs = batch.column("prot_id"), batch.column("seq")
        for row in range(batch.num_rows):
            ident = ids[row].as_py()
            if not texts or ident != last:
                if size >= part:
                    yield told()
                    texts, owners, known, size = [], [], [], 0
                known.append(ident is not None)
                last = ident
            texts.append((seqs[row].as_py() or "").encode() + b"\0")
            owners.append(len(known) - 1)
            size += len(texts[-1])
    if texts:
        yield told()


def gaps(codes: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each two neighbouring equal residues of a protein, X left out: protein and letter as one number, and the gap."""
    free = (codes > 0) & (codes != X)
    v = np.sort((owner[free] << BITS | codes[free]) << 32 | place[free])
    same = v[1:] >> 32 == v[:-1] >> 32
    return v[1:][same] >> 32, (v[1:] - v[:-1])[same]


def gap_counts(batches: Iterator[pa.RecordBatch], part: int = PART) -> Iterator[pa.RecordBatch]:
    """aa, gap, n."""
    for codes, owner, place, _ in grouped(batches, part):
        key, gap = gaps(codes, owner, place)
        found, n = np.unique((key & 31) << 32 | gap, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(ALPHABET[found >> 32]), pa.array((found & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["aa", "gap", "n"])


def gap_entropies(batches: Iterator[pa.RecordBatch], part: int = PART) -> Iterator[pa.RecordBatch]:
    """aa, entropy (of the gaps, in bits): one row for each residue of a protein that has a gap."""
    for codes, owner, place, _ in grouped(batches, part):
        key, gap = gaps(codes, owner, place)
        found, n = np.unique(key << 32 | gap, return_counts=True)
        if len(found):
            key = found >> 32
            of = np.flatnonzero(np.diff(key, prepend=-1))
            total = np.add.reduceat(n, of)
            e = np.log2(total) - np.add.reduceat(n * np.log2(n), of) / total
            yield pa.RecordBatch.from_arrays([pa.array(ALPHABET[key[of] & 31]), pa.array(np.maximum(e, 0))], names=["aa", "entropy"])


def fragment_counts(batches: Iterator[pa.RecordBatch], lf: int, part: int = PART) -> Iterator[pa.RecordBatch]:
    """word, prots, hits of the fragments of lf residues without X; letters are packed, the first one highest."""
    for codes, owner, _, known in grouped(batches, part):
        stops = np.flatnonzero((codes == 0) | (codes == X))
        own = np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(len(codes)) >= lf
        word, wide = np.zeros(len(codes), np.int64), np.concatenate((codes, np.zeros(lf, np.uint8))).astype(np.int64)
        for k in range(lf):
            word = word << BITS | wide[k : k + len(codes)]
        word, owner = word[own], owner[own]
        if len(word):
            # proteins stand in order, and still do inside a fragment
            order = np.argsort(word, kind="stable")
            word, owner = word[order], owner[order]
            new = np.concatenate(([True], word[1:] != word[:-1]))
            first = (new | np.concatenate(([True], owner[1:] != owner[:-1]))) & known[owner]
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(np.add.reduceat(first.astype(np.int64), at)), pa.array(np.diff(at, append=len(word)))], names=["word", "prots", "hits"])


def text(word: Column, lf: int) -> Column:
    """The letters of a packed word of ``lf``."""
    letter = lambda k: F.char(F.shiftright(word, BITS * (lf - 1 - k)).bitwiseAND(31) + 64)
    return F.concat(*[letter(k) for k in range(lf)])
