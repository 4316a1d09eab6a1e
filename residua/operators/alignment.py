"""The 14 scores of a pair of fragments: with mismatches and costly gaps in closed form, the others by dynamic programming
over Arrow batches, all pairs of a batch and all cells of an anti-diagonal at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Scores and the names of the gap schemes with their opening costs.
MATCH, MISMATCH, EXTEND = 100, 0, -10
SCHEMES = {"Sn": -200, "Mn": -300, "Ln": -400, "Sg": -201, "Mg": -301, "Lg": -401}
METRICS = ("HD", *(f"NW{s}" for s in SCHEMES), "SH", *(f"SW{s}" for s in SCHEMES))
LOW = -(10**8)


def aligned(a: np.ndarray, b: np.ndarray, opening: int, free_ends: bool) -> np.ndarray:
    """Scores of rows of two byte matrices (pairs by length); the first place of a gap costs ``opening``."""
    n, la = a.shape
    lb = b.shape[1]
    two_ago = np.full((n, la + 1), LOW, np.int32)
    one_ago, gap_b, gap_a = two_ago.copy(), two_ago.copy(), two_ago.copy()
    best = np.full(n, LOW, np.int32)
    for d in range(la + lb + 1):
        lo, hi = max(0, d - lb), min(la, d)
        now = np.full((n, la + 1), LOW, np.int32)
        new_b, new_a = np.full((n, la + 1), LOW, np.int32), np.full((n, la + 1), LOW, np.int32)
        if d == 0:
            now[:, 0] = 0
        else:
            new_b[:, lo : hi + 1] = np.maximum(one_ago[:, lo : hi + 1] + opening, gap_b[:, lo : hi + 1] + EXTEND)
            new_a[:, 1:] = np.maximum(one_ago[:, :-1] + opening, gap_a[:, :-1] + EXTEND)
            i = np.arange(max(lo, 1), min(hi, d - 1) + 1)
            now = np.maximum(new_b, new_a)
            if len(i):
                now[:, i] = np.maximum(now[:, i], two_ago[:, i - 1] + np.where(a[:, i - 1] == b[:, d - i - 1], MATCH, MISMATCH))
            if free_ends:
                if d <= lb:
                    now[:, 0] = 0
                if d <= la:
                    now[:, d] = 0
            now[:, :lo] = LOW
            now[:, hi + 1 :] = LOW
        if free_ends:
            if la <= d:
                best = np.maximum(best, now[:, la])
            if 0 <= d - lb <= la:
                best = np.maximum(best, now[:, d - lb])
        elif d == la + lb:
            best = now[:, la]
        new_b[:, :lo], new_b[:, hi + 1 :], new_a[:, :lo], new_a[:, hi + 1 :] = LOW, LOW, LOW, LOW
        two_ago, one_ago, gap_b, gap_a = one_ago, now, new_b, new_a
    return best


def matches_by_diagonal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """100 times the matches at equal places, and on the best diagonal."""
    n = a.shape[1]
    best = np.zeros(len(a), np.int64)
    for d in range(1 - n, n):
        m = (a[:, max(0, d) : n + min(0, d)] == b[:, max(0, -d) : n - max(0, d)]).sum(axis=1)
        best = np.maximum(best, m)
        if d == 0:
            same = m
    return MATCH * same, MATCH * best


def scores(left: list[str], right: list[str]) -> np.ndarray:
    """Pairs by METRICS; fragments of a pair have one length."""
    out = np.zeros((len(left), len(METRICS)), np.int64)
    size = np.array([len(x) for x in left])
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        for part in np.array_split(own, -(-len(own) // 512)):
            a = np.frombuffer("".join(left[i] for i in part).encode("latin-1", "replace"), np.uint8).reshape(len(part), n)
            b = np.frombuffer("".join(right[i] for i in part).encode("latin-1", "replace"), np.uint8).reshape(len(part), n)
            cols = {}
            cols["HD"], cols["SH"] = matches_by_diagonal(a, b)
            for name, opening in SCHEMES.items():
                cols[f"NW{name}"], cols[f"SW{name}"] = aligned(a, b, opening, False), aligned(a, b, opening, True)
            out[part] = np.stack([cols[m] for m in METRICS], axis=1)
    return out


def score_pairs(pairs: DataFrame, left: str = "frag1", right: str = "frag2", tasks: int | None = None) -> DataFrame:
    """``pairs`` with the 14 scores; fragments of unequal length get nulls.

    The work is far more than the bytes, so the rows are dealt to ``tasks`` of their own (four a core, unless given), which
    adaptive execution doesn't join."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", " + ", ".join(f"{m} long" for m in METRICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (left, right))
            good = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x and y and len(x) == len(y)]
            found = scores([a[i] for i in good], [b[i] for i in good])
            columns = []
            for k in range(len(METRICS)):
                col = [None] * len(a)
                for i, v in zip(good, found[:, k].tolist(), strict=True):
                    col[i] = v
                columns.append(pa.array(col, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *METRICS])

    tasks = tasks or 4 * pairs.sparkSession.sparkContext.defaultParallelism
    return pairs.repartition(tasks, *[F.col(c) for c in pairs.columns]).mapInArrow(run, fields)


def score_histogram(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """alignment, keys, score, count."""
    long = scored.unpivot(list(keys), list(METRICS), "alignment", "score")
    return long.groupBy("alignment", *keys, "score").agg(F.count(F.lit(1)).alias("count"))
