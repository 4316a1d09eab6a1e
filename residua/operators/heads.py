"""Heads of suffixes as packed words, and what the lengths up to a head's have in common once heads stand in order.

A word holds twelve letters of five bits, the first one highest, so that words compare as their letters do; after the end of
a text there are zeros.  Heads are cut and packed in numpy, ``PART`` letters at a time; Spark deals them out by ranges and puts
them in order.  Then substrings of every length are runs of neighbouring heads.  A task reads its heads in parts of ``PART`` rows
and closes the runs inside a part; the first and the last run of a part may go on in another one and are handed on as rows,
which are added up afterwards.  So no task holds a run, however frequent its substring is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators.suffix import cumulative
from residua.sinks.scratch import settle, tidied

BITS, LETTERS, PART = 5, 12, 1 << 18
X = ord("X") & 31
#: Keeps the first letters of a word.
KEEP = np.array([((1 << BITS * LETTERS) - 1) & ~((1 << BITS * (LETTERS - k)) - 1) for k in range(LETTERS + 1)], np.int64)
ALPHABET = np.frombuffer(b"\0ABCDEFGHIJKLMNOPQRSTUVWXYZ", "S1")


def n_words(longest: int) -> int:
    return -(-longest // LETTERS)


def names(longest: int) -> list[str]:
    return [f"w{k}" for k in range(n_words(longest))]


def parts(batches: Iterator[pa.RecordBatch], longest: int, part: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """codes of some texts (the column ``seq``) one after another, 0 behind each; of each letter the row of its batch and its
    place (from 1, 0 where it is only looked at), the letter before, and the batch."""
    for batch in batches:
        texts, size, rows, places, some = batch.column("seq"), 0, [], [], []
        for row in range(batch.num_rows):
            text = (texts[row].as_py() or "").encode()
            for at in range(0, len(text), part):
                piece = text[max(at - 1, 0) : at + part + longest]
                place = np.arange(max(at, 1), max(at, 1) + len(piece) + 1)
                place[min(at + part, len(text)) - max(at - 1, 0) :] = 0
                if at:
                    place[0] = 0
                some.append(piece + b"\0")
                rows.append(np.full(len(place), row))
                places.append(place)
                size += len(place)
                if size >= part:
                    yield together(some, rows, places, batch)
                    size, rows, places, some = 0, [], [], []
        if some:
            yield together(some, rows, places, batch)


def together(some: list, rows: list, places: list, batch: pa.RecordBatch) -> tuple:
    codes = np.frombuffer(b"".join(some), np.uint8) & 31
    return codes, np.concatenate(rows), np.concatenate(places), np.concatenate(([0], codes[:-1])), batch


def shifted(a: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate((a[k:], np.zeros(min(k, len(a)), a.dtype)))


def packed(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """The words of the ``longest`` letters from each place, up to the next 0; the last code is 0."""
    ends = np.flatnonzero(codes == 0)
    clear = np.minimum(np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(codes)), longest)
    w1 = codes.astype(np.int64)
    w2 = w1 << BITS | shifted(w1, 1)
    w4 = w2 << 2 * BITS | shifted(w2, 2)
    word = (w4 << 4 * BITS | shifted(w4, 4)) << 4 * BITS | shifted(w4, 8)
    return [shifted(word, LETTERS * k) & KEEP[np.clip(clear - LETTERS * k, 0, LETTERS)] for k in range(n_words(longest))]


def unpacked(words: list[np.ndarray], longest: int) -> np.ndarray:
    """The letters of heads, a row for each place."""
    return np.array([words[i // LETTERS] >> BITS * (LETTERS - 1 - i % LETTERS) & 31 for i in range(longest)], np.uint8)


def common(letters: np.ndarray) -> np.ndarray:
    """How many letters, of those that both have, each head has in common with the one before; -1 for the first."""
    same, n = np.ones(letters.shape[1] - 1, bool), np.zeros(letters.shape[1] - 1, np.int64)
    for row in letters:
        same &= (row[1:] == row[:-1]) & (row[1:] > 0)
        n += same
    return np.concatenate(([-1], n))


def buffered(batches: Iterator[pa.RecordBatch], part: int = PART) -> Iterator[dict[str, np.ndarray]]:
    """The batches of a task as arrays by column, ``part`` rows at a time."""
    some, size = [], 0

    def arrays():
        return {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in some]) for c in some[0].schema.names}

    for batch in batches:
        if batch.num_rows:
            some.append(batch)
            size += batch.num_rows
        if size >= part:
            yield arrays()
            some, size = [], 0
    if some:
        yield arrays()


def in_order(rows: DataFrame, by: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` dealt out by ranges and in order within them; a head that is frequent is dealt out by ``ties``, too."""
    return rows.repartitionByRange(*by, *ties).sortWithinPartitions(*by)


def first_places(batches: Iterator[pa.RecordBatch], lf: int, part: int = PART, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """word, prot_id, pos: the first place of each fragment of ``lf`` letters (up to LETTERS) among the texts of a task; what it holds
    is told apart anew each ``most`` windows, and handed on when that many are held still."""
    held: list[tuple[np.ndarray, ...]] = []

    def told() -> tuple[np.ndarray, ...]:
        word, none, prot, pos = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((pos, prot, none, word))
        word = word[order]
        first = order[np.concatenate(([True], word[1:] != word[:-1]))] if len(order) else order
        return tuple(np.concatenate(c)[first] for c in zip(*held, strict=True))

    def rows(word, none, prot, pos) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(prot, mask=none), pa.array(pos.astype(np.int32))], names=["word", "prot_id", "pos"])

    for codes, row, place, _, batch in parts(batches, lf, part):
        word = packed(codes, lf)[0] >> BITS * (LETTERS - lf)
        own = (place > 0) & (word & 31 > 0)
        ids = batch.column("prot_id")
        none = np.asarray(ids.is_null())[row[own]]
        prot = ids.fill_null(0).to_numpy(zero_copy_only=False)[row[own]]
        held.append((word[own], none, prot, place[own]))
        if sum(len(h[0]) for h in held) >= 2 * most:
            held = [told()]
            if len(held[0][0]) >= most:
                yield rows(*held[0])
                held = []
    if held:
        yield rows(*told())


# --- entropy of the next residue -------------------------------------------------------------------------------------


def distinct_heads(batches: Iterator[pa.RecordBatch], longest: int, part: int = PART) -> Iterator[pa.RecordBatch]:
    """Words and n: the heads up to the first X, told apart and counted part by part."""
    for codes, _, place, _, _ in parts(batches, longest, part):
        codes = np.where(codes == X, 0, codes)
        own = (place > 0) & (codes > 0)
        words = [w[own] for w in packed(codes, longest)]
        order = np.lexsort(words[::-1])
        if len(order):
            words = [w[order] for w in words]
            new = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([w[1:] != w[:-1] for w in words]))))
            yield pa.RecordBatch.from_arrays([*[pa.array(w[new]) for w in words], pa.array(np.diff(new, append=len(order)))], names=[*names(longest), "n"])


def entropy_sums(batches: Iterator[pa.RecordBatch], longest: int, size: int = PART) -> Iterator[pa.RecordBatch]:
    """Of contexts inside a part, by lf: total, contexts, and sums of entropy and its square by total; of the first and the last
    one what follows them: lf, the words of the context, next, total."""
    cols, kinds = [*names(longest), "next", "total", "contexts", "e", "e2"], [*[pa.int64()] * (n_words(longest) + 3), pa.float64(), pa.float64()]
    for part in buffered(batches, size):
        words = [part[c] for c in names(longest)]
        letters = unpacked(words, longest)
        near, length, n = common(letters), (letters > 0).sum(0), part["n"]
        above = np.zeros(1, np.int64)
        for lf in range(1, longest + 1):
            starts = np.flatnonzero(near < lf)
            follow = np.where(length[starts] >= lf, np.add.reduceat(n, starts), 0)
            of = np.searchsorted(starts, above)
            total, logs = np.add.reduceat(follow, of), np.add.reduceat(follow * np.log2(np.maximum(follow, 1)), of)
            rows = []
            for k in {0, len(of) - 1}:
                for i in range(of[k], of[k + 1] if k + 1 < len(of) else len(starts)):
                    if follow[i]:
                        context = [int(w[starts[i]] & KEEP[min(max(lf - 1 - LETTERS * j, 0), LETTERS)]) for j, w in enumerate(words)]
                        rows.append((*context, int(letters[lf - 1, starts[i]]), int(follow[i]), None, None, None))
            total[[0, -1]] = 0
            t, s = total[total > 0], logs[total > 0]
            if len(t):
                e = np.log2(t) - s / t
                rows.append((*[None] * len(words), None, int(t.sum()), len(t), float((e * t).sum()), float((e * e * t).sum())))
            above = starts
            if rows:
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([lf] * len(rows), pa.int32()), *arrays], names=["lf", *cols])


@tidied
def conditional(prots: DataFrame, longest: int, part: int = PART) -> DataFrame:
    """lf, entropy (of the next residue given lf - 1, weighted by hits), variance, total, contexts for lf 1 to ``longest``;
    windows with X are left out."""
    keys = names(longest)
    longs = ", ".join(f"{c} long" for c in keys)
    heads = prots.select("seq").mapInArrow(lambda it: distinct_heads(it, longest, part), f"{longs}, n long")
    sums = in_order(heads, keys).mapInArrow(lambda it: entropy_sums(it, longest, part), f"lf int, {longs}, next long, total long, contexts long, e double, e2 double")
    sums = settle(sums, "entropy-sums")
    ends = sums.filter("next IS NOT NULL").groupBy("lf", *keys, "next").agg(F.sum("total").alias("n"))
    total = F.sum("n")
    ends = ends.groupBy("lf", *keys).agg(total.alias("total"), (F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("_e"))
    one, e, t = F.lit(1).cast("long"), F.col("_e"), F.col("total")
    all_ = sums.filter("next IS NULL").select("lf", "total", "contexts", "e", "e2").unionByName(ends.select("lf", "total", one.alias("contexts"), (e * t).alias("e"), (e * e * t).alias("e2")))
    s = all_.groupBy("lf").agg(*[F.sum(c).alias(c) for c in ("total", "contexts", "e", "e2")])
    mean = F.col("e") / F.col("total")
    return s.select("lf", mean.alias("entropy"), (F.col("e2") / F.col("total") - mean * mean).alias("variance"), "total", "contexts")


# --- maximal repeats of some lengths -------------------------------------------------------------------------------------

RUN = "lf int, frag string, org long, n long, squares long, lefts long, rights long, low_prot long, high_prot long, low long, high long"


def placed_heads(batches: Iterator[pa.RecordBatch], longest: int, least: int, part: int = PART) -> Iterator[pa.RecordBatch]:
    """Words, prot, org and at (place and letter before) of the heads of at least ``least`` letters without X."""
    for codes, row, place, left, batch in parts(batches, longest, part):
        ends = np.flatnonzero((codes == 0) | (codes == X))
        clear = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(codes))
        own = (place > 0) & (clear >= least)
        prot, org = (batch.column(c).to_numpy(zero_copy_only=False)[row[own]] for c in ("prot", "org"))
        at = place[own] << BITS | np.where(place[own] == 1, 0, left[own])
        yield pa.RecordBatch.from_arrays([*[pa.array(w[own]) for w in packed(codes, longest)], pa.array(prot), pa.array(org), pa.array(at)], names=[*names(longest), "prot", "org", "at"])


def several(bits: np.ndarray) -> np.ndarray:
    """Whether a set of letters holds more than one, or the end of a text."""
    return (bits & (bits - 1) != 0) | (bits & 1 != 0)


def repeat_runs(batches: Iterator[pa.RecordBatch], lengths: list[int], size: int = PART) -> Iterator[pa.RecordBatch]:
    """Runs of the lengths: the maximal repeats inside a part (org null, with the sum of squared hits by organism), and what
    stands in the first and last run of a part, by organism."""
    longest = max(lengths) + 1
    for part in buffered(batches, size):
        letters = unpacked([part[c] for c in names(longest)], longest)
        near, total = common(letters), letters.shape[1]
        stop = (letters == X) | (letters == 0)
        clear = np.where(stop.any(0), stop.argmax(0), longest)
        bits, place = np.int64(1) << (part["at"] & 31), part["at"] >> BITS
        for lf in lengths:
            starts = np.flatnonzero(near < lf)
            counts = np.diff(starts, append=total)
            valid, after = clear[starts] >= lf, np.int64(1) << letters[lf].astype(np.int64)
            fold = [np.bitwise_or.reduceat(bits, starts), np.bitwise_or.reduceat(after, starts)]
            edge = np.zeros(len(starts), bool)
            edge[[0, -1]] = True
            inner = valid & ~edge & (counts > 1) & several(fold[0]) & several(fold[1])
            low_prot, high_prot = np.minimum.reduceat(part["prot"], starts), np.maximum.reduceat(part["prot"], starts)
            low, high = np.minimum.reduceat(place, starts), np.maximum.reduceat(place, starts)
            inner &= (low_prot != high_prot) | (high - low >= lf)
            of = np.repeat(np.arange(len(starts)), counts)
            for group in (inner, valid & edge):
                rows = np.flatnonzero(group[of])
                if not len(rows):
                    continue
                own, org = of[rows], part["org"][rows]
                order = np.lexsort((org, own))
                own, org, rows = own[order], org[order], rows[order]
                new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (org[1:] != org[:-1]))))
                n = np.diff(new, append=len(own))
                if group is inner:
                    g = np.flatnonzero(inner)
                    squares = np.add.reduceat(n * n, np.searchsorted(own[new], g))
                    cols = [None, counts[g], squares, fold[0][g], fold[1][g], low_prot[g], high_prot[g], low[g], high[g]]
                else:
                    g = own[new]
                    at = [f.reduceat(v[rows], new) for f, v in ((np.bitwise_or, bits), (np.bitwise_or, after), (np.minimum, part["prot"]), (np.maximum, part["prot"]), (np.minimum, place), (np.maximum, place))]
                    cols = [org[new], n, n * n, *at]
                text = np.ascontiguousarray(ALPHABET[letters[:lf, starts[g]]].T).view(f"S{lf}").ravel().astype(f"U{lf}")
                arrays = [pa.array(np.full(len(g), lf, np.int32)), pa.array(text), *[pa.nulls(len(g), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in cols]]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in RUN.split(", ")])


@tidied
def maximal_repeats(base: DataFrame, lengths: list[int], part: int = PART) -> DataFrame:
    """lf, frag, hits, orthologs, paralogs of the substrings of the given lengths without X that occur more than once, two of
    whose occurrences don't overlap, and that nothing extends to the left or right; of a numbered ``suffix.corpus``."""
    longest = max(lengths) + 1
    keys = names(longest)
    orgs = cumulative(base.select(F.col("org").alias("_org")).distinct(), ["_org"], F.lit(1), "repeats-orgs", "number").select("_org", "number")
    prots = base.join(orgs, F.col("org").eqNullSafe(F.col("_org"))).select("prot", F.col("number").alias("org"), "seq")
    placed = prots.mapInArrow(lambda it: placed_heads(it, longest, min(lengths), part), f"{', '.join(f'{c} long' for c in keys)}, prot long, org long, at long")
    runs = settle(in_order(placed, keys, ("prot", "at")).mapInArrow(lambda it: repeat_runs(it, lengths, part), RUN), "repeats-runs")
    fold = [F.bit_or("lefts").alias("lefts"), F.bit_or("rights").alias("rights"), F.min("low_prot").alias("low_prot"), F.max("high_prot").alias("high_prot"), F.min("low").alias("low"), F.max("high").alias("high")]
    ends = runs.filter("org IS NOT NULL").groupBy("lf", "frag", "org").agg(F.sum("n").alias("n"), *fold)
    ends = ends.groupBy("lf", "frag").agg(F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("n").alias("n"), *fold)
    more = lambda c: F.expr(f"({c} & ({c} - 1)) <> 0 OR ({c} & 1) <> 0")
    ends = ends.filter((F.col("n") > 1) & more("lefts") & more("rights") & ((F.col("low_prot") != F.col("high_prot")) | (F.col("high") - F.col("low") >= F.col("lf"))))
    cols = ["lf", "frag", "n", "squares"]
    pairs = lambda c: F.floor(c / 2).cast("long")
    found = runs.filter("org IS NULL").select(cols).unionByName(ends.select(cols))
    return found.select("lf", "frag", F.col("n").alias("hits"), pairs(F.col("n") * F.col("n") - F.col("squares")).alias("orthologs"), pairs(F.col("squares") - F.col("n")).alias("paralogs"))
