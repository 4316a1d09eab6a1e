"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words and their beginnings of 4 and 5 bytes, in lower case, each hashed to one of ``2**BITS``
numbers.  Two kinds of terms are admitted to the machine: those whose presence goes with the label (a likelihood ratio
test), and those of pairs whose joint presence goes with it in a way that the two terms alone don't explain (a three-way
product moment over all pairs of the ``pair_terms`` most frequent terms of the sample).  Over them the machine learns a
weight for each term and, through factors, one for each pair, so that two terms which say nothing alone can be toxic, or
harmless, together.

What is fitted comes from a bounded sample, whose bounds are parameters: about ``fit_rows`` labelled documents of each
class, chosen by a hash of their id, ``max_terms`` terms of each kind.  The intercept is moved from the sample's share of
toxic rows to that of all labels.  Scoring covers every whole text; the model (2**BITS short numbers and a row a term) is
what gets broadcast.

Defined results: a null or empty text gets the score of a text without terms; of several labels of a document the largest
counts, a null label none; of rows that repeat an id, one is learned from; where one class is missing or no term is
admitted nothing is learned: every score is the share of toxic labels (0.0 without labels) and ``without_toxic`` keeps
every row; a score equal to the threshold is rejected; texts of any length are read whole; ids may be of any type; repeated
rows are scored each; an empty table gives an empty result; other columns are kept out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm.textbuf import bounds, chunks, prefix_sums, slice_hashes, trimmed, utf8

BITS = 20
HEADS = (4, 5)
#: Bytes of words: digits, letters and all bytes of longer characters.
IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
SCHEMA = "score double"


def terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges i, j of texts: the hashed terms, and for each the text (from 0) that it stands in."""
    data, at = utf8(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    for i, j in chunks(at):
        own, edges = data[at[i] : at[j]], at[i : j + 1] - at[i]
        starts, ends, counts = bounds(own, edges, IS_WORD)
        where = np.repeat(np.arange(j - i), counts)
        sums = prefix_sums(own)
        found, places = [slice_hashes(sums, starts, ends)], [where]
        for n in HEADS:
            longer = ends - starts > n
            found.append(slice_hashes(sums, starts[longer], starts[longer] + n) + np.uint64(n))
            places.append(where[longer])
        yield i, j, (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(places)


def term_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = []
        for i, j, h, where in terms(batch.column(1)):
            pairs = np.unique((where << BITS) | h)
            cut = np.searchsorted(pairs, np.arange(j - i + 1) << BITS)
            own = (pairs & ((1 << BITS) - 1)).astype(np.int32)
            sets += [own[cut[k] : cut[k + 1]] for k in range(j - i)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["toxic", "terms"])


def examples(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_id: str, label_col: str, fit_rows: int) -> tuple[list, float]:
    """(toxic, terms) of the sampled documents, in an order of their own, and the share of toxic labels."""
    known = labels.filter(learn & F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("label_id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    n = {r[0]: r[1] for r in known.groupBy("toxic").agg(F.count(F.lit(1))).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return [], share
    draw = F.pmod(F.xxhash64(F.lit("fit"), "label_id"), F.lit(1_000_000))
    limit = F.when(F.col("toxic") == 1, int(min(1.0, fit_rows / n[1]) * 1_000_000)).otherwise(int(min(1.0, fit_rows / n[0]) * 1_000_000))
    chosen = known.filter(draw < limit)  # about 2 * fit_rows ids, by the rates above
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("row_id") == F.col("label_id"))
    rows = rows.groupBy("row_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one of each id
    rows = rows.select("toxic", "text").mapInArrow(lambda it: trimmed(term_sets(it)), "toxic int, terms array<int>")
    found = [(r[0], np.array(r[1], np.int64)) for r in rows.toLocalIterator()]
    return sorted(found, key=lambda r: (r[0], len(r[1]), r[1].tobytes())), share


class Machine:
    """slot: the kept term's number for each hash, or -1; bias, weights and factors of the kept terms; learned: whether there
    was anything to learn."""

    def __init__(self, slot: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray, learned: bool = True):
        self.slot, self.bias, self.weights, self.factors, self.learned = slot, bias, weights, factors, learned

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for i, j, h, where in terms(texts):
            slot = self.slot[h]
            kept = np.flatnonzero(slot >= 0)
            n = len(self.weights)
            pairs = np.unique(where[kept] * n + slot[kept])
            doc, term = pairs // n, pairs % n
            z = self.bias + np.bincount(doc, weights=self.weights[term], minlength=j - i)
            for f in self.factors.T:
                z += 0.5 * (np.bincount(doc, weights=f[term], minlength=j - i) ** 2 - np.bincount(doc, weights=f[term] ** 2, minlength=j - i))
            out[i:j] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def select(rows: list, most: int, least: float = 12.0) -> np.ndarray:
    """The hashed terms that go with the label most, by 2 log of the likelihood ratio, at most ``most``."""
    size = 1 << BITS
    n1, n0 = sum(r[0] for r in rows), sum(1 - r[0] for r in rows)
    a = np.zeros(size)
    b = np.zeros(size)
    for toxic, own in rows:
        (a if toxic else b)[own] += 1
    total = n1 + n0

    def part(x, row, col):
        return np.where(x > 0, x * np.log(np.maximum(x, 1) * total / np.maximum(row * col, 1)), 0)

    c = a + b
    g = 2 * (part(a, n1, c) + part(b, n0, c) + part(n1 - a, n1, total - c) + part(n0 - b, n0, total - c))
    g[c < 3] = 0
    top = np.argsort(-g, kind="stable")[:most]
    return np.sort(top[g[top] >= least])


def select_pairs(rows: list, n_terms: int, most: int, least: float = 6.5, together: int = 8) -> np.ndarray:
    """The terms of pairs that go with the label beyond what each term does, at most ``most`` terms.

    For terms x, x' and label y, all less their means, the sum of x x' y over the rows is about normal where the three are
    independent; pairs at ``least`` deviations or more with ``together`` rows in common or more count, strongest first.
    All pairs of the ``n_terms`` most frequent terms are tested, some columns at a time."""
    count = np.zeros(1 << BITS, np.int64)
    for _, own in rows:
        count[own] += 1
    top = np.argsort(-count, kind="stable")[:n_terms]
    top = np.sort(top[(count[top] >= together) & (count[top] <= len(rows) - together)])
    if len(top) < 2:
        return np.zeros(0, np.int64)
    slot = np.full(1 << BITS, -1, np.int32)
    slot[top] = np.arange(len(top))
    x = np.zeros((len(rows), len(top)), np.float32)
    for i, (_, own) in enumerate(rows):
        k = slot[own]
        x[i, k[k >= 0]] = 1
    y = np.array([r[0] for r in rows], np.float32)
    y -= y.mean()
    p = x.mean(axis=0)
    spread = np.sqrt(p * (1 - p))
    best = np.zeros(len(top))
    weighted = (x - p) * y[:, None]
    for s in range(0, len(top), 512):
        own = slice(s, s + 512)
        z = np.abs((x[:, own] - p[own]).T @ weighted) / (spread[own, None] * spread[None, :] * np.sqrt((y * y).sum()))
        z[x[:, own].T @ x < together] = 0
        z[np.arange(z.shape[0]), s + np.arange(z.shape[0])] = 0
        best[own] = z.max(axis=1)
    order = np.argsort(-best, kind="stable")[:most]
    return np.sort(top[order[best[order] >= least]])


def train(rows: list, share: float, rank: int = 4, steps: int = 2500, batch: int = 256, rate: float = 0.03, decay: float = 2e-5, pair_decay: float = 5e-3, seed: int = 11, max_terms: int = 1024, pair_terms: int = 2048) -> Machine:
    """Logistic loss, Adam steps.  The weights learn alone for the first half, so that the factors, which decay faster,
    take up only what single terms can't say."""
    prior = min(max(share, 0.0), 1.0)
    both = len({r[0] for r in rows}) == 2
    kept = np.union1d(select(rows, max_terms), select_pairs(rows, pair_terms, max_terms)) if both else np.zeros(0, np.int64)
    if not len(kept):
        bias = float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
        return Machine(np.full(1 << BITS, -1, np.int16), bias, np.zeros(1), np.zeros((1, rank)), learned=False)
    slot = np.full(1 << BITS, -1, np.int16)
    slot[kept] = np.arange(len(kept))
    x = np.zeros((len(rows), max(1, len(kept))), np.float32)
    for i, (_, own) in enumerate(rows):
        k = slot[own]
        x[i, k[k >= 0]] = 1
    y = np.array([r[0] for r in rows], np.float32)
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(x.shape[1], np.float32), rng.normal(0, 0.01, (x.shape[1], rank)).astype(np.float32), np.zeros(1, np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, v, bias)]
    order = np.zeros(0, int)
    for step in range(1, steps + 1):
        if len(order) < batch:  # an epoch's rest goes before the next epoch's rows
            order = np.concatenate((order, rng.permutation(len(y))))
        own, order = order[:batch], order[batch:]
        xb = x[own]
        sums = xb @ v
        z = bias[0] + xb @ w + 0.5 * ((sums**2).sum(1) - (xb @ (v**2)).sum(1))
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y[own]).astype(np.float32) / len(own)
        grads = (xb.T @ d + decay * w, xb.T @ (d[:, None] * sums) - v * (xb.T @ d)[:, None] + pair_decay * v, np.array([d.sum()], np.float32))
        for p, g, (m1, m2) in zip((w, v, bias), grads, moments, strict=True):
            if p is v and step <= steps // 2:
                continue
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    sampled = float(y.mean())
    shift = np.log(prior / (1 - prior)) - np.log(sampled / (1 - sampled)) if 0 < prior < 1 else 0.0
    return Machine(slot, float(bias[0] + shift), w.astype(np.float64), v.astype(np.float64))


def scored(batches: Iterator[pa.RecordBatch], machine) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.value.scores(batch.column(1)), pa.float64())], names=["doc_id", "score"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", fit_rows: int = 3000, max_terms: int = 1024, pair_terms: int = 2048) -> Machine:
    """A machine learned from the labels for which ``learn`` holds."""
    rows, share = examples(docs, labels, learn, id_col, text_col, label_id, label_col, fit_rows)
    return train(rows, share, max_terms=max_terms, pair_terms=pair_terms)


def toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(lambda it: trimmed(scored(it, shared)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def rejected(batches: Iterator[pa.RecordBatch], machine, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(machine.value.scores(batch.column(at)) < threshold))


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold; all of them where nothing was learned."""
    if not machine.learned:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: trimmed(rejected(it, shared, at, threshold)), docs.schema)
