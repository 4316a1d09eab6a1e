"""Language identification by averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text in lower case, anything but letters made a space, is the mean of the embeddings of its byte 3-grams and 4-grams,
each hashed to one of ``2**BITS`` rows.  A linear layer and a softmax follow.  Embeddings and layer are trained together on
segments of labelled documents; then a temperature is fitted on documents held back from training, and the lowest
confidence at which accepted answers are right at the asked rate there becomes the rejection threshold.

What is fitted comes from a bounded sample, whose bounds are parameters: the ``max_languages`` most frequent languages,
about ``fit_rows`` documents of each, chosen by a hash of id and text (equal rows count once), up to ``most_segments``
pieces of SEGMENT characters from all over each.  Prediction covers every whole text of every document.  Embeddings and
layer are broadcast; the sum of a text's embeddings is taken over pieces of the buffer of a fixed size, so memory depends
neither on the number of languages nor, beyond a few copies of the text itself, on its length.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for all texts where nothing was
learned; ties go to the first language by name; texts of any length are read whole; ids may be of any type; repeated rows
are answered each; an empty table gives an empty result; other columns are kept out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm.textbuf import trimmed, utf8

BITS = 15
SEGMENT = 240
PIECE = 1 << 18
#: Letters stay, by byte: a-z and all bytes of longer characters.
AS_SPACE = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
SCHEMA = "lang_pred string, score double, rejected boolean"


def buckets(data: np.ndarray) -> np.ndarray:
    """Two rows, for 3-grams and 4-grams: the hash of the one that starts at each byte but the last three."""
    d = data.astype(np.uint32)
    three = d[:-3] | (d[1:-2] << np.uint32(8)) | (d[2:-1] << np.uint32(16))
    four = three | (d[3:] << np.uint32(24))
    shift = np.uint32(32 - BITS)
    return np.stack([((three ^ np.uint32(0x5BD1E995)) * np.uint32(2654435761)) >> shift, (four * np.uint32(2246822519)) >> shift]).astype(np.int32)


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of each text between spaces, as one buffer with offsets."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    data, at = utf8(pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("  ", lower, "  ", ""))))
    return AS_SPACE[data], at


def segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Up to ``most`` pieces of each text, spread over all of it."""
    for batch in batches:
        ids, langs, out = [], [], []
        for key, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if not text:
                continue
            n = max(1, min(most, len(text) // SEGMENT))
            step = max(1, (len(text) - SEGMENT) // max(1, n - 1)) if n > 1 else 0
            for k in range(n):
                ids.append(key)
                langs.append(lang)
                out.append(text[k * step : k * step + SEGMENT])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(out, pa.string())], names=["part", "lang", "text"])


def examples(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fit_rows: int, most: int, max_languages: int) -> list:
    """(part, lang, segment): part is a hash of the document, by which whole documents are held back."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(F.col(lang_col).cast("string")).agg(F.count(F.lit(1))).orderBy(F.desc("count(1)"), lang_col).limit(max_languages).collect()}
    if not counts:
        return []
    own = F.xxhash64(F.lit("fit"), F.col(id_col), F.col(text_col))
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, fit_rows / n) * 1_000_000))])
    lang = F.col(lang_col).cast("string")
    chosen = known.filter(F.pmod(own, F.lit(1_000_000)) < rate[lang]).select(F.pmod(F.xxhash64(F.lit("part"), own), F.lit(1 << 40)).alias("part"), lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = chosen.dropDuplicates(["part", "lang"]).mapInArrow(lambda it: trimmed(segments(it, most)), "part long, lang string, text string")
    return sorted(tuple(r) for r in rows.collect())


class Model:
    """Languages, the embedding of each hash, the linear layer, the temperature and the rejection threshold.

    Where there are fewer languages than dimensions, embedding and layer are multiplied once beforehand."""

    def __init__(self, langs: list[str], embedding: np.ndarray, layer: np.ndarray, bias: np.ndarray, temperature: float = 1.0, reject: float = 0.0):
        self.langs, self.bias, self.temperature, self.reject = langs, bias, temperature, reject
        few = len(langs) <= embedding.shape[1]
        self.table, self.layer = (embedding @ layer, None) if few else (embedding, layer)

    def logits(self, texts: pa.Array) -> np.ndarray:
        data, at = padded(texts)
        total, weight = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts))
        last = at[1:] - 4  # where a text's last gram starts: every text has four spaces
        for p in range(int(at[0]), int(at[-1]) - 3, PIECE):
            own = data[p : min(p + PIECE + 3, int(at[-1]))]
            i = int(np.searchsorted(at, p, side="right")) - 1
            j = int(np.searchsorted(at, p + len(own) - 3))  # texts i to j have grams that start in this piece
            begins = np.maximum(at[i:j] - p, 0)
            inside = np.ones(len(own) - 3)
            for gap in range(1, 4):  # grams that would reach into the next text
                out = last[i:j] + gap - p
                inside[out[(out >= 0) & (out < len(inside))]] = 0
            h = buckets(own)
            # a gram of spaces alone says nothing
            inside = inside * (own[1:-2] + own[2:-1].astype(np.int32) != 64)
            weight[i:j] += np.add.reduceat(inside, begins)
            total[i:j] += np.add.reduceat((self.table[h[0]] + self.table[h[1]]) * inside[:, None], begins, axis=0)
        mean = total / np.maximum(2 * weight, 1)[:, None]
        return (mean if self.layer is None else mean @ self.layer) + self.bias

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list, dims: int = 8, epochs: int = 3, rate: float = 8.0, batch: int = 64, seed: int = 7, precision: float = 0.99) -> Model | None:
    """Fit on four fifths of the documents, calibrate on the rest (on all where that leaves none)."""
    langs = sorted({r[1] for r in rows})
    if not langs:
        return None
    index = {x: k for k, x in enumerate(langs)}
    y = np.array([index[r[1]] for r in rows])
    held = np.array([r[0] % 5 == 0 for r in rows])
    if held.all() or not held.any():
        held[:] = False
    rng = np.random.default_rng(seed)
    data, at = padded(pa.array([r[2] for r in rows], pa.string()))
    grams = []
    for i in range(len(rows)):
        own = data[at[i] : at[i + 1]]
        grams.append(buckets(own)[:, own[1:-2] + own[2:-1].astype(np.int32) != 64].ravel() if (own != 32).any() else np.zeros(0, np.int32))
    e = rng.normal(0, 0.1, (1 << BITS, dims))
    w, b = np.zeros((dims, len(langs))), np.zeros(len(langs))
    usable = np.array([i for i in np.flatnonzero(~held) if len(grams[i])], int)
    w += rng.normal(0, 0.1, w.shape)
    steps, done = max(1, epochs * -(-len(usable) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(usable)
        for s in range(0, len(order), batch):
            own = order[s : s + batch]
            lr = rate * (1 - done / steps)
            done += 1
            n = np.array([len(grams[i]) for i in own])
            flat = np.concatenate([grams[i] for i in own])
            x = np.add.reduceat(e[flat], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0) / n[:, None]
            delta = softmax(x @ w + b)
            delta[np.arange(len(own)), y[own]] -= 1
            delta /= len(own)
            back = np.repeat(delta @ w.T / n[:, None], n, axis=0)
            w -= lr * (x.T @ delta)
            b -= 0.1 * lr * delta.sum(axis=0)
            for d in range(dims):  # the sum of all gradients of a row, dense by hash
                e[:, d] -= lr * 8 * np.bincount(flat, weights=back[:, d], minlength=1 << BITS)
    model = Model(langs, e, w, b)
    check = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    logits = model.logits(pa.array([rows[i][2] for i in check], pa.string()))
    truth = y[check]
    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()))
    p = softmax(logits / model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision)
    model.reject = float(top[order[good[-1]]]) if len(good) and good[-1] + 1 < len(order) else 0.0
    return model


def predicted(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        texts = batch.column(1)
        lettered = [t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()]
        if m is None:
            lang, score, rejected = ["und"] * len(lettered), [0.0] * len(lettered), [True] * len(lettered)
        else:
            p = m.probabilities(texts)
            best, top = p.argmax(axis=1), p.max(axis=1)
            lang = [m.langs[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)]
            score = [min(1.0, float(s)) if ok else 0.0 for s, ok in zip(top, lettered, strict=True)]
            rejected = [not ok or s < m.reject for s, ok in zip(score, lettered, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 800, most_segments: int = 4, max_languages: int = 500) -> Model | None:
    """A model of the rows of ``docs`` for which ``learn`` holds."""
    return train(examples(docs.filter(learn), id_col, text_col, lang_col, fit_rows, most_segments, max_languages))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability), rejected (score below the threshold) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(lambda it: trimmed(predicted(it, shared)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
