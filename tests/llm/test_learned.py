"""Language identification and toxicity: held-out accuracy and defined results."""

import random

from helpers import AWKWARD, SCHEMA, frame
from pyspark.sql import functions as F

from residua.llm import language_id, toxicity

WORDS = {"en": "the of and that with from house water light green", "de": "der die und nicht über häuser wasser grün schön zeit", "fr": "le des une avec être maison eau lumière forêt très", "es": "el los una con niño agua señor verde años más"}


def documents(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(4, 120))), lang, "s"))
    return out


def test_language_held_out(spark):
    rows = documents(600, 1) + [(1000 + r[0], *r[1:]) for r in AWKWARD]
    docs = frame(spark, rows)
    model = language_id.fit(docs, F.col("doc_id") % 3 != 1)
    out = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert len(out) == len(rows)
    held = [r for r in documents(600, 1) if r[0] % 3 == 1]
    assert sum(out[i].lang_pred == lang for i, _, lang, _ in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())
    for i in (2, 3, 4):
        assert out[1000 + i].lang_pred == "und" and out[1000 + i].rejected
    again = language_id.identify(docs.repartition(4), language_id.fit(docs.repartition(4), F.col("doc_id") % 3 != 1))
    assert {r.doc_id: r.lang_pred for r in again.collect()} == {i: r.lang_pred for i, r in out.items()}


def test_language_without_anything_to_learn(spark):
    docs = frame(spark, [(1, "some text"), (2, None)])
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(docs, F.lit(True))).collect()} == {"und"}
    empty = frame(spark, [])
    assert language_id.identify(empty, language_id.fit(empty, F.lit(True))).count() == 0


def test_toxicity_held_out_and_pairs(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(["tree", "house", "walk", "river", "cloud", "stone", "bread"]) for _ in range(rng.randint(5, 40))]
        kind = rng.random()
        toxic = 0
        if kind < 0.12:  # one word is enough
            w[rng.randrange(len(w))], toxic = "Scum!!", 1
        elif kind < 0.3:  # only both together are
            w[0], w[-1], toxic = "bad", "folk", 1
        elif kind < 0.45:
            w[0] = "bad"
        elif kind < 0.6:
            w[0] = "folk"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    docs, lab = frame(spark, rows), spark.createDataFrame([*labels, (5000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    machine = toxicity.fit(docs, lab, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, machine).collect()}
    held = [(i, t) for i, _, t in labels if i % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(t) for i, t in held) >= 0.97 * len(held)
    kept = toxicity.without_toxic(docs, machine)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    awkward = {r.doc_id: r.score for r in toxicity.toxicity(frame(spark, AWKWARD), machine).collect()}
    assert len(awkward) == len(AWKWARD) and awkward[2] == awkward[3] and all(0 <= s <= 1 for s in awkward.values())


def test_toxicity_without_labels_or_rows(spark):
    docs = frame(spark, AWKWARD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    machine = toxicity.fit(docs, none, F.lit(True))
    assert all(r.score < 1e-6 for r in toxicity.toxicity(docs, machine).collect())
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), machine).count() == 0


def test_language_memory_is_free_of_length_and_languages():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    few = language_id.Model([f"l{k}" for k in range(4)], rng.normal(size=(1 << language_id.BITS, 8)), rng.normal(size=(8, 4)), np.zeros(4))
    many = language_id.Model([f"l{k}" for k in range(300)], rng.normal(size=(1 << language_id.BITS, 8)), rng.normal(size=(8, 300)), np.zeros(300))
    assert few.table.shape[1] == 4 and many.table.shape[1] == 8
    texts = ["", "ab", "one two", "Über das Haus 12 é", "word " * 200_000, "x", "yz " * 90_000, None]
    for m in (few, many):
        whole = m.logits(pa.array(texts, pa.string()))
        piece, language_id.PIECE = language_id.PIECE, 37
        try:
            np.testing.assert_allclose(m.logits(pa.array(texts[:4] + texts[5:6], pa.string())), whole[[0, 1, 2, 3, 5]], atol=1e-9)
        finally:
            language_id.PIECE = piece
        full = m.table if m.layer is None else m.table @ m.layer
        for text, got in zip(texts, whole, strict=True):  # brute force, gram by gram
            if text is None or len(text) > 100:
                continue
            data, _ = language_id.padded(pa.array([text]))
            grams = [h for k in range(len(data) - 3) if not (data[k + 1] == data[k + 2] == 32) for h in language_id.buckets(data[k : k + 4])[:, 0]]
            np.testing.assert_allclose(got, full[grams].mean(axis=0) + m.bias if grams else m.bias, atol=1e-9)


def test_language_calibration_and_rejection(spark):
    rng = random.Random(4)
    mixed = []  # half of the words of any language: what is predicted is often wrong, and must say so
    for i in range(1200):
        lang = rng.choice(list(WORDS))
        other = " ".join(WORDS.values()).split()
        mixed.append((i, " ".join(rng.choice(WORDS[lang].split() if rng.random() < 0.45 else other) for _ in range(rng.randint(3, 12))), lang, "s"))
    docs = frame(spark, mixed)
    model = language_id.fit(docs, F.col("doc_id") % 3 != 1)
    out = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    held = [(out[i], lang) for i, _, lang, _ in mixed if i % 3 == 1]
    right = sum(r.lang_pred == lang for r, lang in held) / len(held)
    assert right < 0.97 and abs(sum(r.score for r, _ in held) / len(held) - right) < 0.08  # confidence is the rate of right answers
    kept = [(r, lang) for r, lang in held if not r.rejected]
    assert 0 < len(kept) < len(held) and sum(r.lang_pred == lang for r, lang in kept) / len(kept) > max(0.95, right)
    strange = language_id.identify(frame(spark, [(1, "zzkqx wvvkj qqxzz kkvwq")]), model).collect()
    assert strange[0].rejected


def test_toxicity_of_pairs_that_single_terms_say_nothing_about(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(3000):
        w = [rng.choice(["tree", "house", "walk", "river", "cloud", "stone", "bread"]) for _ in range(rng.randint(5, 30))]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w += ["alpha"] * a + ["omega"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(a == b)))  # both or neither
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.fit(docs, lab, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, machine).collect()}
    held = [(i, t) for i, _, t in labels if i % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(t) for i, t in held) >= 0.95 * len(held)


def test_nothing_learned_keeps_every_row(spark):
    docs = frame(spark, AWKWARD)
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 1)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels, F.lit(True))
    assert not machine.learned and toxicity.without_toxic(docs, machine).count() == len(AWKWARD)


def test_ids_of_another_type_and_repeated_ids(spark):
    docs = spark.createDataFrame([("a", "scum here", "en"), ("a", "other text", "en"), (None, "x", "de")], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, toxic int")
    assert toxicity.toxicity(docs, toxicity.fit(docs, labels, F.lit(True))).count() == 3
    assert language_id.identify(docs, language_id.fit(docs, F.lit(True))).count() == 3
