"""Small documents with every awkward case, and extra columns whose names clash with the operators' own."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, taken string, Shard int, keep_id string, component_id string, spans string"


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *(None,) * (4 - len(r))) for r in rows]
    return spark.createDataFrame([(i, t, la, so, len(t) if t is not None else None, "x", 1, "k", "c", "s") for i, t, la, so in full], SCHEMA)


AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n", None, "b"),
    (5, "word", "de", "b"),
    (6, "é 日本 😀 " * 3, "fr", None),
    (7, "long " * 60_000, "en", "a"),
    (8, "x" * 100_000, "en", "c"),
    (9, "the quick brown fox jumps over the lazy dog and runs far away from here", "en", "a"),
    (10, "The  quick brown fox jumps over the lazy dog and runs far away from here\n", "en", "b"),
    (11, "no\x00 control \x1f chars \x7f here at all, just bytes", "es", "c"),
    (12, "l1 l1 l1 l1\n" * 50, "en", "b"),
]
NO_ID = [(None, "row without an id and some more words to go on with here"), (None, None)]
