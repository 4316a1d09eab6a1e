import random

from helpers import AWKWARD, frame

from residua.llm import line_dedup as op


def brute(docs, least):
    seen, out = set(), {}
    for i, t, *_ in sorted(docs):
        lines = [x.strip() for x in t.encode().split(b"\n")] if t else []
        gone = set()
        for a in range(len(lines)):
            n, e = 0, a
            while n < least and e < len(lines):
                n += len(lines[e].split())
                e += 1
            if n < least:
                break
            if tuple(lines[a:e]) in seen:
                gone |= set(range(a, e))
            seen.add(tuple(lines[a:e]))
        out[i] = (len(lines), sorted(gone))
    return out


def run(spark, docs, least):
    found = op.repeats(frame(spark, docs).repartition(4), least)
    return {r.doc_id: (r.n_lines, r.gone) for r in found.select("doc_id", "n_lines", op.deleted_lines(found["runs"]).alias("gone")).collect()}


def test_matches_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 6))) for _ in range(25)]
    docs = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    for least in (1, 4, 9):
        assert run(spark, docs, least) == brute(docs, least)
    assert run(spark, AWKWARD, 4) == brute(AWKWARD, 4)


def test_hot_line_and_text_without_it(spark):
    docs = [(i, f"own line number {i} of this text\nthe very same line in each of these documents\nend {i}") for i in range(300)]
    df = frame(spark, docs)
    found = op.repeats(df, 8)
    out = {r.doc_id: r.text for r in op.dedup_lines(df, found).collect()}
    assert out[0] == docs[0][1]
    assert all(out[i] == f"own line number {i} of this text\nend {i}" for i in range(1, 300))
    assert op.dedup_lines(df, found).columns == df.columns


def test_repeated_row_is_one_document_and_empty(spark):
    docs = [(1, "one two three four five\nsix"), (1, "one two three four five\nsix"), (2, None)]
    assert all(r.runs == [] for r in op.repeats(frame(spark, docs), 3).collect())
    assert op.repeats(frame(spark, []), 3).count() == 0


def test_every_window_has_a_fingerprint():
    rng = random.Random(7)
    text = "\n".join(" ".join("w" for _ in range(rng.randint(0, 4))) + f" {rng.randint(0, 9)}" for _ in range(200)).encode()
    n, wins = op.windows(text, 8)
    picked = {w["anchor"] for w in wins if w["opens"]}
    assert n == 200 and {w["anchor"] for w in wins} == picked


def test_blank_lines_take_linear_time():
    import time

    def took(n):
        t = time.process_time()
        found = op.windows(b"\n" * n + b"one two three four five six seven eight", 8)
        assert found[0] == n + 1 and len(found[1]) == n + 1
        return time.process_time() - t

    assert took(80_000) < 12 * took(10_000) + 0.2


def test_same_result_with_and_without_broadcast(spark):
    rng = random.Random(9)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 6))) for _ in range(25)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    found = op.repeats(frame(spark, docs), 4, max_broadcast_rows=0)
    assert {r.doc_id: (r.n_lines, r.gone) for r in found.select("doc_id", "n_lines", op.deleted_lines(found["runs"]).alias("gone")).collect()} == brute(docs, 4)


def test_ids_of_another_type(spark):
    docs = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), (None, "one two three four")], "doc_id string, text string")
    found = op.repeats(docs, 3)
    assert {r.doc_id: len(r.runs) for r in found.collect()} == {"a": 0, "b": 1, None: 1}
