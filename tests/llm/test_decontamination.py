import random
import re

from helpers import AWKWARD, frame

from residua.llm import decontamination as op

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(docs, items, n):
    split = lambda t: re.findall(WORD, (t or "").translate(LOW))
    out = []
    for i, t, *_ in docs:
        w = split(t)
        hit, ids = set(), set()
        for k, x in items:
            iw = split(x)
            for win in [iw[j : j + n] for j in range(max(1, len(iw) - n + 1))] if iw else []:
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit.update(range(a, a + len(win)))
                        ids.add(str(k))
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out)


def run(spark, docs, items, **how):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in op.contamination(frame(spark, docs), bench, **how).collect())


def test_matches_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(["a", "B", "ab", "é", "日本", "1", "The"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 4, 6, 12]))) for i in range(25)] + [(90, None), (91, "..."), (92, "same one here"), (93, "same one here")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(150)] + [(300, "x same ONE... here same one here"), *[(400 + r[0], r[1]) for r in AWKWARD]]
    assert run(spark, docs, items, window=3) == brute(docs, items, 3)


def test_parts_change_nothing(spark):
    items = [(i, f"alpha beta {i} gamma delta {i % 3} tail") for i in range(30)]
    docs = [(i, f"start alpha beta {i} gamma delta {i % 3} tail end") for i in range(40)]
    want = brute(docs, items, 4)
    assert run(spark, docs, items, window=4) == want
    assert run(spark, docs, items, window=4, max_pattern_chars=50) == want


def test_spans_are_code_points_of_the_text(spark):
    docs = [(1, "é😀 One, TWO\nthree! four")]
    bench = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    (r,) = op.contamination(frame(spark, docs), bench).collect()
    assert [docs[0][1][s.start : s.end] for s in r.spans] == ["One, TWO\nthree"]


def test_filter_keeps_columns_and_clean_rows(spark):
    bench = spark.createDataFrame([(7, "the lazy dog and runs far away from here")], "item_id long, text string")
    docs = frame(spark, AWKWARD)
    out = op.without_contaminated(docs, bench)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 4, 5, 6, 7, 8, 11, 12]
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.without_contaminated(docs, none).count() == len(AWKWARD)
    assert op.contamination(frame(spark, []), bench).count() == 0


def test_repetitive_texts_and_every_window_length(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("aab") for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 4, 5, 6, 9, 10, 11, 23, 40])]
    docs = [(i, text(rng.randint(0, 80))) for i in range(60)] + [(100, "a " * 3000)]
    for window in (1, 2, 5, 10):
        assert run(spark, docs[:60], items, window=window) == brute(docs[:60], items, window)
        assert run(spark, docs[:60], items, window=window, max_pattern_chars=30) == brute(docs[:60], items, window)
    assert run(spark, docs[60:], [(7, "a " * 2000)], window=10) == [(100, 3000, 3000, ["7"])]


def test_a_large_benchmark_is_one_part():
    import time

    rng = random.Random(12)
    words = [f"w{i:05d}" for i in range(20_000)]
    items = [(str(i), " ".join(rng.choice(words) for _ in range(500))) for i in range(600)]  # 2 MB
    (part,) = op.parts(iter(items), 10, 50_000_000)
    assert len(part.patterns) <= sum(len(t.split()) for _, t in items) // 5 + 1  # as large as the items, not ten times that
    import pyarrow as pa

    docs = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(2000)] + [items[5][1]]
    op.automaton(part)
    began = time.process_time()
    (found,) = list(op.scanned(pa.array(docs[-300:]), part))
    assert time.process_time() - began < 5
    assert list(found[3]) == [299] and len(found[3][299]) == 500 and found[4][299] == {"5"}
