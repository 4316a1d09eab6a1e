import hashlib
import random
import re

from helpers import AWKWARD, frame

from residua.llm import exact_dedup as op


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    return sorted((i, min(groups[norm(t)])[1], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows)


def decided(df, **how):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in op.decisions(df, **how).collect())


def test_matches_brute_force(spark):
    assert decided(frame(spark, AWKWARD)) == brute(AWKWARD)
    rng = random.Random(3)
    rows = [(i, rng.choice(["", " ", "a b", "ab", "a\tb", "abc", "é", "E" * rng.randint(1, 9)])) for i in range(400)]
    assert decided(frame(spark, rows)) == brute(rows)


def test_small_filter_and_no_broadcast_change_nothing(spark):
    rows = [(i, f"text {i % 150}") for i in range(300)]
    df = frame(spark, rows)
    want = brute(rows)
    assert decided(df, bits_per_row=1) == want
    assert decided(df, max_broadcast_bytes=0) == want


def test_ranges_of_hashes_change_nothing(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i % 150}") for i in range(300)] + [(500, None), (None, "text 1")]
    df = frame(spark, rows)
    narrow = op.marked(op.keys(df), "text_sha256", 302, 512, 4096)
    assert sum(not r.may_repeat for r in narrow.collect()) >= 1
    as_rows = lambda **how: sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in op.decisions(df, **how).collect()), key=str)
    assert as_rows(bits_per_row=512, max_broadcast_bytes=0) == as_rows()


def test_hot_group_and_repeated_rows(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"own {i}") for i in range(600)] + [(700, "twice"), (700, "twice")]
    df = frame(spark, rows).repartition(5)
    out = op.decisions(df).collect()
    assert sum(r.kept for r in out) == len({re.sub(r"\s", "", t) for _, t in rows})
    kept = op.exact_dedup(df)
    assert kept.columns == df.columns
    assert kept.count() == len({t for _, t in rows})
    assert sum(r.kept for r in out if r.doc_id == 700) == 1


def test_empty(spark):
    assert op.decisions(frame(spark, [])).count() == 0
    assert op.exact_dedup(frame(spark, [])).count() == 0
